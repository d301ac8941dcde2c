"""History of a key up to, not including, the moment of a row, without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.recovery import cut_lineage
from .ordering import ordered_totals

__all__ = ["salted_lookup", "prior_totals", "prior_rates", "answered_totals", "answered_rates"]


MAX_HOT_KEYS = 10_000   # keys that may be hot, so that their list can be broadcast


def salted_lookup(rows: DataFrame, table: DataFrame, keys: list[str], row_id: str, part_rows: int = 100_000) -> DataFrame:
    """Left join of ``rows`` to a table that is unique in ``keys``, with hot keys spread out.

    A key with more rows than ``part_rows`` (or than 1/10,000 of the rows, so that there are at most 10,000 such keys) is
    split into as many parts of that size as it has: its rows get a salt from a hash of the row id, and its table row is
    copied once per part.
    """
    limit = max(part_rows, -(-rows.count() // MAX_HOT_KEYS))
    over = F.col("_n") > limit
    # a key is hot only if its first column's value is: counts of all the columns are needed for those values alone
    first = F.broadcast(rows.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("_n")).where(over).select(keys[0]))
    counts = rows.join(first, keys[0], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(counts.where(over).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    salt = F.coalesce(F.pmod(F.xxhash64(row_id), F.col("_parts")), F.lit(0)).cast("int")
    left = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_parts")
    copies = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    right = table.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_parts")
    return left.join(right, keys + ["_salt"], "left").drop("_salt")


def prior_totals(rows: DataFrame, keys: list[str], ts: str, sums: list[str]) -> DataFrame:
    """(keys, ts, <sum>_prior): totals over strictly earlier seconds, one row per key and second.

    Seconds are added up first and stored, then months; a window sees one month of seconds of a key (at most
    2,678,400 rows) or the months of a key, never a key's raw rows.
    """
    sec = cut_lineage(rows.groupBy(*keys, ts).agg(*[F.sum(c).alias(c) for c in sums])).withColumn("_month", F.trunc(ts, "MM"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    months = sec.groupBy(*keys, "_month").agg(*[F.sum(c).alias(c) for c in sums])
    by_month = before(Window.partitionBy(*keys).orderBy("_month"))
    months = months.select(*keys, "_month", *[F.coalesce(F.sum(c).over(by_month), F.lit(0)).alias(f"_m_{c}") for c in sums])
    in_month = before(Window.partitionBy(*keys, "_month").orderBy(ts))
    out = sec.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(in_month), F.lit(0)) for c in sums})
    return out.join(months, keys + ["_month"]).select(
        *keys, ts, *[(F.col(f"_i_{c}") + F.col(f"_m_{c}")).alias(f"{c}_prior") for c in sums])


def prior_rates(pairs: DataFrame, key: str, order_id: str, ts: str, bad: str, prefix: str) -> DataFrame:
    """Prior order count and prior bad rate per order over its (distinct) keys.

    ``pairs`` has one row per order and key. Only purchase order decides what is earlier: the
    review of a prior order may not have been written yet at that moment.
    """
    hist = prior_totals(pairs.withColumns({"_n": F.lit(1), "_b": F.col(bad).cast("long")}), [key], ts, ["_n", "_b"])
    j = salted_lookup(pairs.select(order_id, key, ts), hist, [key, ts], order_id)
    g = j.groupBy(order_id).agg(F.sum("_n_prior").alias(f"{prefix}_hist_cnt"), F.sum("_b_prior").alias("_b"))
    return g.withColumn(f"{prefix}_hist_bad_rate",
                        F.try_divide(F.col("_b").cast("double"), F.col(f"{prefix}_hist_cnt"))).drop("_b")


def _second(ts: str):
    """Seconds of a timestamp without a zone, as a number that orders them."""
    c = F.col(ts)
    return (F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c))).cast("double")


def answered_totals(asked: DataFrame, answered: DataFrame, key: str, asked_ts: str, answered_ts: str, sums: list[str]) -> DataFrame:
    """(key, second, <sum>_prior) for each key and second of ``asked``: totals of the rows of ``answered`` whose own time lies
    strictly before it.

    Both kinds of event are put in one time order, added up by key and second. The order is cut into ranges of time with
    offsets per key, so the events of a hot seller spread over tasks; no window holds a seller. Rows without a key or a
    time take no part.
    """
    zero = [F.lit(0).cast("long").alias(c) for c in sums]
    events = (answered.select(key, _second(answered_ts).alias("second"), F.lit(0).alias("_asks"), *[F.col(c).cast("long").alias(c) for c in sums])
              .unionByName(asked.select(key, _second(asked_ts).alias("second"), F.lit(1).alias("_asks"), *zero)))
    events = events.where(F.col(key).isNotNull() & F.col("second").isNotNull())
    seconds = events.groupBy(key, "second").agg(F.max("_asks").alias("_asks"), *[F.sum(c).alias(c) for c in sums])
    placed = ordered_totals(seconds, "second", {c: F.col(c) for c in sums}, [key])
    return placed.where("_asks = 1").select(key, "second", *[F.col(f"{c}_before").cast("long").alias(f"{c}_prior") for c in sums])


def answered_rates(pairs: DataFrame, key: str, order_id: str, ts: str, answered_ts: str, bad: str, prefix: str) -> DataFrame:
    """prior_rates as they could be known at the purchase: an earlier order's review counts only if it was answered before.

    ``pairs`` has one row per order and key; a review without an answer time never counts.
    """
    marked = pairs.withColumns({"_n": F.lit(1), "_b": F.col(bad).cast("long")})
    hist = answered_totals(pairs, marked, key, ts, answered_ts, ["_n", "_b"])
    j = salted_lookup(pairs.select(order_id, key, _second(ts).alias("second")), hist, [key, "second"], order_id)
    g = j.groupBy(order_id).agg(F.coalesce(F.sum("_n_prior"), F.lit(0)).alias(f"{prefix}_hist_cnt"), F.sum("_b_prior").alias("_b"))
    return g.withColumn(f"{prefix}_hist_bad_rate", F.try_divide(F.col("_b").cast("double"), F.col(f"{prefix}_hist_cnt"))).drop("_b")
