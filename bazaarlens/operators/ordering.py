"""Global order without a single-partition window.

A window that has no partition key moves every row to one task. Here the ordered column is
cut into value ranges first (approximate quantiles, a bounded list on the driver), totals
per range give each range its offset, and the window runs inside a range. A value that
covers more than one range (a heavy tie) is split further by a hash of the tie-breaking
id, so no range outgrows the others. Ranges are plain data, hence stable under retries.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import HASH_SPACE, hash60
from ..sources.recovery import cut_lineage

__all__ = ["value_ranges", "place", "ordered_totals", "midranks", "ranked", "ntile",
           "quantiles"]

RANGE_ROWS = 1_000_000  # rows that one window task sorts


def _range_count(df: DataFrame) -> int:
    """As many ranges as the rows need, and at least one for each shuffle partition."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-df.count() // RANGE_ROWS))


def value_ranges(df: DataFrame, value: str, ranges: int | None = None) -> list[float]:
    """Range bounds with repeats: a repeated bound marks a heavy value."""
    n = ranges or _range_count(df)
    row = df.agg(F.percentile_approx(F.col(value).cast("double"),
                                     [i / n for i in range(1, n)], max(10_000, 20 * n))).first()
    return sorted(float(x) for x in (row[0] or []))


def place(df: DataFrame, value: str, bounds: list[float], tie: Column | None) -> DataFrame:
    """Add ``_range``, increasing with (value, tie hash), and ``_tie``."""
    cuts = sorted(set(bounds))
    weight = [bounds.count(c) for c in cuts]
    parts = [w if w > 1 and tie is not None else 0 for w in weight]
    # rows below the first cut live in cell 0; range i (1-based) covers [cuts[i-1], cuts[i])
    at = 1
    heavy_at, rest_at = [], []
    for p in parts:
        heavy_at.append(at)
        rest_at.append(at + p)
        at += p + 1
    out = df.withColumn("_v", F.col(value).cast("double"))
    if not cuts:
        out = out.withColumn("_i", F.lit(0.0))
    else:
        out = Bucketizer(splits=[float("-inf")] + cuts + [float("inf")], inputCol="_v",
                         outputCol="_i", handleInvalid="keep").transform(out)
    i = F.col("_i").cast("int")
    out = out.withColumn("_tie", (tie if tie is not None else F.lit(0)).cast("long"))

    def pick(values, default):
        return F.when(i == 0, F.lit(default)).otherwise(F.get(F.array(*[F.lit(v) for v in values]), i - 1))

    if not cuts:
        return out.withColumn("_range", F.lit(0)).drop("_v", "_i")
    cut, share = pick(cuts, 0.0), pick(parts, 0)
    sub = F.floor(F.col("_tie").cast("double") / HASH_SPACE * share).cast("int")
    cell = F.when(i == 0, F.lit(0)).when(
        (share > 0) & (F.col("_v") == cut), pick(heavy_at, 0) + F.least(sub, share - 1)
    ).otherwise(pick(rest_at, 0))
    return out.withColumn("_range", cell).drop("_v", "_i")


def ordered_totals(df: DataFrame, value: str, sums: dict[str, Column], keys: list[str] | None = None,
                   tie: str | None = None, ranges: int | None = None) -> DataFrame:
    """Add ``<name>_before``: sums over all rows earlier in (value, tie hash, tie id) order.

    Rows must be unique in (keys, value) unless ``tie`` names an id column.
    """
    keys = keys or []
    df = df if hasattr(df, "stored_at") else cut_lineage(df)  # bounds, offsets and the window read the same stored rows
    bounds = value_ranges(df, value, ranges)
    placed = place(df, value, bounds, hash60(F.col(tie)) if tie else None)
    placed = placed.withColumns({f"_s_{n}": c for n, c in sums.items()})
    order = [F.col(value), F.col("_tie")] + ([F.col(tie)] if tie else [])
    inside = (Window.partitionBy(*keys, "_range").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    across = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range")
              .rowsBetween(Window.unboundedPreceding, -1))
    # one row per (key, range): bounded by keys x ranges
    offsets = (placed.groupBy(*keys, "_range").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
               .select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_o_{n}")
                                          for n in sums]))
    local = placed.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_s_{n}").over(inside), F.lit(0))
                                for n in sums})
    out = local.join(offsets, keys + ["_range"])
    return (out.withColumns({f"{n}_before": F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in sums})
            .drop("_range", "_tie", *[f"_{x}_{n}" for n in sums for x in "slo"]))


def midranks(df: DataFrame, value: str, count: str, out: str = "mid_rank") -> DataFrame:
    """Average rank of each distinct value; one input row per value with its row count."""
    r = ordered_totals(df, value, {"_c": F.col(count)})
    return r.withColumn(out, F.col("_c_before") + (F.col(count) + 1) / 2).drop("_c_before")


def ranked(df: DataFrame, value: str, tie: str, keys: list[str] | None = None,
           out: str = "rank_no") -> DataFrame:
    """Global rank 1..N ascending; equal values follow the hash of the tie id."""
    r = ordered_totals(df, value, {"_one": F.lit(1)}, keys, tie)
    return r.withColumn(out, F.col("_one_before") + 1).drop("_one_before")


def ntile(df: DataFrame, value: str, tie: str, n: int = 5, out: str = "tile") -> DataFrame:
    """NTILE over the whole table: the first (rows mod n) tiles get one extra row."""
    r = ranked(df, value, tie, out="_rank")
    total = df.agg(F.count(F.lit(1))).scalar()
    small, extra = F.floor(total / n), total % n
    zero = F.col("_rank") - 1
    wide = extra * (small + 1)
    tile = F.when(zero < wide, F.floor(zero / (small + 1))).otherwise(
        extra + F.floor((zero - wide) / F.greatest(small, F.lit(1))))
    return r.withColumn(out, (tile + 1).cast("int")).drop("_rank")


def quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation per key, for groups too large for one task.

    Works on counts per distinct value and picks the two order statistics around each position.
    """
    keys = keys or []
    v = df.where(F.col(value).isNotNull()).withColumn("_x", F.col(value).cast("double")).where(~F.isnan("_x"))
    counts = cut_lineage(v.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n")))  # placed and added up
    r = ordered_totals(counts, "_x", {"_c": F.col("_n")}, keys)
    if keys:
        r = r.join(counts.groupBy(*keys).agg(F.sum("_n").alias("_total")), keys)
    else:
        r = r.withColumn("_total", counts.agg(F.sum("_n")).scalar())
    first, last = F.col("_c_before"), F.col("_c_before") + F.col("_n") - 1
    picks, out = [], []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        for tag, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((first <= pos) & (pos <= last), F.col("_x"))).alias(f"_{name}_{tag}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_w"))
        lo, hi, w = (F.col(f"_{name}_{t}") for t in ("lo", "hi", "w"))
        out.append((lo + (hi - lo) * w).alias(name))
    return r.groupBy(*keys).agg(*picks).select(*keys, *out)
