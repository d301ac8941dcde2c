"""Checks that stop a run, and the cleaning steps from raw to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import zero_date
from ..params import MIN_DELIVERED_RATIO

__all__ = ["expect", "shape_report", "bad_rows", "typed", "latest_per_key", "parse_mismatches",
           "zero_date_count", "duplicate_keys", "domain_violations", "tie_out", "state_gap",
           "category_gap", "unmatched_orders", "tail_diagnostic", "drop_truncated", "missing_keys"]


class CheckFailed(AssertionError):
    """A reconciliation did not hold."""


def expect(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Every row must satisfy the condition; NULL counts as a failure. Returns ``df``."""
    bad = df.where(~F.coalesce(condition, F.lit(False))).limit(1).collect()
    if bad:
        raise CheckFailed(f"{message}: {bad[0]}")
    return df


def shape_report(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One pass over all columns: rows, nulls and values that do not look like the column's type."""
    cells = [F.struct(F.lit(c).alias("column_name"),
                      F.count(F.lit(1)).alias("row_cnt"),
                      F.count_if(F.col(c).isNull()).alias("null_cnt"),
                      F.count_if(~F.col(c).cast("string").rlike(p)).alias("misfit_cnt"))
             for c, p in patterns.items()]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def bad_rows(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Rows with at least one misfit, with the names of the columns at fault."""
    faults = F.filter(F.array(*[F.when(~F.col(c).cast("string").rlike(p), F.lit(c))
                                for c, p in patterns.items()]), lambda x: x.isNotNull())
    return df.withColumn("bad_columns", faults).where(F.size("bad_columns") > 0)


def typed(df: DataFrame, types: dict[str, str], formats: dict[str, str] | None = None) -> DataFrame:
    """Convert text columns; what does not convert becomes NULL instead of stopping the job."""
    formats = formats or {}
    def convert(c, t):
        if c in formats:
            return F.expr(f"cast(try_to_timestamp(`{c}`, '{formats[c]}') as {t})").alias(c)
        return F.col(c).try_cast(t).alias(c)
    return df.select([convert(c, types[c]) if c in types else F.col(c) for c in df.columns])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``: an aggregate, so a hot key is combined early."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def parse_mismatches(df: DataFrame, stored: str, raw: str, fmt: str) -> DataFrame:
    """Rows whose stored timestamp is not what an explicit parse of the raw text gives."""
    parsed = F.expr(f"cast(try_to_timestamp(`{raw}`, '{fmt}') as timestamp_ntz)")
    return df.where(~F.col(stored).cast("timestamp_ntz").eqNullSafe(parsed))


def zero_date_count(df: DataFrame, *cols: str) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column_name"), F.count_if(zero_date(F.col(c))).alias("zero_dates")) for c in cols]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def domain_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass: how many rows break each named rule (NULL breaks it)."""
    cells = [F.struct(F.lit(n).alias("rule"),
                      F.count_if(~F.coalesce(r, F.lit(False))).alias("violations"))
             for n, r in rules.items()]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def tie_out(category: DataFrame, state: DataFrame, overall: DataFrame, value: str = "gmv") -> DataFrame:
    """Category total = state total = overall; the differences should be exactly zero."""
    parts = [d.agg(F.coalesce(F.sum(value), F.lit(0)).alias(n)).withColumn("_k", F.lit(1))
             for d, n in ((category, "by_category"), (state, "by_state"), (overall, "overall"))]
    j = parts[0].join(parts[1], "_k").join(parts[2], "_k")
    return j.select("by_category", "by_state", "overall",
                    (F.col("by_category") - F.col("overall")).alias("category_gap"),
                    (F.col("by_state") - F.col("overall")).alias("state_gap"))


def state_gap(panel: DataFrame, states: DataFrame) -> DataFrame:
    """Largest gap between stored and recomputed monthly factors over the common months."""
    cols = ("buyers", "delivered_cnt", "gmv")
    s = states.select("stat_month", *[F.col(c).alias(f"{c}_again") for c in cols])
    gap = F.greatest(*[F.abs(F.col(c).cast("double") - F.col(f"{c}_again").cast("double")) for c in cols])
    return panel.join(s, "stat_month").agg(F.max(gap).alias("max_gap"), F.count(F.lit(1)).alias("months"))


def category_gap(cat_month: DataFrame, totals: DataFrame, panel: DataFrame) -> DataFrame:
    """Item counts, amounts and delivered orders across the three grains, largest gaps."""
    by_cat = cat_month.groupBy("stat_month").agg(F.sum("item_cnt").alias("_q"),
                                                 F.sum("item_amount").alias("_a"))
    z = F.lit(0)
    diff = lambda a, b: F.max(F.abs(F.coalesce(a, z) - F.coalesce(b, z)))
    return (totals.join(by_cat, "stat_month", "full")
            .join(panel.select("stat_month", "delivered_cnt"), "stat_month", "full")
            .agg(diff(F.col("item_cnt"), F.col("_q")).alias("item_gap"),
                 diff(F.col("item_amount"), F.col("_a")).alias("amount_gap"),
                 diff(F.col("delivered_orders"), F.col("delivered_cnt")).alias("order_gap")))


def unmatched_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Delivered orders without any item row; a warning, not a failure."""
    return orders.where("is_delivered = 1").join(items.select("order_id").distinct(), "order_id",
                                                "left_anti")


def tail_diagnostic(panel: DataFrame, last: int = 3, tolerance: float = 0.98) -> DataFrame:
    """Delivered share of the last months against the median; flags an undelivered tail."""
    p = panel.withColumn("delivered_share", F.try_divide(F.col("gmv").cast("double"),
                                                         F.col("gmv_all").cast("double")))
    med = p.agg(F.median("delivered_share")).scalar()
    return (p.orderBy(F.col("stat_month").desc()).limit(last)
            .select("stat_month", "gmv", "gmv_all", "delivered_share", med.alias("median_share"))
            .withColumn("is_truncated", F.col("delivered_share") < F.col("median_share") * tolerance))


def drop_truncated(months: DataFrame, ratio_col: str = "delivered_ratio",
                   floor: float = MIN_DELIVERED_RATIO) -> DataFrame:
    return months.where(F.col(ratio_col) >= floor)


def missing_keys(df: DataFrame, key: str, required) -> DataFrame:
    """Required key values that the table does not have."""
    want = df.sparkSession.createDataFrame([(k,) for k in required], f"{key} string")
    return want.join(df, key, "left_anti")
