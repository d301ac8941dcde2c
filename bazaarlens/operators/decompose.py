"""Revenue attribution: log-mean factors, structure contributions, basket-value effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binomial_p, log_mean, ratio
from ..sources.recovery import cut_lineage

__all__ = ["lmdi", "revenue_factors", "paired_dims", "structure_contribution", "aov_inputs",
           "aov_effects", "aov_detail", "effect_window", "waterfall", "AOV_EFFECTS",
           "REVENUE_FACTORS", "cumulative_share", "main_driver", "latest", "ends"]

REVENUE_FACTORS = ("buyers", "orders_per_buyer", "aov")
AOV_EFFECTS = ("price", "mix", "quantity", "freight", "interaction")


def lmdi(v0, v1, pairs: dict) -> dict:
    """Additive log-mean contributions as columns: name -> L(v1, v0) * ln(x1 / x0).

    Equal totals give zero for every factor; totals that are not positive give NULL.
    """
    ok = (v0 > 0) & (v1 > 0)
    mean = log_mean(v1, v0)
    return {name: F.when(v0 == v1, F.lit(0.0)).when(ok, mean * F.log(x1 / x0))
            for name, (x0, x1) in pairs.items()}


def revenue_factors(states: DataFrame) -> DataFrame:
    """Three-factor attribution of each month against the month before, one row per factor.

    ``states`` has one row per month, so the ordered window is bounded by the calendar.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("stat_month")
    cols = ("gmv",) + REVENUE_FACTORS
    s = states.select("stat_month", *[F.col(c).cast("double").alias(c) for c in cols])
    p = s.withColumns({f"{c}_0": F.lag(c).over(w) for c in cols}).where(F.col("gmv_0").isNotNull())
    delta = F.col("gmv") - F.col("gmv_0")
    parts = lmdi(F.col("gmv_0"), F.col("gmv"),
                 {f: (F.col(f"{f}_0"), F.col(f)) for f in REVENUE_FACTORS})
    wide = p.select("stat_month", delta.alias("delta_gmv"),
                    F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"{f}_0").alias("factor_prev"),
                                       F.col(f).alias("factor_curr"),
                                       parts[f].alias("contribution_amount"))
                              for f in REVENUE_FACTORS]).alias("_f"))
    return (wide.select("stat_month", "delta_gmv", F.inline("_f"))
            .withColumn("contribution_pct", ratio(F.col("contribution_amount"), F.col("delta_gmv"))))


def paired_dims(dim_months: DataFrame, pairs: DataFrame, dim: str, values: list[str]) -> DataFrame:
    """Both periods of every month pair side by side, zero where a dimension is missing.

    Each month row goes out at most twice, as the current and as the previous period, and
    the two meet in one grouping: the input is read once and no month x dimension grid is built.
    """
    roles = pairs.select(F.col("stat_month").alias("_m"), F.lit(1).alias("_now"), F.col("stat_month").alias("_pair")).unionByName(
        pairs.select(F.col("prev_month").alias("_m"), F.lit(0).alias("_now"), F.col("stat_month").alias("_pair")))
    j = dim_months.join(roles, F.col("stat_month") == F.col("_m"))
    return j.groupBy(F.col("_pair").alias("stat_month"), dim).agg(*[
        F.sum(F.when(F.col("_now") == t, F.col(v).cast("double")).otherwise(0.0)).alias(f"{v}_{t}")
        for v in values for t in (0, 1)])


def structure_contribution(dim_months: DataFrame, pairs: DataFrame) -> DataFrame:
    """Contribution of each dimension value to growth, in percentage points.

    The contributions of a pair add up to its total growth. Pairs with a total that is not
    positive are skipped, and values that are zero to the cent in both periods are left out.
    """
    p = cut_lineage(paired_dims(dim_months.where(F.col("dim_value").isNotNull()), pairs, "dim_value", ["gmv"]))
    totals = p.groupBy("stat_month").agg(F.sum("gmv_0").alias("_t0"), F.sum("gmv_1").alias("_t1"))
    g0, g1 = F.col("gmv_0"), F.col("gmv_1")
    return (p.join(totals, "stat_month").where("_t0 > 0 AND _t1 > 0")
            .where((F.round(g0, 2) != 0) | (F.round(g1, 2) != 0))
            .select("stat_month", "dim_value", g1.alias("gmv"), g0.alias("gmv_prev"),
                    (g1 - g0).alias("contrib_amount"),
                    (g1 / F.col("_t1")).alias("gmv_share"), (g0 / F.col("_t0")).alias("gmv_share_prev"),
                    F.when(g0 > 0, (g1 / g0 - 1) * 100).alias("growth_pct"),
                    ((g1 - g0) / F.col("_t0") * 100).alias("contrib_pp")))


def aov_inputs(cat_month: DataFrame, totals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Category rows of each month pair with the shares, prices and order-level ratios of both
    periods. A category unsold in one period takes the other period's price, so entry and exit
    land in the mix effect."""
    totals = cut_lineage(totals)  # one row per month, read as current and as previous
    cats = paired_dims(cat_month, pairs, "category_en", ["item_cnt", "item_amount"])
    t = totals.select("stat_month", *[F.col(c).cast("double").alias(c) for c in
                                      ("delivered_orders", "item_cnt", "item_amount", "freight_amount")])
    both = pairs.join(t.select("stat_month", F.col("delivered_orders").alias("o1"),
                               F.col("item_cnt").alias("q1"), F.col("item_amount").alias("a1"),
                               F.col("freight_amount").alias("f1")), "stat_month")
    both = both.join(t.select(F.col("stat_month").alias("prev_month"),
                              F.col("delivered_orders").alias("o0"), F.col("item_cnt").alias("q0"),
                              F.col("item_amount").alias("a0"), F.col("freight_amount").alias("f0")),
                     "prev_month").where("least(o0, o1, q0, q1) > 0")
    order_level = both.select("stat_month", "q0", "q1",
                              *[(F.col(f"a{t}") / F.col(f"q{t}")).alias(f"unit_{t}") for t in (0, 1)],
                              *[(F.col(f"q{t}") / F.col(f"o{t}")).alias(f"items_{t}") for t in (0, 1)],
                              *[(F.col(f"f{t}") / F.col(f"o{t}")).alias(f"freight_{t}") for t in (0, 1)])
    own = {t: ratio(F.col(f"item_amount_{t}"), F.when(F.col(f"item_cnt_{t}") > 0, F.col(f"item_cnt_{t}")))
           for t in (0, 1)}
    return (cats.join(order_level, "stat_month")
            .withColumns({"own_price_0": own[0], "own_price_1": own[1]})
            .withColumns({
                "price_0": F.coalesce("own_price_0", "own_price_1", F.lit(0.0)),
                "price_1": F.coalesce("own_price_1", "own_price_0", F.lit(0.0)),
                "share_0": F.col("item_cnt_0") / F.col("q0"),
                "share_1": F.col("item_cnt_1") / F.col("q1")})
            .withColumns({
                "price_contrib": F.col("items_0") * F.col("share_0") * (F.col("price_1") - F.col("price_0")),
                "mix_contrib": F.col("items_0") * F.col("price_0") * (F.col("share_1") - F.col("share_0")),
                "_cross": F.col("items_0") * (F.col("share_1") - F.col("share_0"))
                          * (F.col("price_1") - F.col("price_0"))}))


def aov_effects(inputs: DataFrame) -> DataFrame:
    """Five effects per month pair, one row per effect; they add up to the change exactly."""
    level = ["unit_0", "unit_1", "items_0", "items_1", "freight_0", "freight_1"]
    g = (inputs.groupBy("stat_month")
         .agg(F.sum("price_contrib").alias("price"), F.sum("mix_contrib").alias("mix"),
              F.sum("_cross").alias("_cross"), *[F.first(c).alias(c) for c in level]))
    d_items, d_unit = F.col("items_1") - F.col("items_0"), F.col("unit_1") - F.col("unit_0")
    g = g.withColumns({
        "aov_prev": F.col("unit_0") * F.col("items_0") + F.col("freight_0"),
        "aov_curr": F.col("unit_1") * F.col("items_1") + F.col("freight_1"),
        "quantity": F.col("unit_0") * d_items,
        "freight": F.col("freight_1") - F.col("freight_0"),
        "interaction": d_unit * d_items + F.col("_cross")})
    g = g.withColumn("delta_aov", F.col("aov_curr") - F.col("aov_prev"))
    long = g.select("stat_month", "aov_prev", "aov_curr", "delta_aov", F.inline(F.array(*[
        F.struct(F.lit(e).alias("factor"), F.col(e).alias("contribution_amount")) for e in AOV_EFFECTS])))
    return long.withColumn("contribution_pct", ratio(F.col("contribution_amount"), F.col("delta_aov")))


def aov_detail(inputs: DataFrame) -> DataFrame:
    """Category detail with the real prices (0 when unsold), not the filled ones."""
    return (inputs.where("item_cnt_0 <> 0 OR item_cnt_1 <> 0")
            .select("stat_month", "category_en",
                    F.col("item_cnt_0").cast("long").alias("item_cnt_prev"),
                    F.col("item_cnt_1").cast("long").alias("item_cnt_curr"),
                    F.col("share_0").alias("share_prev"), F.col("share_1").alias("share_curr"),
                    F.coalesce("own_price_0", F.lit(0.0)).alias("price_prev"),
                    F.coalesce("own_price_1", F.lit(0.0)).alias("price_curr"),
                    "price_contrib", "mix_contrib"))


def effect_window(effects: DataFrame) -> DataFrame:
    """Window summary per effect: total, mean, negative and positive months, sign test."""
    c = F.col("contribution_amount")
    g = (effects.groupBy("factor")
         .agg(F.sum(c).alias("total_amount"), F.avg(c).alias("mean_per_month"),
              F.count_if(c < 0).alias("negative_months"), F.count_if(c > 0).alias("positive_months"),
              F.count(c).alias("months")))
    neg, pos = F.col("negative_months"), F.col("positive_months")
    return g.withColumn("sign_test_p", binomial_p(F.least(neg, pos), neg + pos))


def waterfall(steps: DataFrame, seq: str, delta: str, keys: list[str]) -> DataFrame:
    """Bars of a waterfall: each starts where all earlier bars of its chart end."""
    w = Window.partitionBy(*keys).orderBy(seq)
    before = F.coalesce(F.sum(delta).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (steps.withColumn("bar_start", before)
            .withColumn("bar_end", F.col("bar_start") + F.col(delta)))


def cumulative_share(rows: DataFrame, key: str, amount: str, flag: str | None = None) -> DataFrame:
    """Total per key over all months, its share of the grand total, and flagged months."""
    aggs = [F.sum(amount).alias("total_amount")] + ([F.sum(flag).alias("flagged_months")] if flag else [])
    g = rows.groupBy(key).agg(*aggs)
    grand = rows.agg(F.sum(amount)).scalar()
    return g.withColumn("share_pct", ratio(F.col("total_amount"), grand) * 100)


def latest(rows: DataFrame, month: str = "stat_month") -> DataFrame:
    """Rows of the latest month."""
    return rows.where(F.col(month) == rows.agg(F.max(month)).scalar())


def main_driver(rows: DataFrame, key: str = "stat_month", name: str = "factor",
                amount: str = "contribution_amount") -> DataFrame:
    """The row with the largest absolute amount per key."""
    pick = F.max_by(F.struct(F.col(name), F.col(amount)), F.struct(F.abs(amount), F.col(name)))
    return rows.groupBy(key).agg(pick.alias("_r")).select(key, "_r.*")


def ends(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """First and last n rows per key in the given order."""
    up = Window.partitionBy(*keys).orderBy(*order)
    down = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    low = rows.withColumn("_r", F.row_number().over(up)).where(F.col("_r") <= n)
    high = rows.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= n)
    return (low.withColumn("side", F.lit("bottom")).unionByName(high.withColumn("side", F.lit("top")))
            .withColumnRenamed("_r", "position"))
