"""Revenue growth: factor attribution, trend, structure, basket value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import decompose as D
from ..operators import panels as P
from ..operators import quality as Q
from ..operators import resample as B
from ..operators import trend as E
from ..sources.recovery import cut_lineage
from ..params import (B_REVENUE, B_STRUCTURE, MAX_BREAKS, MIN_ORDERS_COMPLETE_MONTH, MIN_SEGMENT, SEED)

__all__ = ["analysis_window", "revenue_attribution", "revenue_trend", "structure_report", "basket_report"]


def analysis_window(orders: DataFrame, min_orders=MIN_ORDERS_COMPLETE_MONTH):
    """Month panel and its complete window; the window comes back as two literal dates."""
    panel = P.month_panel(orders, min_orders)
    return panel, P.complete_window(panel)


def revenue_attribution(orders: DataFrame, min_orders=MIN_ORDERS_COMPLETE_MONTH, b: int = B_REVENUE,
                        seed: int = SEED, last: int = 0, checks: bool = True) -> DataFrame:
    """Contribution of buyers, frequency and basket value to each monthly change, with intervals."""
    panel, window = analysis_window(orders, min_orders)
    inside = P.within(orders, window)
    daily = cut_lineage(P.daily_customer_panel(inside))
    states = cut_lineage(P.month_states(daily))
    pairs = P.month_pairs(states)
    if last:
        pairs = pairs.orderBy(F.col("stat_month").desc()).limit(last)
    factors = D.revenue_factors(states).join(pairs.select("stat_month"), "stat_month", "left_semi")
    if checks:
        Q.expect(Q.state_gap(panel, states), F.col("max_gap") < 0.01, "recomputed factors differ from the panel")
        total = factors.groupBy("stat_month").agg(F.sum("contribution_amount").alias("s"), F.first("delta_gmv").alias("d"),
                                                  F.sum("contribution_pct").alias("p"))
        Q.expect(total, (F.abs(F.col("s") - F.col("d")) < 0.01)
                 & (F.col("p").isNull() | (F.abs(F.col("p") - 1) < 1e-3)), "contributions do not add up")
    ci = B.bootstrap_lmdi(daily, pairs, b, seed).drop("max_residual")
    return rounded(factors.join(ci, ["stat_month", "factor"]), factor_prev=6, factor_curr=6, delta_gmv=2,
                   contribution_amount=2, contribution_pct=4, ci_low=2, ci_high=2)


def revenue_trend(orders: DataFrame, min_orders=MIN_ORDERS_COMPLETE_MONTH, max_breaks: int = MAX_BREAKS) -> DataFrame:
    """Month rows of the window with break flags and the trend of the segment each month is in."""
    panel, window = analysis_window(orders, min_orders)
    s = P.within(panel, window, ts=None).withColumns({"_log": F.log(F.col("gmv").cast("double")), "_k": F.lit(1)})
    cut = E.change_points(s, ["_k"], "stat_month", "_log", MIN_SEGMENT, max_breaks)
    seg = E.segment_report(cut, ["_k"], "stat_month", "gmv").select(
        "_k", "segment_id", F.col("tau").alias("mk_tau"), F.col("p_value").alias("mk_p_value"),
        F.col("trend").alias("mk_trend"), F.col("slope_log").alias("mk_slope_log"))
    return cut.join(seg, ["_k", "segment_id"]).drop("_k", "_log", "idx")


def structure_report(orders: DataFrame, items: DataFrame, dims=("category", "state"),
                     min_orders=MIN_ORDERS_COMPLETE_MONTH, b: int = B_STRUCTURE, seed: int = SEED,
                     checks: bool = True) -> DataFrame:
    """Growth contribution per category and state with intervals."""
    _, window = analysis_window(orders, min_orders)
    inside = P.within(orders, window)
    out = None
    for dim in dims:
        daily = P.daily_dim_panel(inside, items, dim)
        daily = cut_lineage(daily)
        base = P.dim_month(daily)
        pairs = P.month_pairs(base)
        part = D.structure_contribution(base, pairs)
        if checks:
            g = part.groupBy("stat_month").agg(F.sum("contrib_pp").alias("pp"), F.sum("gmv").alias("t1"),
                                               F.sum("gmv_prev").alias("t0"))
            Q.expect(g, F.abs(F.col("pp") - (F.col("t1") - F.col("t0")) / F.col("t0") * 100) < 0.01,
                     f"{dim} contributions do not add up to growth")
        ci = B.bootstrap_contrib(daily, pairs, b, seed, label=dim)
        rows = part.join(ci, ["stat_month", "dim_value"]).withColumn("dim_type", F.lit(dim))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, gmv=2, gmv_prev=2, contrib_amount=2, gmv_share=4, gmv_share_prev=4, growth_pct=2,
                   contrib_pp=4, ci_low=4, ci_high=4)


def basket_report(orders: DataFrame, items: DataFrame, min_orders=MIN_ORDERS_COMPLETE_MONTH,
                  b: int = B_STRUCTURE, seed: int = SEED, checks: bool = True) -> dict[str, DataFrame]:
    """Monthly effects, category detail and window summary of the average order value."""
    panel, window = analysis_window(orders, min_orders)
    cats, totals = P.category_month(orders, items), P.month_totals(orders)
    pairs = P.month_pairs(P.within(panel, window, ts=None))
    cats = cut_lineage(cats)
    inputs = cut_lineage(D.aov_inputs(cats, totals, pairs))
    effects = cut_lineage(D.aov_effects(inputs))
    if checks:
        Q.expect(Q.category_gap(cats, totals, panel),
                 (F.col("item_gap") < 0.01) & (F.col("amount_gap") < 0.01) & (F.col("order_gap") < 0.01),
                 "category, order and panel totals differ")
        total = effects.groupBy("stat_month").agg(F.sum("contribution_amount").alias("s"), F.first("delta_aov").alias("d"))
        Q.expect(total, F.abs(F.col("s") - F.col("d")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("d")),
                 "effects do not add up")
    ci = B.bootstrap_means(effects, "factor", "stat_month", "contribution_amount", b, seed, label="month")
    window_rows = D.effect_window(effects).join(ci, "factor")
    return {"effects": effects, "detail": D.aov_detail(inputs), "window": window_rows}
