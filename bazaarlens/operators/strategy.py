"""What-if return of intervention strategies over the order pool."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import (BAD_VALUE, BAD_VALUES, BUDGET_LEVELS, REPEAT_ELIGIBLE, RESCUE_RATE, RESCUE_RATES,
                      STRATEGIES, STRATEGY_PARAM_KEYS)
from .quality import missing_keys

__all__ = ["hit_strategies", "strategy_coverage", "strategy_by_segment", "strategy_params", "cost_per_order", "roi", "sensitivity",
           "budget_plan", "invariants"]


def hit_strategies(pool: DataFrame) -> DataFrame:
    """One row per order and strategy that reaches it, from a single scan of the pool."""
    hits = F.array_compact(F.array(*[F.when(F.col(f"hit_{s}") == 1, F.lit(s)) for s in STRATEGIES]))
    return pool.withColumn("strategy", F.explode(hits))


def strategy_coverage(pool: DataFrame) -> DataFrame:
    """Orders, globally distinct customers, amount and bad orders per strategy; a strategy that reaches no order has a row
    of zeros. Customers are first reduced to one row per strategy and customer, so three strategies do not mean three tasks."""
    hit = hit_strategies(pool).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("covered_orders"), F.countDistinct("customer_unique_id").alias("covered_customers"),
        F.sum("order_amount").alias("covered_gmv"), F.sum("is_bad").alias("bad_orders"))
    every = pool.sparkSession.createDataFrame([(s,) for s in STRATEGIES], "strategy string")
    return every.join(hit, "strategy", "left").select("strategy", *[
        F.coalesce(F.col(f.name), F.lit(0)).cast(f.dataType).alias(f.name) for f in hit.schema.fields if f.name != "strategy"])


def strategy_by_segment(pool: DataFrame, segments: DataFrame, segment: str = "rfm_segment") -> DataFrame:
    """Coverage and bad share per strategy and customer segment; customers without a segment are 'none'."""
    joined = hit_strategies(pool).join(segments.select("customer_unique_id", segment), "customer_unique_id", "left")
    return joined.groupBy("strategy", F.coalesce(segment, F.lit("none")).alias(segment)).agg(
        F.count(F.lit(1)).alias("covered_orders"), F.countDistinct("customer_unique_id").alias("covered_customers"),
        F.sum("order_amount").alias("covered_gmv"), F.avg("is_bad").alias("bad_rate"))


def strategy_params(params: DataFrame) -> DataFrame:
    """One wide row of the required parameters; a missing one stops the run."""
    absent = [r[0] for r in missing_keys(params, "param_key", STRATEGY_PARAM_KEYS).collect()]
    if absent:
        raise KeyError(f"missing strategy parameters: {sorted(absent)}")
    return params.agg(*[F.max(F.when(F.col("param_key") == k, F.col("param_value").cast("double"))).alias(k)
                        for k in STRATEGY_PARAM_KEYS])


def cost_per_order(strategy: Column) -> Column:
    """Expedite: fixed. Intercept: face x redeem + contact. Voucher: face x redeem."""
    p = F.col
    return (F.when(strategy == "p1_expedite", p("p1_expedite_cost"))
            .when(strategy == "p2_intercept", p("p2_voucher_face") * p("p2_redeem_rate") + p("p2_contact_cost"))
            .when(strategy == "p3_voucher", p("p3_voucher_face") * p("p3_redeem_rate")))


def roi(coverage: DataFrame, params: DataFrame, scenarios=((RESCUE_RATE, BAD_VALUE),)) -> DataFrame:
    """Cost, revenue, net, return and break-even rescue rate per strategy and (p, v) scenario.

    View A counts rescued bad reviews only; view B adds repeat purchases, for strategies that
    remove the delay itself. Nothing is rounded here.
    """
    row = strategy_params(params).first()  # twelve numbers
    one = {k: F.lit(row[k]).cast("double") for k in STRATEGY_PARAM_KEYS}
    grid = F.array(*[F.struct(F.lit(float(p)).alias("rescue_rate"), F.lit(float(v)).alias("bad_value")) for p, v in scenarios])
    c = coverage.withColumns(one).select("*", F.inline(grid))
    orders, p, v = F.col("covered_orders").cast("double"), F.col("rescue_rate"), F.col("bad_value")
    eligible = F.col("strategy").isin(*REPEAT_ELIGIBLE)
    per_rate = F.when(eligible, F.col("covered_customers") * F.abs("repeat_effect_pp") / 100).otherwise(F.lit(0.0))
    c = c.withColumns({"cost_per_order": cost_per_order(F.col("strategy")),
                       "bad_upper": orders * (F.col("baseline_bad_late") - F.col("baseline_bad_ontime")) / 100,
                       "rescued_repeat": per_rate * p})
    c = c.withColumns({"total_cost": orders * F.col("cost_per_order"), "revenue_review": F.col("bad_upper") * p * v,
                       "revenue_repeat": F.col("rescued_repeat") * F.col("aov_delayed"),
                       "_a": F.col("bad_upper") * v})
    c = c.withColumns({"revenue_total": F.col("revenue_review") + F.col("revenue_repeat"),
                       "_b": F.col("_a") + per_rate * F.col("aov_delayed")})
    cost = F.col("total_cost")
    over = lambda a, b: F.try_divide(a, F.when(b > 0, b))
    c = c.withColumns({
        "net_benefit_a": F.col("revenue_review") - cost, "net_benefit_b": F.col("revenue_total") - cost,
        "roi_a": over(F.col("revenue_review"), cost), "roi_b": over(F.col("revenue_total"), cost),
        "breakeven_p_a": over(cost, F.col("_a")), "breakeven_p_b": over(cost, F.col("_b"))})
    b = F.col("breakeven_p_b")
    verdict = (F.when(b > 1.0, "no_go").when(b > 0.7, "needs_high_rescue").when(b > 0.45, "needs_half_rescue")
               .when(b.isNotNull(), "go"))
    return c.withColumn("verdict", verdict).drop(*STRATEGY_PARAM_KEYS, "_a", "_b")


def sensitivity(coverage: DataFrame, params: DataFrame, rates=RESCUE_RATES, values=BAD_VALUES) -> DataFrame:
    """Every (p, v) of the grid per strategy."""
    r = roi(coverage, params, [(p, v) for p in rates for v in values])
    return r.select("strategy", "rescue_rate", "bad_value", "total_cost", F.col("revenue_total").alias("revenue"),
                    F.col("net_benefit_b").alias("net_benefit"), F.col("roi_b").alias("roi"),
                    (F.col("net_benefit_b") > 0).cast("int").alias("is_profitable"))


def budget_plan(roi_rows: DataFrame, levels=BUDGET_LEVELS) -> DataFrame:
    """Each budget goes to strategies by net benefit per unit of cost, each up to its full cycle.

    Loss-making strategies keep a zero row and a leftover above 1 an ``unallocated`` row. The
    input has one row per strategy, so the ordered windows are as short as the strategy list.
    """
    r = roi_rows.select("strategy", "covered_orders", F.col("total_cost").alias("cycle"),
                        F.col("net_benefit_b").alias("net"))
    r = r.withColumn("per_unit", F.when(F.col("cycle") > 0, F.col("net") / F.col("cycle")).otherwise(0.0))
    r = r.select("*", F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("budget_level"))
    win = F.col("per_unit") > 0
    w = Window.partitionBy("budget_level", win).orderBy(F.col("per_unit").desc(), "strategy").rowsBetween(
        Window.unboundedPreceding, -1)
    r = r.withColumn("_prior", F.coalesce(F.sum("cycle").over(w), F.lit(0.0)))
    left = F.greatest(F.lit(0.0), F.least(F.col("cycle"), F.col("budget_level") - F.col("_prior")))
    r = r.withColumn("_alloc", F.when(win, left).otherwise(0.0))
    frac = F.col("_alloc") / F.col("cycle")
    zero, null = F.lit(0.0), F.lit(None).cast("double")
    paid = r.where(win & (F.col("_alloc") > 0)).select(
        "budget_level", "strategy", F.col("_alloc").alias("allocated"),
        F.bround(F.col("covered_orders") * frac).cast("long").alias("covered_orders"),
        (F.col("net") * frac).alias("expected_net"), (F.col("net") / F.col("cycle") + 1).alias("expected_roi"))
    idle = r.where(~win).select("budget_level", "strategy", zero.alias("allocated"),
                                F.lit(0).cast("long").alias("covered_orders"), zero.alias("expected_net"),
                                null.alias("expected_roi"))
    rest = (r.groupBy("budget_level").agg(F.sum("_alloc").alias("_s"))
            .where(F.col("budget_level") - F.col("_s") > 1)
            .select("budget_level", F.lit("unallocated").alias("strategy"),
                    (F.col("budget_level") - F.col("_s")).alias("allocated"), F.lit(0).cast("long").alias("covered_orders"),
                    zero.alias("expected_net"), null.alias("expected_roi")))
    out = reduce(lambda a, b: a.unionByName(b), [paid, idle, rest])
    return out.withColumn("alloc_pct", F.col("allocated") / F.col("budget_level") * 100)


def invariants(coverage: DataFrame, params: DataFrame) -> DataFrame:
    """Named conditions that must all hold: coverage order, baselines, positive costs, identities."""
    s = coverage.agg(*[F.max(F.when(F.col("strategy") == x, F.col("covered_orders"))).alias(x) for x in STRATEGIES])
    p1, p2, p3 = (s.select(x).scalar() for x in STRATEGIES)
    wide = strategy_params(params)
    r = roi(coverage, params)
    star = r.where(F.col("breakeven_p_b").between(0, 1))
    k = F.col("net_benefit_b") + F.col("total_cost")
    # cost and revenue again, order by order from the coverage rows and the parameters
    v = wide.first()
    unit = {"p1_expedite": v["p1_expedite_cost"], "p2_intercept": v["p2_voucher_face"] * v["p2_redeem_rate"] + v["p2_contact_cost"],
            "p3_voucher": v["p3_voucher_face"] * v["p3_redeem_rate"]}
    again = []
    for c in coverage.collect():  # one row per strategy
        rescued = c["covered_orders"] * (v["baseline_bad_late"] - v["baseline_bad_ontime"]) / 100 * RESCUE_RATE
        repeat = c["covered_customers"] * abs(v["repeat_effect_pp"]) / 100 * RESCUE_RATE if c["strategy"] in REPEAT_ELIGIBLE else 0.0
        again.append((c["strategy"], float(c["covered_orders"] * unit[c["strategy"]]), float(rescued * BAD_VALUE + repeat * v["aov_delayed"])))
    told = r.join(coverage.sparkSession.createDataFrame(again, "strategy string, cost_again double, revenue_again double"), "strategy")
    near = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.abs(b), F.lit(1.0))
    back = F.abs(k / F.col("rescue_rate") * F.col("breakeven_p_b") - F.col("total_cost")) <= 1e-6 * F.col("total_cost")
    checks = {
        "coverage_grows": wide.select((p1 < p2) & (p2 < p3)),
        "late_is_worse": wide.select(F.col("baseline_bad_late") > F.col("baseline_bad_ontime")),
        "costs_positive": r.agg(F.bool_and(F.col("cost_per_order") > 0)),
        "roi_identity": told.agg(F.bool_and(F.col("roi_b").isNull() & (F.col("cost_again") == 0)
                                            | near(F.col("roi_b"), F.col("revenue_again") / F.col("cost_again")))),
        "net_identity": told.agg(F.bool_and(near(F.col("net_benefit_b"), F.col("revenue_again") - F.col("cost_again")))),
        "breakeven_returns_zero": star.agg(F.coalesce(F.bool_and(back), F.lit(True))),
    }
    return reduce(lambda a, b: a.unionByName(b),
                  [d.toDF("holds").select(F.lit(n).alias("rule"), "holds") for n, d in checks.items()])
