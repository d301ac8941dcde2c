"""First orders, censoring, survival curves and the two-group log-rank test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chi2_1_tail, day_of, month_start, ratio, z_quantile
from ..params import ALPHA, MIN_CURVE_GROUP, SURVIVAL_CAP_DAYS
from ..sources.recovery import cut_lineage
from .ordering import quantiles

__all__ = ["first_orders", "censor_at", "kaplan_meier", "logrank", "median_time", "group_membership",
           "survival_curves", "retention", "experience_base"]


def first_orders(orders: DataFrame, attributes: dict[str, Column]) -> DataFrame:
    """One row per customer: first-order attributes, gap to the second order, days observed.

    Only two rows per customer are needed. Filtering on the row number lets Spark keep the first
    two of each map task before the shuffle, so a customer with a third of all orders stays small.
    """
    w = Window.partitionBy("customer_unique_id").orderBy("purchase_ts", "order_id")
    two = (orders.where(F.col("purchase_ts").isNotNull())
           .select("customer_unique_id", "purchase_ts", "order_id", *[c.alias(n) for n, c in attributes.items()])
           .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2))
    snapshot = orders.agg(F.max("purchase_ts").cast("date")).scalar()
    first = F.col("_rn") == 1
    g = two.groupBy("customer_unique_id").agg(
        F.max(F.when(first, day_of("purchase_ts"))).alias("first_day"),
        F.max(F.when(~first, day_of("purchase_ts"))).alias("second_day"),
        *[F.max(F.when(first, F.col(n))).alias(n) for n in attributes])
    return (g.withColumns({
        "event": F.col("second_day").isNotNull().cast("int"),
        "days_to_repeat": F.datediff("second_day", "first_day"),
        "tenure_days": F.datediff(snapshot, F.col("first_day")),
        "first_cohort_month": F.trunc("first_day", "MM")}).drop("second_day"))


def censor_at(df: DataFrame, cap: int = SURVIVAL_CAP_DAYS) -> DataFrame:
    """Observed days (at least 1, at most the cap; NULL where neither gap nor tenure is known) and the event flag."""
    happened = F.col("event") == 1
    ev = happened & (F.col("days_to_repeat") <= cap)
    t = F.least(F.when(happened, F.coalesce("days_to_repeat", F.lit(cap))).otherwise(F.col("tenure_days")), F.lit(cap))
    known = happened | F.col("tenure_days").isNotNull()  # least and greatest skip NULL
    return df.withColumns({"obs_days": F.when(known, F.greatest(t, F.lit(1))), "obs_event": F.coalesce(ev, F.lit(False)).cast("int")})


def _exits(df: DataFrame, time: str, event: str, keys: list[str]) -> DataFrame:
    """(keys, t): exits and events; at most one row per day of the observation cap."""
    return (df.groupBy(*keys, F.col(time).alias("t_days"))
            .agg(F.count(F.lit(1)).alias("exits"), F.sum(event).alias("events")))


def kaplan_meier(df: DataFrame, time: str, event: str, keys: list[str], alpha: float = ALPHA) -> DataFrame:
    """Survival at each event time per group, with Greenwood log-log intervals, to 6 decimals."""
    return _km_rows(_exits(df, time, event, keys), keys, alpha)


def _km_rows(rows: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    part = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("t_days")
    later = part.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    run = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = rows.withColumn("at_risk", F.sum("exits").over(later)).where("events > 0")
    n, d = F.col("at_risk").cast("double"), F.col("events").cast("double")
    e = e.withColumns({"_s": F.product(1 - d / n).over(run),
                       "_g": F.sum(F.when(n > d, d / (n * F.when(n > d, n - d))).otherwise(0.0)).over(run)})
    z = z_quantile(alpha)
    inside = (F.col("_s") > 0) & (F.col("_s") < 1)
    se = F.sqrt("_g") / F.abs(F.log(F.when(inside, F.col("_s"))))
    low = F.when(inside, F.pow("_s", F.exp(z * se))).otherwise(F.col("_s"))
    high = F.when(inside, F.pow("_s", F.exp(-z * se))).otherwise(F.col("_s"))
    clip = lambda c: F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 6)
    return e.select(*keys, "t_days", "at_risk", "events", clip(F.col("_s")).alias("surv"),
                    clip(low).alias("ci_low"), clip(high).alias("ci_high"))


def logrank(df: DataFrame, time: str, event: str, group: str, keys: list[str]) -> DataFrame:
    """Two-group log-rank per key; ``group`` is 0 or 1. V <= 0 gives NULL."""
    e = df.groupBy(*keys, F.col(time).alias("t")).agg(*[
        a for g in (0, 1) for a in (F.count_if(F.col(group) == g).alias(f"x{g}"),
                                    F.coalesce(F.sum(F.when(F.col(group) == g, F.col(event))), F.lit(0)).alias(f"d{g}"))])
    return _logrank_rows(e, keys)


def _logrank_rows(e: DataFrame, keys: list[str]) -> DataFrame:
    later = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy("t")
             .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    e = e.withColumns({f"n{g}": F.sum(f"x{g}").over(later).cast("double") for g in (0, 1)})
    n, d = F.col("n0") + F.col("n1"), (F.col("d0") + F.col("d1")).cast("double")
    e = e.where((d > 0) & (n > 1))
    v = F.col("n1") * F.col("n0") * d * (n - d) / (n * n * (n - 1))
    g = e.groupBy(*keys).agg(F.sum("d1").cast("double").alias("observed"), F.sum(d * F.col("n1") / n).alias("expected"),
                             F.sum(v).alias("variance"))
    diff = F.col("observed") - F.col("expected")
    return (g.withColumn("chi2", F.try_divide(diff * diff, F.when(F.col("variance") > 0, F.col("variance"))))
            .withColumn("p_value", chi2_1_tail(F.col("chi2"))))


def median_time(curve: DataFrame, keys: list[str]) -> DataFrame:
    """First time survival is at or under one half; NULL if never."""
    return curve.groupBy(*keys).agg(F.min(F.when(F.col("surv") <= 0.5, F.col("t_days"))).alias("median_days"))


def group_membership(df: DataFrame) -> DataFrame:
    """A row per customer and curve group it belongs to: all, late, on time, bad, good."""
    tests = {"all": F.lit(True), "first_late": F.col("first_is_late") == 1, "first_ontime": F.col("first_is_late") == 0,
             "first_bad_review": F.col("first_review_score") <= 2, "first_good_review": F.col("first_review_score") >= 4}
    codes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    return df.withColumn("group_code", F.explode(codes))


def survival_curves(first: DataFrame, cap: int = SURVIVAL_CAP_DAYS, min_group: int = MIN_CURVE_GROUP,
                    alpha: float = ALPHA) -> DataFrame:
    """Curve rows per group with the group's median, sizes and the log-rank p against its natural
    counterpart. Groups under ``min_group`` have no curve but still serve as counterpart."""
    m = (group_membership(censor_at(first, cap)).groupBy("group_code", "obs_days", "obs_event")
         .agg(F.count(F.lit(1)).alias("n")))
    m = cut_lineage(m)
    # counts per (group, day, event): the rest of the work is on at most 2 x cap rows per group
    sizes = m.groupBy("group_code").agg(F.sum("n").alias("n_total"),
                                        F.sum(F.col("n") * F.col("obs_event")).alias("n_event"))
    curve = _curve_from_counts(m, alpha)
    test = F.when(F.col("group_code").isin("first_late", "first_ontime"), "delivery").when(
        F.col("group_code").isin("first_bad_review", "first_good_review"), "review")
    side = F.col("group_code").isin("first_ontime", "first_good_review").cast("int")
    both = m.withColumns({"test": test, "side": side}).where(F.col("test").isNotNull())
    lr = _logrank_from_counts(both).select("test", F.col("p_value").alias("logrank_p"))
    out = (curve.join(sizes, "group_code").where(F.col("n_total") >= min_group)
           .join(median_time(curve, ["group_code"]), "group_code").withColumn("test", test)
           .join(lr, "test", "left").drop("test"))
    return out.withColumn("cum_ret", F.round(1 - F.col("surv"), 6))


def _curve_from_counts(m: DataFrame, alpha: float) -> DataFrame:
    rows = m.groupBy("group_code", "obs_days").agg(F.sum("n").alias("exits"),
                                                   F.sum(F.col("n") * F.col("obs_event")).alias("events"))
    return _km_rows(rows.withColumnRenamed("obs_days", "t_days"), ["group_code"], alpha)


def _logrank_from_counts(both: DataFrame) -> DataFrame:
    e = both.groupBy("test", F.col("obs_days").alias("t")).agg(*[
        a for g in (0, 1) for a in (
            F.coalesce(F.sum(F.when(F.col("side") == g, F.col("n"))), F.lit(0)).alias(f"x{g}"),
            F.coalesce(F.sum(F.when(F.col("side") == g, F.col("n") * F.col("obs_event"))), F.lit(0)).alias(f"d{g}"))])
    return _logrank_rows(e, ["test"])


def retention(orders: DataFrame) -> DataFrame:
    """Cohort month x months since: distinct customers with an order (our definition)."""
    first = orders.groupBy("customer_unique_id").agg(F.min(month_start("purchase_ts")).alias("cohort_month"))
    act = orders.select("customer_unique_id", month_start("purchase_ts").alias("m")).distinct()
    k = F.months_between("m", "cohort_month").cast("int")
    # both sides are unique per customer and month, so the counts need no distinct
    g = (act.join(first, "customer_unique_id").groupBy("cohort_month", k.alias("month_offset"))
         .agg(F.count(F.lit(1)).alias("customers")))
    size = F.max(F.when(F.col("month_offset") == 0, F.col("customers"))).over(Window.partitionBy("cohort_month"))
    return g.withColumn("cohort_size", size).withColumn("retention", ratio(F.col("customers"), F.col("cohort_size")))


def experience_base(first: DataFrame) -> DataFrame:
    """Customers and repeat customers by seven first-order dimensions in one pass (our buckets)."""
    cuts = quantiles(first, "first_amount", {"a": 0.25, "b": 0.5, "c": 0.75})
    q = cuts.select(F.array("a", "b", "c")).scalar()
    amount_q = F.when(F.col("first_amount") <= F.get(q, F.lit(0)), "q1").when(
        F.col("first_amount") <= F.get(q, F.lit(1)), "q2").when(
        F.col("first_amount") <= F.get(q, F.lit(2)), "q3").otherwise("q4")
    km = F.col("first_dist_km")
    dist = F.when(km.isNull(), "unknown").when(km < 500, "under_500").when(km < 2000, "500_2000").when(
        km < 8000, "2000_8000").otherwise("8000_up")
    items = F.col("first_item_cnt")
    dims = {"first_is_late": F.coalesce(F.col("first_is_late").cast("string"), F.lit("unknown")),
            "first_score": F.coalesce(F.col("first_review_score").cast("string"), F.lit("unknown")),
            "first_amount_q": amount_q, "first_dist_km": dist,
            "first_item_cnt": F.when(items >= 3, "3+").otherwise(items.cast("string")),
            "first_state": F.coalesce("first_state", F.lit("unknown")),
            "first_cohort_month": F.date_format("first_cohort_month", "yyyy-MM")}
    long = first.select("event", F.inline(F.array(*[
        F.struct(F.lit(d).alias("dim_type"), c.alias("dim_value")) for d, c in dims.items()])))
    return long.groupBy("dim_type", "dim_value").agg(F.count(F.lit(1)).alias("customers"),
                                                     F.sum("event").alias("repeat_customers"))
