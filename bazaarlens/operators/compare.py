"""Group comparisons: rank tests, dose response, proportions, stage durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (bh_fdr, hours_between, interval_bucket, mann_whitney_exact_p, prop_z, ratio, student_t_p,
                         two_sided_p, wilson, z_quantile)
from ..params import (ALPHA, B_DELIVERY, DELAY_BUCKETS, DELAY_CONTROL, MIN_CUSTOMERS_DIM,
                      MIN_ORDERS_DIM, SEED, STAGES)
from ..sources.recovery import cut_lineage
from .ordering import midranks
from .resample import block_group_means, block_mean_diff_ci

__all__ = ["valid_deliveries", "with_delay", "mann_whitney", "spearman", "dose_response",
           "score_difference", "weighted_rollup", "proportion_tests", "bottleneck_table",
           "repeat_rate_table", "stage_durations", "stack"]


def stack(df: DataFrame, name: str, value: str, cols: dict[str, Column], keys: list[str]) -> DataFrame:
    """Columns to rows: one (name, value) row per entry."""
    return df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(k).alias(name), c.alias(value)) for k, c in cols.items()])))


def valid_deliveries(orders: DataFrame) -> DataFrame:
    """Delivered orders whose delivery and estimate are both known."""
    return orders.where((F.col("is_delivered") == 1) & F.col("customer_delivered_ts").isNotNull()
                        & F.col("estimated_ts").isNotNull() & F.col("purchase_ts").isNotNull())


def with_delay(orders: DataFrame, buckets=DELAY_BUCKETS) -> DataFrame:
    """Whole hours of delay and the delay bucket. Hours truncate, so half an hour late is 0 and
    falls in the on-time bucket although the order's own flag says late."""
    h = hours_between("estimated_ts", "customer_delivered_ts")
    return (orders.withColumn("delay_hours", h)
            .withColumn("bucket_code", interval_bucket(F.col("delay_hours"), [(c, lo, hi) for c, _, lo, hi in buckets])))


EXACT_GROUP = 8     # a U test whose smaller group has at most so many values, and no ties, is exact
EXACT_PAIRS = 40_000   # and whose groups make at most so many pairs


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """Two-sided U test of group 0 against group 1: U of group 0, tie and continuity corrected normal p, or the exact p where
    a group is small and nothing is tied; z and p are NULL for an empty group or where all values are tied. Works on counts
    per distinct value, with average ranks."""
    v = (df.where(F.col(value).isNotNull() & F.col(group).isin(0, 1))
         .groupBy(F.col(value).cast("double").alias("v"))
         .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(group) == 0).alias("n0")))
    r = midranks(v, "v", "n")
    c = F.col("n").cast("double")
    g = r.agg(F.sum("n0").cast("double").alias("n0"), F.sum("n").cast("double").alias("n"),
              F.sum(F.col("n0") * F.col("mid_rank")).alias("_r"), F.sum(c * c * c - c).alias("tie_term"))
    n0, n1, n = F.col("n0"), F.col("n") - F.col("n0"), F.col("n")
    u = F.col("_r") - n0 * (n0 + 1) / 2
    sd = F.sqrt(n0 * n1 / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    z = (F.greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5) / F.when(sd > 0, sd)
    few = (F.least("n_0", "n_1") <= EXACT_GROUP) & (F.col("n_0") * F.col("n_1") <= EXACT_PAIRS)
    exact = F.col("z").isNotNull() & few & (F.col("tie_term") == 0)
    return (g.select(n0.cast("long").alias("n_0"), n1.cast("long").alias("n_1"), u.alias("u_statistic"),
                     "tie_term", z.alias("z"))
            .withColumn("p_value", F.when(exact, mann_whitney_exact_p(F.when(exact, F.col("u_statistic")), F.col("n_0"), F.col("n_1")))
                        .when(F.col("z").isNotNull(), F.least(
                            F.when(F.col("z") < 0, F.lit(1.0)).otherwise(two_sided_p(F.col("z"))), F.lit(1.0)))))


def spearman(df: DataFrame, x: str, y: str, normal: bool = False) -> DataFrame:
    """Rank correlation with average ranks on (x, y) counts. p is Student's with n - 2 degrees of freedom; with ``normal``
    its normal approximation, for thousands of rows."""
    pairs = cut_lineage(df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
                        .groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
                        .agg(F.count(F.lit(1)).alias("n")))
    rx = midranks(pairs.groupBy("x").agg(F.sum("n").alias("nx")), "x", "nx", "rx").select("x", "rx")
    ry = midranks(pairs.groupBy("y").agg(F.sum("n").alias("ny")), "y", "ny", "ry").select("y", "ry")
    n = F.col("n").cast("double")
    total = pairs.agg(F.sum("n").cast("double")).scalar()
    mid = (total + 1) / 2
    dx, dy = F.col("rx") - mid, F.col("ry") - mid
    g = (pairs.join(rx, "x").join(ry, "y")
         .agg(F.sum("n").alias("n"), F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"),
              F.sum(n * dy * dy).alias("yy")))
    rho = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    m = F.col("n").cast("double")
    t = F.col("rho") * F.sqrt(F.try_divide(m - 2, 1 - F.col("rho") * F.col("rho")))
    out = g.select("n", rho.alias("rho"))
    if normal:
        return out.withColumn("p_value", two_sided_p(t))
    t = F.when(F.abs(F.col("rho")) < 1, t).when(F.abs(F.col("rho")) >= 1, F.lit(float("inf")))
    return out.withColumn("p_value", student_t_p(t, F.col("n") - 2))


def dose_response(df: DataFrame, bucket: str = "bucket_code", value: str = "review_score",
                  control: str = DELAY_CONTROL, alpha: float = ALPHA) -> DataFrame:
    """Mean per bucket with a normal interval, and the difference to the control bucket with a
    Welch interval. One pass to (n, mean, variance); the control row is a scalar of that result."""
    v = F.col(value).cast("double")
    g = (df.where(F.col(bucket).isNotNull() & v.isNotNull()).groupBy(bucket)
         .agg(F.count(v).alias("n_orders"), F.avg(v).alias("avg_score"), F.var_samp(v).alias("_var")))
    base = g.where(F.col(bucket) == control).select(F.struct(
        F.col("avg_score").alias("m"), (F.col("_var") / F.col("n_orders")).alias("v"))).scalar()
    z = z_quantile(alpha)
    j = g.withColumns({"_cm": base.getField("m"), "_cv": base.getField("v")})
    se = F.sqrt(F.col("_var") / F.col("n_orders"))
    se_d = F.sqrt(F.col("_var") / F.col("n_orders") + F.col("_cv"))
    d = F.col("avg_score") - F.col("_cm")
    return (j.select(F.col(bucket), "n_orders", "avg_score", (F.col("avg_score") - z * se).alias("score_low"),
                     (F.col("avg_score") + z * se).alias("score_high"), d.alias("diff_vs_ontime"),
                     (d - z * se_d).alias("diff_low"), (d + z * se_d).alias("diff_high"))
            .withColumn("is_late", F.col(bucket).startswith("late").cast("int"))
            .withColumn("is_significant", ((F.col("diff_low") > 0) | (F.col("diff_high") < 0)).cast("int")))


def score_difference(df: DataFrame, group: str = "is_late", value: str = "review_score",
                     delay: str = "delay_hours", block: str = "d", b: int = B_DELIVERY,
                     seed: int = SEED) -> DataFrame:
    """Long metric table: group sizes, means, difference with interval, U test, rank correlation."""
    v = F.col(value).cast("double")
    s = df.agg(F.count_if(F.col(group) == 0).alias("n_on_time"), F.count_if(F.col(group) == 1).alias("n_late"),
               F.avg(F.when(F.col(group) == 0, v)).alias("mean_score_on_time"),
               F.avg(F.when(F.col(group) == 1, v)).alias("mean_score_late"))
    ci = block_mean_diff_ci(df, block, group, value, b, seed)
    u, r = mann_whitney(df, group, value), spearman(df, delay, value, normal=True)
    c = lambda n: F.col(n).cast("double")
    head = stack(s, "metric", "value", {
        "n_on_time": c("n_on_time"), "n_late": c("n_late"), "mean_score_on_time": c("mean_score_on_time"),
        "mean_score_late": c("mean_score_late"),
        "mean_diff": c("mean_score_late") - c("mean_score_on_time")}, [])
    return (head.unionByName(stack(ci, "metric", "value", {"mean_diff_ci_low": c("ci_low"),
                                                           "mean_diff_ci_high": c("ci_high")}, []))
            .unionByName(stack(u, "metric", "value", {"mw_u_statistic": c("u_statistic"),
                                                      "mw_p_value": c("p_value")}, []))
            .unionByName(stack(r, "metric", "value", {"spearman_delay_score": c("rho"),
                                                      "spearman_p_value": c("p_value")}, [])))


def weighted_rollup(value: str, weight: str) -> Column:
    """Weighted mean over the rows where the value is known."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return ratio(F.sum(F.col(value) * w), F.sum(w))


def proportion_tests(rows: DataFrame, k: str, n: str, family: list[str], overall: DataFrame, p0: str,
                     min_n: int, alpha: float = ALPHA) -> DataFrame:
    """Rate with Wilson interval, z and p against the overall rate, q per family. Rows under
    ``min_n`` keep the point estimate; their test columns stay NULL (not tested is not 0).

    ``rows`` and ``overall`` are result tables: one row per dimension value, one per family.
    """
    j = rows.join(overall, family, "left")
    lo, hi = wilson(F.col(k), F.col(n), alpha)
    rate = ratio(F.col(k), F.col(n))
    tested = F.col(n) >= min_n
    j = j.withColumns({"rate": rate, "rate_low": lo, "rate_high": hi,
                       "diff_vs_overall_pp": (rate - F.col(p0)) * 100,
                       "z_stat": F.when(tested, prop_z(F.col(k), F.col(n), F.col(p0)))})
    j = j.withColumn("p_value_raw", two_sided_p(F.col("z_stat")))
    j = bh_fdr(j, "p_value_raw", family, "p_value_fdr")
    return (j.withColumn("is_significant", (F.col("p_value_fdr") < alpha).cast("int")).drop(p0))


def bottleneck_table(base: DataFrame, min_orders: int = MIN_ORDERS_DIM, alpha: float = ALPHA) -> DataFrame:
    """Late rate per dimension value over the window, tested against the rate of its dimension."""
    base = cut_lineage(base)  # dimension x month rows, read for the rates and for the overall rate
    g = base.groupBy("dim_type", "dim_value").agg(
        F.sum("delivered_cnt").alias("delivered_cnt"), F.sum("late_cnt").alias("late_cnt"),
        F.sum("gmv").alias("gmv"), *[weighted_rollup(c, "delivered_cnt").alias(c) for c in
                                     ("avg_lastmile_hours", "avg_distance_km", "avg_review_score")])
    overall = base.groupBy("dim_type").agg(ratio(F.sum("late_cnt"), F.sum("delivered_cnt")).alias("p0"))
    return (proportion_tests(g, "late_cnt", "delivered_cnt", ["dim_type"], overall, "p0", min_orders, alpha)
            .withColumnRenamed("rate", "late_rate"))


def repeat_rate_table(base: DataFrame, overall_dim: str = "first_is_late",
                      min_customers: int = MIN_CUSTOMERS_DIM, alpha: float = ALPHA) -> DataFrame:
    """Repeat rate per experience value, tested against the overall rate, q per dimension."""
    base = cut_lineage(base)
    overall = (base.where(F.col("dim_type") == overall_dim)
               .agg(ratio(F.sum("repeat_customers"), F.sum("customers")).alias("p0")))
    fam = base.select("dim_type").distinct().withColumn("p0", overall.scalar())
    return (proportion_tests(base, "repeat_customers", "customers", ["dim_type"], fam, "p0", min_customers, alpha)
            .withColumnRenamed("rate", "repeat_rate"))


def stage_durations(df: DataFrame, stages=STAGES, group: str = "is_late", block: str = "d",
                    b: int = B_DELIVERY, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """Mean hours per stage for late and on-time orders with day-block intervals. Stages with
    only one of the groups are left out."""
    names = {s: f"{s}_hours" if s != "total" else "total_delivery_hours" for s in stages}
    long = stack(df.where(F.col(group).isin(0, 1)), "stage_code", "hours",
                 {s: F.col(c).cast("double") for s, c in names.items()}, [block, group])
    long = long.withColumn("group_code", F.when(F.col(group) == 1, "late").otherwise("on_time"))
    m = block_group_means(long, ["stage_code", "group_code"], block, "hours", b, seed, alpha, "stage")
    both = m.groupBy("stage_code").count().where("count = 2").select("stage_code")
    return m.join(both, "stage_code", "left_semi").withColumnRenamed("mean_value", "mean_hours")
