"""Subject and result tables built from the wide order table (definitions ours where noted)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import day_of, hours_between, month_start, ratio, weekday_index
from ..params import RISK_FEATURES
from ..sources.recovery import cut_lineage
from .compare import valid_deliveries, with_delay
from .history import prior_rates

__all__ = ["daily_revenue", "seller_table", "state_month", "fulfilment_monthly", "delay_profile",
           "bottleneck_base", "order_features", "intervention_pool", "strategy_month", "measured_params"]


def daily_revenue(orders: DataFrame) -> DataFrame:
    done = F.col("is_delivered") == 1
    return orders.groupBy(day_of("purchase_ts").alias("d")).agg(
        F.count(F.lit(1)).alias("order_cnt"), F.coalesce(F.sum("is_delivered"), F.lit(0)).alias("delivered_cnt"),
        F.coalesce(F.sum(F.when(done, F.col("order_amount"))), F.lit(0)).alias("gmv"))


def seller_table(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders, items, revenue, late share and mean score per seller over delivered orders."""
    per = items.groupBy("order_id", "seller_id").agg(
        F.count(F.lit(1)).alias("_q"), F.sum(F.col("price") + F.col("freight_value")).alias("_v"))
    o = orders.where("is_delivered = 1").select("order_id", "is_late", "review_score")
    return per.join(o, "order_id").groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("order_cnt"), F.sum("_q").alias("item_cnt"), F.sum("_v").alias("gmv"),
        F.avg("is_late").alias("late_rate"), F.avg("review_score").alias("avg_review_score"))


def state_month(orders: DataFrame) -> DataFrame:
    return (orders.where((F.col("is_delivered") == 1) & F.col("customer_state").isNotNull())
            .groupBy(month_start("purchase_ts").alias("stat_month"), "customer_state")
            .agg(F.count(F.lit(1)).alias("order_cnt"), F.countDistinct("customer_unique_id").alias("buyers"),
                 F.sum("order_amount").alias("gmv")))


def fulfilment_monthly(orders: DataFrame) -> DataFrame:
    """Delivered share, late rate and valid deliveries per month."""
    valid = (F.col("is_delivered") == 1) & F.col("customer_delivered_ts").isNotNull() & F.col("estimated_ts").isNotNull()
    g = (orders.where(F.col("purchase_ts").isNotNull()).groupBy(month_start("purchase_ts").alias("stat_month"))
         .agg(F.count(F.lit(1)).alias("order_cnt"), F.count_if(valid).alias("valid_cnt"),
              F.coalesce(F.sum("is_delivered"), F.lit(0)).alias("_done"),
              F.count_if(valid & (F.col("is_late") == 1)).alias("late_cnt")))
    return g.select("stat_month", "order_cnt", "valid_cnt", "late_cnt",
                    ratio(F.col("_done"), F.col("order_cnt")).alias("delivered_ratio"),
                    ratio(F.col("late_cnt"), F.col("valid_cnt")).alias("late_rate"))


def delay_profile(orders: DataFrame) -> DataFrame:
    """Orders, reviews, mean score and bad share per delay bucket."""
    d = with_delay(valid_deliveries(orders))
    return d.groupBy("bucket_code").agg(
        F.count(F.lit(1)).alias("n_orders"), F.count("review_score").alias("n_reviewed"),
        F.avg("review_score").alias("avg_score"), F.avg((F.col("review_score") <= 2).cast("int")).alias("bad_rate"))


def bottleneck_base(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Dimension x month base of valid deliveries. An order counts once in each category it has."""
    cols = ["order_id", "purchase_ts", "is_late", "lastmile_hours", "avg_distance_km", "review_score"]
    v = cut_lineage(valid_deliveries(orders).select(*cols, "customer_state", "order_amount"))  # read for both dimensions
    state = v.where(F.col("customer_state").isNotNull()).select(
        *cols, F.lit("state").alias("dim_type"), F.col("customer_state").alias("dim_value"), F.col("order_amount").alias("_v"))
    per = (items.where(F.col("category_en").isNotNull()).groupBy("order_id", "category_en")
           .agg(F.sum(F.col("price") + F.col("freight_value")).alias("_v")))
    cat = v.select(cols).join(per, "order_id").select(
        *cols, F.lit("category").alias("dim_type"), F.col("category_en").alias("dim_value"), "_v")
    return (state.unionByName(cat)
            .groupBy("dim_type", "dim_value", month_start("purchase_ts").alias("stat_month"))
            .agg(F.count(F.lit(1)).alias("delivered_cnt"), F.coalesce(F.sum("is_late"), F.lit(0)).alias("late_cnt"),
                 F.sum("_v").alias("gmv"), F.avg("lastmile_hours").alias("avg_lastmile_hours"),
                 F.avg("avg_distance_km").alias("avg_distance_km"), F.avg("review_score").alias("avg_review_score")))


def order_features(detail: DataFrame, order_sellers: DataFrame, items: DataFrame) -> DataFrame:
    """26 features per reviewed delivery, with seller and category history before the purchase."""
    base = (valid_deliveries(detail).where(F.col("review_score").isNotNull())
            .withColumn("is_bad", (F.col("review_score") <= 2).cast("int")))
    base = cut_lineage(base)  # the wide rows are read for the features and for both histories
    when = base.select("order_id", "purchase_ts", "is_bad")
    sellers = cut_lineage(order_sellers.join(when, "order_id"))
    cats = items.where(F.col("category_en").isNotNull()).select("order_id", "category_en").distinct()
    cats = cut_lineage(cats.join(when, "order_id"))
    f = (base.join(prior_rates(sellers, "seller_id", "order_id", "purchase_ts", "is_bad", "seller"), "order_id", "left")
         .join(prior_rates(cats, "category_en", "order_id", "purchase_ts", "is_bad", "cat"), "order_id", "left")
         .withColumns({
             "stat_month": month_start("purchase_ts"),
             "delay_hours": hours_between("estimated_ts", "customer_delivered_ts"),
             "estimated_hours": hours_between("purchase_ts", "estimated_ts"),
             "freight_ratio": ratio(F.col("freight_amount"), F.col("item_amount")),
             "dow": weekday_index("purchase_ts")}))
    return f.select("order_id", "stat_month", "is_bad", *[F.col(c).cast("double").alias(c) for c in RISK_FEATURES])


def intervention_pool(orders: DataFrame) -> DataFrame:
    """Reviewed deliveries with the strategies that would reach them: P1 late 3 to 7 days, P2 late
    over 3 days, P3 every late order (bounds ours)."""
    v = with_delay(valid_deliveries(orders)).where(F.col("review_score").isNotNull())
    h = F.col("delay_hours")
    return v.select("order_id", "customer_unique_id", month_start("purchase_ts").alias("stat_month"), "order_amount",
                    (F.col("review_score") <= 2).cast("int").alias("is_bad"), "is_late",
                    ((h > 72) & (h <= 168)).cast("int").alias("hit_p1_expedite"),
                    (h > 72).cast("int").alias("hit_p2_intercept"), (h > 0).cast("int").alias("hit_p3_voucher"))


def strategy_month(long_pool: DataFrame) -> DataFrame:
    """Strategy x month; its customer counts must not be added over months."""
    return long_pool.groupBy("strategy", "stat_month").agg(
        F.count(F.lit(1)).alias("covered_orders"), F.countDistinct("customer_unique_id").alias("covered_customers"),
        F.sum("order_amount").alias("covered_gmv"), F.sum("is_bad").alias("bad_orders"))


def measured_params(pool: DataFrame, assumed: dict[str, float]) -> DataFrame:
    """Strategy parameter table: late and on-time bad rates and order values are measured on the
    pool, the rest is assumed and passed in. Returns (param_key, param_value, is_measured)."""
    late, on_time = F.col("is_late") == 1, F.col("is_late") == 0
    amount = F.col("order_amount").cast("double")
    m = pool.agg(F.avg(F.when(late, amount)).alias("aov_delayed"), F.avg(F.when(on_time, amount)).alias("aov_ontime"),
                 (F.avg(F.when(late, F.col("is_bad"))) * 100).alias("baseline_bad_late"),
                 (F.avg(F.when(on_time, F.col("is_bad"))) * 100).alias("baseline_bad_ontime"))
    rows = [F.struct(F.lit(k).alias("param_key"), F.col(k).alias("param_value"), F.lit(1).alias("is_measured"))
            for k in m.columns]
    rows += [F.struct(F.lit(k).alias("param_key"), F.lit(float(v)).alias("param_value"), F.lit(0).alias("is_measured"))
             for k, v in assumed.items()]
    return m.select(F.inline(F.array(*rows)))
