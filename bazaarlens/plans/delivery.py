"""Delivery experience: delay against score, bottlenecks, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import day_of
from ..operators import compare as C
from ..operators import marts as M
from ..operators import panels as P
from ..operators import quality as Q
from ..operators import trend as E
from ..params import B_DELIVERY, MIN_ORDERS_COMPLETE_MONTH, MIN_ORDERS_DIM, SEED
from ..sources.recovery import cut_lineage
from .revenue import analysis_window

__all__ = ["scored_deliveries", "delay_impact", "late_rate_trend", "bottlenecks", "stage_report"]


def scored_deliveries(orders: DataFrame, min_orders=MIN_ORDERS_COMPLETE_MONTH) -> DataFrame:
    _, window = analysis_window(orders, min_orders)
    v = C.valid_deliveries(P.within(orders, window)).where(F.col("review_score").isNotNull())
    keep = ["order_id", day_of("purchase_ts").alias("d"), "is_late", "review_score", "delay_hours", "bucket_code"]
    return cut_lineage(C.with_delay(v).select(*keep))  # joined once, read by every statistic


def delay_impact(orders: DataFrame, min_orders=MIN_ORDERS_COMPLETE_MONTH, b: int = B_DELIVERY, seed: int = SEED,
                 checks: bool = True) -> dict[str, DataFrame]:
    """Dose response by delay bucket and the overall late / on-time comparison."""
    v = scored_deliveries(orders, min_orders)
    if checks:
        Q.expect(v.agg(F.count_if(F.col("bucket_code").isNull()).alias("n")), F.col("n") == 0,
                 "orders outside every delay bucket")
    return {"dose": C.dose_response(v), "difference": C.score_difference(v, b=b, seed=seed)}


def late_rate_trend(orders: DataFrame, min_orders=MIN_ORDERS_COMPLETE_MONTH, min_ratio: float | None = None) -> DataFrame:
    """Trend of the monthly late rate without truncated months, with first, last and mean rate."""
    _, window = analysis_window(orders, min_orders)
    m = P.within(M.fulfilment_monthly(orders), window, ts=None)
    m = cut_lineage(m)
    kept = (Q.drop_truncated(m) if min_ratio is None else Q.drop_truncated(m, floor=min_ratio)).withColumn("series", F.lit("late_rate"))
    ends = kept.groupBy("series").agg(F.min_by("late_rate", "stat_month").alias("first_rate"),
                                      F.max_by("late_rate", "stat_month").alias("last_rate"),
                                      F.avg("late_rate").alias("mean_rate"))
    return ends.join(E.mann_kendall(kept, ["series"], "stat_month", "late_rate"), "series", "left")


def bottlenecks(detail: DataFrame, items: DataFrame, min_orders=MIN_ORDERS_COMPLETE_MONTH,
                min_dim: int = MIN_ORDERS_DIM) -> DataFrame:
    """Late rate per category and state, tested against its dimension with q values."""
    _, window = analysis_window(detail, min_orders)
    base = M.bottleneck_base(P.within(detail, window), items)
    return Q.expect(C.bottleneck_table(base, min_dim), F.col("late_cnt") <= F.col("delivered_cnt"),
                    "more late than delivered orders")


def stage_report(orders: DataFrame, min_orders=MIN_ORDERS_COMPLETE_MONTH, b: int = B_DELIVERY, seed: int = SEED) -> DataFrame:
    _, window = analysis_window(orders, min_orders)
    v = C.valid_deliveries(P.within(orders, window)).withColumn("d", day_of("purchase_ts"))
    return C.stage_durations(v, b=b, seed=seed)
