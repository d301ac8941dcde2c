"""Customer value: rule cells against clusters, repeat purchase, matched effect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from ..operators import compare as C
from ..operators import quality as Q
from ..operators import segment as S
from ..operators import survival as V
from ..params import CLUSTER_KS, CLUSTER_RESTARTS, SEED
from ..sources.recovery import cut_lineage

__all__ = ["first_order_columns", "survival_input", "cluster_evaluation", "repeat_rates"]

def first_order_columns() -> dict:
    c = F.col
    return {"first_is_late": c("is_late"), "first_review_score": c("review_score"), "first_amount": c("order_amount"),
            "first_item_cnt": c("item_cnt"), "first_seller_cnt": c("seller_cnt"), "first_dist_km": c("avg_distance_km"),
            "first_installments": c("max_installments"), "first_pay_type_cnt": c("pay_type_cnt"),
            "first_freight_ratio": ratio(c("freight_amount"), c("item_amount")), "first_state": c("customer_state")}


def survival_input(detail: DataFrame, checks: bool = False) -> DataFrame:
    """One row per customer with a delivered order."""
    first = V.first_orders(detail.where("is_delivered = 1"), first_order_columns())
    if checks:
        Q.expect(Q.domain_violations(first, {
            "repeat_has_gap": (F.col("event") == 0) | F.col("days_to_repeat").isNotNull(),
            "tenure_not_negative": F.col("tenure_days") >= 0}), F.col("violations") == 0, "survival input is broken")
    return first


def repeat_rates(first: DataFrame) -> DataFrame:
    return C.repeat_rate_table(V.experience_base(first))


def cluster_evaluation(profile: DataFrame, ks=CLUSTER_KS, restarts: int = CLUSTER_RESTARTS, seed: int = SEED) -> DataFrame:
    """Long table: silhouettes, best K, agreement with the rule cells, the quintile groups and a
    clustering without frequency, cluster sizes and the cell x cluster table."""
    key = "customer_unique_id"
    base = cut_lineage(S.rfm_segments(S.rfm_cells(profile.dropna(subset=list(S.RFM_COLUMNS)))))
    Q.expect(Q.domain_violations(base, {
        "monetary": F.col("monetary") >= 0, "order_cnt": F.col("order_cnt") >= 1, "recency": F.col("recency_days") >= 0,
        "cell": F.col("rfm_code").rlike("^[01]{3}$")}), F.col("violations") == 0, "customer profile is broken")
    z = cut_lineage(S.log_standardise(base, S.RFM_COLUMNS))
    three, two = [f"z_{c}" for c in S.RFM_COLUMNS], ["z_recency_days", "z_monetary"]
    models = S.kmeans_sweep(z, key, three, ks, restarts, seed)
    sil = S.silhouettes(z, three, models)
    best = min(k for k in sil if sil[k] == max(sil.values()))
    small = S.kmeans_sweep(z, key, two, (best,), restarts, seed)
    lab = S.assign(S.assign(z, three, models[best]["centres"]), two, small[best]["centres"], "cluster_rm")
    lab = cut_lineage(lab.drop(*three))
    sil_rm = S.silhouettes(z, two, small)[best]
    spark = profile.sparkSession
    fixed = spark.createDataFrame(
        [("kmeans", "silhouette", f"k={k}", float(v)) for k, v in sorted(sil.items())]
        + [("kmeans", "best_k", "best", float(best)), ("kmeans", "silhouette", "rm_only", float(sil_rm))],
        "method string, metric string, label string, value double")
    def ari(other, name):
        return S.adjusted_rand(lab, other, "cluster").select(
            F.lit("kmeans").alias("method"), F.lit("ari").alias("metric"), F.lit(name).alias("label"), F.col("ari").alias("value"))
    values = {"cluster_size": "customers", **{c: c for c in ("avg_recency", "avg_monetary", "med_monetary", "avg_order_cnt", "repeat_rate", "share_pct")}}
    prof = S.cluster_profile(lab).select(
        F.concat(F.lit("cluster="), F.col("cluster").cast("string")).alias("label"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in values.items()]))).select(
        F.lit("cluster_profile").alias("method"), "metric", "label", "value")
    cross = S.crosstab(lab, "rfm_code", "cluster").select(
        F.lit("cross_tab").alias("method"), F.concat(F.lit("cluster"), F.col("cluster").cast("string")).alias("metric"),
        F.concat(F.lit("rfm="), F.col("rfm_code")).alias("label"), F.col("n").cast("double").alias("value"))
    parts = [fixed, ari("rfm_code", "vs_rfm_cells"), ari("rfm_segment", "vs_rfm_segment"), ari("cluster_rm", "vs_rm_only"),
             prof, cross]
    return reduce(lambda a, b: a.unionByName(b), parts)
