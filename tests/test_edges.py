"""Rows and groups that are missing, empty or doubled; fitted risk models; the topic plans."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens import functions as fn
from bazaarlens.operators import compare as C
from bazaarlens.operators import ordering as O
from bazaarlens.operators import risk as R
from bazaarlens.operators import segment as S
from bazaarlens.operators import strategy as X
from bazaarlens.operators import survival as V
from bazaarlens.plans import customers, delivery, revenue
from bazaarlens.sources import Canonical
from bazaarlens.sources import writers as W

BASE = "/root/testdata/sf0.001"


def test_a_strategy_without_hits_keeps_its_row(spark):
    pool = spark.createDataFrame([(1, "a", 10.0, 1, 0, 0, 1), (2, "a", 5.0, 0, 0, 0, 1)],
                                 "order_id int, customer_unique_id string, order_amount double, is_bad int, hit_p1_expedite int, hit_p2_intercept int, hit_p3_voucher int")
    got = {r.strategy: tuple(r)[1:] for r in X.strategy_coverage(pool).collect()}
    assert got == {"p1_expedite": (0, 0, 0.0, 0), "p2_intercept": (0, 0, 0.0, 0), "p3_voucher": (2, 1, 15.0, 1)}


def test_all_eight_cells(spark):
    profile = spark.createDataFrame([("a", 10, 1, 5.0), ("b", 400, 3, 50.0)], "customer_unique_id string, recency_days int, order_cnt long, monetary double")
    got = {r.rfm_code: (r.customers, r.monetary, r.avg_order_cnt, r.thr_recency_days) for r in S.rfm_summary(S.rfm_cells(profile)).collect()}
    assert len(got) == 8 and got["000"] == (0, 0.0, None, 180) and got["100"] == (1, 5.0, 1.0, 180) and got["011"][0] == 1


def test_updates_never_multiply_rows(spark):
    target = spark.createDataFrame([(1, 0.1)], "k int, v double")
    with pytest.raises(ValueError):
        W.update_columns(target, spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, v double"), "k", ["v"])


def test_contract_compares_types(spark):
    df = spark.createDataFrame([(1.9, 1)], "x double, y int")
    schema = lambda x, y: T.StructType([T.StructField("x", x), T.StructField("y", y)])
    for bad in (schema(T.IntegerType(), T.IntegerType()), schema(T.DoubleType(), T.ShortType()), schema(T.FloatType(), T.IntegerType()), schema(T.DoubleType(), T.DecimalType(8, 0))):
        with pytest.raises(ValueError):
            W.check_contract(df, bad)
    assert W.check_contract(df, schema(T.DoubleType(), T.LongType())).dtypes == [("x", "double"), ("y", "bigint")]
    assert W.check_contract(df, schema(T.DoubleType(), T.DecimalType(12, 2))).count() == 1


def test_replace_may_read_its_target_and_survives_a_failed_job(spark, tmp_path):
    t = str(tmp_path / "t")
    W.replace(spark.range(5).toDF("x"), t)
    assert W.replace(spark.read.parquet(t).where("x > 1"), t) == 3
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("x"))
    with pytest.raises(Exception):
        W.replace(broken, t)
    assert W.stored_count(spark, t) == 3


def test_rank_test_without_a_group(spark):
    for rows in ([(0, 1.0), (0, 2.0)], [(0, 3.0), (1, 3.0), (1, 3.0)]):
        r = C.mann_whitney(spark.createDataFrame(rows, "g int, v double"), "g", "v").first()
        assert r.z is None and r.p_value is None


def test_unknown_stays_unknown(spark):
    got = V.censor_at(spark.createDataFrame([(0, None, None), (0, None, 40), (1, 3, None)], "event int, days_to_repeat int, tenure_days int")).collect()
    assert [(r.obs_days, r.obs_event) for r in got] == [(None, 0), (40, 0), (3, 1)]
    n = F.lit(None).cast("double")
    row = spark.range(1).select(fn.clipped_log1p(n), fn.scalars.logit(n), fn.great_circle_km(n, n, n, n), fn.clipped_log1p(F.lit(-1.0))).first()
    assert tuple(row) == (None, None, None, 0.0)


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE_ROWS", 10)
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("v"))
    assert O._range_count(df) == 50
    got = O.ranked(df, "v", "id", out="r").orderBy("r").collect()
    assert [r.r for r in got] == list(range(1, 501)) and all(a.v <= b.v for a, b in zip(got, got[1:]))


def test_silhouette_of_labels(spark):
    rng = np.random.default_rng(3)
    x, lab = rng.normal(size=(60, 2)), rng.integers(0, 3, 60)
    lab[0] = 9  # alone in its cluster
    df = spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(x, lab)], "a double, b double, k int")
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    s = []
    for i in range(60):
        own = (lab == lab[i])
        if own.sum() == 1:
            s.append(0.0)
            continue
        a, b = d[i][own].sum() / (own.sum() - 1), min(d[i][lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert S.silhouette(df, ["a", "b"], "k").first()[0] == pytest.approx(np.mean(s))
    assert S.silhouette(df.withColumn("k", F.lit(1)), ["a", "b"], "k").first()[0] == 0


def test_risk_models(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        x, y, z = rng.normal(size=3)
        bad = int(rng.random() < 1 / (1 + math.exp(-2.5 * x)))
        rows.append((f"o{i}", bad, float(x), None if i % 9 == 0 else float(y), float(z)))
    df = spark.createDataFrame(rows, "order_id string, is_bad int, x double, y double, z double")
    train, test = df.where("cast(substr(order_id, 2) as int) < 1000"), df.where("cast(substr(order_id, 2) as int) >= 1000")
    prep = R.prepare(train, ["x", "y", "z"])
    models = {"logreg": (R.fit_logistic(train, prep), False), "boosted": (R.fit_boosted(train, prep, rounds=10, depth=2), True)}
    scored = {n: R.score(m, test, prep, b, ["order_id", "is_bad"]).withColumn("model", F.lit(n)) for n, (m, b) in models.items()}
    for s in scored.values():
        assert R.roc_auc(s).first()[0] > 0.85
    both = scored["logreg"].unionByName(scored["boosted"])
    told = {(r.model, r.metric): r.value for r in R.evaluation(both, both).collect()}
    assert told["boosted", "roc_auc"] > 0.85 and told["logreg", "n_test"] == 500 and 0 < told["logreg", "precision_at_thr"] <= 1
    weight = {r.feature: r.importance for r in R.permutation_importance(models["boosted"][0], test, prep, True, 2).collect()}
    assert set(weight) == {"x", "y", "z"} and weight["x"] > 0.1 > abs(weight["z"])
    coef = R.coefficient_importance(models["logreg"][0], prep, spark).orderBy("rank_no").first()
    assert coef.feature == "x"


def test_topic_plans_run_with_their_checks(spark):
    c = Canonical(spark, BASE)
    orders, items = c.orders_wide(), c.order_items()
    assert revenue.revenue_attribution(orders, min_orders=5) is not None
    assert revenue.structure_report(orders, items, min_orders=5) is not None
    assert delivery.delay_impact(orders, min_orders=5) is not None
    broken = orders.withColumn("order_amount", F.when(F.col("order_id") % 2 == 0, -F.col("order_amount")).otherwise(F.col("order_amount")))
    with pytest.raises(Exception):
        customers.cluster_evaluation(S.user_profile(broken).withColumn("monetary", -F.abs("monetary")), ks=(2,), restarts=1)
