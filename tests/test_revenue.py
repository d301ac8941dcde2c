"""Attribution identities and bootstrap behaviour."""
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import decompose as D
from bazaarlens.operators import panels as P
from bazaarlens.operators import resample as B


def _lmdi(spark, rows):
    df = spark.createDataFrame(rows, "v0 double, v1 double, a0 double, a1 double, b0 double, b1 double, c0 double, c1 double")
    parts = D.lmdi(F.col("v0"), F.col("v1"), {x: (F.col(f"{x}0"), F.col(f"{x}1")) for x in "abc"})
    return df.select("v0", "v1", *[c.alias(n) for n, c in parts.items()]).collect()


def test_lmdi_has_no_residual(spark):
    rnd = random.Random(0)
    rows = []
    for _ in range(2000):
        x0 = [rnd.uniform(0.5, 500) for _ in range(3)]
        x1 = [x * rnd.uniform(0.5, 2) for x in x0]
        rows.append((math.prod(x0), math.prod(x1), x0[0], x1[0], x0[1], x1[1], x0[2], x1[2]))
    worst = max(abs(r.a + r.b + r.c - (r.v1 - r.v0)) / max(1, abs(r.v1 - r.v0)) for r in _lmdi(spark, rows))
    assert worst < 1e-11


def test_lmdi_hand_cases(spark):
    one, two, same, bad = _lmdi(spark, [
        (100.0, 110.0, 10.0, 11.0, 1.0, 1.0, 10.0, 10.0), (5000.0, 6600.0, 50.0, 60.0, 1.0, 1.0, 100.0, 110.0),
        (100.0, 100.0, 10.0, 20.0, 1.0, 0.5, 10.0, 10.0), (0.0, 100.0, 1.0, 2.0, 1.0, 1.0, 1.0, 1.0)])
    assert (one.a, one.b, one.c) == pytest.approx((10, 0, 0), abs=1e-9)
    assert two.a == pytest.approx(1600 * math.log(1.2) / (math.log(1.2) + math.log(1.1)))
    assert (same.a, same.b, same.c) == (0, 0, 0)  # equal totals give zeros even when factors moved
    assert bad.a is None


def _two_months(spark):
    rows = []
    for m, (buyers, money) in ((1, (5, 100.0)), (2, (6, 110.0))):
        for day in range(1, 11):
            for k in range(buyers):
                rows.append((dt.date(2018, m, 1), dt.date(2018, m, day), f"{m}-{day}-{k}", 1, money))
    return spark.createDataFrame(rows, "stat_month date, d date, customer_unique_id string, delivered_cnt int, gmv double")


def test_every_replicate_adds_up_and_buyers_are_not_double_counted(spark):
    daily = _two_months(spark)
    out = B.bootstrap_lmdi(daily, P.month_pairs(daily), b=50, seed=1)
    assert out.agg(F.max("max_residual")).first()[0] < 1e-6
    # one customer on every day: any replicate has exactly one buyer
    same = daily.withColumn("customer_unique_id", F.lit("x"))
    assert {r.buyers for r in B.bootstrap_states(same, 20, 3).collect()} == {1}
    # all different: buyers are those of the distinct days drawn, fewer than the orders drawn
    s = B.bootstrap_states(daily, 20, 3).collect()
    assert all(r.buyers <= r.delivered_cnt for r in s) and any(r.buyers < r.delivered_cnt for r in s)


def test_bootstrap_does_not_depend_on_partitions(spark):
    daily = _two_months(spark)
    res = []
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        res.append(sorted(map(tuple, B.bootstrap_lmdi(daily.repartition(int(n)), P.month_pairs(daily), b=30, seed=9)
                              .select("factor", F.round("ci_low", 6), F.round("ci_high", 6)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1] == res[2]


def test_structure_contributions_add_up(spark):
    rnd = random.Random(4)
    rows = [(dt.date(2018, m, 1), dt.date(2018, m, d), f"c{k}", round(rnd.uniform(0, 100), 2))
            for m in (1, 2) for d in range(1, 11) for k in range(4)]
    daily = spark.createDataFrame(rows, "stat_month date, d date, dim_value string, gmv double")
    base = P.dim_month(daily)
    pairs = P.month_pairs(base)
    c = D.structure_contribution(base, pairs)
    got = c.agg(F.sum("contrib_pp"), F.sum("gmv"), F.sum("gmv_prev")).first()
    assert got[0] == pytest.approx((got[1] - got[2]) / got[2] * 100, abs=1e-9)
    ci = B.bootstrap_contrib(daily, pairs, 50, 1)
    assert ci.count() == 4 and ci.where("ci_low > ci_high").count() == 0


def _aov(spark, q0, a0, q1, a1, f0, f1, o0, o1):
    m0, m1 = dt.date(2018, 1, 1), dt.date(2018, 2, 1)
    cats = [(m, f"c{i}", float(q), float(a)) for m, qs, as_ in ((m0, q0, a0), (m1, q1, a1)) for i, (q, a) in enumerate(zip(qs, as_)) if q]
    tot = [(m0, float(o0), float(sum(q0)), float(sum(a0)), float(f0)), (m1, float(o1), float(sum(q1)), float(sum(a1)), float(f1))]
    cm = spark.createDataFrame(cats, "stat_month date, category_en string, item_cnt double, item_amount double")
    t = spark.createDataFrame(tot, "stat_month date, delivered_orders double, item_cnt double, item_amount double, freight_amount double")
    inp = D.aov_inputs(cm, t, P.month_pairs(t))
    return {r.factor: r for r in D.aov_effects(inp).collect()}, D.aov_detail(inp).collect()


def test_aov_effects_add_up(spark):
    rnd = random.Random(7)
    for _ in range(3):
        k = rnd.randint(3, 8)
        q0, q1 = [rnd.randint(10, 500) for _ in range(k)], [rnd.randint(10, 500) for _ in range(k)]
        p0 = [rnd.uniform(5, 300) for _ in range(k)]
        e, _ = _aov(spark, q0, [q * p for q, p in zip(q0, p0)], q1, [q * p * rnd.uniform(.7, 1.3) for q, p in zip(q1, p0)],
                    rnd.uniform(50, 5000), rnd.uniform(50, 5000), sum(q0) // 2 + 1, sum(q1) // 2 + 1)
        d = e["price"].delta_aov
        assert sum(r.contribution_amount for r in e.values()) == pytest.approx(d, rel=1e-9, abs=1e-9)


def test_aov_boundary_cases(spark):
    same, _ = _aov(spark, (100, 150), (1000, 3000), (120, 130), (1200, 2600), 200, 300, 100, 110)
    assert abs(same["price"].contribution_amount) < 1e-9
    new, detail = _aov(spark, (100, 100, 0), (1000, 2000, 0), (100, 100, 100), (1000, 2000, 5000), 200, 300, 100, 150)
    assert abs(new["price"].contribution_amount) < 1e-9 and new["mix"].contribution_amount > 0
    assert {r.category_en: r.price_prev for r in detail}["c2"] == 0  # real price, not the filled one
    lost, _ = _aov(spark, (100, 100, 100), (1000, 2000, 5000), (100, 100, 0), (1000, 2000, 0), 200, 300, 100, 100)
    assert abs(lost["price"].contribution_amount) < 1e-9 and lost["mix"].contribution_amount < 0
