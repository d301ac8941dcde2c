"""Trend, change points, proportions, ranks, survival and cluster statistics."""
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens import functions as fn
from bazaarlens.operators import compare as C
from bazaarlens.operators import ordering as O
from bazaarlens.operators import segment as S
from bazaarlens.operators import survival as V
from bazaarlens.operators import trend as E


def _series(spark, **ys):
    return spark.createDataFrame([(k, t, float(y)) for k, s in ys.items() for t, y in enumerate(s)], "k string, t int, y double")


def test_mann_kendall(spark):
    rnd = random.Random(2)
    df = _series(spark, up=[i + rnd.gauss(0, .1) for i in range(12)], down=range(12, 0, -1), n4=(100, 120, 150, 190),
                 n5=(100, 120, 150, 190, 240), n6=(100, 120, 150, 190, 240, 300), n3=(1, 2, 3),
                 spike=(10, 11, 12, 13, 900, 15, 16, 17, 18, 19), flat=[5.0] * 8, gap=(1, 2, float("nan"), 3, 4, 5))
    r = {x.k: x for x in E.mann_kendall(df, ["k"], "t", "y").collect()}
    assert r["up"].trend == r["n5"].trend == r["n6"].trend == r["spike"].trend == "increasing"
    assert r["down"].trend == "decreasing" and r["n4"].trend == "insufficient" and not r["n4"].can_detect
    assert r["n3"].trend == "too few" and r["n3"].p_value is None
    assert r["spike"].s == 35 and r["flat"].z == 0 and r["gap"].n == 5
    assert r["n4"].min_p == pytest.approx(0.0894, abs=1e-3) and r["n5"].min_p == pytest.approx(0.0275, abs=1e-3)


def _segment(y, lo=3, most=4):
    """Serial reference for the parallel rounds: try every cut of every segment."""
    y, n = np.asarray(y, float), len(y)
    cost = lambda s: ((s - s.mean()) ** 2).sum()
    if n < 2 * lo or np.ptp(y) <= 1e-12 * max(1, abs(y.mean())):
        return []
    limit, segs, found = cost(y) / n * math.log(n), [(0, n)], []
    while len(found) < most:
        tries = [(cost(y[a:b]) - cost(y[a:c]) - cost(y[c:b]), -i, -c) for i, (a, b) in enumerate(segs) for c in range(a + lo, b - lo + 1)]
        if not tries or max(tries)[0] <= limit:
            break
        _, i, c = max(tries)
        a, b = segs.pop(-i)
        segs += [(a, -c), (-c, b)]
        found.append(-c)
    return sorted(found)


def test_change_points(spark):
    rng = np.random.default_rng(5)
    ys = {"step": np.log([100.0] * 10 + [50.0] * 10), "flat": np.log([100.0] * 20), "short": [1, 2, 3, 4, 5],
          "three": np.repeat([1.0, 5.0, 2.0, 9.0], 8) + rng.normal(0, .2, 32)}
    ys |= {f"r{i}": rng.normal(0, 1, 30) + (np.arange(30) > rng.integers(5, 25)) * rng.uniform(0, 4) for i in range(6)}
    got = {k: [] for k in ys}
    for r in E.change_points(_series(spark, **ys), ["k"], "t", "y").where("breakpoint_flag = 1").collect():
        got[r.k].append(r.idx)
    assert {k: sorted(v) for k, v in got.items()} == {k: _segment(v) for k, v in ys.items()}
    assert sorted(got["step"]) == [10] and got["flat"] == []


def test_log_slope(spark):
    df = _series(spark, g=[100 * 1.1 ** i for i in range(12)], few=(1, 2), neg=(-1, 1, 2, 4))
    r = {x.k: x.slope_log for x in E.log_slope(df, ["k"], "t", "y").collect()}
    assert math.exp(r["g"]) == pytest.approx(1.1, abs=1e-6) and r["few"] is None
    assert r["neg"] == pytest.approx(math.log(2))  # re-indexed after dropping the non-positive point


def test_wilson_and_tails(spark):
    df = spark.createDataFrame([(95, 396), (0, 10), (0, 0)], "k int, n int")
    lo, hi = fn.wilson(F.col("k"), F.col("n"))
    a, b, c = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert a.lo == pytest.approx(.2005, abs=5e-4) and a.hi == pytest.approx(.2843, abs=5e-4)
    assert b.lo >= -1e-12 and c.lo is None
    r = spark.createDataFrame([(3, 10), (0, 0), (5, 10)], "k int, n int").select(fn.binomial_p(F.col("k"), F.col("n")).alias("p")).collect()
    assert [x.p for x in r] == [pytest.approx(0.34375), None, 1.0]
    z = spark.createDataFrame([(1.959963984540054,), (0.0,), (None,)], "z double").select(fn.two_sided_p(F.col("z")).alias("p")).collect()
    assert [x.p for x in z] == [pytest.approx(.05), 1.0, None]


def test_bh(spark):
    ps = [.001, .02, .03, .9, None]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "f string, i int, p double")
    q = [r.q_value for r in fn.bh_fdr(df, "p", ["f"]).orderBy("i").collect()]
    assert q[4] is None and q[:4] == pytest.approx([.004, .04, .04, .9])


def test_hours_truncate_and_bucket(spark):
    df = spark.sql("select timestamp_ntz'2018-01-10 00:00:00' e, timestamp_ntz'2018-01-10 00:30:00' a, timestamp_ntz'2018-01-09 21:30:00' b")
    r = df.select(fn.hours_between("e", "a"), fn.hours_between("e", "b")).first()
    assert tuple(r) == (0, -2)
    from bazaarlens.params import DELAY_BUCKETS
    bounds = [(c, lo, hi) for c, _, lo, hi in DELAY_BUCKETS]
    got = spark.createDataFrame([(x,) for x in (-240, -239, -72, 0, 1, 72, 73, 168, 336, 337)], "h int").select(
        fn.interval_bucket(F.col("h"), bounds).alias("b")).collect()
    assert [g.b for g in got] == ["early_10p", "early_3_10", "early_3_10", "early_0_3", "late_0_3", "late_0_3", "late_3_7",
                                  "late_3_7", "late_7_14", "late_14p"]


def test_ranks_without_one_partition(spark):
    rnd = random.Random(8)
    rows = [(f"i{i}", rnd.choice([0.0, 0.0, 0.0, round(rnd.random(), 3)])) for i in range(3000)]  # one heavy value
    df = spark.createDataFrame(rows, "id string, v double")
    got = sorted((r.rank_no, r.v) for r in O.ranked(df, "v", "id").collect())
    assert [g[0] for g in got] == list(range(1, 3001)) and [g[1] for g in got] == sorted(v for _, v in rows)
    tiles = [r["count"] for r in O.ntile(df, "v", "id", 7).groupBy("tile").count().orderBy("tile").collect()]
    assert tiles == [429] * 4 + [428] * 3
    q = O.quantiles(df, "v", {"a": .25, "b": .9}).first()
    want = np.quantile([v for _, v in rows], [.25, .9])
    assert (q.a, q.b) == pytest.approx(tuple(want))


def test_rank_tests(spark):
    rnd = random.Random(3)
    x = [(i % 3 == 0, rnd.randint(1, 5)) for i in range(400)]
    df = spark.createDataFrame([(int(g), s) for g, s in x], "g int, s int")
    r = C.mann_whitney(df, "g", "s").first()
    a, b = [s for g, s in x if not g], [s for g, s in x if g]
    u = sum((p > q) + .5 * (p == q) for p in a for q in b)
    assert r.u_statistic == u and 0 <= r.p_value <= 1
    pts = [(rnd.randint(0, 20), rnd.random()) for _ in range(300)]
    rank = lambda v: [sum(o < w for o in v) + (sum(o == w for o in v) + 1) / 2 for w in v]
    want = np.corrcoef(rank([p[0] for p in pts]), rank([p[1] for p in pts]))[0, 1]
    assert C.spearman(spark.createDataFrame(pts, "a int, b double"), "a", "b").first().rho == pytest.approx(want)


def test_kaplan_meier(spark):
    full = spark.createDataFrame([("full", i, 1) for i in range(1, 6)] + [("cens", i, int(i != 4)) for i in range(1, 6)]
                                 + [("none", i, 0) for i in range(1, 4)], "g string, t int, e int")
    r = {}
    for x in V.kaplan_meier(full, "t", "e", ["g"]).orderBy("g", "t_days").collect():
        r.setdefault(x.g, []).append(x)
    assert [x.surv for x in r["full"]] == [.8, .6, .4, .2, 0.0] and "none" not in r
    assert len(r["cens"]) == 4 and r["cens"][-1].at_risk == 1
    z, v = fn.z_quantile(), math.sqrt(.05 / math.log(.8) ** 2)
    assert r["full"][0].ci_low == pytest.approx(.8 ** math.exp(z * v), abs=1e-6)
    assert r["full"][0].ci_high == pytest.approx(.8 ** math.exp(-z * v), abs=1e-6)
    assert (r["full"][-1].ci_low, r["full"][-1].ci_high) == (0, 0)
    assert V.median_time(V.kaplan_meier(full, "t", "e", ["g"]), ["g"]).where("g = 'full'").first().median_days == 3


def test_logrank(spark):
    rows = [("s", t, 1, int(t > 2)) for t in range(1, 5)] + [("n", t, 1, g) for t in range(1, 5) for g in (0, 1)]
    r = {x.k: x for x in V.logrank(spark.createDataFrame(rows, "k string, t int, e int, g int"), "t", "e", "g", ["k"]).collect()}
    assert r["s"].chi2 == pytest.approx(2.882353, abs=1e-5) and r["s"].p_value == pytest.approx(.0895552, abs=1e-5)
    assert r["n"].chi2 == pytest.approx(0, abs=1e-9) and r["n"].p_value == pytest.approx(1)


def test_censoring(spark):
    df = spark.createDataFrame([(1, 10, 100), (1, 500, 900), (0, None, 40), (0, None, 0), (1, 0, 5)], "event int, days_to_repeat int, tenure_days int")
    got = [(r.obs_days, r.obs_event) for r in V.censor_at(df).collect()]
    assert got == [(10, 1), (365, 0), (40, 0), (1, 0), (1, 1)]


def test_scaling_and_agreement(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, float(rng.gamma(2, 60)), int(rng.integers(2, 6)) if rng.random() < .03 else 1, float(rng.lognormal(5, 1.2)))
                                for i in range(500)], "customer_unique_id int, recency_days double, order_cnt int, monetary double")
    z = S.log_standardise(df, S.RFM_COLUMNS)
    for c in S.RFM_COLUMNS:
        m, s = z.agg(F.avg(f"z_{c}"), F.stddev_pop(f"z_{c}")).first()
        assert m == pytest.approx(0, abs=1e-9) and s == pytest.approx(1)
    same = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 2), ("c", 3)], "x string, y int")
    assert S.adjusted_rand(same, "x", "y").first().ari == pytest.approx(1)
    anti = spark.createDataFrame(list(itertools.product("ab", (1, 2))), "x string, y int")
    assert S.adjusted_rand(anti, "x", "y").first().ari < 0


def test_kmeans_finds_separated_groups(spark):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(c, .2, (60, 2)) for c in ((0, 0), (5, 5), (0, 8))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, a double, b double")
    m = S.kmeans_sweep(df, "id", ["a", "b"], (2, 3, 4), restarts=4, seed=3)
    sil = S.silhouettes(df, ["a", "b"], m)
    assert max(sil, key=sil.get) == 3
    lab = S.assign(df, ["a", "b"], m[3]["centres"])
    assert sorted(r["count"] for r in lab.groupBy("cluster").count().collect()) == [60, 60, 60]
    # the same number by the plain definition
    x, k = pts, np.array([r.cluster for r in lab.orderBy("id").collect()])
    d = ((x[:, None] - x[None]) ** 2).sum(-1)  # squared distances
    s = []
    for i in range(len(x)):
        a = d[i][k == k[i]].sum() / ((k == k[i]).sum() - 1)
        b = min(d[i][k == c].mean() for c in set(k) if c != k[i])
        s.append((b - a) / max(a, b))
    assert sil[3] == pytest.approx(np.mean(s))


def test_rfm_code_bounds(spark):
    df = spark.createDataFrame([(180, 2, 10.0), (181, 1, 10.1)], "r int, n int, m double")
    got = [x[0] for x in df.select(S.rfm_code(F.col("r"), F.col("n"), F.col("m"), F.lit(180), F.lit(10.0))).collect()]
    assert got == ["110", "001"]


def test_student_tail(spark):
    """Two-sided tails from tables and closed forms (1, 2 and 3 degrees of freedom)."""
    from bazaarlens.functions import student_t_p
    x3 = 40 / math.sqrt(3)
    rows = [(2.0, 10.0, 0.07338803477074), (1.0, 1.0, 0.5), (3.0, 2.0, 0.09546596626670), (0.0, 5.0, 1.0), (12.706204736, 1.0, 0.05), (2.7764451052, 4.0, 0.05),
            (1.96, 1e6, 0.04999606757), (40.0, 3.0, 1 - 2 / math.pi * (x3 / (1 + x3 * x3) + math.atan(x3))), (float("inf"), 3.0, 0.0)]
    df = spark.createDataFrame(rows, "t double, n double, want double")
    for r in df.withColumn("p", student_t_p(F.col("t"), F.col("n"))).collect():
        assert r.p == pytest.approx(r.want, rel=1e-6, abs=1e-9)
    one = [(x / 7, 1.0) for x in range(-60, 61)]
    for r in spark.createDataFrame(one, "t double, n double").withColumn("p", student_t_p(F.col("t"), F.col("n"))).collect():
        assert r.p == pytest.approx(1 - 2 * math.atan(abs(r.t)) / math.pi, abs=1e-12)
    assert spark.createDataFrame([(None, 3.0), (1.0, 0.0)], "t double, n double").where(student_t_p(F.col("t"), F.col("n")).isNotNull()).isEmpty()


def test_exact_u_of_small_groups(spark):
    from itertools import combinations
    for x, y in (([1.0, 5.0, 9.0], [2.0, 3.0, 4.0, 11.0]), ([1.0, 2.0], [3.0, 4.0, 5.0]), ([7.5], [1.0, 2.0, 3.0, 4.0, 9.0])):
        pool = sorted(x + y)
        u = lambda a: sum(p > q for p in a for q in pool if q not in a)
        mid, own = len(x) * len(y) / 2, sum(p > q for p in x for q in y)
        every = [u(c) for c in combinations(pool, len(x))]
        want = min(1.0, 2 * sum(k >= max(own, 2 * mid - own) for k in every) / len(every))
        df = spark.createDataFrame([(0, v) for v in x] + [(1, v) for v in y], "g int, v double")
        r = C.mann_whitney(df, "g", "v").first()
        assert r.u_statistic == own and r.p_value == pytest.approx(want, abs=1e-12)
    tied = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 2.0), (1, 3.0)], "g int, v double")
    assert 0 < C.mann_whitney(tied, "g", "v").first().p_value <= 1


def test_history_knows_only_what_was_answered(spark):
    import datetime as dt
    import random

    from bazaarlens.operators import history as H
    r, start = random.Random(9), dt.datetime(2020, 1, 1)
    rows = []
    for i in range(600):
        bought = start + dt.timedelta(seconds=r.randrange(40_000) * 60)
        rows.append((i, r.choice(["hot"] * 5 + ["a", "b", None]), bought, None if i % 9 == 0 else bought + dt.timedelta(days=r.randrange(20)), int(r.random() < 0.3)))
    df = spark.createDataFrame(rows, "order_id long, seller string, bought timestamp_ntz, answered timestamp_ntz, bad int")
    got = {x["order_id"]: (x["s_hist_cnt"], x["s_hist_bad_rate"]) for x in H.answered_rates(df, "seller", "order_id", "bought", "answered", "bad", "s").collect()}
    for i, seller, bought, _, _ in rows:
        known = [b for _, s, _, a, b in rows if seller is not None and s == seller and a is not None and a < bought]
        assert got[i] == (len(known), pytest.approx(sum(known) / len(known)) if known else None)
