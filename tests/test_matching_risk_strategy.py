import math
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import history as H
from bazaarlens.operators import matching as PM
from bazaarlens.operators import resample as B
from bazaarlens.operators import risk as R
from bazaarlens.operators import strategy as X


def _hash(text):
    return int(md5(text.encode()).hexdigest()[:15], 16)


def _serial(rows, k, caliper, seed):
    """The serial greedy rule, one treated unit after the other."""
    order = sorted(rows, key=lambda r: (r[3], _hash(r[0]), r[0]))
    ctl = [r for r in order if r[1] == 0]
    prio = lambda r: (_hash(f"{seed}|{r[0]}"), r[0])
    before, n = {}, 0
    for r in order:
        before[r[0]] = n
        n += r[1] == 0
    treated = [r for r in rows if r[1] == 1]
    at = {}
    for v in {r[3] for r in treated}:
        at[v] = min(before[r[0]] for r in sorted((r for r in treated if r[3] == v), key=prio)[:k])
    taken, out = set(), {}
    for r in sorted(treated, key=prio):
        p = at[r[3]]
        near = sorted(range(max(0, p - k), min(len(ctl), p + k)), key=lambda i: (abs(ctl[i][3] - r[3]), abs(i - p + .5), i))[:k]
        for i in near:
            if i not in taken:
                if abs(ctl[i][3] - r[3]) <= caliper:
                    taken.add(i)
                    out[r[0]] = ctl[i][0]
                break
    return out


@pytest.mark.parametrize("n,share,k,caliper,block,digits", [(300, .4, 8, .05, 32, 3), (400, .7, 4, .2, 16, 1), (300, .5, 64, .05, 4096, 6)])
def test_matching_equals_the_serial_rule(spark, n, share, k, caliper, block, digits):
    rng = np.random.default_rng(n + k)
    rows = [(f"u{i}", int(rng.random() < share), int(rng.random() < .5), float(np.round(rng.normal(), digits) + 0.0)) for i in range(n)]
    df = spark.createDataFrame(rows, "customer_unique_id string, treat int, y int, logit double")
    pairs = PM.match_nearest(df, caliper=caliper, neighbours=k, seed=7, block=block).collect()
    assert {r.treat_id: r.control_id for r in pairs} == _serial(rows, k, caliper, 7)
    assert len({r.control_id for r in pairs}) == len(pairs)


def test_propensity_and_balance(spark):
    rng = np.random.default_rng(20260827)
    rows = [(f"u{i}", int(i < 5), int(i % 2), *map(float, rng.normal(size=3))) for i in range(25)]
    df = spark.createDataFrame(rows, "customer_unique_id string, treat int, y int, a double, b double, c double")
    s = PM.propensity_scores(df, ["a", "b", "c"])
    assert s.where("logit IS NULL OR isnan(logit)").count() == 0
    two = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 1.0), (0, -1.0, 1.0), (0, 0.0, 1.0)], "treat int, x double, k double")
    smd = {r.covariate: r.smd for r in PM.balance(two, ["x", "k"]).collect()}
    assert smd["x"] == pytest.approx(math.sqrt(2)) and smd["k"] == 0


def test_matched_effect(spark):
    pairs = spark.createDataFrame([(1, 0)] * 30 + [(0, 1)] * 10 + [(1, 1)] * 60, "y_t int, y_c int")
    r = B.matched_effect(pairs, 400, 5).first()
    assert r["diff"] == pytest.approx(.2) and r.n_pairs == 100
    se = math.sqrt((.4 - .04) / 100)
    assert r.ci_low == pytest.approx(.2 - 1.96 * se, abs=.03) and r.ci_high == pytest.approx(.2 + 1.96 * se, abs=.03)
    assert r.is_significant == 1 and r.p_value < .01


def test_history_excludes_the_same_second_and_spreads_hot_keys(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", f"2018-01-{1 + i % 9:02d} 0{i % 4}:00:00", i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "order_id int, seller string, t string, bad int").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r.order_id: (r.seller_hist_cnt, r.seller_hist_bad_rate) for r in H.prior_rates(df, "seller", "order_id", "ts", "bad", "seller").collect()}
    for i, s, t, _ in rows:
        prior = [b for _, s2, t2, b in rows if s2 == s and t2 < t]
        assert got[i] == (len(prior), pytest.approx(sum(prior) / len(prior)) if prior else None)


def test_ranking_metrics(spark):
    rng = np.random.default_rng(9)
    y, s = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "order_id int, is_bad int, score double")
    cuts = sorted(set(s), reverse=True)
    pts = [((s >= c).sum(), y[s >= c].sum()) for c in cuts]
    ap = sum((tp - (pts[i - 1][1] if i else 0)) / y.sum() * tp / n for i, (n, tp) in enumerate(pts))
    assert R.average_precision(df).first()[0] == pytest.approx(ap)
    auc = np.mean([(a > b) + .5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert R.roc_auc(df).first()[0] == pytest.approx(auc)
    f1 = {c: 2 * tp / (n + y.sum()) for c, (n, tp) in zip(cuts, pts)}
    best = R.best_f1_threshold(df).first()
    assert best.f1 == pytest.approx(max(f1.values())) and best.threshold == min(c for c in cuts if f1[c] == max(f1.values()))
    g = {r.top_pct: r for r in R.gain_table(df).collect()}
    order = sorted(range(200), key=lambda i: (-s[i], _hash(str(i)), i))
    assert all(g[p].captured == y[order[:g[p].n_orders]].sum() for p in g) and g[1].n_orders == 2 and g[50].n_orders == 100


PARAMS = {"p1_expedite_cost": 8.0, "p2_voucher_face": 15.0, "p2_redeem_rate": .6, "p2_contact_cost": 2.0, "p3_voucher_face": 10.0,
          "p3_redeem_rate": .65, "bad_review_cost": 40.75, "repeat_effect_pp": -1.46, "aov_delayed": 171.29, "aov_ontime": 158.54,
          "baseline_bad_ontime": 9.19, "baseline_bad_late": 53.99}


def test_strategies(spark):
    params = spark.createDataFrame(list(PARAMS.items()), "param_key string, param_value double")
    cov = spark.createDataFrame([("p1_expedite", 1000, 990, 171290.0), ("p2_intercept", 5000, 4980, 894198.0), ("p3_voucher", 1000, 990, 171290.0)],
                                "strategy string, covered_orders long, covered_customers long, covered_gmv double")
    r = {x.strategy: x for x in X.roi(cov, params, [(.5, 40.0)]).collect()}
    assert [r[s].cost_per_order for s in ("p1_expedite", "p2_intercept", "p3_voucher")] == pytest.approx([8, 11, 6.5])
    p3 = r["p3_voucher"]
    assert p3.bad_upper == pytest.approx(448) and p3.total_cost == 6500 and p3.roi_b == pytest.approx(8960 / 6500)
    assert p3.net_benefit_b == pytest.approx(2460) and p3.rescued_repeat == 0 and p3.breakeven_p_b == pytest.approx(6500 / (448 * 40))
    assert r["p1_expedite"].rescued_repeat == pytest.approx(990 * .0146 * .5)
    star = X.roi(cov, params, [(p3.breakeven_p_b, 40.0)]).where("strategy = 'p3_voucher'").first()
    assert abs(star.net_benefit_b) < 1e-6
    assert X.sensitivity(cov, params).count() == 126
    plan = X.budget_plan(X.roi(cov, params, [(.5, 40.0)])).collect()
    for level in {x.budget_level for x in plan}:
        assert sum(x.allocated for x in plan if x.budget_level == level) <= level + 1e-6
    assert all(x.allocated == 0 for x in plan if x.strategy == "p2_intercept")
    with pytest.raises(KeyError):
        X.strategy_params(params.where("param_key <> 'aov_ontime'"))


def test_budget_equals_the_greedy_loop(spark):
    rows = [("p1_expedite", 1000, 70_000.0, 9_000.0), ("p2_intercept", 5000, 90_000.0, -5.0), ("p3_voucher", 8000, 60_000.0, 30_000.0)]
    df = spark.createDataFrame(rows, "strategy string, covered_orders long, total_cost double, net_benefit_b double")
    got = {(r.budget_level, r.strategy): r.allocated for r in X.budget_plan(df).collect()}
    for level in (50_000, 100_000, 200_000, 500_000):
        left = level
        for name, _, cost, net in sorted(rows, key=lambda x: -x[3] / x[2]):
            if net > 0 and left > 0:
                assert got[(level, name)] == min(left, cost)
                left -= min(left, cost)
        assert got.get((level, "unallocated"), 0) == (left if left > 1 else 0)


def test_a_key_with_half_the_rows_is_split(spark):
    rows = spark.range(4000).select(F.col("id").alias("order_id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
    table = rows.select("k", (F.col("k") * 10).alias("v")).distinct()
    got = H.salted_lookup(rows, table, ["k"], "order_id", part_rows=100)
    assert got.count() == 4000 and got.where("v = k * 10").count() == 4000
    size = got.withColumn("task", F.spark_partition_id()).where("k = 0").groupBy("task").count().agg(F.count("*"), F.max("count")).first()
    assert size[0] > 1 and size[1] < 1900


def test_boosted_trees_skip_columns_without_a_split(spark):
    """Constant columns never split, so the trees are the same without them."""
    rows = [(i, float((i * 37) % 101), None if i % 7 == 0 else float((i * 11) % 13), 4.0, int((i * 37) % 101 > 60 or i % 7 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "order_id long, a double, b double, same double, is_bad int").coalesce(1)
    prep = R.prepare(df, ["a", "b", "same"])
    assert prep.boosted_columns() == ["a", "b", "_gap_b"]
    few = R.fit_boosted(df, prep, rounds=4)
    assert few.numFeatures == 3 and R._used_features(few, prep) == ["a", "b"]
    got = R.score(few, df, prep, True, ["order_id"]).orderBy("order_id").collect()
    prep.varied = None
    assert got == R.score(R.fit_boosted(df, prep, rounds=4), df, prep, True, ["order_id"]).orderBy("order_id").collect()


def test_swapped_scores_are_the_models_own(spark, monkeypatch):
    """To the last bit, so that equal scores tie as in the model; trees without the feature are asked once for all features."""
    rows = [(i, float((i * 37) % 101), None if i % 7 == 0 else float((i * 11) % 13), float(i % 3), int((i * 37) % 101 > 60 or i % 7 == 0 or (i * 13) % 29 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "order_id long, a double, b double, c double, is_bad int").coalesce(1)
    feats = ["a", "b", "c"]
    prep = R.prepare(df, feats)
    model = R.fit_boosted(df, prep, rounds=20)
    other = df.select((F.col("order_id") - 1).alias("order_id"), F.struct(*feats).alias("_other"))
    pairs = df.join(other, "order_id").withColumn("_rep", F.lit(1)).withColumn("is_bad", F.col("order_id"))   # the label tells rows apart
    trees, lost = R._trees(model, prep)
    got = R._swapped_scores(pairs, trees, lost, prep, feats, "is_bad").collect()
    for f in feats:
        want = R.score(model, pairs.withColumn(f, F.col(f"_other.{f}")), prep, True, ["order_id"]).collect()
        assert {r["is_bad"]: r["score"] for r in got if r["_f"] == f} == {r["order_id"]: r["score"] for r in want}
    calls = []
    monkeypatch.setattr(R, "score", lambda m, d, *a, real=R.score: calls.append(d.columns) or real(m, d, *a))
    R.permutation_importance(model, df, prep, True, 2).collect()
    assert len(calls) == 1 and "_rep" not in calls[0]
