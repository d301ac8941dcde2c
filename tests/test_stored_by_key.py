"""Lines stored in buckets by order, and history that shuffles each row once."""
import datetime
import threading
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import history as H
from bazaarlens.operators import matching as PM
from bazaarlens.sources import Canonical, remove_stored, store_by_key
from bazaarlens.sources.recovery import _tables

DAY = datetime.datetime(1996, 5, 1)


def _plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """40 orders; part 3 comes twice, part 9 is not listed, one line comes twice."""
    base = str(tmp_path_factory.mktemp("star"))
    lines = [(o, o * 3 % 7, (o + k) % 10, 10.25 * k + o, .01 * (o % 5), DAY + datetime.timedelta(o + k)) for o in range(38) for k in range(1 + o % 4)]
    tables = {
        "lineitem": (lines + lines[:1], "l_orderkey long, l_suppkey long, l_partkey long, l_extendedprice double, l_tax double, l_shipdate timestamp_ntz"),
        "part": ([(p, f"name {p}", f"b{p % 3}", p) for p in [*range(9), 3]], "p_partkey long, p_name string, p_brand string, p_size int"),
        "orders": ([(o, o % 6, "F", DAY + datetime.timedelta(o % 9)) for o in range(40)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz"),
        "customer": ([(c, c % 2) for c in range(5)], "c_custkey long, c_nationkey int"),
        "nation": ([(0, "N0"), (1, "N1")], "n_nationkey int, n_name string"),
        "supplier": ([(s, s % 2) for s in range(6)], "s_suppkey long, s_nationkey int")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{base}/{name}.parquet")
    return base


def test_lines_are_grouped_by_order_without_a_shuffle(spark, folder):
    c = Canonical(spark, folder, one_pass=True)
    for df in (c.order_sellers(), c._item_totals(), c.lines.groupBy("order_id").agg(F.countDistinct("product_id"), F.max("weight_g"))):
        assert "Exchange" not in _plan(df)


def test_stored_lines_give_the_totals_of_the_raw_lines(spark, folder):
    one, plain = Canonical(spark, folder, one_pass=True), Canonical(spark, folder)
    got = one.order_items().groupBy("order_id", "category_en").agg(F.sum("price").alias("p"), F.sum("freight_value").alias("f"))
    want = plain.order_items().groupBy("order_id", "category_en").agg(F.sum("price").alias("p"), F.sum("freight_value").alias("f"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(tuple, one.order_sellers().collect())) == sorted(map(tuple, plain.order_sellers().collect()))
    # a line comes once for each row of its part
    three = [r.item_cnt for r in one.lines.where("product_id = 3").collect()]
    assert sum(three) == plain.order_items().where("product_id = 3").count()
    got, want = one.orders_detail().drop("item_amount", "freight_amount", "order_amount", "item_cnt"), plain.orders_detail()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_removing_stored_rows_drops_their_table(spark):
    df = store_by_key(spark.range(20).repartition(4, "id"), "id", 4)
    name = _tables[df.stored_at]
    assert df.count() == 20 and spark.catalog.tableExists(name)
    remove_stored(df)
    assert not spark.catalog.tableExists(name)


def test_history_runs_over_months_and_days(spark):
    rows = [(i, f"s{i % 3}", DAY + datetime.timedelta(days=i * 7 % 150, seconds=i % 4), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows + [(200, None, DAY, 1)], "o long, k string, ts timestamp_ntz, bad int").withColumn("b", F.col("bad").cast("long"))
    got = {(r.k, r.ts): r.b_prior for r in H.prior_totals(df, ["k"], "ts", ["b"]).collect()}
    want = {}
    for k in ("s0", "s1", "s2"):
        times = sorted({t for _, x, t, _ in rows if x == k})
        sums = [sum(b for _, x, u, b in rows if (x, u) == (k, t)) for t in times]
        want |= {(k, t): n for t, n in zip(times, [0, *accumulate(sums)])}
    assert got == want


def test_lookup_counts_only_keys_that_may_be_hot(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("k"), (F.col("id") % 2).alias("t"))
    table = rows.groupBy("k", "t").agg(F.sum("id").alias("v"))
    got = H.salted_lookup(rows, table, ["k", "t"], "id", part_rows=40)
    want = rows.join(table, ["k", "t"], "left")
    assert sorted(map(tuple, got.select("id", "k", "t", "v").collect())) == sorted(map(tuple, want.select("id", "k", "t", "v").collect()))


def test_horizons_are_worked_on_at_the_same_time(spark, monkeypatch):
    """Each horizon waits for the other one; one after the other they would never meet. Rows keep the order of the horizons."""
    rows = [(f"u{i}", i % 2, 200 + i, i % 3 % 2, 100 + i) for i in range(40)]
    first = spark.createDataFrame(rows, "customer_unique_id string, first_is_late int, tenure_days int, event int, days_to_repeat int").withColumn("first_state", F.lit("S"))
    meet, plain = threading.Barrier(2, timeout=60), PM.horizon_outcome
    monkeypatch.setattr(PM, "horizon_outcome", lambda df, h: (meet.wait(), plain(df, h))[1])
    got = PM.experience_effects(first, horizons=(180, 120), min_arm=100).collect()
    monkeypatch.undo()
    for r, h in zip(got, (180, 120), strict=True):
        naive = PM.naive_effect(plain(first, h)).first()
        assert (r.outcome, r.method, r.n_treat, r["diff"]) == (f"repeat_{h}", "naive", naive.n_treat, naive["diff"])
