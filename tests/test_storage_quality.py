import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens import functions as fn
from bazaarlens.operators import quality as Q
from bazaarlens.sources import readers as R
from bazaarlens.sources import writers as W


def test_csv_quotes_newlines_and_last_line(spark, tmp_path):
    f = tmp_path / "reviews.csv"
    f.write_bytes('id,score,text\r\n1,5,"two\nlines, ""quoted"""\r\n2,x,bad\r\n3,4,São Paulo'.encode())
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("score", T.IntegerType()), T.StructField("text", T.StringType())])
    rows = R.read_csv(spark, str(f), schema, multi_line=True).orderBy("id").collect()
    assert len(rows) == 3 and rows[0].text == 'two\nlines, "quoted"' and rows[2].text == "São Paulo"
    assert rows[1].score is None and rows[1]._bad is not None and rows[1]._file.endswith("reviews.csv")
    shifted = T.StructType([schema[1], schema[0], schema[2]])
    with pytest.raises(Exception):
        R.read_csv(spark, str(f), shifted).collect()


def test_write_modes(spark, tmp_path):
    t = str(tmp_path / "t")
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "m int, v double")
    assert W.write(df, t) == 2 and W.write(df, t) == 4
    assert spark.read.parquet(t).where("v IS NULL").count() == 2  # NaN is stored as NULL
    assert W.replace(df, t) == 2 and W.replace(df, t) == 2
    assert W.replace(df.where("false"), t) == 0 and W.stored_count(spark, t) == 2  # empty leaves the old rows
    with pytest.raises(Exception):
        W.write(df, t, "fail")
    p = str(tmp_path / "p")
    W.replace(df, p, ["m"])
    assert W.replace(df.where("m = 1").withColumn("v", F.lit(9.0)), p, ["m"]) == 2
    assert {(r.m, r.v) for r in spark.read.parquet(p).collect()} == {(1, 9.0), (2, 2.0)}
    assert R.table_exists(spark, "t", str(tmp_path)) and not R.table_exists(spark, "none", str(tmp_path))


def test_keyed_update(spark, tmp_path):
    t = str(tmp_path / "t")
    spark.createDataFrame([(1, 0.1, "a"), (2, 0.2, "b")], "k int, tau double, note string").write.parquet(t)
    up = spark.createDataFrame([(2, None, "new"), (3, 9.0, "never inserted")], "k int, tau double, note string")
    got = {tuple(r) for r in spark.read.parquet(W.keyed_update(spark, up, t, "k", ["tau", "note"])).collect()}
    assert got == {(1, 0.1, "a"), (2, None, "new")}


def test_contract_and_union(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    W.check_contract(df, df.schema)
    with pytest.raises(ValueError):
        W.check_contract(df.select("y", "x"), df.schema)
    with pytest.raises(ValueError):
        W.union_branches(df, df.drop("y"))
    assert W.union_branches(df, df.select("y", "x")).count() == 2


def test_cleaning(spark):
    df = spark.createDataFrame([("2018-01-02 03:04:05", "7"), ("0000-00-00 00:00:00", "2017-03-29"), (None, "8")], "ts string, n string")
    t = Q.typed(df, {"ts": "timestamp_ntz", "n": "int"}, {"ts": "yyyy-MM-dd HH:mm:ss"}).collect()
    assert t[0].ts == dt.datetime(2018, 1, 2, 3, 4, 5) and t[1].ts is None and t[1].n is None and t[2].n == 8
    shape = {r.column_name: r.misfit_cnt for r in Q.shape_report(df, {"n": "^[0-9]+$", "ts": "^[12]"}).collect()}
    assert shape == {"n": 1, "ts": 1}
    assert Q.bad_rows(df, {"n": "^[0-9]+$"}).first().bad_columns == ["n"]
    stored = df.withColumn("stored", F.lit("2018-01-02 03:04:05").cast("timestamp_ntz"))
    assert Q.parse_mismatches(stored, "stored", "ts", "yyyy-MM-dd HH:mm:ss").count() == 2
    old = spark.sql("select timestamp_ntz'0001-01-01 00:00:00' a, timestamp_ntz'2018-01-01 00:00:00' b")
    assert {r.column_name: r.zero_dates for r in Q.zero_date_count(old, "a", "b").collect()} == {"a": 1, "b": 0}
    assert spark.sql("select 'São Paulo' a, 'sao paulo' b").select(fn.same_text(F.col("a"), F.col("b"))).first()[0]
    with pytest.raises(AssertionError):
        Q.expect(df, F.col("ts").isNotNull(), "null timestamps")


def test_tie_out_is_exact(spark):
    d = lambda *v: spark.createDataFrame([(x,) for x in v], "gmv decimal(18,2)") if v else None
    from decimal import Decimal as M
    r = Q.tie_out(d(M("0.10"), M("0.20")), d(M("0.30")), d(M("0.15"), M("0.15"))).first()
    assert r.category_gap == 0 and r.state_gap == 0
