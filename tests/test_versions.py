"""Published versions: whole old rows or whole new rows, whatever dies on the way."""

import json

import pytest
from pyspark.sql import functions as F

from bazaarlens.sources import versions as V


@pytest.fixture
def table(spark, tmp_path):
    t = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (2, "b", float("nan")), (None, "c", 3.0)], "m int, k string, v double")
    return t, df


def rows(spark, t, version=None):
    return sorted((tuple(r) for r in V.published(spark, t, version).collect()), key=str)


def test_three_modes_and_old_versions(spark, table):
    t, df = table
    first = sorted([(1, "a", 1.0), (1, "a", 1.0), (2, "b", None), (None, "c", 3.0)], key=str)
    with pytest.raises(ValueError):
        V.published(spark, t)
    assert V.publish(df, t, partition_cols=["m"]) == 1 and rows(spark, t) == first
    assert V.publish(df.where("m = 2"), t, "append") == 2 and len(rows(spark, t)) == 5
    fresh = spark.createDataFrame([(1, "z", 9.0), (7, "y", 7.0), (None, "x", 0.0)], df.schema)
    assert V.publish(fresh, t, "partitions") == 3
    assert rows(spark, t) == sorted([(1, "z", 9.0), (7, "y", 7.0), (None, "x", 0.0), (2, "b", None), (2, "b", None)], key=str)
    assert rows(spark, t, 1) == first and V.published_versions(spark, t) == [1, 2, 3]
    assert V.publish(df.where("false"), t, "partitions") == 3 and V.publish(df.where("false"), t) == 3
    assert V.publish(V.published(spark, t).where("m = 7"), t, partition_cols=["m"]) == 4     # reads what it replaces
    assert rows(spark, t) == [(7, "y", 7.0)]
    assert V.publish(df.where("false"), t, keep_old_when_empty=False, partition_cols=["m"]) == 5 and rows(spark, t) == []
    with pytest.raises(ValueError):
        V.published(spark, t, 99)


def test_other_columns_are_refused(spark, table):
    t, df = table
    V.publish(df, t, partition_cols=["m"])
    for bad in (df.drop("v"), df.withColumn("v", F.col("v").cast("string")), df.select("k", "m", "v")):
        with pytest.raises(ValueError):
            V.publish(bad, t, "append")
    with pytest.raises(ValueError):
        V.publish(df, t, "partitions", ["k"])
    with pytest.raises(ValueError):
        V.publish(df.withColumn("written_in", F.lit(1)), t)
    assert V.published_versions(spark, t) == [1]


@pytest.mark.parametrize("writer", ["replace", "append", "partitions", "update"])
def test_a_job_that_dies_leaves_the_old_version(spark, table, writer, monkeypatch):
    t, df = table
    V.publish(df, t, partition_cols=["m"])
    before = rows(spark, t)
    broken = df.withColumn("v", F.when(F.col("k") == "c", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.lit(5.0)))

    def run(frame):
        if writer == "update":
            return V.publish_update(spark, frame.select("k", "v").distinct(), t, "k", ["v"])
        return V.publish(frame, t, writer, ["m"])

    with pytest.raises(Exception, match="lost"):     # tasks fail while rows are written
        run(broken)
    assert rows(spark, t) == before and V.published_versions(spark, t) == [1]

    def dies(*_):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:                 # all rows are written, the manifest is not
        m.setattr(V, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            run(df.withColumn("v", F.lit(5.0)))
    assert rows(spark, t) == before
    assert run(df.withColumn("v", F.lit(5.0))) == 2 and rows(spark, t) != before


def test_second_writer_at_once_is_told(spark, table, monkeypatch):
    t, df = table
    V.publish(df, t)
    commit = V._commit

    def late(*args):
        with monkeypatch.context() as m:
            m.setattr(V, "_commit", commit)
            V.publish(df.where("m = 1"), t)
        commit(*args)
    monkeypatch.setattr(V, "_commit", late)
    with pytest.raises(FileExistsError):
        V.publish(df.where("m = 2"), t)
    assert {r[0] for r in rows(spark, t)} == {1} and V.published_versions(spark, t) == [1, 2]


def test_update_and_prune(spark, table, tmp_path):
    t, df = table
    V.publish(df, t, partition_cols=["m"])
    V.publish(df.where("m = 2").withColumn("v", F.lit(4.0)), t, "partitions")
    up = spark.createDataFrame([("c", None), ("new", 1.0)], "k string, v double")
    assert V.publish_update(spark, up, t, "k", ["v"]) == 3
    want = sorted([(1, "a", 1.0), (1, "a", 1.0), (2, "b", 4.0), (None, "c", None)], key=str)
    assert rows(spark, t) == want
    with pytest.raises(ValueError):
        V.publish_update(spark, up.union(up), t, "k", ["v"])
    assert V.prune(spark, t, 2) == [1] and len(rows(spark, t, 2)) == 4 and rows(spark, t) == want
    assert V.prune(spark, t, 0) == [2] and rows(spark, t) == want and V.prune(spark, t) == []
    manifest = json.loads((tmp_path / "t" / "_manifests" / "v000000000003.json").read_text())
    assert manifest["partitioned_by"] == ["m"]
