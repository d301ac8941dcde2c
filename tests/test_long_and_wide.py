"""Multi-line files over many tasks, long trend series, Euclidean silhouettes and wide tables."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.operators import ordering as O
from bazaarlens.operators import panels as P
from bazaarlens.operators import segment as S
from bazaarlens.operators import trend as E
from bazaarlens.sources import csv_records, read_csv

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("note", T.StringType()), T.StructField("amount", T.DoubleType())])


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_records_across_byte_ranges(spark, tmp_path, small_ranges):
    r = random.Random(1)
    notes = ['plain', 'a, b', 'two\nlines', 'he said "yes"\n\nand left', '"', '""', '\n', 'x' * 700 + '\n' + '"y", ' * 60, '', ' padded ', 'end with quote"', 'crlf\r\nin field']
    want = {}
    for file, end in (("a", "\n"), ("b", "\r\n")):
        rows = [(i, r.choice(notes), i / 4) for i in range(200)]
        want |= {(file, i + 1): row for i, row in enumerate(rows)}
        body = end.join(f'{i},"{n.replace(chr(34), chr(34) * 2)}",{a}' if r.random() < 2 else "" for i, n, a in rows)
        (tmp_path / f"{file}.csv").write_text("id,note,amount" + end + body + end + end, newline="")
    df = read_csv(spark, str(tmp_path), SCHEMA, multi_line=True)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 100
    got = {(x["_file"][-5], x["_record"]): (x["id"], x["note"] or "", x["amount"]) for x in df.collect()}
    assert got == want and df.where("_bad IS NOT NULL").isEmpty()
    assert csv_records(spark, str(tmp_path)).count() == 402


def test_bad_records_are_placed(spark, tmp_path, small_ranges):
    rows = [f'{i},"note {i}\nmore",{i}.5' if i % 50 else f'{i},"note\n{i}",not a number' for i in range(300)] + ['7,"never closed\n']
    (tmp_path / "f.csv").write_text("\n".join(["id,note,amount", *rows]))
    bad = {x["_record"]: x["_bad"] for x in read_csv(spark, str(tmp_path / "f.csv"), SCHEMA, multi_line=True).where("_bad IS NOT NULL").collect()}
    assert sorted(bad)[:6] == [1, 51, 101, 151, 201, 251] and bad[51] == '50,"note\n50",not a number' and set(bad) - {1, 51, 101, 151, 201, 251} <= {301}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "wrong.csv").write_text("id,amount,note\n1,2.0,x\n")
    with pytest.raises(ValueError, match="header"):
        read_csv(spark, str(tmp_path / "g"), SCHEMA, multi_line=True)
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "empty.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "h"), SCHEMA, multi_line=True).collect() == []


def test_long_trend_equals_short_and_is_right_on_many_points(spark, monkeypatch):
    r = random.Random(2)
    rows = [(k, float(i * 3 + r.random()), r.choice([0.0, -0.0, 1.0, 2.5, float("nan"), None, r.gauss(0.002 * i, 1)])) for k, n in (("a", 3), ("b", 40), ("c", 700), ("d", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, t double, y double")
    monkeypatch.setattr(E, "BLOCK_BITS", 4)
    plain = lambda d: sorted((tuple(None if isinstance(v, float) and np.isnan(v) else v for v in x) for x in d.collect()), key=str)
    short, long = plain(E.mann_kendall(df, ["k"], "t", "y")), plain(E.mann_kendall_long(df, ["k"], "t", "y"))
    assert [x[:2] + x[-1:] for x in short] == [x[:2] + x[-1:] for x in long]
    for a, b in zip(short, long):
        assert all(u == v or u == pytest.approx(v, abs=1e-12) for u, v in zip(a, b)), (a, b)
    monkeypatch.setattr(E, "BLOCK_BITS", 10)
    n = 200_000
    many = spark.range(n).select(F.lit("x").alias("k"), F.col("id").alias("t"), (F.col("id") + 50 * F.pmod(F.xxhash64("id"), F.lit(1000))).cast("double").alias("y"))
    got = E.mann_kendall_long(many, ["k"], "t", "y").first()
    y = many.orderBy("t").toPandas()["y"].to_numpy()

    def inversions(v):   # by merging sorted halves
        if len(v) < 2:
            return v, 0, 0
        a, f1, r1 = inversions(v[:len(v) // 2])
        b, f2, r2 = inversions(v[len(v) // 2:])
        falls = int((len(a) - np.searchsorted(a, b, side="right")).sum())
        rises = int(np.searchsorted(a, b, side="left").sum())
        return np.sort(np.concatenate((a, b))), f1 + f2 + falls, r1 + r2 + rises
    _, falls, rises = inversions(y)
    assert got["n"] == n and got["s"] == rises - falls and got["trend"] == "increasing"


def test_euclidean_silhouette(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, (60, 2)), r.normal(3, 1, (50, 2)), [[9.0, 9.0]], np.tile([[1.0, 1.0]], (40, 1))]).round(3)
    label = np.array(["a"] * 60 + ["b"] * 50 + ["c"] + ["b"] * 40)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a, b = d[i][own].sum() / (own.sum() - 1), min(d[i][label == k].mean() for k in set(label) - {label[i]})
        s.append((b - a) / max(a, b))
    rows = [(str(k), float(p), float(q)) for k, (p, q) in zip(label, x)]
    df = spark.createDataFrame(rows + [(None, 1.0, 2.0), ("a", None, 1.0)], "l string, p double, q double")
    for size in (4096, 20):
        monkeypatch.setattr(S, "TILE_ROWS", size)
        assert S.euclidean_silhouette(df, ["p", "q"], "l").first()[0] == pytest.approx(np.mean(s), abs=1e-12)
    assert S.euclidean_silhouette(df.where("l = 'a'"), ["p", "q"], "l").first()[0] == 0
    assert S.euclidean_silhouette(df.limit(0), ["p", "q"], "l").first()[0] is None


def test_wide(spark):
    df = spark.createDataFrame([("x", "m1", 1, 2.0), ("x", "m2", 3, None), ("y", "m1", None, 5.0), ("y", None, 9, 9.0), ("x", "m2", None, 4.0)], "k string, name string, a int, b double")
    got = {r["k"]: r.asDict() for r in P.wide(df, ["k"], "name", ["a", "b"]).collect()}
    assert got["x"] == {"k": "x", "a_m1": 1, "b_m1": 2.0, "a_m2": 3, "b_m2": 4.0} and got["y"]["b_m1"] == 5.0 and got["y"]["a_m2"] is None
    assert P.wide(df, ["k"], "name", ["a"], ["m2"]).columns == ["k", "m2"]
    with pytest.raises(ValueError):
        P.wide(spark.range(2000).select(F.lit(1).alias("k"), "id"), ["k"], "id", ["id"])


def test_any_two_tiles_meet_once(spark):
    """So the distance of two points is found once and serves both."""
    points = spark.range(40).select(F.col("id").alias("_id"))
    met = S._met(points, 4)
    assert met.select("_x", "_y").distinct().count() == 10 and met.where("_x > _y").isEmpty()
    assert {r["count"] for r in met.groupBy("_id").count().collect()} == {4}
    r = np.random.default_rng(3)
    x, y, wx, wy = r.normal(size=(130, 3)), r.normal(size=(1100, 3)), r.random((130, 2)), r.random((1100, 2))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    sx, sy = S._distance_sums(x, y, wx, wy)
    assert np.allclose(sx, d @ wy) and np.allclose(sy, d.T @ wx)


def test_points_are_copied_to_few_tiles(spark, monkeypatch):
    """Each copy is shuffled, and so are its sums."""
    assert [S._tiles(n) for n in (0, 1, 10_000, 70_000, 262_144, 900_000, 5_400_000)] == [0, 1, 3, 16, 16, 16, 21]
    monkeypatch.setattr(S, "TILE_ROWS", 8)
    monkeypatch.setattr(S, "MOST_TILE_ROWS", 64)
    copied = []
    monkeypatch.setattr(S, "_met", lambda points, tiles, real=S._met: copied.append(tiles) or real(points, tiles))
    df = spark.range(500).select(F.concat(F.lit("l"), F.col("id") % 3).alias("l"), F.col("id").cast("double").alias("p"), (F.col("id") * 7 % 31).cast("double").alias("q"))
    few = S.euclidean_silhouette(df, ["p", "q"], "l").first()[0]
    monkeypatch.setattr(S, "TILE_ROWS", 16_384)
    monkeypatch.setattr(S, "MOST_TILE_ROWS", 262_144)
    assert few == pytest.approx(S.euclidean_silhouette(df, ["p", "q"], "l").first()[0], abs=1e-12) and copied == [16, 1]


def test_quantiles_read_their_rows_once(spark):
    out = O.quantiles(spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("x")), "x", {"m": 0.5}, ["k"])
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["k"]: r["m"] for r in out.collect()} == {0: 49.5, 1: 49.0, 2: 50.0}
