"""The stages together, each against a brute-force version on what the one before kept, and the registered text queries."""
import collections
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from bazaarlens.llm.common import read, stage
from bazaarlens.llm.oracles import ORACLES
from bazaarlens.llm.queries import QUERIES

from test_operators import brute_components, brute_lines, brute_passages, brute_quality, rows_of

BASE = "/root/testdata/sf0.001"


def test_each_stage_on_all_its_input(spark):
    docs = read(spark, BASE)
    columns = docs.columns
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before, docs = dict(rows_of(docs)), stage(step(spark, docs, BASE))
        if k < 4:
            assert docs.columns == columns
            after = dict(rows_of(docs))
            assert all(n == len(after[d]) for d, n in docs.select("doc_id", "n_chars").collect())
        if name == "quality_rules":
            failed = {d for d, t in before.items() if brute_quality(t)[-1]}
            assert failed.isdisjoint(after) and all(before[d] == t for d, t in after.items()) and len(after) > 0.9 * (len(before) - len(failed)) - 20
        elif name == "line_dedup":
            want = {d: x for (d, t), (_, gone, x) in brute_lines(list(before.items())).items() if not gone or x.strip(" \t\n\r\x0b\x0c")}
            assert after == want
        elif name == "near_dedup":
            assert set(after) == {c for _, _, c in brute_components(list(before.items()), 5, 80)} and all(before[d] == t for d, t in after.items())
        elif name == "passage_dedup":
            cut = dict(before)
            for d, _, a, b, _ in sorted(brute_passages(list(before.items())), key=lambda r: -r[2]):
                cut[d] = cut[d][:a] + cut[d][b:]
            assert after == {d: t for d, t in cut.items() if t == before[d] or t.split()}
        else:
            got = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("piece").alias("m")).collect()
            assert {r["doc_id"] for r in got} == set(before) and all(r["n"] == r["m"] + 1 for r in got)


def test_line_dedup_leaves_nothing_blank_and_no_column_changed(spark):
    rows = [(1, "a\nb\nc", "one", 4), (2, "a\nb\nc\n\n\t", "two", 5), (3, "x\n\n", "three", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, n_removed long")
    out = corpus_pipeline.line_dedup(spark, docs, BASE)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def test_run_is_its_stages(spark):
    docs = read(spark, BASE)
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, BASE))
    want, got = (collections.Counter(map(tuple, d.collect())) for d in (docs, corpus_pipeline.run(spark, BASE)))
    assert got == want and got


def test_stages_on_edge_rows_and_nothing(spark, edge, empty):
    for docs in (edge, empty):
        for k, (name, step) in enumerate(corpus_pipeline.STAGES):
            if name == "near_dedup" and docs is edge:
                continue   # in test_operators
            out = step(spark, docs, BASE)
            assert out.count() >= 0 and (k == 4 or out.columns == docs.columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    df, rel = QUERIES[name](spark, BASE), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    at = [rel.columns.index(c) for c in columns]

    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else v
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
    assert set(ORACLES) <= set(names)
