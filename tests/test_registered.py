"""Registered queries against their SQL on the smallest tables; BAZAARLENS_ALL=1 runs every one."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUICK = ["month_panel", "revenue_factors", "revenue_factor_intervals", "structure_by_category", "aov_effects", "trend_by_state",
         "dose_response", "bottleneck_table", "stage_durations", "survival_curves", "repeat_rate_table", "rfm_segments", "order_features",
         "gain_table", "strategy_budget", "keyed_update", "published_events", "change_points_by_category"]
ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("BAZAARLENS_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return c


def _norm(v):
    return "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, BASE)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(_norm(r[i]) for i in at) for r in rel.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
