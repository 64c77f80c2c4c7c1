"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from codexloom import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    return float(f"{value:.8g}") if isinstance(value, float) else value


def same_rows(spark, name: str) -> int:
    base = duckdb.connect()
    for t in TABLES:
        base.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry_point.queries()[name](spark, SF)
    found = base.sql(entry_point.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    a = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    at = [found.columns.index(c) for c in columns]
    b = sorted(repr([_plain(r[i]) for i in at]) for r in found.fetchall())
    assert a == b
    return len(a)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, name):
    rows = same_rows(spark, name)
    if name not in {"queue_claim", "queue_claimable", "owned_jobs", "review_get_or_create"}:
        assert rows > 0


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
