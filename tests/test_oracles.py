"""Every registered query of the package against its DuckDB counterpart on the small tables."""

import datetime
import decimal
import os
from pathlib import Path

import duckdb
import pytest

from quarry import index_queries, oracles, queries, service_oracles, service_queries

ORACLES, QUERIES = oracles.ORACLES | service_oracles.ORACLES | index_queries.ORACLES, queries.QUERIES | service_queries.QUERIES | index_queries.QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert got == sorted(repr([plain(r[c]) for c in columns]) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["file_path", "relevance_score", "content_snippet", "chunks_found", "file_type"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
