"""The registered queries of this subpackage that SQL can express, against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from quarry.llm.oracles import ORACLES
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = c.sql(ORACLES[name])
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted(want.columns) == columns
    assert sorted(repr([r[k] for k in columns]) for r in df.collect()) == sorted(repr([r[k] for k in columns]) for r in rows)
