"""Registered queries with SQL next to DuckDB on the smallest tables."""

import pytest

from gradeloom.llm.queries import ORACLES, QUERIES
from tools.check import connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, folder, name):
    con = connect(folder)
    df = QUERIES[name](spark, folder)
    columns = ", ".join(df.columns)
    want = con.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, map(tuple, want)))
