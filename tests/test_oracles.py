"""Every query with comparison SQL gives the rows that DuckDB gives on the same files."""

import math
from pathlib import Path

import pytest

from corpusloom.plans import catalog_queries, search_queries

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
QUERIES, SQL = search_queries.QUERIES | catalog_queries.QUERIES, search_queries.SQL | catalog_queries.SQL
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the supplied tables are not here")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    return f"{value + 0.0:.6f}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, database, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = database.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
