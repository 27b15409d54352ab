"""Every query against DuckDB on the same tables, where SQL can state it."""

import glob
import os

import duckdb
import pytest

from riverbed import capture_queries, entity_queries, further_queries, more_queries, queries  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(_plain, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = [tuple(_plain(v) for v in r) for r in df.collect()]
    assert rows or name not in queries.SQL
    if name in queries.SQL:
        found = duck.execute(queries.SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        at = [columns.index(c) for c in df.columns]
        want = [tuple(_plain(r[k]) for k in at) for r in found.fetchall()]
        assert len(rows) == len(want)
        assert sorted(map(repr, rows)) == sorted(map(repr, want))
