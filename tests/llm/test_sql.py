"""The registered queries that SQL can state, on the sample tables."""

import pytest

from riverbed.llm import queries
from tests.test_queries import SF, _plain, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):  # noqa: F811
    df = queries.queries()[name](spark, SF)
    found = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(_plain(r[columns.index(c)]) for c in df.columns) for r in found.fetchall()]
    assert sorted(repr(tuple(map(_plain, r))) for r in df.collect()) == sorted(map(repr, want)) and want
