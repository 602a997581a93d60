"""The llm queries against their SQL, the rest for running."""

import pytest

from tests.oracle import same
from textdex.llm import queries as llm

Q, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, sf, name):
    same(Q[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, sf, name):
    df = Q[name](spark, sf)
    assert df.count() == df.distinct().count() or name == "p6_ids"
