"""Every core query with SQL gives what the SQL gives; the others run and keep their schema."""

import pytest

from tests.oracle import same
from textdex import queries as core

Q, SQL = core.queries(), core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, sf, name):
    same(Q[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, sf, name):
    df = Q[name](spark, sf)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", ["wildcard_hash", "constant_pattern", "path_bool", "numeric_word_pct", "url_refs", "approx_regex", "exact_zone", "request_near", "request_offsets", "best_match_records", "pattern_file_5000"])
def test_has_rows(spark, sf, name):
    assert Q[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["is_binary", "is_uuencode", "is_postscript", "is_heavy", "is_hqx", "soif_valid", "cast_compressible"])
def test_has_both_answers(spark, sf, name):
    df = Q[name](spark, sf)
    assert {r[0] for r in df.select("ok" if name == "soif_valid" else "yes").distinct().collect()} == {True, False}
