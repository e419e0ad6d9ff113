"""Every registered query with an oracle statement equals DuckDB on sf0.01."""

import pytest

import __spark_entry__ as entry_mod
from tests.oracle_check import compare

ORACLE = entry_mod.oracle_sql()
QUERIES = entry_mod.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    assert name in QUERIES, f"oracle without query: {name}"
    ok, msg = compare(QUERIES[name](spark, sf_dir), duck, ORACLE[name])
    assert ok, f"{name}: {msg}"


def test_every_query_runs_small(spark):
    """Queries without an oracle still run and keep a stable schema (sf0.001)."""
    for name, fn in QUERIES.items():
        if name in ORACLE:
            continue
        df = fn(spark, "/root/testdata/sf0.001")
        assert df.count() >= 0, name
