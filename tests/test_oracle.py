"""Every registered query with an oracle equals its DuckDB SQL (sf0.001 by default)."""

import pytest

import __spark_entry__ as E
from scripts.check_oracle import rows_of

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    scols, srows = df.columns, [tuple(r) for r in df.collect()]
    r = duck.execute(ORACLE[name])
    dcols = [d[0] for d in r.description]
    assert sorted(scols) == sorted(dcols)
    assert rows_of(scols, srows) == rows_of(dcols, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"name", "n_calls", "n_recovered", "n_in_parallel_turns"}
