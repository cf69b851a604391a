"""Every query of the catalogue runs, and gives the rows of its SQL where it has one."""

import pytest

from rankloom.plans import catalog

Q, S = catalog.queries(), catalog.oracle_sql()


def test_sql_belongs_to_queries():
    assert set(S) <= set(Q)


@pytest.mark.parametrize("name", sorted(S))
def test_query_equals_sql(name, same_rows):
    same_rows(Q[name], S[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_query_runs(name, spark, sf_dir):
    df = Q[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and [r["p"] for r in rows] == sorted(r["p"] for r in rows)
    assert set(e.oracle_sql()) <= set(e.queries())
