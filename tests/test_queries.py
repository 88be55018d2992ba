"""Every query against its SQL over the same tables; the others run and give rows."""

import pytest

from fluxloom.queries import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(against_sql, name):
    # all texts have one key, so the mean length that bm25 joins is one row
    against_sql(QUERIES[name], SQL[name], one_row=name.startswith("f17"))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
