"""Every query of the library with SQL gives what DuckDB gives; the others give rows."""

import pytest
from conftest import same_rows

from parley.plans import library

SLOW = {"ab_compare", "cross_validate", "train_acoustic", "train_gbt"}


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_query_against_sql(spark, duck, sf_dir, name):
    same_rows(library.queries()[name](spark, sf_dir), duck.sql(library.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(library.queries()) - set(library.oracle_sql()) - SLOW))
def test_query_gives_rows(spark, sf_dir, name):
    assert library.queries()[name](spark, sf_dir).count() > 0


def test_sql_names_queries():
    assert set(library.oracle_sql()) <= set(library.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
