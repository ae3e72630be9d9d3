"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle_check import difference, oracle

import __spark_entry__ as registry
from millrace.plans import lineage_queries, warehouse_queries

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle(DIRECTORY)


CORE = {**warehouse_queries.QUERIES, **lineage_queries.QUERIES}


def test_every_core_query_has_sql():
    assert set(CORE) <= set(registry.queries())
    assert set(CORE) <= set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", CORE)
def test_equal_to_sql(spark, connection, name):
    result = registry.queries()[name](spark, DIRECTORY)
    assert difference(result, connection.sql(registry.oracle_sql()[name])) is None


def test_downstream_to_the_end_passes_three_hops(spark):
    found = registry.queries()["lin11_downstream_to_the_end"](spark, DIRECTORY)
    assert found.filter("hops > 3").count() > 0
    assert found.filter("hops <= 3").count() == registry.queries()["lin11_downstream"](spark, DIRECTORY).count()


def test_entry(spark):
    assert registry.entry(spark).count() == 3


def test_total_order(spark):
    """The registered check ignores order, so the sort itself is looked at here."""
    found = [tuple(row) for row in registry.queries()["top2_sorted"](spark, DIRECTORY).collect()]
    assert found == sorted(found, key=lambda row: (-row[1], row[0]))


def test_first_rows(spark):
    assert registry.queries()["src2_parquet"](spark, DIRECTORY).limit(5).count() == 5
