"""Every query with a SQL answer must equal it: schema, row count and every value."""

import compare
import pytest

import __spark_entry__ as entry
from patronage.catalog import QUERIES
from patronage.oracle import ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert compare.difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_entry_has_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_clusters_cover_every_customer(spark, sf_dir):
    found = QUERIES["clusters"](spark, sf_dir)
    counts = {row["cluster"]: row["count"] for row in found.groupBy("cluster").count().collect()}
    assert len(counts) == 5
    assert sum(counts.values()) == QUERIES["rfm_base"](spark, sf_dir).count()


def test_entry_returns_segments(spark):
    found = entry.entry(spark)
    assert {"customer_id", "segment", "value_tier"} <= set(found.columns)
    assert found.count() == 150
