"""Every query of the library against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from placemill.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert ok, message


# Queries whose bounds and sizes the smallest tables do not reach.
@pytest.mark.parametrize("name", ["a10_export_manifest", "d2_dedupe_places", "c9_excerpts", "c16_similar_pairs", "d6_semantic_dedupe", "c10_nearest_photos"])
def test_query_on_larger_tables(spark, name):
    folder = "/root/testdata/sf0.01"
    ok, message = compare(spark, connect(folder), folder, name, QUERIES[name], ORACLES[name])
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() == 50


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
