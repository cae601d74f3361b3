"""Every registered catalogue query against DuckDB, and the entry points."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from lodestore.plans import catalogue_queries as Q
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_duckdb(spark, con, name):
    got, want = compare(spark, con, Q.QUERIES[name], Q.ORACLE[name], SF)
    assert got == want


def test_every_query_has_its_twin():
    assert set(Q.QUERIES) == set(Q.ORACLE)


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
