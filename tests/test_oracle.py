"""Every registered query against its SQL, on whole tables of the smallest data set."""

from __future__ import annotations

import os

import duckdb
import pytest

from quizgrove.plans.catalogue import ORACLE, QUERIES
from quizgrove.plans.fixtures import BASE
from tools.check import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    text, _, _ = compare(spark, connection, name, SF_DIR)
    assert not text.startswith("FAIL"), text


def test_every_sql_text_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
