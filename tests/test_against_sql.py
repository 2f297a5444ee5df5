"""Every registered query with a SQL form gives the same columns, rows and values in both engines."""

import os

import compare
import pytest

from moodstream.plans.oracle_sql import ORACLES
from moodstream.plans.table_queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result(spark, sql, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), sql, ORACLES[name]) is None


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
