"""Every registered query beside its SQL, on the smallest tables."""

import os

import pytest

from workload.check import compare, duck
from workload.queries import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    ok, note = compare(spark, connection, SF_DIR, name)
    assert ok, note
