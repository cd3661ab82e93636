"""Every registered query against its check SQL on the smallest tables."""

import pytest

from scholia.queries import all_queries, all_sql
from tests.agreement import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_agrees(spark, duck, name):
    ok, message = compare(spark, duck, SF_DIR, all_queries()[name], all_sql().get(name))
    assert ok, message
