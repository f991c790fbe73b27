"""Every registered query with SQL, on the smallest tables, against DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402

from analystry.registry import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return compare.open_oracle(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, oracle, name):
    verdict, _, detail = compare.compare_one(spark, oracle, SF_DIR, name, QUERIES[name], ORACLES[name])
    assert verdict == "ok", detail


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
