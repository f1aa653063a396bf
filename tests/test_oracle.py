"""Every registered query against its SQL twin (DuckDB) on driver data."""
import os

import pytest

from flowgauge.plans.registry import ORACLE, QUERIES
from tests.oracle_check import compare, duck

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF), ORACLE[name], SF, con)
    assert ok, f"{name}: {msg}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns
    df.count()
