import os

import pytest

from postlake.plans.queries import load_all
from tests.oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
REGISTRY = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.oracle])
def test_agrees_with_sql(spark, con, name):
    assert compare(spark, con, REGISTRY[name], SF) is None


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if not q.oracle])
def test_runs(spark, name):
    assert REGISTRY[name].run(spark, SF).count() > 0
