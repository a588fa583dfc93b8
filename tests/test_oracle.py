"""Every registered query of the core against its SQL, on the smallest tables."""

import oracle
import pytest

from sylvaframe.plans import p_queries, queries

SF = "sf0.001"
PAIRS = {k: (m.QUERIES[k], sql) for m in (p_queries, queries) for k, sql in m.ORACLE.items()}

pytestmark = pytest.mark.skipif(not (oracle.DATA / SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_equals_its_sql(spark, con, name):
    assert oracle.compare(spark, con, *PAIRS[name], SF) == ""
