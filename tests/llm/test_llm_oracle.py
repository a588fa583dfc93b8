"""Every registered query for training data against its SQL, on the smallest tables."""

import oracle
import pytest

from sylvaframe.llm import queries

SF = "sf0.001"

pytestmark = pytest.mark.skipif(not (oracle.DATA / SF).exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_its_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), queries.QUERIES[name], queries.ORACLE[name], SF) == ""
