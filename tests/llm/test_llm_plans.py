"""Physical plans of the training-data queries: no Cartesian product, no nested loop."""

import pytest

from conftest import SF001
from tavola.llm.registry import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
