"""Physical-plan properties of the restaurant queries.

* no Cartesian products, nested loops or Python evaluation anywhere;
* on stored tables, filters reach the Parquet scan and only needed columns are read.
"""

import re

import pytest

from conftest import SF001
from tavola.operators import reports as R
from tavola.plans.registry import all_queries
from tavola.sources.sinks import read_snapshot, write_snapshot

QUERIES = {name: fn for name, (fn, _sql) in all_queries().items()}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_nested_loop_or_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    for op in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
               "MapInPandas", "MapInArrow", "PythonUDF"):
        assert op not in plan, op


def test_pushdown_and_pruning_on_stored_tables(spark, seed, tmp_path):
    out = str(tmp_path / "snap")
    write_snapshot(seed, out, 1)
    t = read_snapshot(spark, out, 1)
    plan = _plan(R.unassigned_orders(t))
    assert "PushedFilters: [IsNotNull(order_status), EqualTo(order_status,Pending)" in plan
    assert "PushedFilters: [IsNotNull(delivery_status), EqualTo(delivery_status,Out for Delivery)" in plan
    # Only the columns the report needs are read from the deliveries table.
    assert "ReadSchema: struct<order_id:string,delivery_status:string>" in plan
    # P7 ignores case, so its filter runs over the scan, which is pruned all the same.
    plan = _plan(R.orders_by_status(R.order_headers(t), "processing"))
    assert "lower(order_status" in plan and "= processing" in plan
    assert "ReadSchema: struct<customer_id:string,name:string,email:string>" in plan


def test_top_k_is_take_ordered(spark, seed):
    assert "TakeOrderedAndProject" in _plan(R.top_items(seed))


def test_validation_scans_each_table_twice(spark, tmp_path, seed):
    """Once for the keys of all tables (one exchange), once for the rows' own rules; V5 and V6
    read orders, lines and menu once more."""
    from tavola.operators import validate as V
    out = str(tmp_path / "snap")
    write_snapshot(seed, out, 1)
    t = read_snapshot(spark, out, 1)
    keys = _plan(V.suspect_keys(t))
    assert keys.count("FileScan parquet") == 9 and keys.count("Exchange hashpartitioning") == 1
    rows = _plan(V.validate(t))
    read = re.findall(r"FileScan parquet \[([^\]]*)\]", rows)
    for column in ("amount", "delivery_status", "feedback_text", "email", "salary", "quantity", "total_price"):
        assert sum(f"{column}#" in r for r in read) == 1, column
