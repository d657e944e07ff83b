"""Steps whose cost a task or an exchange must not pay again as tables grow."""

import re

from tavola.operators import reports as R
from tavola.sources import requests as Q
from tavola.sources.tables import raw_seed_rows, tables_from_rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_cart_lines_follow_their_number(spark, tmp_path, monkeypatch):
    d = str(tmp_path)
    spark.range(40).selectExpr("id div 4 as l_orderkey", "id % 5 as l_partkey", "cast(id % 4 as int) as l_linenumber",
                               "cast(2 as double) as l_quantity").write.parquet(f"{d}/lineitem.parquet")
    spark.range(10).selectExpr("id as o_orderkey", "id as o_custkey", "'1-URGENT' as o_orderpriority").write.parquet(f"{d}/orders.parquet")
    spark.range(5).selectExpr("id as p_partkey", "concat('p', id) as p_name", "'b' as p_brand", "cast(1 as double) as p_retailprice"
                              ).write.parquet(f"{d}/part.parquet")
    monkeypatch.setattr(Q, "LINES_A_TASK", 3, raising=False)
    lines = Q.cart_lines(spark, d)
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L, 14\), REPARTITION_BY_NUM", _plan(lines))
    assert lines.count() == 40
    got = {r.request_seq: (r.item_count, r.distinct_items) for r in R.cart_summary(lines).collect()}
    assert got == {i: (8, 4) for i in range(10)}


def test_nested_orders_take_one_exchange_of_full_rows(spark):
    plan = _plan(R.all_orders_nested(tables_from_rows(spark, raw_seed_rows())))
    # Exchanges whose keys include the order id: the rows of an order come together once.
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*\border_id#", plan)) == 1


def test_orders_meet_lines_with_their_menu_items(spark):
    """The menu id is no key of a join once the order's columns are there."""
    tree = R._all_order_rows(tables_from_rows(spark, raw_seed_rows()))._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join LeftOuter, \((\w+)#", tree)
    assert joins[0] == "item_id" and joins.index("item_id") < joins.index("menu_id")


def test_basket_lines_read_once(spark, monkeypatch):
    """The stored lines are written before the two steps that read them."""
    from tavola.operators import changes as C
    kept = []
    plain = C.written
    monkeypatch.setattr(C, "written", lambda df, name: kept.append(name) or plain(df, name))
    t = tables_from_rows(spark, raw_seed_rows())
    ask = spark.createDataFrame([(1, "I001", [("Veggie Delight Pizza", 2)]), (2, "I002", [("Nothing", 1)])],
                                "request_seq long, item_id string, items array<struct<item_name string, quantity int>>")
    res = C.apply_basket_lines(t, ask)
    assert sorted((r.request_seq, r.reason) for r in res.verdicts.collect()) == [(1, None), (2, "unknown_item")]
    assert {(r.item_id, r.quantity) for r in res.tables["items"].collect() if r.item_id < "I003"} == {("I001", 4), ("I002", 1)}
    assert kept.count("stored-lines") == 1


def test_sorted_orders_take_one_exchange_of_full_rows(spark):
    """The exchange of the sort also serves DISTINCT, on lines and rows that are written before."""
    from pyspark.sql import functions as F
    t = tables_from_rows(spark, raw_seed_rows())
    t["orders"] = t["orders"].unionByName(t["orders"])
    out = R.all_orders(t)
    assert re.findall(r"Exchange (\w+)", _plan(out)) == ["rangepartitioning"]
    got = [(r.order_date, r.order_id, r.menu_id) for r in out.collect()]
    assert [g[1] for g in got] == [f"O00{i}" for i in range(7, 0, -1)]
    one = R._all_order_rows(t)
    assert sorted(out.collect(), key=str) == sorted(one.collect(), key=str) and one.filter(F.col("menu_id").isNull()).count() == 0


def test_written_gives_its_shuffles_back(spark):
    import time
    from tavola.session import SHUFFLE_CLEANUP, written

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before, was = files(), spark.conf.get(SHUFFLE_CLEANUP)
    df = spark.range(1000).groupBy("id").count()
    out = written(df, "given-back")
    ends = time.time() + 20
    while files() - before and time.time() < ends:
        time.sleep(0.5)
    assert not files() - before and spark.conf.get(SHUFFLE_CLEANUP) == was
    assert out.count() == df.count() == 1000


def test_basket_lines_meet_the_full_ones_without_moving(spark):
    """The lines that exceed their column are written first, so the others need no exchange by line to meet them."""
    from tavola.operators import changes as C
    t = tables_from_rows(spark, raw_seed_rows())
    most = (1 << 31) - 1
    ask = spark.createDataFrame([(1, "I001", [("Veggie Delight Pizza", 2)]), (2, "I002", [("Tiramisu", most)]), (3, "I002", [("Tiramisu", 1)]),
                                 (4, "I002", [("Alfredo Pasta", 1)]), (5, "I009", []), (6, None, [("Tiramisu", 1)])],
                                "request_seq long, item_id string, items array<struct<item_name string, quantity int>>")
    res = C.apply_basket_lines(t, ask)
    assert {r.request_seq: r.reason for r in res.verdicts.collect()} == {
        1: None, 2: "quantity_overflow", 3: "quantity_overflow", 4: None, 5: "empty_basket", 6: "missing_item_id"}
    assert not re.search(r"Exchange hashpartitioning\([^)]*\bmenu_id#", _plan(res.verdicts))


def test_lines_of_faulty_carts_are_joined_before_they_are_grouped(spark, tmp_path):
    d = str(tmp_path)
    spark.range(40).selectExpr("id div 4 as l_orderkey", "id % 5 as l_partkey", "cast(id % 4 as int) as l_linenumber",
                               "cast(2 as double) as l_quantity").write.parquet(f"{d}/lineitem.parquet")
    spark.range(12).selectExpr("id as o_orderkey", "id as o_custkey", "'1-URGENT' as o_orderpriority").write.parquet(f"{d}/orders.parquet")
    spark.range(5).selectExpr("id as p_partkey", "concat('p', id) as p_name", "'b' as p_brand").write.parquet(f"{d}/part.parquet")
    carts = Q.faulty_carts(spark, d)
    assert "Join" not in _plan(carts)
    sizes = {r.item_id: len(r["items"]) for r in carts.collect()}     # order 1 has no basket id and is left out of the lines
    assert sizes == {(None if i == 1 else f"I{90000000 + i if i % 4 == 3 else i}"): 4 if i < 10 and i != 1 else 0 for i in range(12)}
