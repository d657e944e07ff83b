"""Hot keys: one customer owns a third of the orders, one menu item is in a
third of the basket lines, one courier gets a third of the assignment
requests. Results must equal brute force computed in pandas."""

import datetime as dt
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tavola.operators import changes as C
from tavola.operators import reports as R
from tavola.schema import SCHEMAS


@pytest.fixture(scope="module")
def skewed(spark, seed):
    n = 3000
    orders, items = [], []
    for i in range(n):
        cust = "C001" if i % 3 == 0 else f"C{(i % 10) + 1:03d}"
        status = ["Pending", "Processing", "Completed", "Cancelled"][i % 4]
        orders.append((f"O{i:05d}", cust, f"I{i:05d}", Decimal(i % 97 + 1), status,
                       dt.datetime(2024, 3, 1) + dt.timedelta(hours=i)))
        menu_id = "M001" if i % 3 == 0 else f"M{(i % 9) + 1:03d}"
        items.append((f"I{i:05d}", menu_id, i % 5 + 1, Decimal(i % 7 + 1)))
    t = dict(seed)
    t["orders"] = spark.createDataFrame(orders, SCHEMAS["orders"]).repartition(7)
    t["items"] = spark.createDataFrame(items, SCHEMAS["items"]).repartition(7)
    return t, pd.DataFrame(orders, columns=SCHEMAS["orders"].fieldNames()), \
        pd.DataFrame(items, columns=SCHEMAS["items"].fieldNames())


def test_top_customers_with_hot_customer(skewed, seed):
    t, o, _ = skewed
    c = seed["customer"].toPandas()
    j = o.merge(c, on="customer_id")
    want = (j.groupby(["name", "email"]).agg(order_count=("order_id", "count"), total_spent=("total_price", "sum"))
            .reset_index().sort_values(["total_spent", "name"], ascending=[False, True]).head(5))
    got = [(r.name, r.order_count, r.total_spent) for r in R.top_customers(t).collect()]
    assert got == [(r.name, r.order_count, r.total_spent) for r in want.itertuples()]
    assert got[0][0] == "Priya Iyer" and got[0][1] >= 1000


def test_top_items_with_hot_item(skewed, seed):
    t, o, i = skewed
    m = seed["menu"].toPandas()[["menu_id", "item_name"]]
    j = i.merge(m, on="menu_id").merge(o, on="item_id")
    want = (j.groupby("item_name").agg(order_count=("order_id", "count"), total_quantity=("quantity", "sum"),
                                       total_revenue=("total_price", "sum"))
            .reset_index().sort_values(["total_revenue", "item_name"], ascending=[False, True]).head(5))
    got = [(r.item_name, r.order_count, r.total_quantity, r.total_revenue) for r in R.top_items(t).collect()]
    assert got == [(r.item_name, r.order_count, r.total_quantity, r.total_revenue) for r in want.itertuples()]


def test_customer_profile_with_hot_customer(skewed):
    t, o, _ = skewed
    got = {r.customer_id: (r.total_orders, r.total_spent) for r in R.customer_profile(t).collect()}
    want = o.groupby("customer_id").agg(n=("order_id", "count"), s=("total_price", "sum"))
    for cid, row in want.iterrows():
        assert got[cid] == (row.n, row.s)


def test_hot_courier_assignments(spark, skewed):
    t, o, _ = skewed
    pending = o[o.order_status == "Pending"].order_id.tolist()
    reqs = [(k, oid, "E004" if k % 3 == 0 else "E005") for k, oid in enumerate(pending)]
    df = spark.createDataFrame(reqs, "request_seq long, order_id string, delivery_person_id string").repartition(5)
    v = {r.request_seq: r.reason for r in C.apply_assignments(t, df).verdicts.collect()}
    assert v[0] is None and v[1] is None
    assert all(v[k] == "courier_busy" for k in v if k > 1)


def test_hot_order_status_requests(spark, skewed):
    """A third of the status requests hit one order: the scan path handles it."""
    t, _, _ = skewed
    reqs = [(k, "O00000" if k % 3 == 0 else f"O{k:05d}", ["Processing", "Completed", "Pending"][k % 3])
            for k in range(1500)]
    df = spark.createDataFrame(reqs, "request_seq long, order_id string, status string")
    res = C.apply_order_status(t, df, refresh_totals=False, width=64)
    hot = sorted((r.request_seq, r.accepted) for r in res.verdicts.filter(F.col("order_id") == "O00000").collect())
    # O00000 starts Pending; requests alternate Processing (k%3==0 only) -> only the first is accepted,
    # later ones find it Processing.
    assert hot[0] == (0, True) and all(not a for _, a in hot[1:])
    assert len(hot) == 500
