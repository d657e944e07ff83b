"""Change batches publish only tables that keep the schema's rules."""

import itertools

import pytest

from tavola.operators import changes as C
from tavola.operators.fold import fold_transitions
from tavola.schema import ORDER_STATUSES, transitions


def reasons(result, *key):
    return {tuple(r[k] for k in (key or ("request_seq",))): r["reason"] for r in result.verdicts.collect()}


def unique(df, col):
    return df.select(col).distinct().count() == df.count()


def test_registrations_need_their_own_number(spark, seed):
    req = spark.createDataFrame(
        [(None, "A", "a@x.com", "9000000001", "s"), (None, "B", "a@x.com", "9000000002", "s"),
         (5, "C", "c@x.com", "9000000003", "s"), (5, "D", "c@x.com", "9000000004", "s"),
         (6, "E", "e@x.com", "9000000005", "s"), (7, "F", "e@x.com", "9000000006", "s")],
        "request_seq long, name string, email string, phone_number string, address string")
    res = C.apply_registrations(seed, req)
    assert reasons(res, "name") == {("A",): "missing_request_seq", ("B",): "missing_request_seq",
                                    ("C",): "repeated_request_seq", ("D",): "repeated_request_seq",
                                    ("E",): None, ("F",): "email_in_batch"}
    assert unique(res.tables["customer"], "email") and unique(res.tables["customer"], "phone_number")


ITEMS = "array<struct<item_name:string,quantity:int>>"


@pytest.mark.parametrize("bad", [None, -5, 0])
def test_order_quantities(spark, seed, bad):
    name = seed["menu"].orderBy("menu_id").first()["item_name"]
    customer = seed["customer"].first()["customer_id"]
    carts = spark.createDataFrame([(1, customer, [(name, 2)], "UPI"), (2, customer, [(name, 3), (name, bad)], "UPI"),
                                   (3, customer, [(None, 1), (name, 1)], "UPI"), (4, customer, [], "UPI")],
                                  f"request_seq long, customer_id string, items {ITEMS}, payment_method string")
    res = C.place_orders(seed, carts)
    assert reasons(res) == {(1,): None, (2,): "bad_quantity", (3,): "unknown_item", (4,): "empty_cart"}
    assert res.extra["new_orders"].filter("total_price > 0").count() == res.extra["new_orders"].count() == 1
    assert res.extra["new_items"].filter("quantity is null or quantity < 1 or price is null").count() == 0
    basket = seed["items"].first()["item_id"]
    lines = spark.createDataFrame([(1, basket, [(name, bad)]), (2, basket, [(name, 1)])],
                                  f"request_seq long, item_id string, items {ITEMS}")
    res = C.apply_basket_lines(seed, lines)
    assert reasons(res) == {(1,): "bad_quantity", (2,): None}
    assert res.tables["items"].filter("quantity is null or quantity < 1").count() == 0


def test_priceless_orders_are_rejected(spark, seed):
    from pyspark.sql import functions as F
    t = dict(seed)
    t["menu"] = seed["menu"].withColumn("price", F.lit(None).cast("decimal(10,2)"))
    name = seed["menu"].first()["item_name"]
    carts = spark.createDataFrame([(1, seed["customer"].first()["customer_id"], [(name, 2)], "UPI")],
                                  f"request_seq long, customer_id string, items {ITEMS}, payment_method string")
    assert reasons(C.place_orders(t, carts)) == {(1,): "invalid_total"}


EMP = "request_seq long, op string, employee_id string, name string, role string, phone_number decimal(10,0), salary decimal(18,2)"


def test_employee_phones_and_deletes(spark, seed):
    from decimal import Decimal as D
    p, q = D(6111111111), D(6222222222)
    free = seed["employee"].join(seed["delivery"], "employee_id", "left_anti").orderBy("employee_id").first()["employee_id"]
    one, two, three = [r["employee_id"] for r in seed["employee"].orderBy("employee_id").collect()
                       if r["employee_id"] != free][:3]
    req = spark.createDataFrame(
        [(1, "update", one, "A", "Chef", p, D(5)), (2, "update", two, "B", "Chef", p, D(5)),
         (3, "insert", None, "C", "Chef", p, D(5)), (4, "update", one, "A2", "Chef", p, D(6)),
         (5, "delete", free, None, None, None, None), (6, "update", free, "D", "Chef", q, D(5)),
         (7, "delete", free, None, None, None, None), (8, "insert", None, "F", "Chef", q, D(5)),
         (9, "insert", None, "G", "Chef", q, D(5)), (9, "delete", three, None, None, None, None)], EMP)
    res = C.apply_employee_changes(seed, req)
    got = {(r["request_seq"], r["op"]): r["reason"] for r in res.verdicts.collect()}
    assert got == {(1, "update"): None, (2, "update"): "duplicate_phone", (3, "insert"): "duplicate_phone",
                   (4, "update"): None, (5, "delete"): None, (6, "update"): "not_found", (7, "delete"): "not_found",
                   (8, "insert"): None, (9, "insert"): "repeated_request_seq", (9, "delete"): "repeated_request_seq"}
    assert unique(res.tables["employee"], "phone_number")


def test_status_verdicts_do_not_depend_on_the_width(spark, seed):
    reqs = [(s, "O001", st) for s, st in zip(itertools.cycle([3, 1, None, 2, 2]), list(ORDER_STATUSES) * 5, strict=False)]
    reqs += [(7, f"O00{i}", ORDER_STATUSES[i % 4]) for i in range(2, 7)]
    cur = seed["orders"].select("order_id", "order_status")
    req = spark.createDataFrame(reqs, "request_seq long, order_id string, status string")
    out = []
    for width in (2, 64, 512):
        f = fold_transitions(req, "order_id", "request_seq", "status", cur, list(ORDER_STATUSES), transitions("lenient"),
                             width=width)
        out.append(sorted((str(tuple(r)) for r in f.collect())))
        v = C.apply_order_status(seed, req, width=width, refresh_totals=False).verdicts
        out[-1].append(sorted(str(tuple(r)) for r in v.collect()))
    assert out[0] == out[1] == out[2]
