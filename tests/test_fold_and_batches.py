"""Change batches: the sequential order state machine against brute force,
plus property checks of the other batch operators."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tavola.operators import changes as C
from tavola.schema import ORDER_STATUSES, OTHER, transitions

STATUSES = list(ORDER_STATUSES)


def brute_force(current: dict, requests: list, mode: str):
    """Apply requests one by one exactly like the source server."""
    allowed = set(transitions(mode))
    state = dict(current)
    out = {}
    for seq, oid, status in sorted(requests):
        if status not in STATUSES:
            out[seq] = (False, "invalid_status")
            continue
        if oid not in state:
            out[seq] = (False, "order_not_found")
            continue
        cur = state[oid] if state[oid] in STATUSES else OTHER
        if (cur, status) in allowed:
            state[oid] = status
            out[seq] = (True, None)
        else:
            out[seq] = (False, "invalid_transition")
    return out, state


def _orders_frame(spark, seed, current):
    base = seed["orders"].limit(1).collect()[0]
    data = [(oid, base.customer_id, base.item_id, base.total_price, st, base.order_date) for oid, st in current.items()]
    return spark.createDataFrame(data, seed["orders"].schema)


@pytest.mark.parametrize("mode,width", [("lenient", 2), ("strict", 3), ("lenient", 8), ("strict", 512)])
def test_order_status_matches_sequential(spark, seed, mode, width):
    rnd = random.Random(7 + width)
    current = {f"O{i:03d}": rnd.choice(STATUSES + ["Paid"]) for i in range(12)}
    # A hot order holding a third of the requests, plus unknown ids and statuses.
    reqs = []
    for seq in range(120):
        oid = "O000" if seq % 3 == 0 else rnd.choice(list(current) + ["O999"])
        st = rnd.choice(STATUSES + ["Bogus"])
        reqs.append((seq * 5 + rnd.randint(0, 4), oid, st))
    expected, final = brute_force(current, reqs, mode)
    t = dict(seed)
    t["orders"] = _orders_frame(spark, seed, current)
    req_df = spark.createDataFrame(reqs, "request_seq long, order_id string, status string")
    res = C.apply_order_status(t, req_df, mode=mode, refresh_totals=False, width=width)
    got = {r.request_seq: (r.accepted, r.reason) for r in res.verdicts.collect()}
    assert got == expected
    new = dict(rows(res.tables["orders"], "order_id", "order_status"))
    assert new == final


def test_order_status_propagates_to_deliveries(spark, seed):
    req = spark.createDataFrame([(1, "O002", "Completed"), (2, "O007", "Completed"), (3, "O004", "Cancelled")],
                                "request_seq long, order_id string, status string")
    res = C.apply_order_status(seed, req)
    assert {r.request_seq: r.accepted for r in res.verdicts.collect()} == {1: True, 2: True, 3: True}
    d = dict(rows(res.tables["deliveries"], "order_id", "delivery_status"))
    assert d["O007"] == "Delivered"
    o = dict(rows(res.tables["orders"], "order_id", "order_status"))
    assert o["O002"] == "Completed" and o["O004"] == "Cancelled"


def test_assignment_one_per_courier(spark, seed):
    req = spark.createDataFrame([(1, "O002", "E004"), (2, "O004", "E004"), (3, "O002", "E010"),
                                 (4, "O002", "E001"), (5, "O002", "E999"), (6, "O404", "E005")],
                                "request_seq long, order_id string, delivery_person_id string")
    res = C.apply_assignments(seed, req)
    got = {r.request_seq: r.reason for r in res.verdicts.collect()}
    assert got == {1: None, 2: "courier_busy", 3: "courier_busy", 4: "not_delivery_person",
                   5: "employee_not_found", 6: "order_not_found"}
    new = res.extra["new_deliveries"].collect()
    assert [(r.delivery_id, r.order_id, r.delivery_person_id) for r in new] == [("D005", "O002", "D001")]
    assert dict(rows(res.tables["orders"], "order_id", "order_status"))["O002"] == "Processing"


def test_registrations(spark, seed):
    req = spark.createDataFrame([
        (1, "A", "priya.iyer@gmail.com", "7111111111", "x"),    # e-mail taken
        (2, "B", "b@x.com", "7009876543", "x"),                 # phone taken
        (3, "C", "c@x.com", "71111", "x"),                      # bad phone
        (4, "D", "d@x.com", "7222222222", "x"),                 # ok -> C011
        (5, "E", "d@x.com", "7333333333", "x"),                 # e-mail used earlier in batch
        (6, "F", "f@x.com", "7444444444", ""),                  # missing address
        (7, "G", "g@x.com", "7555555555", "y"),                 # ok -> C012
    ], "request_seq long, name string, email string, phone_number string, address string")
    res = C.apply_registrations(seed, req)
    got = {r.request_seq: r.reason for r in res.verdicts.collect()}
    assert got == {1: "email_registered", 2: "phone_registered", 3: "invalid_phone", 4: None, 5: "email_in_batch",
                   6: "missing_fields", 7: None}
    assert rows(res.extra["new_customers"], "customer_id", "name") == [("C011", "D"), ("C012", "G")]
    assert res.tables["customer"].count() == 12


def test_deletes_are_idempotent(spark, seed):
    ids = spark.createDataFrame([(1, "C010"), (2, "C001"), (3, "C404")], "request_seq long, customer_id string")
    first = C.apply_customer_deletes(seed, ids)
    assert {r.request_seq: r.reason for r in first.verdicts.collect()} == {1: None, 2: "has_orders", 3: "not_found"}
    t2 = dict(seed)
    t2["customer"] = first.tables["customer"]
    again = C.apply_customer_deletes(t2, ids)
    assert {r.request_seq: r.reason for r in again.verdicts.collect()}[1] == "not_found"


def test_account_delete_guard(spark, seed):
    ids = spark.createDataFrame([(1, "C002"), (2, "C001"), (3, "C010")], "request_seq long, customer_id string")
    got = {r.request_seq: r.reason for r in C.apply_account_deletes(seed, ids).verdicts.collect()}
    assert got == {1: "active_orders", 2: "referenced", 3: None}


def test_basket_quantities_add(spark, seed):
    req = spark.createDataFrame([
        (1, "I001", [("Veggie Delight Pizza", 1), ("Veggie Delight Pizza", 2)]),
        (2, "I001", [("Tiramisu", 1)]),
        (3, "I002", [("No Such Dish", 1)]),
    ], "request_seq long, item_id string, items array<struct<item_name:string,quantity:int>>")
    res = C.apply_basket_lines(seed, req)
    assert {r.request_seq: r.reason for r in res.verdicts.collect()} == {1: None, 2: None, 3: "unknown_item"}
    items = {(r.item_id, r.menu_id): (r.quantity, r.price) for r in res.tables["items"].collect()}
    assert items[("I001", "M001")] == (5, Decimal("995.00"))
    assert items[("I001", "M004")] == (1, Decimal("200.00"))
    assert items[("I002", "M004")] == (1, Decimal("200.00"))


def test_place_orders(spark, seed):
    carts = spark.createDataFrame([
        (10, "C001", [("Tiramisu", 2), ("Paneer Tikka", 1)], "Cash"),
        (11, "C002", [("Gulab Jamun", 1)], "UPI"),
        (12, "C003", [("Mystery", 1)], "UPI"),
        (13, "C404", [("Tiramisu", 1)], "UPI"),
        (14, "C004", [], "UPI"),
    ], "request_seq long, customer_id string, items array<struct<item_name:string,quantity:int>>, payment_method string")
    res = C.place_orders(seed, carts)
    assert {r.request_seq: r.reason for r in res.verdicts.collect()} == {
        10: None, 11: None, 12: "unknown_item", 13: "customer_not_found", 14: "empty_cart"}
    o = {r.order_id: (r.item_id, r.total_price, r.order_status) for r in res.extra["new_orders"].collect()}
    assert o == {"O008": ("I008", Decimal("490.00"), "Pending"), "O009": ("I009", Decimal("79.00"), "Pending")}
    p = {r.payment_id: (r.order_id, r.amount, r.payment_status) for r in res.extra["new_payments"].collect()}
    assert p == {"P008": ("O008", Decimal("490.00"), "Pending"), "P009": ("O009", Decimal("79.00"), "Completed")}


def test_feedback_upsert(spark, seed):
    req = spark.createDataFrame([
        (1, "O001", "C001", Decimal("3.0"), "ok"),        # update F001
        (2, "O002", "C002", Decimal("4.0"), "nice"),      # insert F004
        (3, "O002", "C002", Decimal("5.0"), "great"),     # updates the new row
        (4, "O003", "C001", Decimal("4.0"), "x"),         # not the owner
        (5, "O004", "C004", Decimal("6.0"), "x"),         # out of range
        (6, "O004", "C004", Decimal("0.0"), "x"),         # 0 is missing
    ], "request_seq long, order_id string, customer_id string, rating_score decimal(2,1), feedback_text string")
    res = C.apply_feedback(seed, req)
    assert {r.request_seq: r.reason for r in res.verdicts.collect()} == {
        1: None, 2: None, 3: None, 4: "order_not_found", 5: "rating_out_of_range", 6: "missing_fields"}
    fb = {r.rating_id: (r.order_id, r.rating_score, r.feedback_text) for r in res.tables["feedback"].collect()}
    assert fb["F001"] == ("O001", Decimal("3.0"), "ok")
    assert fb["F004"] == ("O002", Decimal("5.0"), "great")
    assert len(fb) == 4


def test_menu_updates_and_deletes(spark, seed):
    req = spark.createDataFrame([
        (1, "M001", "Pizza", "d", Decimal("210.00"), "Veg Main Course", "Available"),
        (2, "M001", "Pizza 2", "d", Decimal("220.00"), "Veg Main Course", "Not Available"),
        (3, "M002", "Pasta", "d", Decimal("-1.00"), "Veg Main Course", "Available"),
        (4, "M404", "X", "d", Decimal("1.00"), "Drinks", "Available"),
    ], "request_seq long, menu_id string, name string, description string, price decimal(10,2), category string, "
       "availability_status string")
    res = C.apply_menu_updates(seed, req)
    assert {r.request_seq: r.reason for r in res.verdicts.collect()} == {1: None, 2: None, 3: "invalid_price",
                                                                          4: "not_found"}
    m = {r.menu_id: (r.item_name, r.price, r.availability_status) for r in res.tables["menu"].collect()}
    assert m["M001"] == ("Pizza 2", Decimal("220.00"), "Not Available")
    dels = spark.createDataFrame([(1, "M001"), (2, "M003"), (3, "M404")], "request_seq long, menu_id string")
    got = {r.request_seq: r.reason for r in C.apply_menu_deletes(seed, dels).verdicts.collect()}
    assert got == {1: "ordered", 2: None, 3: "not_found"}


def test_delivery_status(spark, seed):
    req = spark.createDataFrame([(1, "O007", "D004", "Delivered"), (2, "O007", "D001", "Delivered"),
                                 (3, "O001", "D001", "Lost")],
                                "request_seq long, order_id string, delivery_person_id string, status string")
    res = C.apply_delivery_status(seed, req)
    assert {r.request_seq: r.reason for r in res.verdicts.collect()} == {
        1: None, 2: "not_found_or_unauthorized", 3: "invalid_status"}
    assert dict(rows(res.tables["orders"], "order_id", "order_status"))["O007"] == "Completed"
    d = {r.order_id: (r.delivery_status, r.delivery_time is not None) for r in res.tables["deliveries"].collect()}
    assert d["O007"] == ("Delivered", True)


def test_employee_changes_and_routes(spark, seed):
    req = spark.createDataFrame([
        (1, "insert", None, "New Courier", "Delivery", Decimal(6111111111), Decimal("100.00")),
        (2, "insert", None, "Dup Phone", "Chef", Decimal(6009876543), Decimal("100.00")),
        (3, "insert", None, "Bad Role", "Waiter", Decimal(6222222222), Decimal("100.00")),
        (4, "update", "E002", "Rohan V", "Chef", Decimal(6009876544), Decimal("36000.00")),
        (5, "delete", "E010", None, None, None, None),   # courier with a delivery out
        (6, "delete", "E003", None, None, None, None),
        (7, "insert", None, "New Chef", "Chef", Decimal(6333333333), Decimal("100.00")),
    ], "request_seq long, op string, employee_id string, name string, role string, phone_number decimal(10,0), "
       "salary decimal(18,2)")
    res = C.apply_employee_changes(seed, req)
    assert {r.request_seq: r.reason for r in res.verdicts.collect()} == {
        1: None, 2: "duplicate_phone", 3: "invalid_role", 4: None, 5: "active_deliveries", 6: None, 7: None}
    emp = {r.employee_id: r.name for r in res.tables["employee"].collect()}
    assert emp["E011"] == "New Courier" and emp["E012"] == "New Chef" and emp["E002"] == "Rohan V" and "E003" not in emp
    routed = C.route_new_employees(res.extra["new_employees"])
    assert rows(routed["delivery"], "delivery_id", "employee_id") == [("D011", "E011")]
    assert rows(routed["chef"], "employee_id") == [("E012",)]


def test_change_audit(spark, seed):
    new = seed["customer"].withColumn("email", F.when(F.col("customer_id") == "C001", "p@x.com")
                                      .otherwise(F.col("email")))
    log = C.change_audit(seed["customer"], new, "customer_id", "email", min_length=8).collect()
    assert [(r.customer_id, r.old_value, r.new_value, r.reason) for r in log] == [
        ("C001", "priya.iyer@gmail.com", "p@x.com", "too_short")]


def test_random_assignment_is_repeatable(spark, seed):
    a = rows(C.random_assignment(seed, seed["orders"], seed=3))
    b = rows(C.random_assignment(seed, seed["orders"], seed=3))
    assert a == b and all(r[2] is not None for r in a)
    assert {r[1] for r in a} <= {1, 2, 3, 4}


# The expected transition tables (from, to) -> accepted.
LENIENT_OK = {("Pending", "Pending"), ("Processing", "Pending"), ("Completed", "Pending"), ("Cancelled", "Pending"),
              ("Pending", "Processing"), ("Processing", "Completed"), ("Pending", "Cancelled"),
              ("Processing", "Cancelled"), ("Cancelled", "Cancelled")}
STRICT_OK = {("Pending", "Processing"), ("Pending", "Cancelled"), ("Processing", "Completed"),
             ("Processing", "Cancelled")}


@pytest.mark.parametrize("mode,ok", [("lenient", LENIENT_OK), ("strict", STRICT_OK)])
def test_all_transitions(spark, seed, mode, ok):
    current = {f"O{i}{j}": a for i, a in enumerate(STATUSES) for j in range(4)}
    reqs = [(n, f"O{i}{j}", b) for n, (i, j, b) in enumerate(
        (i, j, STATUSES[j]) for i in range(4) for j in range(4))]
    t = dict(seed)
    t["orders"] = _orders_frame(spark, seed, current)
    df = spark.createDataFrame(reqs, "request_seq long, order_id string, status string")
    res = C.apply_order_status(t, df, mode=mode, refresh_totals=False)
    got = {(current[r.order_id], r.status): r.accepted for r in res.verdicts.collect()}
    assert got == {(a, b): (a, b) in ok for a in STATUSES for b in STATUSES}


def test_verdicts_cover_every_request(spark):
    """accepted + rejected = requests, for every batch built from sf0.001."""
    from conftest import SF001
    from tavola.sources import requests as Q
    from tavola.sources.tables import star_tables
    t = star_tables(spark, SF001)
    def ask(name):
        return Q.request_frame(spark, SF001, name)
    cases = [(apply(t, ask(name)).verdicts, ask(name)) for apply, name in (
        (C.apply_order_status, "statuses"), (C.apply_assignments, "assignments"), (C.apply_registrations, "registrations"),
        (C.apply_profile_updates, "profiles"), (C.apply_feedback, "feedbacks"), (C.apply_menu_updates, "menu_updates"),
        (C.apply_menu_deletes, "menu_deletes"), (C.apply_customer_deletes, "customer_deletes"), (C.apply_employee_changes, "employees"))]
    carts = Q.faulty_carts(spark, SF001)
    cases += [(C.place_orders(t, carts).verdicts, carts), (C.apply_basket_lines(t, carts).verdicts, carts)]
    for verdicts, reqs in cases:
        seqs = [r.request_seq for r in verdicts.select("request_seq").collect()]
        assert sorted(seqs, key=str) == sorted((r.request_seq for r in reqs.select("request_seq").collect()), key=str)
        assert verdicts.filter("accepted and reason is not null or not accepted and reason is null").count() == 0


def test_second_application_is_rejected(spark, seed):
    req = spark.createDataFrame([(1, "D", "d@x.com", "7222222222", "x")],
                                "request_seq long, name string, email string, phone_number string, address string")
    first = C.apply_registrations(seed, req)
    t2 = dict(seed)
    t2["customer"] = first.tables["customer"]
    assert [r.reason for r in C.apply_registrations(t2, req).verdicts.collect()] == ["email_registered"]
    asg = spark.createDataFrame([(1, "O002", "E004")], "request_seq long, order_id string, delivery_person_id string")
    a1 = C.apply_assignments(seed, asg)
    t3 = dict(seed)
    t3["deliveries"] = a1.tables["deliveries"]
    assert [r.reason for r in C.apply_assignments(t3, asg).verdicts.collect()] == ["courier_busy"]
