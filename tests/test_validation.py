"""Validation over faulty tables: every rule fires, and all hits are as the rules say."""

import random
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from tavola.operators import validate as V
from tavola.plans.catalog_checks import VIOLATIONS_SQL
from tavola.schema import PRIMARY_KEYS, SCHEMAS, TEXT_LIMITS
from tavola.sources.tables import tables_from_rows

OTHER_RULES = {("items", "orphan_basket"), ("items", "line_price_changed"), ("orders", "order_without_basket"), ("orders", "total_mismatch"),
               ("payment", "amount_mismatch"), ("deliveries", "state_mismatch"), ("orders", "item_unavailable"),
               ("orders", "duplicate_pending"), ("orders", "double_assignment")}


def test_every_rule_fires(spark):
    df = E.queries()["violations_of_faulty_tables"](spark, "/root/testdata/sf0.01")
    fired = {(r["table_name"], r["rule"]) for r in df.select("table_name", "rule").distinct().collect()}
    want = {(t, V.rule_name(k, c)) for t, k, c, _ in V.ROW_RULES} | {(t, "duplicate_key") for t in PRIMARY_KEYS}
    want |= {(t, f"duplicate_unique:{c}") for t, c in V.UNIQUE_KEYS} | {(c, f"fk:{col}") for c, col, _, _ in V.FOREIGN_KEYS} | OTHER_RULES
    assert fired == want
    assert TEXT_LIMITS and len(want) > 80


def random_tables(seed):
    """Small tables with few keys: duplicates, nulls, missing owners, owners that differ."""
    rng = random.Random(seed)
    key = lambda p, n=6: rng.choice([None, *[f"{p}{i}" for i in range(n)]])
    money = lambda: rng.choice([None, Decimal("0.00"), Decimal("2.50"), Decimal("5.00"), Decimal("7.50")])
    make = {
        "employee": lambda: (key("E"), "n", "Chef", rng.choice([None, Decimal(1), Decimal(2)]), Decimal(1)),
        "customer": lambda: (key("C"), "n", rng.choice([None, "a@b.cc", "b@b.cc"]), "1234567890", "x"),
        "menu": lambda: (key("M"), "n", "Drinks", money(), "d", rng.choice(["Available", "Not Available"]), None),
        "items": lambda: (key("I"), key("M"), rng.choice([None, 0, 1, 2, 3]), money()),
        "orders": lambda: (key("O"), key("C"), key("I"), money(), rng.choice(["Pending", "Completed", "Cancelled", None]), None),
        "delivery": lambda: (key("D"), key("E"), None),
        "deliveries": lambda: (key("X"), key("O"), key("D"), rng.choice(["Out for Delivery", "Delivered", "Cancelled", None]), None),
        "payment": lambda: (key("P"), key("O"), money(), "Pending", "UPI", None),
        "feedback": lambda: (key("F"), key("O"), key("C"), None, None),
    }
    return {t: [make[t]() for _ in range(rng.choice([0, 5, 9, 14]))] for t in SCHEMAS}


@pytest.mark.parametrize("seed", range(6))
def test_random_tables_equal_the_rules(spark, seed):
    rows = random_tables(seed)
    con = duckdb.connect()
    kinds = {"string": "varchar", "timestamp_ntz": "timestamp"}
    for t, schema in SCHEMAS.items():
        con.execute(f"create table r_{t} (" + ", ".join(f"{f.name} {kinds.get(f.dataType.simpleString(), f.dataType.simpleString())}"
                                                        for f in schema) + ")")
        if rows[t]:
            con.executemany(f"insert into r_{t} values ({', '.join('?' * len(schema))})", rows[t])
    want = sorted(map(str, con.execute(VIOLATIONS_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in V.validate(tables_from_rows(spark, rows)).collect()) == want


def test_one_table_only(spark):
    """The rules of one table read what that table needs, with the rows that all tables' rules give for it."""
    t = tables_from_rows(spark, random_tables(3))
    every = [tuple(r) for r in V.validate(t).collect()]
    for table in ("customer", "orders", "items"):
        got = V.validate(t, only=(table,))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in every if r[0] == table), table
    assert not [r for r in V.suspect_keys(t, ("customer",)).collect() if r.space not in ("customer", "customer.email")]


def test_lines_send_two_keys(spark):
    """A line's menu item is looked up once, beside the line's own key and its basket."""
    assert len(V._tags("items", tuple(SCHEMAS))) == 2
