"""Data-quality rules as one violations frame (table_name, row_key, rule).

Row-level rules (formats, allowed values, ranges, NOT NULL, text length) are
evaluated for each table in a *single scan*: every rule adds its name to an
array when it fails, the array is filtered and exploded. Rules about keys (duplicates,
foreign keys, orphans, derived values, state) share one aggregation over the
tagged keys of all tables; only keys that may break a rule are looked at again.
NULL passes a CHECK constraint, as in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.schema import (AVAILABILITY, CATEGORIES, DELIVERY_STATUSES, EMAIL_PATTERN, NOT_NULL, ORDER_STATUSES,
                           PAYMENT_METHODS, PAYMENT_STATUSES, PHONE_PATTERN, PRIMARY_KEYS, ROLES, TEXT_LIMITS)
from tavola.session import written
from tavola.sources.tables import Tables

# (table, kind, column, argument): the row-level rules.
ROW_RULES: list[tuple[str, str, str, object]] = [
    ("customer", "regex", "phone_number", PHONE_PATTERN),          # V1
    ("customer", "regex", "email", EMAIL_PATTERN),                 # V2
    ("menu", "positive", "price", None),                           # V3
    ("items", "range", "quantity", (1, 99)),                       # V4
    ("menu", "allowed", "category", CATEGORIES),                   # V7
    ("menu", "allowed", "availability_status", AVAILABILITY),
    ("employee", "allowed", "role", ROLES),
    ("orders", "allowed", "order_status", ORDER_STATUSES),
    ("deliveries", "allowed", "delivery_status", DELIVERY_STATUSES),
    ("payment", "allowed", "payment_status", PAYMENT_STATUSES),
    ("payment", "allowed", "payment_method", PAYMENT_METHODS),
    ("delivery", "range", "rating", (1, 5)),                       # V8
    ("feedback", "range", "rating_score", (1, 5)),
    ("employee", "positive", "salary", None),
    ("orders", "positive", "total_price", None),
]
ROW_RULES += [(tbl, "not_null", c, None) for tbl, cols in NOT_NULL.items() for c in cols]          # V9
ROW_RULES += [(tbl, "max_len", c, n) for tbl, lim in TEXT_LIMITS.items() for c, n in lim.items()]  # V9

# (child table, column, parent table, parent column): V11.
FOREIGN_KEYS = [
    ("items", "menu_id", "menu", "menu_id"),
    ("orders", "customer_id", "customer", "customer_id"),
    ("delivery", "employee_id", "employee", "employee_id"),
    ("deliveries", "order_id", "orders", "order_id"),
    ("deliveries", "delivery_person_id", "delivery", "delivery_id"),
    ("payment", "order_id", "orders", "order_id"),
    ("feedback", "order_id", "orders", "order_id"),
    ("feedback", "customer_id", "customer", "customer_id"),
]
UNIQUE_KEYS = [("customer", "email"), ("employee", "phone_number")]


def rule_name(kind: str, col: str) -> str:
    return f"{kind}:{col}"


def _violates(kind: str, col: str, arg) -> Column:
    c = F.col(col)
    if kind == "regex":
        return c.isNotNull() & ~c.cast("string").rlike(arg)
    if kind == "positive":
        return c.isNotNull() & (c <= 0)
    if kind == "range":
        return c.isNotNull() & ~c.between(arg[0], arg[1])
    if kind == "allowed":
        return c.isNotNull() & ~c.isin(*arg)
    if kind == "not_null":
        return c.isNull()
    if kind == "max_len":
        return c.isNotNull() & (F.length(c.cast("string")) > arg)
    raise ValueError(kind)


def row_key(table: str) -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in PRIMARY_KEYS[table]])


def _hits(df: DataFrame, table: str, key: Column, checks: list[tuple[Column, str]]) -> DataFrame:
    """Rows of ``df`` with every failing check's rule name, one row per hit.

    A plain OR of the checks (whole-stage codegen) drops valid rows first;
    only failing rows build the array of rule names."""
    any_bad = None
    for c, _ in checks:
        c = F.coalesce(c, F.lit(False))
        any_bad = c if any_bad is None else (any_bad | c)
    names = F.array(*[F.when(c, F.lit(n)) for c, n in checks])
    return (df.filter(any_bad).select(F.lit(table).alias("table_name"), key.alias("row_key"), F.explode(names).alias("rule"))
            .filter("rule IS NOT NULL"))


# ---------------------------------------------------------------------------
# Keys. Every table sends one row for each key it owns or names:
# (space, key, what it is worth there). All tables meet in one aggregation of
# mergeable measures, so a hot key costs a partial aggregate and no group is ever
# gathered. Keys that cannot break a rule are dropped there; the others are
# written once, and each table's own rows meet them in a second scan. Only a line's menu
# item is no such name: lines are the largest table and each needs its item's price, so
# they meet the owners themselves (``DIRECT``) and send no row for it.

BASKET, COURIER = "basket", "courier"
# Key spaces: (owner table, owner column(s)). A key is unique in its space, but
# for a basket, which is all lines with its id.
SPACES: dict[str, tuple[str, tuple[str, ...]]] = {
    **{t: (t, pk) for t, pk in PRIMARY_KEYS.items() if t not in ("delivery",)},
    COURIER: ("delivery", PRIMARY_KEYS["delivery"]), BASKET: ("items", ("item_id",)),
    **{f"{t}.{c}": (t, (c,)) for t, c in UNIQUE_KEYS},
}
# Names of a key: (child table, column, space).
REFERENCES = [(child, col, COURIER if parent == "delivery" else parent) for child, col, parent, _ in FOREIGN_KEYS]
REFERENCES.append(("orders", "item_id", BASKET))
DIRECT = ("items", "menu_id", "menu")
# What is compared: value of the owner, and of the row that names it.
VALUE = "decimal(18,2)"
OWN_VALUE = {"orders": "total_price", BASKET: "price"}
REF_VALUE = {("payment", "orders"): lambda: F.col("amount"), ("orders", BASKET): lambda: F.col("total_price")}
OPEN = "Out for Delivery"


def _outcome(status: Column, done: str) -> Column:
    """1 done, 2 cancelled, 0 any other known status: what orders and deliveries must agree in."""
    return F.when(status == done, 1).when(status == "Cancelled", 2).when(status.isNotNull(), 0)


def _tag(space: str, key: Column, key2: Column | None = None, own: int = 0, ref: int = 0, value: Column | None = None,
         outcome: Column | None = None, is_open: Column | None = None) -> Column:
    """One tagged row; a value's side follows from ``own``/``ref``."""
    none = F.lit(None).cast(VALUE)
    v = none if value is None else value.cast(VALUE)
    gap = F.lit(0) if value is None else value.isNull().cast("int")
    code = F.lit(None).cast("int") if outcome is None else outcome
    return F.struct(
        F.lit(space).alias("space"), key.cast("string").alias("key"),
        (F.lit(None).cast("string") if key2 is None else key2.cast("string")).alias("key2"),
        F.lit(own).alias("own"), F.lit(ref).alias("ref"),
        (v if own else none).alias("own_value"), (v if ref else none).alias("ref_value"),
        (gap if own else F.lit(0)).alias("own_gap"), (gap if ref else F.lit(0)).alias("ref_gap"),
        (code if own else F.lit(None).cast("int")).alias("own_code"), (code if ref else F.lit(None).cast("int")).alias("ref_code"),
        (F.lit(0) if is_open is None else F.coalesce(is_open.cast("int"), F.lit(0))).alias("open"))


def _tags(table: str, only: tuple[str, ...]) -> list[Column]:
    """The tagged rows that one row of ``table`` sends (null where it names no key), as far as
    the rules of the tables ``only`` need them."""
    out = []
    for space, (owner, cols) in SPACES.items():
        if owner == table and (owner in only or any(child in only for child, _, named in REFERENCES if named == space)):
            value = F.col(OWN_VALUE[space]) if space in OWN_VALUE else None
            outcome = _outcome(F.col("order_status"), "Completed") if space == "orders" else None
            tag = _tag(space, F.col(cols[0]), F.col(cols[1]) if len(cols) > 1 else None, own=1, value=value, outcome=outcome)
            out.append(F.when(F.col(cols[0]).isNotNull(), tag) if "." in space else tag)
    for child, col, space in REFERENCES:
        # Orphan baskets and orders with several deliveries out are told by who names the key.
        told = SPACES[space][0] in only and (space == BASKET or (child, space) == ("deliveries", "orders"))
        if child == table and (child in only or told) and (child, col, space) != DIRECT:
            value = REF_VALUE[child, space]() if (child, space) in REF_VALUE else None
            delivers = child == "deliveries" and space == "orders"
            outcome = _outcome(F.col("delivery_status"), "Delivered") if delivers else None
            is_open = F.col("delivery_status") == OPEN if delivers else None
            out.append(F.when(F.col(col).isNotNull(), _tag(space, F.col(col), ref=1, value=value, outcome=outcome, is_open=is_open)))
    return out


def suspect_keys(t: Tables, only: tuple[str, ...] = tuple(PRIMARY_KEYS)) -> DataFrame:
    """Keys of all spaces that may break a rule of the tables ``only``, with their measures.

    One scan of each table and one exchange: counts of owners and names, the
    least and greatest values on both sides, gaps (nulls) and outcomes.
    """
    tagged = None
    for table in PRIMARY_KEYS:
        tags = _tags(table, only)
        if not tags:
            continue
        rows = t[table].select(F.explode(F.array(*tags)).alias("_t")).filter("_t IS NOT NULL").select("_t.*")
        tagged = rows if tagged is None else tagged.unionByName(rows)
    keys = tagged.groupBy("space", "key", "key2").agg(
        F.sum("own").alias("own"), F.sum("ref").alias("ref"), F.sum("own_value").alias("own_sum"),
        *[f(c).alias(f"{n}_{c}") for c in ("own_value", "ref_value", "own_code", "ref_code") for n, f in (("min", F.min), ("max", F.max))],
        F.max("own_gap").alias("own_gap"), F.max("ref_gap").alias("ref_gap"), F.sum("open").alias("open"))
    basket = F.col("space") == BASKET
    low, high = (F.when(basket, F.col("own_sum")).otherwise(F.col(f"{n}_own_value")) for n in ("min", "max"))
    differ = ((F.col("min_ref_value") != low) | (F.col("max_ref_value") != high) | (F.col("min_ref_value") != high)
              | (F.col("min_ref_code") != F.col("min_own_code")) | (F.col("max_ref_code") != F.col("max_own_code"))
              | (F.col("min_own_code") != F.col("max_own_code")))
    odd = ((F.col("own") == 0) | (~basket & (F.col("own") > 1)) | (basket & (F.col("ref") == 0))
           | ((F.col("own_gap") + F.col("ref_gap") > 0) & (F.col("ref") > 0)) | F.coalesce(differ, F.lit(False)) | (F.col("open") > 1))
    return keys.filter(odd)


def key_violations(suspects: DataFrame) -> DataFrame:
    """Rules that the key itself breaks: V10 duplicates, V11 orphan baskets, V14 an
    order with several deliveries out."""
    table = F.create_map(*[F.lit(x) for space, (owner, _) in SPACES.items() for x in (space, owner)])
    rule = F.create_map(*[F.lit(x) for space, (_, cols) in SPACES.items()
                          for x in (space, rule_name("duplicate_unique", cols[0]) if "." in space else "duplicate_key")])
    basket, own = F.col("space") == BASKET, F.col("own")
    found = F.array_compact(F.array(
        F.when(~basket & (own > 1), rule[F.col("space")]), F.when(basket & (F.col("ref") == 0), F.lit("orphan_basket")),
        F.when(F.col("open") > 1, F.lit("double_assignment"))))
    named = suspects.select(F.explode(found).alias("rule"), "space", "key", "key2", "own")
    owner = F.when(F.col("rule") == "double_assignment", F.lit("orders")).otherwise(table[F.col("space")])
    # Lines without a basket id are an orphan basket without a name.
    name = F.when(F.col("rule") == "orphan_basket", F.col("key")).otherwise(F.concat_ws("/", "key", "key2"))
    return named.select(owner.alias("table_name"), name.alias("row_key"), "rule")


def _differs(value: Column, low: Column, high: Column, gap: Column) -> Column:
    """The value is not that of every owner of its key (NULL equals NULL)."""
    return ~value.eqNullSafe(low) | ~value.eqNullSafe(high) | ((gap > 0) & value.isNotNull())


def _owners(t: Tables, space: str) -> DataFrame:
    """Every key of a table with the measures of its owners."""
    owner, (col,) = SPACES[space]
    price = F.col("price").cast(VALUE)
    return t[owner].groupBy(F.col(col).alias("key")).agg(
        F.count(F.lit(1)).alias("own"), F.min(price).alias("min_own_value"), F.max(price).alias("max_own_value"),
        F.max(F.col("price").isNull().cast("int")).alias("own_gap"))


def row_violations(t: Tables, table: str, suspects: DataFrame) -> DataFrame | None:
    """All failures of one table's rows: the row-level rules and, by left joins with the
    suspect keys, foreign keys and derived values, in one scan."""
    rules = [(_violates(k, c, a), rule_name(k, c)) for tb, k, c, a in ROW_RULES if tb == table]
    rows = t[table]
    for child, col, space in REFERENCES:
        if child != table:
            continue
        p = f"_{space}_"
        if (child, col, space) == DIRECT:
            side = _owners(t, space)
            side = side.select(*[F.col(c).alias(p + c) for c in side.columns])
            rows = rows.join(side, F.col(col) == F.col(p + "key"), "left")
            there = F.col(p + "own").isNotNull()
            low, high, gap = F.col(p + "min_own_value"), F.col(p + "max_own_value"), F.col(p + "own_gap")
            line = [(v.cast("decimal(10,2)") * F.col("quantity")).cast("decimal(18,2)") for v in (low, high)]
            rules += [(F.col(col).isNotNull() & ~there, rule_name("fk", col)),
                      (there & _differs(F.col("price"), *line, gap), "line_price_changed")]
            continue
        side = suspects.filter(F.col("space") == space).select(*[
            F.col(c).alias(p + c) for c in ("key", "own", "own_sum", "min_own_value", "max_own_value", "own_gap", "min_own_code",
                                            "max_own_code")])
        rows = rows.join(side, F.col(col) == F.col(p + "key"), "left")
        missing = F.col(p + "own") == 0
        there, hit = F.col(p + "own") > 0, F.col(p + "own").isNotNull()
        low, high, gap = F.col(p + "min_own_value"), F.col(p + "max_own_value"), F.col(p + "own_gap")
        if space == BASKET:
            lines = F.col(p + "own_sum").cast("decimal(18,2)")
            rules += [(F.col(col).isNull() | missing, "order_without_basket"),
                      (F.when(hit, ~F.col("total_price").eqNullSafe(lines)).when(F.col(col).isNull(), F.col("total_price").isNotNull()),
                       "total_mismatch")]
            continue
        rules.append((missing, rule_name("fk", col)))
        if table == "payment":
            amount = [v.cast("decimal(18,2)") for v in (low, high)]
            rules.append((F.when(hit, _differs(F.col("amount"), *amount, gap)).when(F.col(col).isNull(), F.col("amount").isNotNull()),
                          "amount_mismatch"))
        if table == "deliveries" and space == "orders":
            code = _outcome(F.col("delivery_status"), "Delivered")
            rules.append((there & ((code != F.col(p + "min_own_code")) | (code != F.col(p + "max_own_code"))), "state_mismatch"))
    return _hits(rows, table, row_key(table), rules) if rules else None


def order_rule_violations(t: Tables) -> list[DataFrame]:
    """V5 item unavailable on a Pending order; V6 the same customer has two
    Pending orders containing the same item."""
    pending = t["orders"].filter(F.col("order_status") == "Pending").select("order_id", "customer_id", "item_id")
    lines = pending.join(t["items"].select("item_id", "menu_id"), "item_id")
    unavailable = (lines.join(t["menu"].select("menu_id", "availability_status"), "menu_id")
                   .filter(F.col("availability_status") != "Available")
                   .select(F.lit("orders").alias("table_name"),
                           F.concat_ws("/", "order_id", "menu_id").alias("row_key"),
                           F.lit("item_unavailable").alias("rule")))
    dup = (lines.groupBy("customer_id", "menu_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
           .select(F.lit("orders").alias("table_name"), F.concat_ws("/", "customer_id", "menu_id").alias("row_key"),
                   F.lit("duplicate_pending").alias("rule")))
    return [unavailable, dup]


def validate(t: Tables, only: tuple[str, ...] = tuple(PRIMARY_KEYS)) -> DataFrame:
    """Every violation of V1-V12 and V14 in one frame, of all tables or of those in ``only``.

    Each table is scanned twice: once to send its keys to the one exchange of
    ``suspect_keys`` (written to the shared folder when the frame is built,
    because every table's second scan reads it), once for all rules of its rows.
    Pending orders and their lines are read once more for V5 and V6. The lines, read
    three times, are written first, so that whatever makes them runs once. A row whose
    key has several owners is compared with all of them and reported once.
    """
    if "items" in only or "orders" in only:
        t = {**{n: t[n] for n in PRIMARY_KEYS}, "items": written(t["items"], "lines")}
    suspects = written(suspect_keys(t, only), "suspect-keys")
    out = key_violations(suspects).filter(F.col("table_name").isin(*only))
    for table in only:
        rows = row_violations(t, table, suspects)
        out = out if rows is None else out.unionByName(rows)
    for p in order_rule_violations(t) if "orders" in only else []:
        out = out.unionByName(p)
    return out


def violation_counts(t: Tables) -> DataFrame:
    return validate(t).groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("violations"))


def validate_cart_lines(lines: DataFrame) -> DataFrame:
    """A cart line needs an item name and a numeric price, quantity parsed."""
    price_ok = F.col("price").cast("string").try_cast("double").isNotNull()
    checks = [(F.col("item_name").isNull() | (F.trim("item_name") == ""), "missing_name"), (~price_ok, "bad_price"),
              (F.col("quantity").cast("string").try_cast("int").isNull(), "bad_quantity")]
    return _hits(lines, "cart_lines", F.struct("request_seq", "line_no"), checks).select(
        "row_key.request_seq", "row_key.line_no", "rule")
