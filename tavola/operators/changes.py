"""Guarded change batches, set at a time.

Every write path of the ordering system is "check some rows, reject with a
reason, else insert/update/delete". Here one DataFrame of requests goes in and
a ``BatchResult`` comes out: new snapshots of the touched tables and one
verdict frame (request columns + ``accepted`` + ``reason``). Tables and new rows are
built when they are asked for. Verdicts that need several passes over the
batch (C1, C2, C6, C7, C8, C14) write it to the shared folder when the batch is applied.

In-batch ordering follows ``request_seq``, because the source applies requests
one after another; a request without a number, or sharing one with another, is
rejected (``missing_request_seq``, ``repeated_request_seq``). Rules per operator:

* order status (C8): exact sequential state machine via ``fold_transitions``
  (parallel scan, skew-safe);
* delivery status (C9), menu/employee/profile updates, feedback: the last
  accepted request per key wins (``max_by``, a mergeable aggregate);
* assignments (C10): the first request per courier that passes every other
  check wins (the courier is busy afterwards);
* registrations (C1), profile e-mail/phone (C2) and employee phones (C14): who
  holds a value is followed request by request (``resolve_claims``: rounds over
  the whole batch that end where the answers agree with themselves);
* deletes: the first request that passes removes the row, later ones find nothing;
* quantities add (C6), so their order does not matter. Requests for a line that
  together exceed its column are all rejected.

Derived columns are refreshed for touched rows only (line price, order total,
payment amount), as the source triggers do on insert and update.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.session import reliable_checkpoint, written

from tavola.functions.exprs import broadcast_if_small, payment_status_for
from tavola.functions.keys import allocate_keys, key_number, key_suffix_number, pad_key, seeded_draw, with_row_number
from tavola.operators.claims import resolve_claims
from tavola.operators.derive import basket_sums
from tavola.operators.fold import fold_transitions
from tavola.schema import (CATEGORIES, AVAILABILITY, DELIVERY_STATUSES, EMAIL_PATTERN, ORDER_STATUSES, PAYMENT_METHODS,
                           PHONE_PATTERN, ROLES, TEXT_LIMITS, transitions)
from tavola.sources.tables import Tables

DEFAULT_AS_OF = dt.datetime(2024, 4, 1, 12, 0, 0)


class Frames(Mapping):
    """Frames by name, each built when it is first asked for (some need jobs: key numbering)."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers, self._built = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._makers[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass
class BatchResult:
    tables: Mapping[str, DataFrame]
    verdicts: DataFrame
    extra: Mapping[str, DataFrame] = field(default_factory=dict)

    @property
    def accepted(self) -> DataFrame:
        return self.verdicts.filter(F.col("accepted"))

    @property
    def rejected(self) -> DataFrame:
        return self.verdicts.filter(~F.col("accepted"))


def _reason(*checks: tuple[Column, str]) -> Column:
    """First failing check's reason (NULL when all pass)."""
    expr = None
    for cond, reason in reversed(checks):
        value = reason if isinstance(reason, Column) else F.lit(reason)
        expr = F.when(cond, value) if expr is None else F.when(cond, value).otherwise(expr)
    return expr if expr is not None else F.lit(None).cast("string")


def _sequenced(requests: DataFrame, *cols: str) -> DataFrame:
    """The request columns with ``_seq_why``: requests are applied in
    ``request_seq`` order, so one without a number, or several with the same
    one, have no place in it and are rejected."""
    r = requests.select(*cols)
    again = (r.filter(F.col("request_seq").isNotNull()).groupBy("request_seq").agg(F.count(F.lit(1)).alias("_n"))
             .filter("_n > 1").select("request_seq", F.lit(True).alias("_again")))
    return r.join(again, "request_seq", "left").withColumn(
        "_seq_why", _reason((F.col("request_seq").isNull(), "missing_request_seq"),
                            (F.col("_again").isNotNull(), "repeated_request_seq"))).drop("_again")


def _seq_check() -> tuple[Column, Column]:
    return F.col("_seq_why").isNotNull(), F.col("_seq_why")


def _verdict(df: DataFrame, cols: list[str], reason: Column) -> DataFrame:
    return df.select(*cols, reason.isNull().alias("accepted"), reason.alias("reason"))


def _too_long(table: str, **fields: str) -> list[tuple[Column, str]]:
    """Checks that the texts of a request fit the table's columns (column=request field).
    Keys stay out: the batch's own keys are longer than the source's."""
    return [(F.length(field) > TEXT_LIMITS[table][col], f"{field}_too_long") for col, field in fields.items()]


def _once_per(df: DataFrame, key: str) -> DataFrame:
    """``_why`` is ``not_found`` for every request after the first that passes for its
    ``key`` (the row is gone by then)."""
    first = df.filter(F.col("_why").isNull()).groupBy(key).agg(F.min("request_seq").alias("_first"))
    return df.join(first, key, "left").withColumn("_why", F.coalesce("_why", F.when(
        F.col("request_seq") != F.col("_first"), F.lit("not_found")))).drop("_first")


def _blank(c: Column) -> Column:
    """JS falsy text: NULL or '' (a blank string of spaces is truthy)."""
    return c.isNull() | (c.cast("string") == "")


def _blank_num(c: Column) -> Column:
    """JS falsy number: NULL or 0."""
    return c.isNull() | (c == 0)


def _as_of(as_of) -> Column:
    """The batch's clock (replaces SYSDATE) as a zone-less timestamp."""
    v = as_of or DEFAULT_AS_OF
    text = v.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(v, dt.datetime) else str(v)
    return F.lit(text).cast("timestamp_ntz")


def _max_key_scalar(df: DataFrame, col: str, default: int = 0, suffix: bool = False) -> Column:
    num = key_suffix_number(col) if suffix else key_number(col)
    return df.select(F.coalesce(F.max(num), F.lit(default)).cast("long")).scalar()


def _refresh_totals(orders: DataFrame, items: DataFrame, touched: DataFrame) -> DataFrame:
    """D2 for the touched order ids only (the trigger fires on update): only
    the baskets of touched orders are summed, not the whole items table."""
    t = touched.select("order_id").distinct().withColumn("_touch", F.lit(True))
    baskets = orders.join(t, "order_id").select("item_id").distinct()
    sums = basket_sums(items.join(baskets, "item_id", "left_semi"))
    return (orders.join(t, "order_id", "left").join(sums, "item_id", "left")
            .select("order_id", "customer_id", "item_id",
                    F.when(F.col("_touch"), F.col("_basket_total")).otherwise(F.col("total_price"))
                    .cast("decimal(18,2)").alias("total_price"),
                    "order_status", "order_date"))


# ---------------------------------------------------------------------------
# Order status

def apply_order_status(t: Tables, requests: DataFrame, mode: str = "lenient", refresh_totals: bool = True,
                       width: int = 512) -> BatchResult:
    """Requests (request_seq, order_id, status).

    Unknown statuses and orders are rejected up front; the rest run through
    the state machine of ``mode`` (lenient = server rules, strict = page
    rules) in request order. A completed order's deliveries become
    Delivered, a cancelled order's deliveries Cancelled.
    """
    cur = t["orders"].select("order_id", F.col("order_status").alias("_cur"))
    r = _sequenced(requests, "request_seq", "order_id", "status").join(cur, "order_id", "left")
    pre = _reason(_seq_check(), (~F.col("status").isin(*ORDER_STATUSES) | F.col("status").isNull(), "invalid_status"),
                  (F.col("_cur").isNull(), "order_not_found"))
    early = r.withColumn("_why", pre)
    rejected_early = _verdict(early.filter(F.col("_why").isNotNull()), ["request_seq", "order_id", "status"],
                              F.col("_why"))
    candidates = early.filter(F.col("_why").isNull()).select("request_seq", "order_id", "status")
    folded = fold_transitions(candidates, "order_id", "request_seq", "status", cur, list(ORDER_STATUSES),
                              transitions(mode), width=width)
    verdicts = rejected_early.unionByName(
        _verdict(folded, ["request_seq", "order_id", "status"],
                 F.when(~F.col("accepted"), F.lit("invalid_transition"))))

    acc = folded.filter("accepted")
    def orders():
        final = acc.groupBy("order_id").agg(F.max_by("status", "request_seq").alias("_new"))
        out = (t["orders"].join(final, "order_id", "left")
               .withColumn("order_status", F.coalesce(F.col("_new"), F.col("order_status"))).drop("_new"))
        return _refresh_totals(out, t["items"], final) if refresh_totals else out

    def deliveries():
        dl = (acc.filter(F.col("status").isin("Completed", "Cancelled")).groupBy("order_id")
              .agg(F.max_by("status", "request_seq").alias("_last")))
        return (t["deliveries"].join(dl, "order_id", "left")
                .withColumn("delivery_status",
                            F.when(F.col("_last") == "Completed", F.lit("Delivered"))
                            .when(F.col("_last") == "Cancelled", F.lit("Cancelled"))
                            .otherwise(F.col("delivery_status")))
                .select("delivery_id", "order_id", "delivery_person_id", "delivery_status", "delivery_time"))

    return BatchResult(Frames(orders=orders, deliveries=deliveries), verdicts)


# ---------------------------------------------------------------------------
# Delivery status by the courier

def apply_delivery_status(t: Tables, requests: DataFrame, as_of=None, refresh_totals: bool = True) -> BatchResult:
    """Requests (request_seq, order_id, delivery_person_id, status).

    The courier must hold a delivery of the order; the status must be one of
    the delivery statuses. The last accepted status per (order, courier)
    stays, with ``delivery_time = as_of``; an accepted Delivered completes
    the order (Cancelled leaves the order as it is).
    """
    own = t["deliveries"].select("order_id", "delivery_person_id").distinct().withColumn("_own", F.lit(True))
    r = _sequenced(requests, "request_seq", "order_id", "delivery_person_id", "status").join(
        own, ["order_id", "delivery_person_id"], "left")
    why = _reason(_seq_check(), (F.col("_own").isNull(), "not_found_or_unauthorized"),
                  (~F.col("status").isin(*DELIVERY_STATUSES) | F.col("status").isNull(), "invalid_status"))
    verdicts = _verdict(r, ["request_seq", "order_id", "delivery_person_id", "status"], why)
    acc = verdicts.filter("accepted")
    last = acc.groupBy("order_id", "delivery_person_id").agg(F.max_by("status", "request_seq").alias("_new"))
    deliveries = (t["deliveries"].join(last, ["order_id", "delivery_person_id"], "left")
                  .select("delivery_id", "order_id", "delivery_person_id",
                          F.coalesce(F.col("_new"), F.col("delivery_status")).alias("delivery_status"),
                          F.when(F.col("_new").isNotNull(), _as_of(as_of)).otherwise(F.col("delivery_time"))
                          .alias("delivery_time")))
    done = acc.filter(F.col("status") == "Delivered").select("order_id").distinct()
    orders = (t["orders"].join(done.withColumn("_done", F.lit(True)), "order_id", "left")
              .withColumn("order_status", F.when(F.col("_done"), F.lit("Completed")).otherwise(F.col("order_status")))
              .drop("_done"))
    if refresh_totals:
        orders = _refresh_totals(orders, t["items"], done)
    return BatchResult({"deliveries": deliveries, "orders": orders}, verdicts)


# ---------------------------------------------------------------------------
# Courier assignment

def apply_assignments(t: Tables, requests: DataFrame, as_of=None, refresh_totals: bool = True) -> BatchResult:
    """Requests (request_seq, order_id, delivery_person_id = an employee id).

    Checks in the source's order: employee exists, has role Delivery, has a
    courier row, the courier has no delivery out, the order exists (foreign
    key of the new row). Of the requests passing all that, the first per
    courier wins; later ones find the courier busy. Accepted requests add a
    delivery ``D###`` (next keys in request order) and move the order to
    Processing (the order's current status is not checked, as in the source).
    """
    e = t["employee"].select(F.col("employee_id").alias("delivery_person_id"), F.col("role").alias("_role"),
                             F.lit(True).alias("_emp"))
    courier = (t["delivery"].groupBy("employee_id").agg(F.min("delivery_id").alias("_courier"))
               .withColumnRenamed("employee_id", "delivery_person_id"))
    busy = (t["deliveries"].filter(F.col("delivery_status") == "Out for Delivery")
            .select(F.col("delivery_person_id").alias("_courier")).distinct().withColumn("_busy", F.lit(True)))
    known = t["orders"].select("order_id").withColumn("_known", F.lit(True))
    # Busy flags are joined to the couriers (one row each), not to the requests:
    # requests without a courier would all meet in one NULL key.
    courier = courier.join(busy, "_courier", "left")
    r = (_sequenced(requests, "request_seq", "order_id", "delivery_person_id")
         .join(e, "delivery_person_id", "left").join(courier, "delivery_person_id", "left")
         .join(known, "order_id", "left"))
    checks = [_seq_check(), (F.col("_emp").isNull(), "employee_not_found"),
              (F.col("_role").isNull() | (F.col("_role") != "Delivery"), "not_delivery_person"),
              (F.col("_courier").isNull(), "no_courier_record"), (F.col("_busy").isNotNull(), "courier_busy"),
              (F.col("_known").isNull(), "order_not_found")]
    r = r.withColumn("_why", _reason(*checks))
    ok = r.filter(F.col("_why").isNull())
    first = ok.groupBy("_courier").agg(F.min("request_seq").alias("_first"))
    ok = ok.join(first, "_courier").withColumn(
        "_why", F.when(F.col("request_seq") != F.col("_first"), F.lit("courier_busy"))).drop("_first")
    r = r.filter(F.col("_why").isNotNull()).unionByName(ok)
    verdicts = _verdict(r, ["request_seq", "order_id", "delivery_person_id", "_courier"], F.col("_why")) \
        .withColumnRenamed("_courier", "courier_id")
    acc = verdicts.filter("accepted")

    def new_rows():
        start = _max_key_scalar(t["deliveries"], "delivery_id", 0, suffix=True)
        return (allocate_keys(acc, "D", start, [F.col("request_seq").asc()], "delivery_id")
                .select("delivery_id", "order_id", F.col("courier_id").alias("delivery_person_id"),
                        F.lit("Out for Delivery").alias("delivery_status"), _as_of(as_of).alias("delivery_time")))

    extra = Frames(new_deliveries=new_rows)
    moved = acc.select("order_id").distinct()
    orders = (t["orders"].join(moved.withColumn("_m", F.lit(True)), "order_id", "left")
              .withColumn("order_status", F.when(F.col("_m"), F.lit("Processing")).otherwise(F.col("order_status")))
              .drop("_m"))
    if refresh_totals:
        orders = _refresh_totals(orders, t["items"], moved)
    return BatchResult(Frames(deliveries=lambda: t["deliveries"].unionByName(extra["new_deliveries"]), orders=lambda: orders),
                       verdicts, extra)


# ---------------------------------------------------------------------------
# customers

def apply_registrations(t: Tables, requests: DataFrame) -> BatchResult:
    """Requests (request_seq, name, email, phone_number, address).

    Rejected when a field is missing, the e-mail or phone is already
    registered, the phone is not 10 digits or the e-mail malformed, a text does
    not fit its column, or an earlier request of the batch that passed took the
    e-mail or phone (``resolve_claims``). Accepted rows get
    keys ``C###`` after the current maximum (10 when the table is empty).
    """
    cust = t["customer"]
    emails = cust.select("email").distinct().withColumn("_e_taken", F.lit(True))
    phones = cust.select("phone_number").distinct().withColumn("_p_taken", F.lit(True))
    cols = ["request_seq", "name", "email", "phone_number", "address"]
    r = _sequenced(requests, *cols).join(emails, "email", "left").join(phones, "phone_number", "left")
    r = written(r.select(*cols, _reason(
        _seq_check(), (_blank(F.col("name")) | _blank(F.col("email")) | _blank(F.col("phone_number")) | _blank(F.col("address")),
         "missing_fields"),
        (F.col("_e_taken").isNotNull(), "email_registered"), (F.col("_p_taken").isNotNull(), "phone_registered"),
        (~F.col("phone_number").rlike(PHONE_PATTERN), "invalid_phone"),
        (~F.col("email").rlike(EMAIL_PATTERN), "invalid_email"),
        *_too_long("customer", name="name", email="email", address="address")).alias("_why")), "registrations")
    ok = r.filter(F.col("_why").isNull())
    answers = resolve_claims(ok.select(F.col("request_seq").alias("seq"), F.col("request_seq").cast("string").alias("actor"),
                                       F.lit(True).alias("can"), "email", "phone_number"), ["email", "phone_number"], releases=False)
    ok = ok.join(answers.select(F.col("seq").alias("request_seq"), "blocked_email", "blocked_phone_number"), "request_seq")
    ok_why = _reason((F.col("blocked_email").isNotNull(), "email_in_batch"),
                     (F.col("blocked_phone_number").isNotNull(), "phone_in_batch"))
    verdicts = _verdict(r.filter(F.col("_why").isNotNull()), cols, F.col("_why")).unionByName(
        _verdict(ok, cols, ok_why))
    acc = verdicts.filter("accepted")

    def new_rows():
        start = _max_key_scalar(cust, "customer_id", 10, suffix=True)
        return allocate_keys(acc, "C", start, [F.col("request_seq").asc()], "customer_id").select(
            "customer_id", "name", "email", "phone_number", "address")

    extra = Frames(new_customers=new_rows)
    return BatchResult(Frames(customer=lambda: cust.unionByName(extra["new_customers"])), verdicts, extra)


def apply_profile_updates(t: Tables, requests: DataFrame) -> BatchResult:
    """Requests (request_seq, customer_id, name, email, phone_number, address).

    All four fields are required; the e-mail and phone must not be *another*
    customer's at that moment: one that a customer gave up earlier in the batch is free,
    one that a customer took is not (``resolve_claims``). Formats and lengths are
    checked as on insert. The last accepted request per customer wins.
    """
    cust = t["customer"]
    cols = ["request_seq", "customer_id", "name", "email", "phone_number", "address"]
    known = cust.select("customer_id").distinct().withColumn("_known", F.lit(True))
    r = _sequenced(requests, *cols).join(known, "customer_id", "left")
    early = _reason(_seq_check(), (_blank(F.col("name")) | _blank(F.col("email")) | _blank(F.col("phone_number"))
                                   | _blank(F.col("address")), "missing_fields"))
    late = _reason((F.col("_known").isNull(), "not_found"), (~F.col("phone_number").rlike(PHONE_PATTERN), "invalid_phone"),
                   (~F.col("email").rlike(EMAIL_PATTERN), "invalid_email"),
                   *_too_long("customer", name="name", email="email", address="address"))
    r = written(r.select(*cols, early.alias("_why"), late.alias("_late")), "profiles")
    asked = r.filter(F.col("_why").isNull())
    answers = resolve_claims(
        asked.select(F.col("request_seq").alias("seq"), F.col("customer_id").alias("actor"), F.col("_late").isNull().alias("can"),
                     "email", "phone_number"),
        ["email", "phone_number"], cust.select(F.col("customer_id").alias("actor"), "email", "phone_number"))
    asked = asked.join(answers.select(F.col("seq").alias("request_seq"), "blocked_email", "blocked_phone_number"), "request_seq")
    blocked = [(F.col(f"blocked_{k}") == how, f"{name}_{label}") for k, name in (("email", "email"), ("phone_number", "phone"))
               for how, label in (("held", "in_use"), ("taken", "in_batch"))]
    verdicts = _verdict(r.filter(F.col("_why").isNotNull()), cols, F.col("_why")).unionByName(
        _verdict(asked, cols, _reason(*blocked, (F.col("_late").isNotNull(), F.col("_late")))))

    def customer():
        last = (verdicts.filter("accepted").groupBy("customer_id")
                .agg(F.max_by(F.struct("name", "email", "phone_number", "address"), "request_seq").alias("_n")))
        return (cust.join(last, "customer_id", "left")
                .select("customer_id", *[F.coalesce(F.col(f"_n.{c}"), F.col(c)).alias(c)
                                         for c in ("name", "email", "phone_number", "address")]))

    return BatchResult(Frames(customer=customer), verdicts)


# ---------------------------------------------------------------------------
# Customer deletes

def _customer_delete(t: Tables, ids: DataFrame, guard_statuses, guard_reason: str, fk_guard: bool) -> BatchResult:
    cols = ["request_seq", "customer_id"]
    r = _sequenced(ids, *cols)
    known = t["customer"].select("customer_id").withColumn("_known", F.lit(True))
    o = t["orders"]
    guarded = (o.filter(F.col("order_status").isin(*guard_statuses)) if guard_statuses else o) \
        .select("customer_id").distinct().withColumn("_guard", F.lit(True))
    refs = (o.select("customer_id").unionByName(t["feedback"].select("customer_id")).distinct()
            .withColumn("_ref", F.lit(True)))
    r = r.join(known, "customer_id", "left").join(guarded, "customer_id", "left").join(refs, "customer_id", "left")
    checks = [_seq_check(), (F.col("_guard").isNotNull(), guard_reason)]
    if fk_guard:
        checks.append((F.col("_ref").isNotNull(), "referenced"))
    checks.append((F.col("_known").isNull(), "not_found"))
    r = _once_per(r.withColumn("_why", _reason(*checks)), "customer_id")
    verdicts = _verdict(r, cols, F.col("_why"))
    gone = verdicts.filter("accepted").select("customer_id").distinct()
    return BatchResult(Frames(customer=lambda: t["customer"].join(gone, "customer_id", "left_anti")), verdicts)


def apply_account_deletes(t: Tables, ids: DataFrame) -> BatchResult:
    """A customer closes the account: refused while Pending/Processing
    orders exist; refused by the foreign keys while any order or feedback
    still names the customer; unknown ids are reported."""
    return _customer_delete(t, ids, ("Pending", "Processing"), "active_orders", True)


def apply_customer_deletes(t: Tables, ids: DataFrame) -> BatchResult:
    """C4: the admin deletes customers: refused when any order exists."""
    return _customer_delete(t, ids, None, "has_orders", True)


def apply_active_order_guard(t: Tables, ids: DataFrame, statuses=("Pending", "Preparing", "Ready")) -> BatchResult:
    """The legacy delete guard with its own list of active statuses."""
    return _customer_delete(t, ids, statuses, "active_orders", True)


# ---------------------------------------------------------------------------
# Baskets and orders

def _merged_lines(requests: DataFrame, key_cols: list[str]) -> DataFrame:
    """Explode ``items`` and add quantities of the same name per request."""
    lines = requests.select(*key_cols, F.explode_outer("items").alias("_it")).select(
        *key_cols, "_it", F.col("_it.item_name").alias("item_name"), F.col("_it.quantity").alias("quantity"))
    # A line without an item name or with a quantity below 1 faults its request.
    real = F.col("_it").isNotNull()
    lines = lines.withColumn("_faulty", real & (F.col("quantity").isNull() | (F.col("quantity") < 1)))
    lines = lines.withColumn("_nameless", real & F.col("item_name").isNull()).drop("_it")
    return lines.groupBy(*key_cols, "item_name").agg(
        F.sum("quantity").cast("long").alias("quantity"), F.max("_faulty").alias("_faulty"),
        F.max("_nameless").alias("_nameless"))


def apply_basket_lines(t: Tables, requests: DataFrame) -> BatchResult:
    """Requests (request_seq, item_id, items array<struct<item_name, quantity>>).

    Names are resolved to menu ids (lowest id per name); a request naming an
    unknown or priceless item, or with a quantity missing or below 1, is rejected whole. Accepted quantities are added to the
    basket line (inserted when new) and the touched lines are re-priced at
    the current menu price. Where the requests for a line would together exceed what its
    columns hold, all requests that name the line are rejected (``quantity_overflow``).

    Only baskets that may be touched are rewritten: the hashes of touched basket ids,
    cut to ``TOUCH_BITS`` bits, are a set of bounded size that every task gets, and lines
    outside it pass as they are, without a shuffle.
    """
    from tavola.operators.reports import menu_ids_by_name
    requests = written(requests.select("request_seq", "item_id", "items"), "basket-batch")
    menu_price = t["menu"].select("menu_id", F.col("price").alias("_mp"))
    # Prices meet the names, not the lines, which would have to move once more for them.
    names = menu_ids_by_name(t["menu"]).join(menu_price, "menu_id", "left")
    lines = written(_merged_lines(requests, ["request_seq", "item_id"]).join(names, "item_name", "left"), "basket-lines")
    bad = (lines.groupBy("request_seq", "item_id")
           .agg(F.max(F.col("_nameless") | F.col("menu_id").isNull() & F.col("item_name").isNotNull()).alias("_unknown"),
                F.max("_faulty").alias("_faulty"), F.count("item_name").alias("_n"),
                F.max(F.col("menu_id").isNotNull() & F.col("_mp").isNull()).alias("_priceless")))
    r = _sequenced(requests, "request_seq", "item_id").join(bad, ["request_seq", "item_id"], "left")
    r = written(r.select("request_seq", "item_id", _reason(
        _seq_check(), (_blank(F.col("item_id")), "missing_item_id"), (F.col("_unknown"), "unknown_item"),
        (F.coalesce(F.col("_n"), F.lit(0)) == 0, "empty_basket"), (F.col("_faulty"), "bad_quantity"),
        (F.col("_priceless"), "priceless_item")).alias("_why")), "basket-requests")
    whole = written(lines.join(r.filter(F.col("_why").isNull()).select("request_seq"), "request_seq", "left_semi")
                    .select("request_seq", "item_id", "menu_id", "quantity", "_mp"), "basket-whole")
    line = ["item_id", "menu_id"]
    total = (whole.groupBy(*line).agg(F.sum("quantity").alias("_add"), F.max("_mp").alias("_mp"))
             .join(_touched_only(t["items"], whole).groupBy(*line).agg(F.sum("quantity").alias("_had")), line, "left"))
    total = total.withColumn("_all", F.coalesce("_had", F.lit(0)) + F.col("_add"))
    # Written, its size is known: few lines exceed their column, and all others need not move to meet them.
    over = written(total.filter(_too_much(F.col("_all"), F.col("_mp"))).select(*line), "basket-over")
    late = whole.join(over, line, "left_semi").select("request_seq").distinct().withColumn("_over", F.lit(True))
    r = r.join(late, "request_seq", "left")
    verdicts = _verdict(r, ["request_seq", "item_id"], F.coalesce("_why", F.when(F.col("_over"), F.lit("quantity_overflow"))))

    def items():
        stored = written(t["items"], "stored-lines")
        acc = whole.join(late, "request_seq", "left_anti")
        add = acc.groupBy(*line).agg(F.sum("quantity").alias("_add"), F.max("_mp").alias("_mp"))
        quantity = F.coalesce(F.col("quantity"), F.lit(0)) + F.coalesce(F.col("_add"), F.lit(0))
        rewritten = (_touched_only(stored, whole).join(add, line, "full_outer")
                     .select(*line, F.when(F.col("_add").isNull(), F.col("quantity")).otherwise(quantity).cast("int").alias("quantity"),
                             F.when(F.col("_add").isNotNull(), F.col("_mp") * quantity).otherwise(F.col("price"))
                             .cast("decimal(18,2)").alias("price")))
        return _touched_only(stored, whole, inside=False).select(*rewritten.columns).unionByName(rewritten)

    return BatchResult(Frames(items=items), verdicts)


TOUCH_BITS = 20     # a set of at most 2**20 numbers of 4 bytes goes to every task


def _touched_only(items: DataFrame, touched: DataFrame, inside: bool = True) -> DataFrame:
    """Lines whose basket id may be (``inside=False``: cannot be) among those of ``touched``."""
    def slot(c: str) -> Column:
        return F.xxhash64(c).bitwiseAND(F.lit((1 << TOUCH_BITS) - 1)).cast("int")

    slots = touched.select(slot("item_id").alias("_slot")).distinct()
    return items.join(F.broadcast(slots), slot("item_id") == F.col("_slot"), "left_semi" if inside else "left_anti")


def _too_much(quantity: Column, price: Column) -> Column:
    """More than a line's columns hold: an int quantity, a decimal(18,2) price."""
    return (quantity > (1 << 31) - 1) | (price * quantity >= F.lit(10 ** 16).cast("decimal(20,0)"))


def place_orders(t: Tables, carts: DataFrame, as_of=None) -> BatchResult:
    """Carts (request_seq, customer_id, items, payment_method) -> new basket
    lines, orders and payments.

    A cart is rejected when empty, when it names an unknown item, when a
    quantity is missing or below 1, when a line or the total exceeds what its column
    holds, when the total is missing or not above 0, when the customer does not exist or when the payment method is not allowed. Each
    accepted cart takes the next basket, order and payment keys (request
    order); line prices, the order total (Pending, dated ``as_of``) and the
    payment amount are derived; cash is paid Pending, other methods Completed.
    """
    from tavola.operators.reports import menu_ids_by_name
    # The batch feeds the verdicts, the key numbering and the new rows: write
    # it once to the shared checkpoint folder instead of recomputing upstream.
    carts = carts.select("request_seq", "customer_id", "items", "payment_method").transform(reliable_checkpoint)
    names = menu_ids_by_name(t["menu"])
    menu_price = t["menu"].select("menu_id", F.col("price").alias("_mp"))
    lines = (_merged_lines(carts.select("request_seq", "items"), ["request_seq"]).join(names, "item_name", "left")
             .join(menu_price, "menu_id", "left"))
    stats = (lines.groupBy("request_seq")
             .agg(F.max(F.col("_nameless") | F.col("menu_id").isNull() & F.col("item_name").isNotNull()).alias("_unknown"),
                  F.max("_faulty").alias("_faulty"), F.count("item_name").alias("_n"),
                  F.sum(F.col("_mp") * F.col("quantity")).alias("_total"),
                  F.max(_too_much(F.col("quantity"), F.col("_mp"))).alias("_over"),
                  F.max(F.col("menu_id").isNotNull() & F.col("_mp").isNull()).alias("_priceless")))
    known = t["customer"].select("customer_id").withColumn("_known", F.lit(True))
    cols = ["request_seq", "customer_id", "payment_method"]
    r = _sequenced(carts, *cols).join(stats, "request_seq", "left").join(known, "customer_id", "left")
    verdicts = _verdict(r, cols, _reason(
        _seq_check(), (F.coalesce(F.col("_n"), F.lit(0)) == 0, "empty_cart"), (F.col("_unknown"), "unknown_item"),
        (F.col("_faulty"), "bad_quantity"),
        (F.coalesce(F.col("_over"), F.lit(False)) | (F.col("_total") >= F.lit(10 ** 16).cast("decimal(20,0)")), "quantity_overflow"),
        (F.coalesce(F.col("_priceless"), F.lit(False)) | F.col("_total").isNull() | (F.col("_total") <= 0), "invalid_total"),
        (F.col("_known").isNull(), "customer_not_found"),
        (~F.col("payment_method").isin(*PAYMENT_METHODS) | F.col("payment_method").isNull(),
         "invalid_payment_method")))
    # Verdicts feed the numbering, the new rows and the output: write them once.
    verdicts = reliable_checkpoint(verdicts)
    acc = verdicts.filter("accepted")
    numbered = with_row_number(acc, [F.col("request_seq").asc()], "_pos")
    i0 = _max_key_scalar(t["items"], "item_id", 0)
    o0 = _max_key_scalar(t["orders"], "order_id", 0)
    p0 = _max_key_scalar(t["payment"], "payment_id", 0)
    keyed = numbered.select("request_seq", "customer_id", "payment_method",
                            pad_key("I", i0 + F.col("_pos")).alias("item_id"),
                            pad_key("O", o0 + F.col("_pos")).alias("order_id"),
                            pad_key("P", p0 + F.col("_pos")).alias("payment_id"))
    new_items = (lines.join(keyed.select("request_seq", "item_id"), "request_seq").filter(F.col("menu_id").isNotNull())
                 .select("item_id", "menu_id", F.col("quantity").cast("int").alias("quantity"),
                         (F.col("_mp") * F.col("quantity")).cast("decimal(18,2)").alias("price")))
    totals = new_items.groupBy("item_id").agg(F.sum("price").cast("decimal(18,2)").alias("total_price"))
    new_orders = keyed.join(totals, "item_id", "left").select(
        "order_id", "customer_id", "item_id", "total_price", F.lit("Pending").alias("order_status"),
        _as_of(as_of).alias("order_date"))
    new_payments = keyed.join(totals, "item_id", "left").select(
        "payment_id", "order_id", F.col("total_price").cast("decimal(18,2)").alias("amount"),
        payment_status_for("payment_method").alias("payment_status"), "payment_method",
        _as_of(as_of).alias("transaction_date"))
    verdicts = verdicts.join(keyed.select("request_seq", "order_id"), "request_seq", "left")
    return BatchResult({"items": t["items"].unionByName(new_items), "orders": t["orders"].unionByName(new_orders),
                        "payment": t["payment"].unionByName(new_payments)}, verdicts,
                       {"new_items": new_items, "new_orders": new_orders, "new_payments": new_payments})


# ---------------------------------------------------------------------------
# C11: feedback

def apply_feedback(t: Tables, requests: DataFrame) -> BatchResult:
    """C11: requests (request_seq, order_id, customer_id, rating_score, feedback_text).

    Fields are required (0 and '' count as missing, as in the page code), the
    score must be 1..5, the text at most 500 characters and the order must
    belong to the customer. An order's feedback is updated when it exists
    (last request wins), else inserted under the next ``F###`` key.
    """
    cols = ["request_seq", "order_id", "customer_id", "rating_score", "feedback_text"]
    owned = t["orders"].select("order_id", "customer_id").withColumn("_own", F.lit(True))
    r = _sequenced(requests, *cols).join(owned, ["order_id", "customer_id"], "left")
    why = _reason(
        _seq_check(), (_blank(F.col("order_id")) | _blank_num(F.col("rating_score")) | _blank(F.col("feedback_text")),
         "missing_fields"),
        ((F.col("rating_score") < 1) | (F.col("rating_score") > 5), "rating_out_of_range"),
        (F.length("feedback_text") > 500, "text_too_long"),
        (F.col("_own").isNull(), "order_not_found"))
    verdicts = _verdict(r, cols, why)
    acc = verdicts.filter("accepted")
    last = acc.groupBy("order_id").agg(F.max_by(F.struct("rating_score", "feedback_text"), "request_seq").alias("_n"),
                                       F.min_by("customer_id", "request_seq").alias("_c"),
                                       F.min("request_seq").alias("_first"))
    fb = t["feedback"]
    existing = fb.select("order_id").distinct()
    updated = (fb.join(last, "order_id", "left")
               .select("rating_id", "order_id", "customer_id",
                       F.coalesce(F.col("_n.rating_score"), F.col("rating_score")).alias("rating_score"),
                       F.when(F.col("_n").isNotNull(), F.col("_n.feedback_text")).otherwise(F.col("feedback_text"))
                       .alias("feedback_text")))
    fresh = last.join(existing, "order_id", "left_anti")

    def inserted():
        start = _max_key_scalar(fb, "rating_id", 0, suffix=True)
        return allocate_keys(fresh, "F", start, [F.col("_first").asc()], "rating_id").select(
            "rating_id", "order_id", F.col("_c").alias("customer_id"), F.col("_n.rating_score").alias("rating_score"),
            F.col("_n.feedback_text").alias("feedback_text"))

    extra = Frames(new_feedback=inserted)
    return BatchResult(Frames(feedback=lambda: updated.unionByName(extra["new_feedback"])), verdicts, extra)


# ---------------------------------------------------------------------------
# menu

def apply_menu_updates(t: Tables, requests: DataFrame) -> BatchResult:
    """Requests (request_seq, menu_id, name, description, price, category,
    availability_status) replace five columns. Schema checks (name, price > 0,
    category and availability values, text lengths) reject a request; unknown ids are
    reported (the source silently accepts them). Last request per id wins."""
    cols = ["request_seq", "menu_id", "name", "description", "price", "category", "availability_status"]
    known = t["menu"].select("menu_id").withColumn("_known", F.lit(True))
    r = _sequenced(requests, *cols).join(known, "menu_id", "left")
    why = _reason(_seq_check(), (F.col("name").isNull() | (F.trim(F.col("name")) == ""), "missing_name"),
                  (F.col("price").isNull() | (F.col("price") <= 0), "invalid_price"),
                  (~F.col("category").isin(*CATEGORIES) | F.col("category").isNull(), "invalid_category"),
                  (~F.col("availability_status").isin(*AVAILABILITY), "invalid_availability"),
                  *_too_long("menu", item_name="name", description="description"),
                  (F.col("_known").isNull(), "not_found"))
    verdicts = _verdict(r, cols, why)
    last = (verdicts.filter("accepted").groupBy("menu_id")
            .agg(F.max_by(F.struct("name", "description", "price", "category", "availability_status"),
                          "request_seq").alias("_n")))
    m = t["menu"].join(last, "menu_id", "left")
    upd = F.col("_n").isNotNull()
    menu = m.select("menu_id",
                    F.when(upd, F.col("_n.name")).otherwise(F.col("item_name")).alias("item_name"),
                    F.when(upd, F.col("_n.category")).otherwise(F.col("category")).alias("category"),
                    F.when(upd, F.col("_n.price")).otherwise(F.col("price")).cast("decimal(10,2)").alias("price"),
                    F.when(upd, F.col("_n.description")).otherwise(F.col("description")).alias("description"),
                    F.when(upd, F.col("_n.availability_status")).otherwise(F.col("availability_status"))
                    .alias("availability_status"),
                    "image_link")
    return BatchResult({"menu": menu}, verdicts)


def apply_menu_deletes(t: Tables, ids: DataFrame) -> BatchResult:
    """Menu items are deleted unless some basket line names them; a second
    request for the same item finds nothing."""
    cols = ["request_seq", "menu_id"]
    known = t["menu"].select("menu_id").withColumn("_known", F.lit(True))
    used = t["items"].select("menu_id").distinct().withColumn("_used", F.lit(True))
    r = _sequenced(ids, *cols).join(known, "menu_id", "left").join(used, "menu_id", "left")
    r = r.withColumn("_why", _reason(_seq_check(), (F.col("_known").isNull(), "not_found"), (F.col("_used").isNotNull(), "ordered")))
    verdicts = _verdict(_once_per(r, "menu_id"), cols, F.col("_why"))
    gone = verdicts.filter("accepted").select("menu_id").distinct()
    return BatchResult(Frames(menu=lambda: t["menu"].join(gone, "menu_id", "left_anti")), verdicts)


# ---------------------------------------------------------------------------
# employees

def apply_employee_changes(t: Tables, requests: DataFrame) -> BatchResult:
    """C14: requests (request_seq, op in insert/update/delete, employee_id,
    name, role, phone_number, salary).

    insert: role must be Delivery/Chef/Manager, name and phone present, phone
    unused, salary > 0; key ``E###`` in request order. update: same value
    checks, the employee must exist, the phone must not belong to another
    employee; last update wins. Who owns a phone is followed through the batch
    (``resolve_claims``): one given up by an update or a delete is free for the next
    request. Nothing passes for an employee after its first accepted delete.
    delete: refused while one of the employee's courier ids has a delivery out (checked
    through the courier table), while a courier row still references the
    employee, or when the id is unknown.
    """
    emp = t["employee"]
    cols = ["request_seq", "op", "employee_id", "name", "role", "phone_number", "salary"]
    r = _sequenced(requests, *cols)
    known = emp.select("employee_id").withColumn("_known", F.lit(True))
    couriers = t["delivery"].select("employee_id", F.col("delivery_id").alias("_cid"))
    active = (t["deliveries"].filter(F.col("delivery_status") == "Out for Delivery")
              .select(F.col("delivery_person_id").alias("_cid")).distinct())
    active_emp = couriers.join(active, "_cid", "left_semi").select("employee_id").distinct() \
        .withColumn("_active", F.lit(True))
    has_courier = couriers.select("employee_id").distinct().withColumn("_has_courier", F.lit(True))
    r = (r.join(known, "employee_id", "left").join(active_emp, "employee_id", "left")
         .join(has_courier, "employee_id", "left"))
    op = F.col("op")
    values_bad = [_seq_check(), (~F.col("role").isin(*ROLES) | F.col("role").isNull(), "invalid_role"),
                  (F.col("name").isNull() | (F.trim(F.col("name")) == ""), "missing_name"),
                  *_too_long("employee", name="name"), (F.col("phone_number").isNull(), "missing_phone"),
                  (F.col("salary") <= 0, "invalid_salary")]
    ins_why = _reason(*values_bad)
    upd_why = _reason(*values_bad, (F.col("_known").isNull(), "not_found"))
    del_why = _reason(_seq_check(), (F.col("_active").isNotNull(), "active_deliveries"), (F.col("_known").isNull(), "not_found"),
                      (F.col("_has_courier").isNotNull(), "referenced"))
    why = (F.when(op == "insert", ins_why).when(op == "update", upd_why).when(op == "delete", del_why)
           .otherwise(F.coalesce(F.col("_seq_why"), F.lit("invalid_op"))))
    r = r.withColumn("_why", why)
    # After an employee's first accepted delete nothing else finds the employee.
    gone_at = (r.filter((op == "delete") & F.col("_why").isNull()).groupBy("employee_id")
               .agg(F.min("request_seq").alias("_gone_at")))
    r = r.join(gone_at, "employee_id", "left").withColumn("_why", F.coalesce(F.col("_why"), F.when(
        op.isin("update", "delete") & (F.col("request_seq") > F.col("_gone_at")), F.lit("not_found"))))
    r = written(r.select(*cols, "_why"), "employee-changes")
    # The timeline of every phone: who takes it, who gives it up, in request order.
    phone = F.when(op != "delete", F.col("phone_number").cast("string")).alias("phone")
    actor = F.when(op == "insert", F.concat(F.lit("new "), F.col("request_seq").cast("string"))).otherwise(
        F.concat(F.lit("old "), "employee_id")).alias("actor")
    held = emp.select(F.concat(F.lit("old "), "employee_id").alias("actor"), F.col("phone_number").cast("string").alias("phone"))
    asked = r.filter(F.col("_why").isNull())
    answers = resolve_claims(asked.select(F.col("request_seq").alias("seq"), actor, F.lit(True).alias("can"), phone), ["phone"], held)
    asked = asked.join(answers.select(F.col("seq").alias("request_seq"), "blocked_phone"), "request_seq")
    verdicts = _verdict(r.filter(F.col("_why").isNotNull()), cols, F.col("_why")).unionByName(
        _verdict(asked, cols, F.when(F.col("blocked_phone").isNotNull(), F.lit("duplicate_phone"))))
    acc = verdicts.filter("accepted")

    def new_rows():
        start = _max_key_scalar(emp, "employee_id", 0, suffix=True)
        return (allocate_keys(acc.filter(F.col("op") == "insert").drop("employee_id"), "E", start,
                              [F.col("request_seq").asc()], "employee_id")
                .select("employee_id", "name", "role", F.col("phone_number").cast("decimal(10,0)").alias("phone_number"),
                        F.col("salary").cast("decimal(18,2)").alias("salary")))

    extra = Frames(new_employees=new_rows)

    def employee():
        last = (acc.filter(F.col("op") == "update").groupBy("employee_id")
                .agg(F.max_by(F.struct("name", "role", "phone_number", "salary"), "request_seq").alias("_n")))
        gone = acc.filter(F.col("op") == "delete").select("employee_id").distinct()
        kept = emp.join(gone, "employee_id", "left_anti").join(last, "employee_id", "left")
        upd = F.col("_n").isNotNull()
        return kept.select(
            "employee_id", F.when(upd, F.col("_n.name")).otherwise(F.col("name")).alias("name"),
            F.when(upd, F.col("_n.role")).otherwise(F.col("role")).alias("role"),
            F.when(upd, F.col("_n.phone_number")).otherwise(F.col("phone_number")).cast("decimal(10,0)").alias("phone_number"),
            F.when(upd, F.col("_n.salary")).otherwise(F.col("salary")).cast("decimal(18,2)").alias("salary")) \
            .unionByName(extra["new_employees"])

    return BatchResult(Frames(employee=employee), verdicts, extra)


def route_new_employees(new_employees: DataFrame) -> dict[str, DataFrame]:
    """A new Delivery employee also gets a courier row (id ``D`` + the
    employee number, rating unknown); a new Chef gets a chef row."""
    d = new_employees.filter(F.col("role") == "Delivery").select(
        pad_key("D", key_number("employee_id")).alias("delivery_id"), "employee_id",
        F.lit(None).cast("decimal(2,1)").alias("rating"))
    chef = new_employees.filter(F.col("role") == "Chef").select("employee_id", "name")
    return {"delivery": d, "chef": chef}


# ---------------------------------------------------------------------------
# C16 / C17

DIGESTS = 1 << 14    # buckets of a snapshot's digest: the rows that are compared first


def differing_buckets(old: DataFrame, new: DataFrame, key: str, col: str) -> DataFrame:
    """Numbers of the hash buckets of ``key`` in which the snapshots differ (at most ``DIGESTS``).

    A bucket's digest is its row count and the sums of two hashes of (key, value):
    equal rows give equal digests in any order, and each side is reduced to one row a bucket
    before anything is shuffled."""
    def digest(df: DataFrame, side: str) -> DataFrame:
        parts = [F.xxhash64(key, col), F.xxhash64(F.lit(1), col, key)]
        return df.groupBy(_bucket(key).alias("bucket")).agg(F.struct(
            F.count(F.lit(1)).alias("n"), *[F.sum(p.cast("decimal(20,0)")).alias(f"h{i}") for i, p in enumerate(parts)]).alias(side))

    both = digest(old, "a").join(digest(new, "b"), "bucket", "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")


def _bucket(key: str) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(DIGESTS - 1)).cast("int")


def change_audit(old: DataFrame, new: DataFrame, key: str, col: str, as_of=None,
                 min_length: int | None = None) -> DataFrame:
    """One log row per key whose ``col`` really changed (NULL-safe).

    Digests of hash buckets of both snapshots are compared first; only rows of buckets that
    differ are joined, so the join grows with the changes and not with the table. With
    ``min_length`` a change to a shorter value is flagged ``too_short``
    (the source refuses it). Re-aimed from the password log: the caller
    chooses a non-secret column.
    """
    changed = F.broadcast(written(differing_buckets(old, new, key, col), "digests"))  # at most DIGESTS ints
    def touched(df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", _bucket(key)).join(changed, F.col("_bucket") == F.col("bucket"), "left_semi")

    o = touched(old).select(key, F.col(col).alias("old_value"))
    n = touched(new).select(key, F.col(col).alias("new_value"))
    j = o.join(n, key, "inner").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
    too_short = (F.length("new_value") < min_length) if min_length else F.lit(False)
    return j.select(key, _as_of(as_of).alias("change_date"), F.lit(col).alias("column_name"),
                    F.col("old_value").cast("string").alias("old_value"),
                    F.col("new_value").cast("string").alias("new_value"),
                    F.when(too_short, F.lit("too_short")).alias("reason"))


def random_assignment(t: Tables, orders: DataFrame, seed: int = 1) -> DataFrame:
    """C17: each order gets a courier drawn from a hash of its id (repeatable):
    courier number ``pmod(hash, n) + 1`` joined to the numbered couriers (W3).
    The source draws ``mod(trunc(random(1, 100)), n) + 1`` instead."""
    from tavola.operators.reports import courier_index
    couriers = courier_index(t)
    n = t["delivery"].select(F.count(F.lit(1))).scalar()
    pick = orders.select("order_id", (seeded_draw(seed, n, F.col("order_id")) + 1).alias("courier_no"))
    # Few couriers means few distinct join keys: broadcast them when the size
    # estimate allows, so the orders side is never funnelled into n partitions.
    return (pick.join(broadcast_if_small(couriers), "courier_no", "left")
            .select("order_id", "courier_no", "delivery_id", "employee_id"))
