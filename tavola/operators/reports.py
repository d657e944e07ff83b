"""Reports: projections/filters (P*), joins (J*), aggregates (A*), windows (W*).

Each report is a pure function ``(t, **params) -> DataFrame``: lazy, no action
(but ``all_orders`` and the batches of search terms write intermediates), no Python UDF. Ordering follows the source system (NULLs last ascending, first
descending) and every top-k carries a unique tie-break so results are
deterministic.

Scale notes that apply throughout:

* fact-sized tables (orders, items, customer, payment, deliveries, feedback)
  are never hinted for broadcast; Spark broadcasts a side only when its
  measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and AQE
  splits skewed join partitions;
* aggregates are partial (map-side) before their shuffle, and per-customer
  order counts are aggregated *before* joining customers;
* ``NOT IN`` is rewritten as an anti join plus a scalar NULL flag, because
  Spark only plans the null-aware anti join as a broadcast of the subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions.exprs import (broadcast_if_small, case_insensitive_match, day_text, full_stars,
                                    js_or, money_text, status_class)
from tavola.functions.keys import key_number, key_suffix_number, with_row_number
from tavola.schema import PRIMARY_KEYS
from tavola.operators.search import rows_matching
from tavola.session import written
from tavola.sources.tables import Tables

ASC = "asc"
DESC = "desc"


def _o(col: str, direction: str = ASC) -> Column:
    """Oracle NULL order: last when ascending, first when descending."""
    c = F.col(col)
    return c.asc_nulls_last() if direction == ASC else c.desc_nulls_first()


def _sum_money(col) -> Column:
    return F.sum(col).cast("decimal(38,2)")


def _avg4(col) -> Column:
    """AVG as ``sum / count`` in double: the exact decimal sum is converted once,
    so every engine gets the same bits (no intermediate decimal rounding)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def _restrict(df: DataFrame, keys: DataFrame | None, col: str) -> DataFrame:
    """Keep rows whose ``col`` is in a key batch (semi join; no driver lists)."""
    if keys is None:
        return df
    k = keys.select(F.col(keys.columns[0]).alias(col)).distinct()
    return df.join(broadcast_if_small(k), col, "left_semi")


# ---------------------------------------------------------------------------
# P: projections and filters

MENU_PUBLIC = ("id", "name", "category", "price", "description", "availability_status", "image")


def _menu_public(menu: DataFrame) -> DataFrame:
    return menu.select(F.col("menu_id").alias("id"), F.col("item_name").alias("name"), "category", "price",
                       "description", "availability_status", F.col("image_link").alias("image"))


def menu_available(t: Tables) -> DataFrame:
    """Menu items on sale, with the public column names."""
    return _menu_public(t["menu"].filter(F.col("availability_status") == "Available"))


def menu_admin_list(t: Tables) -> DataFrame:
    """Every menu item, sorted by category then name."""
    return (t["menu"].select(F.col("menu_id").alias("item_id"), "item_name", "description", "price", "category",
                             "availability_status")
            .orderBy(_o("category"), _o("item_name"), _o("item_id")))


def menu_search(t: Tables, term: str, literal: bool = False) -> DataFrame:
    """Available items whose name, category or description matches ``term``
    as a case-insensitive regular expression (``literal`` quotes it)."""
    if not term:
        raise ValueError("search term is required")
    m = t["menu"]
    hit = (case_insensitive_match("item_name", term, literal) | case_insensitive_match("category", term, literal)
           | case_insensitive_match("description", term, literal))
    return _menu_public(m.filter((F.col("availability_status") == "Available") & hit))


def menu_search_terms(t: Tables, terms: DataFrame) -> DataFrame:
    """P3, batch form: ``terms(term_id, term)`` against the menu, by posting lists of the
    different names, categories and descriptions (``matching_texts``)."""
    m = t["menu"].filter(F.col("availability_status") == "Available")
    out = rows_matching(m, "menu_id", [F.col("item_name"), F.col("category"), F.col("description")], terms)
    return out.select("term_id", "term", *[F.col(c).alias(n) for c, n in zip(
        ["menu_id", "item_name", "category", "price", "description", "availability_status", "image_link"], MENU_PUBLIC)])


def lookup(t: Tables, name: str, keys: DataFrame) -> DataFrame:
    """Rows of table ``name`` for a batch of primary keys.

    Every requested key comes back once per match; ``found`` is false for keys
    with no row (the source system answers 404 for those).
    """
    pk = list(PRIMARY_KEYS[name])
    k = keys.select(*pk).distinct()
    tbl = t[name].withColumn("_found", F.lit(True))
    return (k.join(tbl, pk, "left")
            .withColumn("found", F.coalesce(F.col("_found"), F.lit(False))).drop("_found"))


def _orders_shown_text() -> Column:
    """Text of one row of the admin order table (cells and button label)."""
    total = F.regexp_replace(F.col("total_price").cast("string"), r"\.?0+$", "")
    return F.lower(F.concat_ws(" ", F.concat(F.lit("#"), F.col("order_id")), F.col("customer_name"),
                               F.concat(F.lit("₹"), total), F.col("order_status"),
                               F.date_format("order_date", "M/d/yyyy"), F.lit("Update Status")))


def order_headers(t: Tables) -> DataFrame:
    """Order header rows of the admin list (one per order)."""
    c = t["customer"].select("customer_id", F.col("name").alias("customer_name"),
                             F.col("email").alias("customer_email"))
    return t["orders"].join(c, "customer_id", "left").select(
        "order_id", "customer_id", "customer_name", "customer_email", "total_price", "order_status", "order_date")


def orders_text_search(df: DataFrame, term: str) -> DataFrame:
    """P5: rows of the admin order list whose shown text contains ``term``."""
    return df.filter(_orders_shown_text().contains(F.lower(F.lit(term or ""))))


def orders_text_search_terms(df: DataFrame, terms: DataFrame) -> DataFrame:
    """P5, batch form: the rows of the admin order list that show each of ``terms(term_id, term)``."""
    return rows_matching(df, "order_id", [_orders_shown_text()], terms, literal=True)


def customers_text_search(t: Tables, term: str) -> DataFrame:
    """Numbered customer list rows whose shown text contains ``term``
    (the shown row number counts too)."""
    listed = with_row_number(_customer_counts(t), [_o("name"), _o("customer_id")], "row_no")
    text = F.lower(F.concat_ws(" ", F.col("row_no").cast("string"), "name", "email", "phone_number",
                               F.col("order_count").cast("string"), F.lit("Delete")))
    return listed.filter(text.contains(F.lower(F.lit(term or ""))))


def orders_by_status(df: DataFrame, status: str | None) -> DataFrame:
    """Case-insensitive status filter; blank means all. Stored text may
    have any case (V7 reports such rows), so the comparison always ignores it."""
    if not status:
        return df
    return df.filter(F.lower(F.col("order_status")) == F.lower(F.lit(status)))


def menu_by_category(t: Tables, category: str) -> DataFrame:
    """Available items of one category."""
    return _menu_public(t["menu"].filter((F.col("category") == category)
                                         & (F.col("availability_status") == "Available")))


def deliveries_bucket(df: DataFrame, bucket: str, col: str = "delivery_status") -> DataFrame:
    """Courier dashboard tabs: all, pending (out for delivery), scheduled (delivered)."""
    if bucket == "pending":
        return df.filter(F.col(col) == "Out for Delivery")
    if bucket == "scheduled":
        return df.filter(F.col(col) == "Delivered")
    return df


def _first_feedback(feedback: DataFrame) -> DataFrame:
    """The first feedback row of each order (lowest rating id)."""
    return feedback.groupBy("order_id").agg(
        F.min_by(F.struct("rating_id", "rating_score", "feedback_text"), F.col("rating_id")).alias("_f")
    ).select("order_id", F.col("_f.rating_id").alias("rating_id"), F.col("_f.rating_score").alias("rating_score"),
             F.col("_f.feedback_text").alias("feedback_text"))


def customer_feedback_for_order(t: Tables, pairs: DataFrame) -> DataFrame:
    """P10: for each (order_id, customer_id) request, the order's feedback when
    the order belongs to that customer; requests for other customers' orders
    give no row, owned orders without feedback give NULLs."""
    owned = pairs.select("order_id", "customer_id").distinct().join(
        t["orders"].select("order_id", "customer_id"), ["order_id", "customer_id"], "left_semi")
    return owned.join(_first_feedback(t["feedback"]), "order_id", "left")


def employees_list(t: Tables) -> DataFrame:
    """All employees by name."""
    return t["employee"].orderBy(_o("name"), _o("employee_id"))


# ---------------------------------------------------------------------------
# J: joins

def order_details(t: Tables, order_ids: DataFrame | None = None) -> DataFrame:
    """J1 (flat): one row per basket line with the *current* menu price."""
    o = _restrict(t["orders"], order_ids, "order_id")
    c = t["customer"].select("customer_id", F.col("name").alias("customer_name"),
                             F.col("email").alias("customer_email"), "phone_number", "address")
    i = t["items"].select("item_id", "menu_id", "quantity")
    m = t["menu"].select("menu_id", "item_name", "price", "description")
    return (o.join(c, "customer_id").join(i, "item_id").join(m, "menu_id")
            .select("order_id", "customer_id", "customer_name", "customer_email", "phone_number", "address",
                    "total_price", "order_status", "order_date", "item_id", "quantity", "item_name", "price",
                    "description"))


def order_details_nested(t: Tables, order_ids: DataFrame | None = None) -> DataFrame:
    """J1 (nested): one row per order, lines as ``array<struct>`` sorted by name.

    A basket holds at most one line per menu item (key item_id, menu_id), so
    each array is bounded by the menu size.
    """
    flat = order_details(t, order_ids)
    head = ["customer_id", "customer_name", "customer_email", "phone_number", "address", "total_price",
            "order_status", "order_date"]
    return _nest(flat, head, F.struct("item_name", "item_id", "quantity", "price", "description"))


def _nest(flat: DataFrame, head: list[str], line: Column) -> DataFrame:
    """One row per order id (as the source groups its replies): the header is
    the smallest header struct of the order (all equal when the keys hold),
    the lines a sorted array (NULL lines skipped)."""
    return (flat.groupBy("order_id")
            .agg(F.min(F.struct(*head)).alias("_h"), F.array_sort(F.collect_list(line)).alias("items"))
            .select("order_id", *[F.col(f"_h.{c}").alias(c) for c in head], "items"))


def all_orders(t: Tables) -> DataFrame:
    """J2 (flat): orders left-joined to customer, basket lines and menu, DISTINCT,
    newest first. Orders with no line keep one row of NULL line columns.

    Equal rows have equal sort keys, so the exchange of the sort also brings the rows of
    DISTINCT together. Lines with their menu items, and the joined rows, are written: their
    columns take a fraction of a shuffle's rows, and the shuffles before them are given back."""
    order = (_o("order_date", DESC), _o("order_id"), _o("menu_id"))
    rows = written(_joined_order_rows(t, keep=lambda df: written(df, "order-lines")), "order-rows")
    return rows.repartitionByRange(*order).dropDuplicates().orderBy(*order)


def _all_order_rows(t: Tables, by_order: bool = False) -> DataFrame:
    """The different rows. ``by_order`` keeps an order's rows together, so that grouping them
    needs no further exchange."""
    rows = _joined_order_rows(t)
    return (rows.repartition("order_id") if by_order else rows).dropDuplicates()


def _joined_order_rows(t: Tables, keep=lambda df: df) -> DataFrame:
    """Lines meet the menu before the orders, while they are narrow; ``keep`` gets them then."""
    c = t["customer"].select("customer_id", F.col("name").alias("customer_name"),
                             F.col("email").alias("customer_email"))
    i = t["items"].select("item_id", "menu_id", "quantity", F.col("price").alias("item_price"))
    m = t["menu"].select("menu_id", "item_name", "description", "category")
    return (t["orders"].join(c, "customer_id", "left").join(keep(i.join(m, "menu_id", "left")), "item_id", "left")
            .select("order_id", "customer_id", "total_price", "order_status", "order_date", "customer_name",
                    "customer_email", "menu_id", "quantity", "item_price", "item_name", "description", "category"))


def all_orders_nested(t: Tables) -> DataFrame:
    """J2 (nested): lines with both a menu id and a name are collected; an order
    without such lines has an empty array."""
    flat = _all_order_rows(t, by_order=True)
    line = F.when(F.col("menu_id").isNotNull() & F.col("item_name").isNotNull(),
                  F.struct("menu_id", "item_name", "category", "quantity", F.col("item_price").alias("price"),
                           "description"))
    return _nest(flat, ["customer_id", "customer_name", "customer_email", "total_price", "order_status", "order_date"],
                 line)


def first_payment(payment: DataFrame) -> DataFrame:
    """The payment with the lowest id of each order."""
    return payment.groupBy("order_id").agg(
        F.min_by(F.struct("payment_method", "payment_status", "amount"), F.col("payment_id")).alias("_p")
    ).select("order_id", F.col("_p.payment_method").alias("payment_method"),
             F.col("_p.payment_status").alias("payment_status"), F.col("_p.amount").alias("amount"))


def customer_orders(t: Tables, customers: DataFrame | None = None) -> DataFrame:
    """J3 (flat): a customer's basket lines with the *frozen* line price and the
    order's payment (first by id; 'Not specified' / 'Pending' when none)."""
    return _customer_order_rows(t, customers).orderBy(_o("order_date", DESC), _o("order_id"), _o("item_name"))


def _customer_order_rows(t: Tables, customers: DataFrame | None = None) -> DataFrame:
    o = _restrict(t["orders"], customers, "customer_id")
    i = t["items"].select("item_id", "menu_id", "quantity", F.col("price").alias("item_price"))
    m = t["menu"].select("menu_id", "item_name")
    p = first_payment(t["payment"])
    return (o.join(i, "item_id").join(m, "menu_id").join(p, "order_id", "left")
            .select("order_id", "customer_id", "order_date", "order_status", "total_price", "item_name", "quantity",
                    "item_price",
                    F.coalesce(F.nullif(F.col("payment_method"), F.lit("")), F.lit("Not specified")).alias("payment_method"),
                    F.coalesce(F.nullif(F.col("payment_status"), F.lit("")), F.lit("Pending")).alias("payment_status")))


def customer_orders_nested(t: Tables, customers: DataFrame | None = None) -> DataFrame:
    """J3 (nested): one row per order with its lines."""
    flat = _customer_order_rows(t, customers)
    return _nest(flat, ["customer_id", "order_date", "order_status", "total_price", "payment_method", "payment_status"],
                 F.struct("item_name", "quantity", F.col("item_price").alias("price")))


def active_deliveries(t: Tables) -> DataFrame:
    """Deliveries out for delivery with order, customer and courier details,
    latest first (NULL times first, as the source database sorts)."""
    d = t["deliveries"].filter(F.col("delivery_status") == "Out for Delivery")
    o = t["orders"].select("order_id", "customer_id", "total_price", "order_status")
    c = t["customer"].select("customer_id", F.col("name").alias("customer_name"), "address", "phone_number")
    dl = t["delivery"].select(F.col("delivery_id").alias("delivery_person_id"), "employee_id")
    e = t["employee"].select("employee_id", F.col("name").alias("delivery_person_name"),
                             F.col("phone_number").alias("delivery_person_phone"))
    return (d.join(o, "order_id").join(c, "customer_id").join(dl, "delivery_person_id").join(e, "employee_id")
            .select("delivery_id", "order_id", "delivery_person_id", "delivery_status", "delivery_time",
                    "customer_id", "total_price", "order_status", "customer_name", "address", "phone_number",
                    "delivery_person_name", "delivery_person_phone")
            .orderBy(_o("delivery_time", DESC), _o("delivery_id")))


def courier_orders(t: Tables, couriers: DataFrame | None = None) -> DataFrame:
    """Orders handled by each courier with customer, delivery and payment
    (one row per payment; amount falls back to the order total)."""
    d = _restrict(t["deliveries"], couriers, "delivery_person_id").select(
        "order_id", "delivery_person_id", "delivery_status")
    c = t["customer"].select("customer_id", F.col("name").alias("customer_name"),
                             F.col("phone_number").alias("customer_phone"), F.col("address").alias("delivery_address"))
    p = t["payment"].select("order_id", "payment_method", "payment_status", "amount")
    return (t["orders"].join(c, "customer_id").join(d, "order_id").join(p, "order_id", "left")
            .select("delivery_person_id", "order_id", "customer_id", "order_date", "order_status", "total_price",
                    "customer_name", "customer_phone", "delivery_address", "delivery_status",
                    F.coalesce(F.nullif(F.col("payment_method"), F.lit("")), F.lit("Not specified")).alias("payment_method"),
                    F.coalesce(F.nullif(F.col("payment_status"), F.lit("")), F.lit("Pending")).alias("payment_status"),
                    js_or("amount", "total_price").cast("decimal(18,2)").alias("payment_amount"))
            .orderBy(_o("delivery_person_id"), _o("order_date", DESC), _o("order_id")))


def unassigned_orders(t: Tables) -> DataFrame:
    """Pending orders with no delivery out, oldest first (NOT EXISTS)."""
    busy = t["deliveries"].filter(F.col("delivery_status") == "Out for Delivery").select("order_id")
    c = t["customer"].select("customer_id", F.col("name").alias("customer_name"), "address", "phone_number")
    return (t["orders"].filter(F.col("order_status") == "Pending")
            .join(busy, "order_id", "left_anti").join(c, "customer_id")
            .select("order_id", "customer_id", "total_price", "order_status", "order_date", "customer_name",
                    "address", "phone_number")
            .orderBy(_o("order_date"), _o("order_id")))


def _delivery_staff(t: Tables) -> DataFrame:
    e = t["employee"].filter(F.col("role") == "Delivery").select("employee_id", "name", "phone_number")
    return e.join(t["delivery"].select("employee_id", "delivery_id", "rating"), "employee_id")


def not_in(df: DataFrame, col: str, sub: DataFrame, sub_col: str) -> DataFrame:
    """``df.col NOT IN (select sub_col from sub)`` with SQL NULL semantics.

    Written as an anti join plus two scalar subqueries (does the subquery
    hold a NULL, is it empty), so no side is broadcast regardless of size.
    """
    s = sub.select(F.col(sub_col).alias("_v"))
    stats = s.agg(F.count(F.lit(1)).alias("n"), F.count("_v").alias("nn"))
    n_rows = stats.select("n").scalar()
    n_nonnull = stats.select("nn").scalar()
    kept = df.join(s.filter(F.col("_v").isNotNull()), F.col(col) == F.col("_v"), "left_anti")
    return kept.filter((n_rows == 0) | ((n_rows == n_nonnull) & F.col(col).isNotNull()))


def available_couriers_asis(t: Tables) -> DataFrame:
    """The source query as written: employee ids compared with courier ids
    by a NULL-aware ``NOT IN`` (so nobody is excluded on the shipped data, and
    one NULL courier id empties the result)."""
    busy = t["deliveries"].filter(F.col("delivery_status") == "Out for Delivery")
    return (not_in(_delivery_staff(t), "employee_id", busy, "delivery_person_id")
            .select("employee_id", "name", "phone_number", "rating").orderBy(_o("name"), _o("employee_id")))


def available_couriers(t: Tables) -> DataFrame:
    """The intended query: couriers whose courier id has no delivery out."""
    busy = (t["deliveries"].filter(F.col("delivery_status") == "Out for Delivery")
            .select(F.col("delivery_person_id").alias("delivery_id")))
    return (_delivery_staff(t).join(busy, "delivery_id", "left_anti")
            .select("employee_id", "name", "phone_number", "rating").orderBy(_o("name"), _o("employee_id")))


def feedback_list(t: Tables) -> DataFrame:
    """All feedback with the customer's name and filled-star count, newest id first."""
    c = t["customer"].select("customer_id", F.col("name").alias("customer_name"))
    return (t["feedback"].join(c, "customer_id")
            .select("rating_id", "order_id", "customer_id", "rating_score", "feedback_text", "customer_name",
                    full_stars("rating_score").alias("full_stars"))
            .orderBy(_o("rating_id", DESC)))


def courier_profile(t: Tables, require_role: bool = False) -> DataFrame:
    """Courier id with the employee's name and phone."""
    e = t["employee"]
    if require_role:
        e = e.filter(F.col("role") == "Delivery")
    return (t["delivery"].join(e.select("employee_id", "name", "phone_number"), "employee_id")
            .select("name", "phone_number", "delivery_id", "employee_id"))


def customer_order_lines(t: Tables, customers: DataFrame | None = None) -> DataFrame:
    """Each customer's orders with item name and current menu price,
    through orders -> items -> menu."""
    o = _restrict(t["orders"], customers, "customer_id")
    i = t["items"].select("item_id", "menu_id")
    m = t["menu"].select("menu_id", "item_name", "price")
    return (o.join(i, "item_id").join(m, "menu_id")
            .select("order_id", "customer_id", "item_id", "total_price", "order_status", "order_date", "menu_id",
                    "item_name", "price")
            .orderBy(_o("customer_id"), _o("order_date", DESC), _o("order_id"), _o("menu_id")))


def orders_with_feedback_flag(t: Tables) -> DataFrame:
    """Every order with a flag (and the values) of its feedback, one join
    instead of one request per order."""
    f = _first_feedback(t["feedback"])
    return (t["orders"].select("order_id", "customer_id", "order_status", "order_date")
            .join(f, "order_id", "left")
            .select("order_id", "customer_id", "order_status", "order_date",
                    F.col("rating_id").isNotNull().alias("has_feedback"), "rating_id", "rating_score",
                    "feedback_text"))


def pending_ratings(t: Tables) -> DataFrame:
    """Completed, delivered orders still waiting for a rating, with the courier's name."""
    done = t["orders"].filter(F.col("order_status") == "Completed").select("order_id", "customer_id")
    d = t["deliveries"].filter(F.col("delivery_status") == "Delivered").select("order_id", "delivery_person_id")
    cour = courier_profile(t).select(F.col("delivery_id").alias("delivery_person_id"),
                                     F.col("name").alias("courier_name"))
    return (done.join(d, "order_id").join(t["feedback"].select("order_id"), "order_id", "left_anti")
            .join(cour, "delivery_person_id", "left")
            .select("order_id", "customer_id", "delivery_person_id", "courier_name"))


def menu_ids_by_name(menu: DataFrame) -> DataFrame:
    """Item name -> menu id; names are not unique by schema, the lowest id wins."""
    return menu.groupBy("item_name").agg(F.min("menu_id").alias("menu_id"))


def resolve_cart_lines(cart_lines: DataFrame, menu: DataFrame) -> DataFrame:
    """Cart line names resolved to menu ids; ``resolved`` false when the
    name is not on the menu (the source rejects the whole basket)."""
    return (cart_lines.join(menu_ids_by_name(menu), "item_name", "left")
            .withColumn("resolved", F.col("menu_id").isNotNull()))


# ---------------------------------------------------------------------------
# A: aggregates

def dashboard_stats(t: Tables) -> DataFrame:
    """A1: one row of table counts (each a scalar subquery, no cross join)."""
    n_cust = t["customer"].select(F.count(F.lit(1))).scalar()
    n_menu = t["menu"].select(F.count(F.lit(1))).scalar()
    return t["orders"].agg(F.count(F.lit(1)).alias("total_orders")).select(
        "total_orders", n_cust.alias("total_customers"), n_menu.alias("menu_items"))


def sales_summary(t: Tables) -> DataFrame:
    """A2: total, mean and count of order totals (0 for missing)."""
    o = t["orders"]
    return o.agg(F.coalesce(_sum_money("total_price"), F.lit(0).cast("decimal(38,2)")).alias("total_sales"),
                 F.coalesce(_avg4("total_price"), F.lit(0.0)).alias("avg_order_value"),
                 F.count(F.lit(1)).alias("total_orders"))


def sales_by_status(t: Tables) -> DataFrame:
    """A3: order count and total by status."""
    return t["orders"].groupBy("order_status").agg(F.count(F.lit(1)).alias("count"),
                                                   _sum_money("total_price").alias("total"))


def _top_items(t: Tables, value: str, k: int) -> DataFrame:
    """Lines meet their orders on the basket id, are summed for each menu id, and only
    these sums meet the menu and its names (a name may belong to several items)."""
    i = t["items"].select("item_id", "menu_id", "quantity", "price")
    o = t["orders"].select("item_id", "order_id", "total_price")
    sold = (i.join(o, "item_id").groupBy("menu_id")
            .agg(F.count("order_id").alias("_orders"), F.sum("quantity").alias("_quantity"), _sum_money(value).alias("_value")))
    return (sold.join(t["menu"].select("menu_id", "item_name"), "menu_id").groupBy("item_name")
            .agg(F.sum("_orders").alias("order_count"), F.sum("_quantity").cast("long").alias("total_quantity"),
                 _sum_money("_value").alias("total_revenue"))
            .orderBy(_o("total_revenue", DESC), _o("item_name")).limit(k))


def top_items(t: Tables, k: int = 5) -> DataFrame:
    """A4: best-selling item names by revenue, top ``k``.

    As in the source, revenue sums the *whole order total* once per basket
    line (join fan-out); ``top_items_by_line`` gives the line-price form.
    """
    return _top_items(t, "total_price", k)


def top_items_by_line(t: Tables, k: int = 5) -> DataFrame:
    """A4 (corrected): revenue as the sum of line prices."""
    return _top_items(t, "price", k)


def category_distribution(t: Tables) -> DataFrame:
    """A5: menu item count and price sum by category."""
    return t["menu"].groupBy("category").agg(F.count(F.lit(1)).alias("item_count"),
                                             _sum_money("price").alias("total_value"))


def _orders_per_customer(orders: DataFrame, value: str | None = None, count_col: str | None = None) -> DataFrame:
    aggs = [F.count(F.col(count_col) if count_col else F.lit(1)).alias("order_count")]
    if value:
        aggs.append(_sum_money(value).alias("total_spent"))
    return orders.groupBy("customer_id").agg(*aggs)


def customer_stats(t: Tables) -> DataFrame:
    """Distinct customers, mean and max orders per customer.

    Orders are counted per customer before the join; customers without orders
    are skipped by AVG/MAX (not counted as zero), exactly like the source.
    """
    per = _orders_per_customer(t["orders"])
    j = t["customer"].select("customer_id").join(per, "customer_id", "left")
    return j.agg(F.countDistinct("customer_id").alias("total_customers"),
                 F.coalesce(_avg4("order_count"), F.lit(0.0)).alias("avg_orders_per_customer"),
                 F.coalesce(F.max("order_count"), F.lit(0)).cast("long").alias("max_orders"))


def top_customers(t: Tables, k: int = 5) -> DataFrame:
    """Customers (by name and email) with the largest spend, top ``k``.

    Orders are pre-aggregated per customer id before the join, so the join
    sees one row per customer; the regroup by (name, email) is exact.
    """
    per = _orders_per_customer(t["orders"], "total_price", "order_id")
    c = t["customer"].select("customer_id", "name", "email")
    return (c.join(per, "customer_id").groupBy("name", "email")
            .agg(F.sum("order_count").cast("long").alias("order_count"),
                 _sum_money("total_spent").alias("total_spent"))
            .orderBy(_o("total_spent", DESC), _o("name"), _o("email")).limit(k))


def daily_stats(t: Tables, k: int = 7) -> DataFrame:
    """Orders and revenue per calendar day, the latest ``k`` days present."""
    o = t["orders"].withColumn("order_day", F.to_date("order_date"))
    return (o.groupBy("order_day")
            .agg(F.countDistinct("order_id").alias("order_count"), _sum_money("total_price").alias("total_revenue"))
            .orderBy(_o("order_day", DESC)).limit(k))


def status_distribution(t: Tables) -> DataFrame:
    """Distinct orders per status."""
    return t["orders"].groupBy("order_status").agg(F.countDistinct("order_id").alias("count"))


CUSTOMER_COLS = ("customer_id", "name", "email", "phone_number", "address")


def customers_with_order_count(t: Tables) -> DataFrame:
    """A10: every customer with the number of orders (0 when none), by name."""
    return _customer_counts(t).orderBy(_o("name"), _o("customer_id"))


def _customer_counts(t: Tables) -> DataFrame:
    per = _orders_per_customer(t["orders"])
    return (t["customer"].select(*CUSTOMER_COLS).join(per, "customer_id", "left")
            .withColumn("order_count", F.coalesce(F.col("order_count"), F.lit(0)).cast("long")))


def customer_profile(t: Tables, customers: DataFrame | None = None) -> DataFrame:
    """Customer with order count and total spend (0 when none)."""
    c = _restrict(t["customer"].select(*CUSTOMER_COLS), customers, "customer_id")
    per = _orders_per_customer(t["orders"], "total_price")
    return (c.join(per, "customer_id", "left")
            .select(*CUSTOMER_COLS, F.coalesce(F.col("order_count"), F.lit(0)).cast("long").alias("total_orders"),
                    F.coalesce(F.col("total_spent"), F.lit(0).cast("decimal(38,2)")).alias("total_spent")))


def basket_totals(t: Tables) -> DataFrame:
    """Sum of current menu price x quantity per basket (0 when no line prices)."""
    m = t["menu"].select("menu_id", F.col("price").alias("menu_price"))
    return (t["items"].join(m, "menu_id", "left").groupBy("item_id")
            .agg(F.coalesce(_sum_money(F.col("menu_price") * F.col("quantity")),
                            F.lit(0).cast("decimal(38,2)")).alias("total_price")))


def cart_merge(cart_lines: DataFrame) -> DataFrame:
    """Quantities of the same item name in one cart are added."""
    return (cart_lines.groupBy("request_seq", "customer_id", "item_name")
            .agg(F.sum("quantity").cast("long").alias("quantity")))


def cart_summary(cart_lines: DataFrame) -> DataFrame:
    """Per cart: item count, distinct names and total (quantity clamped to 1..99)."""
    from tavola.functions.exprs import clamp_quantity
    q = clamp_quantity("quantity")
    return (cart_lines.groupBy("request_seq", "customer_id")
            .agg(F.sum(q).cast("long").alias("item_count"), F.countDistinct("item_name").alias("distinct_items"),
                 _sum_money(F.col("price") * q).alias("cart_total")))


def cart_line_totals(cart_lines: DataFrame) -> DataFrame:
    """A14, line by line: price times quantity (clamped to 1..99) of each cart line."""
    from tavola.functions.exprs import clamp_quantity
    q = clamp_quantity("quantity")
    return cart_lines.select("request_seq", "line_no", "item_name", q.alias("quantity"), "price",
                             (F.col("price") * q).cast("decimal(38,2)").alias("sub_total"))


def order_items_label(t: Tables) -> DataFrame:
    """A15: "name (qty), ..." per order, names sorted (bounded by basket size)."""
    i = t["items"].select("item_id", "menu_id", "quantity")
    m = t["menu"].select("menu_id", "item_name")
    lines = t["orders"].select("order_id", "item_id").join(i, "item_id").join(m, "menu_id")
    return lines.groupBy("order_id").agg(F.concat_ws(", ", F.transform(
        F.array_sort(F.collect_list(F.struct("item_name", "quantity"))),
        lambda x: F.concat(x["item_name"], F.lit(" ("), x["quantity"].cast("string"), F.lit(")")))).alias("items_label"))


def order_labels(t: Tables) -> DataFrame:
    """A15 with P14/F15/F17: label, status class, total text and day text per order."""
    return (t["orders"].join(order_items_label(t), "order_id", "left")
            .select("order_id", "customer_id", "order_status", status_class("order_status").alias("status_class"),
                    money_text("total_price").alias("total_text"), day_text("order_date").alias("day_text"),
                    "items_label"))


def order_bill(t: Tables) -> DataFrame:
    """Bill per order = sum of its basket line prices."""
    lines = t["orders"].select("order_id", "item_id").join(t["items"].select("item_id", "price"), "item_id")
    return lines.groupBy("order_id").agg(_sum_money("price").alias("bill"))


def courier_mean_rating(t: Tables) -> DataFrame:
    """Mean feedback score of the orders each courier delivered."""
    d = t["deliveries"].select("order_id", "delivery_person_id")
    return (t["feedback"].select("order_id", "rating_score").join(d, "order_id")
            .groupBy("delivery_person_id")
            .agg(F.count("rating_score").alias("rating_count"), _avg4("rating_score").alias("mean_rating")))


KEY_COLUMNS = (("employee", "employee_id"), ("customer", "customer_id"), ("menu", "menu_id"), ("items", "item_id"),
               ("orders", "order_id"), ("delivery", "delivery_id"), ("deliveries", "delivery_id"),
               ("payment", "payment_id"), ("feedback", "rating_id"))


def max_keys(t: Tables) -> DataFrame:
    """Largest numeric key part per table (0 when empty), one row per table."""
    parts = [t[n].agg(F.coalesce(F.max(key_number(c)), F.lit(0)).cast("long").alias("max_key"))
             .select(F.lit(n).alias("table_name"), "max_key") for n, c in KEY_COLUMNS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# W: windows

def numbered_customers(t: Tables) -> DataFrame:
    """The customer list as shown, with its 1-based row number."""
    return with_row_number(_customer_counts(t), [_o("name"), _o("customer_id")], "row_no")


def courier_index(t: Tables) -> DataFrame:
    """Couriers numbered 1..n in courier-id order."""
    return with_row_number(t["delivery"].select("delivery_id", "employee_id"), [_o("delivery_id")], "courier_no")
