"""Stand-in request batches built from the driver's test tables.

The ordering system receives requests one HTTP call at a time; the batch
operators take them as DataFrames. For the registered queries these frames
are derived from the test tables so their size grows with the data. The
builders only shape rows into the request schemas; every check and decision
is made by the operators that consume them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.functions.exprs import full_name
from tavola.session import written


LINES_A_TASK = 250_000


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _method(priority):
    return (F.when(priority == "1-URGENT", "Credit Card").when(priority == "2-HIGH", "Debit Card")
            .when(priority == "3-MEDIUM", "UPI").otherwise("Cash"))


def order_key_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order ids to look up: one per event (even numbers, so some are unknown)."""
    ev = _raw(spark, sf_dir, "events")
    return ev.select(F.concat(F.lit("O"), (F.col("event_id") * 2).cast("string")).alias("order_id"))


def ownership_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, customer_id) requests: every second one names another customer."""
    o = _raw(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("order_id"),
                    F.concat(F.lit("C"), (F.col("o_custkey") + F.col("o_orderkey") % 2).cast("string"))
                    .alias("customer_id"))


def cart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat cart lines: one cart per test order, one line per line item.

    ``item_name`` is the part name; the 7th line of an order carries the brand
    instead, a name that is not on the menu. Lines are dealt into as many parts as their
    number asks for, so that a task's share does not grow with the table; those of a cart
    lie together in the end.
    """
    li = _raw(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    o = _raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    p = _raw(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    parts = max(1, -(-li.count() // LINES_A_TASK))     # counted from the file's footers
    li = li.repartition(parts, "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).repartition(parts, "l_orderkey")
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("l_orderkey").alias("request_seq"),
                    F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("customer_id"),
                    F.col("l_linenumber").alias("line_no"),
                    F.when(F.col("l_linenumber") == 7, F.col("p_brand")).otherwise(F.col("p_name")).alias("item_name"),
                    F.col("l_quantity").cast("int").alias("quantity"),
                    F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
                    _method(F.col("o_orderpriority")).alias("payment_method")))


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart payloads ``(request_seq, customer_id, items array<struct>, payment_method)``
    as the checkout page sends them (lines of one test order per cart)."""
    lines = cart_lines(spark, sf_dir)
    return (lines.groupBy("request_seq", "customer_id", "payment_method")
            .agg(F.array_sort(F.collect_list(F.struct("line_no", "item_name", "quantity"))).alias("_l"))
            .select("request_seq", "customer_id",
                    F.transform("_l", lambda x: F.struct(x["item_name"].alias("item_name"),
                                                         x["quantity"].alias("quantity"))).alias("items"),
                    "payment_method"))


def basket_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basket additions: each test order's cart added again to the order's own
    basket id (quantities add to existing lines)."""
    c = carts(spark, sf_dir)
    return c.select("request_seq", F.concat(F.lit("I"), F.col("request_seq").cast("string")).alias("item_id"), "items")


# Requests that reach every rule. The texts run here and in the cross-checks alike:
# they only shape rows (which key, which fault), every check is made by the operators
# and, on the other side, by their SQL. A number that is missing or used twice, and a
# text that is too long or malformed, come about once in about a hundred rows.
def _seq(key: str, missing: int, twice: int) -> str:
    return (f"case when {key} % {missing} = 5 then null when {key} % {twice} = 6 then {key} + 1 else {key} end as request_seq")


REQUEST_SQL = {
    # Three events in a row ask for one e-mail, two of every six for one phone: some
    # lose to requests that lose themselves.
    "registrations": """select """ + _seq("event_id", 211, 223) + """,
 case when event_id % 97 = 3 then '' when event_id % 97 = 4 then 'Guest ' || repeat('x', 60)
 else 'Guest ' || cast(user_id as string) end as name,
 case when event_id % 89 = 7 then 'guest at home' when event_id % 89 = 8 then repeat('a', 100) || '@example.com'
 when event_type = 'error' and event_id % 5 = 0 and c_name is not null then lower(replace(c_name, '#', '.')) || '@example.com'
 else 'guest' || cast(cast(floor(event_id / 3) as bigint) as string) || '@example.com' end as email,
 case when event_id % 83 = 9 then '12345' when event_id % 83 = 10 then cast(7000000000 + user_id as string)
 else cast(8000000000 + case when event_id % 6 in (2, 3) then cast(floor(event_id / 6) as bigint) * 6 + 2 else event_id end as string)
 end as phone_number,
 case when event_id % 79 = 11 then '' when event_id % 79 = 12 then repeat('y', 240)
 else 'Street ' || cast(user_id as string) end as address
from {events} e left join {customer} c on e.user_id = c.c_custkey""",
    # Seven events in a row are one customer's: a new e-mail, then ones that neighbours have, had or gave up.
    "profiles": """select """ + _seq("event_id", 127, 131) + """,
 case when event_id % 113 = 5 then 'C99999999' else 'C' || cast(c as string) end as customer_id,
 case when event_id % 109 = 4 then repeat('n', 60) else 'Guest ' || cast(user_id as string) end as name,
 case when event_id % 101 = 1 then '' when event_id % 107 = 3 then 'nobody'
 when k = 0 then 'new' || cast(c as string) || '@example.com'
 when k = 2 then 'customer.' || lpad(cast(c - 1 as string), 9, '0') || '@example.com'
 when k = 3 then 'new' || cast(c - 1 as string) || '@example.com'
 when k = 5 then 'customer.' || lpad(cast(c + 1 as string), 9, '0') || '@example.com'
 else 'own' || cast(c as string) || '@example.com' end as email,
 case when event_id % 103 = 2 then '123' when k = 4 then cast(7000000001 + c as string)
 when k = 6 then cast(7500000000 + cast(floor(c / 2) as bigint) as string) else cast(7000000000 + c as string) end as phone_number,
 case when event_id % 137 = 7 then repeat('z', 240) else props end as address
from (select *, cast(floor(event_id / 7) as bigint) as c, event_id % 7 as k from {events}) x""",
    # Fifteen customers for each supplier: a story of one employee's phone, told by residue.
    "employees": """select case when k = 14 and e % 2 = 0 then null when k = 14 then c_custkey - 1 else c_custkey end as request_seq,
 case when k in (0, 2, 4, 5, 8, 10) then 'update' when k in (9, 13) then 'delete' when k = 12 then 'hire' else 'insert' end as op,
 case when k = 8 then 'E' || cast(9000000 + c_custkey as string) when k in (0, 2, 4, 5, 9, 10, 13) then 'E' || cast(e as string) end as employee_id,
 case when k = 4 then ' ' when k = 5 then repeat('s', 40) else 'Staff ' || cast(c_custkey as string) end as name,
 case when k = 3 then 'Waiter' when e % 3 = 0 then 'Delivery' when e % 3 = 1 then 'Chef' else 'Manager' end as role,
 cast(case when k = 6 then null when k in (0, 11) then 6100000000 + e when k in (1, 2) then 6000000000 + e
 else 6200000000 + c_custkey end as decimal(10,0)) as phone_number,
 cast(case when k = 7 then -1 else 20000 + k end as decimal(18,2)) as salary
from (select c_custkey, cast(floor(c_custkey / 15) as bigint) as e, c_custkey % 15 as k from {customer}) x""",
    # Known customers (with orders), unknown ones, and newcomers without orders, these twice.
    "customer_deletes": """select """ + _seq("c_custkey", 53, 59) + """, 'C' || cast(c_custkey * 2 as string) as customer_id from {customer}
union all select 10000000 + s_suppkey, 'C' || cast(5000000 + s_suppkey as string) from {supplier}
union all select 20000000 + s_suppkey, 'C' || cast(5000000 + s_suppkey as string) from {supplier}""",
    "menu_deletes": """select """ + _seq("p_partkey", 53, 59) + """, 'M' || cast(p_partkey * 7 as string) as menu_id from {part}
union all select 10000000 + s_suppkey, 'M' || cast(5000000 + s_suppkey as string) from {supplier}
union all select 20000000 + s_suppkey, 'M' || cast(5000000 + s_suppkey as string) from {supplier}""",
    # Ids wrap at 1000, so there are several edits of one item.
    "menu_updates": """select """ + _seq("p_partkey", 31, 37) + """,
 'M' || cast(case when p_partkey % 23 = 1 then 9000000 + p_partkey else p_partkey % 1000 end as string) as menu_id,
 case when p_partkey % 13 = 1 then ' ' when p_partkey % 17 = 1 then repeat('n', 150) else upper(p_name) end as name,
 case when p_partkey % 19 = 1 then repeat('d', 600) else p_type end as description,
 case when p_partkey % 11 = 1 then 0 when p_partkey % 11 = 2 then null else cast(p_retailprice as decimal(10,2)) - 500 end as price,
 case when p_partkey % 29 = 1 then null when p_size % 8 = 7 then 'Snacks' when p_size % 4 = 0 then 'Desserts'
 when p_size % 4 = 1 then 'Drinks' when p_size % 4 = 2 then 'Veg Starter' else 'International' end as category,
 case when p_size % 7 = 0 then 'Sold out' when p_size % 7 = 1 then null when p_size % 7 = 2 then 'Not Available'
 else 'Available' end as availability_status
from {part}""",
    # One order for each event; some couriers are new and have no courier row, some orders unknown.
    "assignments": """select """ + _seq("event_id", 61, 67) + """,
 'O' || cast(case when event_id % 29 = 1 then 90000000 + event_id else event_id end as string) as order_id,
 'E' || cast(case when event_id % 31 = 1 then 5000000 + user_id when event_id % 37 = 1 then 9000000 else user_id end as string)
 as delivery_person_id
from {events}""",
    # Three requests for each order, status from the event type.
    "statuses": """select """ + _seq("event_id", 61, 67) + """,
 'O' || cast(case when event_id % 47 = 1 then 90000000 + event_id else cast(floor(event_id / 3) as bigint) end as string) as order_id,
 case when value < 1 then 'Unknown' when event_type = 'signup' then 'Pending' when event_type = 'view' then 'Processing'
 when event_type in ('click', 'purchase') then 'Completed' else 'Cancelled' end as status
from {events}""",
    # One for each event; the order's customer for two of three, score 0.0-6.0, text from props.
    "feedbacks": """select """ + _seq("event_id", 61, 67) + """, 'O' || cast(event_id as string) as order_id,
 'C' || cast(case when event_id % 3 = 0 then user_id else o_custkey end as string) as customer_id,
 cast(cast(event_id % 61 as decimal(2,0)) * cast(0.1 as decimal(1,1)) as decimal(2,1)) as rating_score,
 case when event_type = 'error' then null when event_id % 43 = 1 then repeat('f', 600) else props end as feedback_text
from {events} left join {orders} on event_id = o_orderkey""",
    # Even events name the order's own courier, odd ones another; some statuses do not exist.
    "delivery_statuses": """select """ + _seq("event_id", 61, 67) + """, 'O' || cast(event_id as string) as order_id,
 case when event_id % 2 = 0 then o.own else 'D' || cast(user_id * 3 as string) end as delivery_person_id,
 case when event_id % 41 = 1 or event_id % 16 = 4 then 'Lost' when event_id % 43 = 1 then null when event_type in ('purchase', 'click')
 then 'Delivered' when event_type = 'error' then 'Cancelled' else 'Out for Delivery' end as status
from {events} e left join (select order_id as own_order, min(delivery_person_id) as own from {deliveries} group by order_id) o
 on o.own_order = 'O' || cast(e.event_id as string)""",
    # Cart lines of each order: faults by order or line number.
    "faulty_lines": """select """ + _seq("o_orderkey", 67, 71) + """, o_orderkey as cart,
 case when o_orderkey % 89 = 1 then null else 'I' || cast(case when o_orderkey % 4 = 3 then 90000000 + o_orderkey else o_orderkey end
 as string) end as item_id,
 'C' || cast(case when o_orderkey % 73 = 1 then 90000000 else o_custkey end as string) as customer_id, l_linenumber as line_no,
 case when o_orderkey % 83 = 1 and l_linenumber = 1 then p_brand when o_orderkey % 83 = 2 and l_linenumber = 1 then null
 else p_name end as item_name,
 case when o_orderkey % 59 = 1 and l_linenumber = 2 then 0 when o_orderkey % 59 = 2 and l_linenumber = 1 then null
 when o_orderkey % 61 = 3 and l_linenumber = 1 then 2147483647 else cast(l_quantity as int) end as quantity,
 case when o_orderkey % 79 = 1 then 'Barter' when o_orderkey % 79 = 2 then null when o_orderpriority = '1-URGENT' then 'Credit Card'
 when o_orderpriority = '2-HIGH' then 'Debit Card' when o_orderpriority = '3-MEDIUM' then 'UPI' else 'Cash' end as payment_method
from {orders} left join {lineitem} on l_orderkey = o_orderkey and o_orderkey % 53 <> 1 left join {part} on p_partkey = l_partkey""",
    # Cart lines as a page stores them: texts, some of them unusable.
    "text_lines": """select l_orderkey as request_seq, l_linenumber as line_no,
 case when l_orderkey % 101 = 1 then null when l_orderkey % 101 = 2 then '  ' else p_name end as item_name,
 case when l_orderkey % 103 = 1 then 'free' when l_orderkey % 103 = 2 then null else cast(p_retailprice as string) end as price,
 case when l_orderkey % 107 = 1 then 'many' when l_orderkey % 107 = 2 then null else cast(cast(l_quantity as int) as string) end as quantity
from {lineitem} join {part} on p_partkey = l_partkey""",
    # Search terms from the menu's own words: whole ones, parts, beginnings, single digits, choices.
    "menu_terms": """select distinct term as term_id, term from (
 select lower(p_type) as term from {part} union all select split_part(p_name, ' ', 2) from {part}
 union all select '^' || split_part(p_name, ' ', 1) from {part} union all select substr(p_brand, 7) from {part}
 union all select substr(p_type, 2, 2) || '.*' || substr(p_type, 5, 1) from {part}
 union all select split_part(p_name, ' ', 2) || '$|^' || split_part(p_name, ' ', 1) from {part}) x""",
    "order_terms": """select 'S' || cast(s_suppkey as string) as term_id, '#O' || cast(s_suppkey as string) || ' ' as term from {supplier}
union all select 'C' || cast(s_suppkey as string), lpad(cast(s_suppkey as string), 9, '0') from {supplier}""",
    # Newcomers: customers without orders (some with feedback), items never ordered, couriers without a courier row.
    "new_customer": """select 'C' || cast(5000000 + s_suppkey as string) as customer_id, s_name as name,
 lower(replace(s_name, '#', '.')) || '@example.com' as email, cast(7900000000 + s_suppkey as string) as phone_number,
 'New street' as address from {supplier}""",
    "new_feedback": """select 'F' || cast(90000000 + s_suppkey as string) as rating_id, 'O' || cast(90000000 + s_suppkey as string) as order_id,
 'C' || cast(5000000 + s_suppkey as string) as customer_id, cast(4 as decimal(2,1)) as rating_score, s_name as feedback_text
from {supplier} where s_suppkey % 5 = 0""",
    "new_menu": """select 'M' || cast(5000000 + s_suppkey as string) as menu_id, s_name as item_name, 'Drinks' as category,
 cast(10 as decimal(10,2)) as price, s_name as description, 'Available' as availability_status, s_name as image_link from {supplier}""",
    "new_employee": """select 'E' || cast(5000000 + s_suppkey as string) as employee_id, s_name as name, 'Delivery' as role,
 cast(6900000000 + s_suppkey as decimal(10,0)) as phone_number, cast(20000 as decimal(18,2)) as salary from {supplier}""",
}


def _names(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def request_sql(name: str) -> str:
    """The text for the cross-checks, over the raw tables (and ``r_deliveries``)."""
    text = REQUEST_SQL[name]
    return text.format(**{n: "r_deliveries" if n == "deliveries" else n for n in _names(text)})


def request_frame(spark: SparkSession, sf_dir: str, name: str, **frames: DataFrame) -> DataFrame:
    """The rows of one of ``REQUEST_SQL``."""
    text = REQUEST_SQL[name]
    return spark.sql(text, **{n: frames[n] if n in frames else _raw(spark, sf_dir, n) for n in _names(text)})


def with_newcomers(spark: SparkSession, sf_dir: str, t: dict) -> dict:
    """The tables and newcomers that nothing refers to yet (of each supplier one)."""
    return t | {n: t[n].unionByName(request_frame(spark, sf_dir, f"new_{n}")) for n in ("customer", "feedback", "menu", "employee")}


def faulty_carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carts of ``faulty_lines``: ``request_seq, item_id, customer_id, items, payment_method``; a
    cart whose order has no lines there is empty. The lines are written: the shuffles of their
    joins are given back before the one that brings carts together."""
    lines = written(request_frame(spark, sf_dir, "faulty_lines"), "faulty-lines")
    line = F.when(F.col("line_no").isNotNull(), F.struct("line_no", "item_name", "quantity"))
    return (lines.groupBy("cart", "request_seq", "item_id", "customer_id", "payment_method")
            .agg(F.array_sort(F.collect_list(line)).alias("_l"))
            .select("request_seq", "item_id", "customer_id",
                    F.transform("_l", lambda x: F.struct(x["item_name"].alias("item_name"), x["quantity"].alias("quantity"))).alias("items"),
                    "payment_method"))


# Faults by the number ``n`` in a row's key: what to put into a column instead. Every
# rule of the schema and of the tables' agreement is broken by some rows.
FAULTS: dict[str, dict[str, str]] = {
    "customer": {"customer_id": "case when n % 113 = 1 then customer_id || '0000000' else customer_id end",
             "name": "case when n % 97 = 1 then null when n % 97 = 2 then repeat('x', 60) else name end",
                 "email": "case when n % 89 = 3 then 'no at sign' when n % 89 = 4 then repeat('e', 120) || '@x.com' "
                          "when n % 89 = 5 then null else email end",
                 "phone_number": "case when n % 83 = 5 then '12' when n % 83 = 6 then '123456789012' when n % 83 = 7 then null "
                                 "else phone_number end",
                 "address": "case when n % 79 = 1 then null when n % 79 = 2 then repeat('y', 240) else address end"},
    "menu": {"menu_id": "case when n % 113 = 1 then menu_id || '0000000' else menu_id end",
             "item_name": "case when n % 61 = 1 then null when n % 61 = 2 then repeat('m', 150) else item_name end",
             "category": "case when n % 73 = 1 then 'Snacks' when n % 73 = 2 then null when n % 73 = 3 then repeat('c', 60) else category end",
             "price": "cast(case when n % 71 = 1 then 0 when n % 71 = 2 then null else price end as decimal(10,2))",
             "description": "case when n % 59 = 1 then repeat('d', 600) else description end",
             "availability_status": "case when n % 67 = 1 then 'Sold out' when n % 67 = 2 then repeat('a', 30) else availability_status end",
             "image_link": "case when n % 53 = 1 then repeat('i', 240) else image_link end"},
    "items": {"menu_id": "case when n % 43 = 1 then 'M0000000' else menu_id end",
              "quantity": "cast(case when n % 53 = 1 then 0 when n % 53 = 2 then 120 when n % 53 = 3 then null else quantity end as int)",
              "price": "cast(case when n % 47 = 1 then null when n % 47 = 2 then price + 1 else price end as decimal(18,2))"},
    "employee": {"employee_id": "case when n % 47 = 1 then employee_id || '0000000' else employee_id end",
             "name": "case when n % 13 = 1 then null when n % 13 = 2 then repeat('s', 40) else name end",
                 "role": "case when n % 7 = 1 then 'Waiter' when n % 7 = 2 then 'Head of all waiters' else role end",
                 "phone_number": "cast(case when n % 11 = 3 then null when n % 11 = 4 then 6000000001 else phone_number end as decimal(10,0))",
                 "salary": "cast(case when n % 5 = 2 then -1 else salary end as decimal(18,2))"},
    "orders": {"order_id": "case when n % 127 = 1 then order_id || '0000000' else order_id end",
             "customer_id": "case when n % 107 = 1 then 'C0000000' else customer_id end",
               "item_id": "case when n % 109 = 1 then 'I0000000' when n % 109 = 2 then null else item_id end",
               "total_price": "cast(case when n % 103 = 1 then 0 when n % 103 = 2 then null else total_price end as decimal(18,2))",
               "order_status": "case when n % 101 = 1 then 'Lost' when n % 101 = 2 then repeat('l', 30) when n % 101 = 3 then null "
                               "else order_status end"},
    "delivery": {"delivery_id": "case when n % 33 = 0 then delivery_id || '0000000' else delivery_id end",
             "employee_id": "case when n % 9 = 0 then 'E0000000' when n % 15 = 0 then null else employee_id end",
                 "rating": "cast(case when n % 6 = 0 then 9.9 else rating end as decimal(2,1))"},
    "deliveries": {"order_id": "case when n % 41 = 1 then 'O0000000' when n % 29 = 1 then 'O' || cast(n - n % 10 as string) else order_id end",
                   "delivery_person_id": "case when n % 31 = 1 then 'D0000000' else delivery_person_id end",
                   "delivery_status": "case when n % 37 = 1 then 'Lost' when n % 37 = 2 then 'Cancelled' when n % 37 = 3 then repeat('o', 30) "
                                      "when n % 29 = 1 or n % 10 = 0 then 'Out for Delivery' else delivery_status end"},
    "payment": {"order_id": "case when n % 27 = 1 then 'O0000000' when n % 27 = 2 then null else order_id end",
                "amount": "cast(case when n % 23 = 1 then null when n % 23 = 2 then amount + 1 else amount end as decimal(18,2))",
                "payment_status": "case when n % 19 = 1 then 'Lost' when n % 19 = 2 then repeat('p', 30) else payment_status end",
                "payment_method": "case when n % 17 = 1 then 'Barter' when n % 17 = 2 then repeat('b', 30) else payment_method end",
                "transaction_date": "case when n % 33 = 1 then null else transaction_date end"},
    "feedback": {"order_id": "case when n % 11 = 1 then 'O0000000' when n % 11 = 2 then null else order_id end",
                 "customer_id": "case when n % 13 = 1 then 'C0000000' when n % 13 = 2 then null else customer_id end",
                 "rating_score": "cast(case when n % 7 = 1 then 0.5 when n % 7 = 2 then 6.0 else rating_score end as decimal(2,1))",
                 "feedback_text": "case when n % 17 = 1 then repeat('z', 600) else feedback_text end"},
}
# Rows that are there twice, by the same number: duplicate keys, and owners of a key that differ.
TWICE = 51


def faulty_sql(table: str, source: str, columns: list[str]) -> str:
    """The rows of ``source`` with the faults of ``table``; some come twice, the second as it was."""
    changed = ", ".join(f"{FAULTS[table][c]} as {c}" if c in FAULTS[table] else c for c in columns)
    numbered = f"(select *, cast(substr({columns[0]}, 2) as bigint) as n from {source}) x"
    plain = ", ".join(columns)
    return f"select {changed} from {numbered} union all select {plain} from {numbered} where n % {TWICE} = 0"


def faulty_tables(t: dict) -> dict:
    """The tables with every kind of fault."""
    return {n: t[n].sparkSession.sql(faulty_sql(n, "{source}", t[n].columns), source=t[n]) for n in FAULTS}
