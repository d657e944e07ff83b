"""Registered queries: name -> (Spark callable, equivalent SQL for a cross-check).

Each callable takes ``(spark, sf_dir)``, maps the test tables onto the
restaurant tables (``star_tables``) and returns the operator's DataFrame.
The SQL strings run on the raw test tables through ``ADAPTER_SQL`` and must
give the same rows; column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tavola.operators import reports as R
from tavola.sources import requests as Q
from tavola.sources.tables import ADAPTER_SQL, star_tables, table_dump

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None, recursive: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        prefix = ADAPTER_SQL.replace("WITH\n", "WITH RECURSIVE\n", 1) if recursive else ADAPTER_SQL
        REGISTRY[name] = (fn, None if sql is None else prefix + sql)
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str):
    return star_tables(spark, sf_dir)


# Shared SQL fragments -------------------------------------------------------
FIRST_FEEDBACK_SQL = ("(select order_id, rating_id, rating_score, feedback_text from (select *, row_number() over "
                      "(partition by order_id order by rating_id) rn from r_feedback) where rn=1)")
FIRST_PAYMENT_SQL = ("(select order_id, payment_method, payment_status, amount from (select *, row_number() over "
                     "(partition by order_id order by payment_id) rn from r_payment) where rn=1)")
ORDERS_PER_CUSTOMER_SQL = "(select customer_id, count(*) as order_count from r_orders group by customer_id)"
MEAN = "(sum({0})::double / count({0})::double)"
CART_LINES_SQL = """cart_lines AS (select l_orderkey as request_seq, 'C'||o_custkey as customer_id, l_linenumber as line_no,
 case when l_linenumber=7 then p_brand else p_name end as item_name, cast(l_quantity as int) as quantity,
 cast(p_retailprice as decimal(10,2)) as price, case o_orderpriority when '1-URGENT' then 'Credit Card' when '2-HIGH' then 'Debit Card'
 when '3-MEDIUM' then 'UPI' else 'Cash' end as payment_method
 from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey)
"""


# S: scans -------------------------------------------------------------------
@register("dump_orders", "select order_id, customer_id, item_id, total_price, order_status, order_date from r_orders")
def q_dump_orders(spark, d):
    return table_dump(tables(spark, d), "orders")


@register("dump_items", "select item_id, menu_id, quantity, price from r_items")
def q_dump_items(spark, d):
    return table_dump(tables(spark, d), "items")


# P: projections and filters ----------------------------------------------------
MENU_PUBLIC_SQL = ("select menu_id as id, item_name as name, category, price, description, availability_status, "
                   "image_link as image from r_menu")


@register("menu_available", MENU_PUBLIC_SQL + " where availability_status='Available'")
def q_menu_available(spark, d):
    return R.menu_available(tables(spark, d))


@register("menu_admin_list", "select menu_id as item_id, item_name, description, price, category, availability_status "
                             "from r_menu")
def q_menu_admin_list(spark, d):
    return R.menu_admin_list(tables(spark, d))


@register("menu_search", MENU_PUBLIC_SQL + " where availability_status='Available' and (regexp_matches(item_name,'veg','i') "
                         "or regexp_matches(category,'veg','i') or regexp_matches(description,'veg','i'))")
def q_menu_search(spark, d):
    return R.menu_search(tables(spark, d), "veg")


@register("lookup_orders", "select k.order_id, o.customer_id, o.item_id, o.total_price, o.order_status, o.order_date, "
                           "o.order_id is not null as found from (select distinct 'O'||(event_id*2) as order_id from events) k "
                           "left join r_orders o on o.order_id=k.order_id")
def q_lookup_orders(spark, d):
    return R.lookup(tables(spark, d), "orders", Q.order_key_batch(spark, d))


ORDER_HEADERS_SQL = ("(select o.order_id, o.customer_id, c.name as customer_name, c.email as customer_email, "
                     "o.total_price, o.order_status, o.order_date from r_orders o left join r_customer c "
                     "on o.customer_id=c.customer_id)")


@register("orders_text_search", "select * from " + ORDER_HEADERS_SQL + " h where contains(lower(concat_ws(' ', "
          "'#'||order_id, customer_name, '₹'||regexp_replace(cast(total_price as varchar), '\\.?0+$', ''), order_status, "
          "strftime(order_date, '%-m/%-d/%Y'), 'Update Status')), '#o1')")
def q_orders_text_search(spark, d):
    return R.orders_text_search(R.order_headers(tables(spark, d)), "#O1")


@register("orders_text_search_terms", f""", terms AS ({Q.request_sql("order_terms")})
select t.term_id, t.term, h.* from """ + ORDER_HEADERS_SQL + """ h join terms t on contains(lower(concat_ws(' ',
 '#'||order_id, customer_name, '₹'||regexp_replace(cast(total_price as varchar), '\\.?0+$', ''), order_status,
 strftime(order_date, '%-m/%-d/%Y'), 'Update Status')), lower(t.term))""")
def q_orders_text_search_terms(spark, d):
    """P5 batch: order ids and customer numbers as search terms."""
    return R.orders_text_search_terms(R.order_headers(tables(spark, d)), Q.request_frame(spark, d, "order_terms"))


@register("customers_text_search", "select * from (select c.customer_id, c.name, c.email, c.phone_number, c.address, "
          "coalesce(o.order_count,0) as order_count, row_number() over (order by c.name, c.customer_id) as row_no "
          "from r_customer c left join " + ORDERS_PER_CUSTOMER_SQL + " o on c.customer_id=o.customer_id) x "
          "where contains(lower(concat_ws(' ', cast(row_no as varchar), name, email, phone_number, "
          "cast(order_count as varchar), 'Delete')), '#0000001')")
def q_customers_text_search(spark, d):
    return R.customers_text_search(tables(spark, d), "#0000001")


@register("orders_by_status", "select * from " + ORDER_HEADERS_SQL + " h where lower(order_status)='processing'")
def q_orders_by_status(spark, d):
    return R.orders_by_status(R.order_headers(tables(spark, d)), "Processing")


@register("menu_by_category", MENU_PUBLIC_SQL + " where category='Desserts' and availability_status='Available'")
def q_menu_by_category(spark, d):
    return R.menu_by_category(tables(spark, d), "Desserts")


# Independent forms for the joins below: rows of one side are taken one by one
# and the other sides are looked up (a scalar for each key, or the list of lines
# of a basket), so that a wrong join kind or key in the operator shows.
CUSTOMER_OF = "(select max(c.{0}) from r_customer c where c.customer_id = {1}.customer_id)"
ITEM_OF = "(select max(m.{0}) from r_menu m where m.menu_id = {1}.menu_id)"
BASKETS_SQL = (", baskets AS (select item_id, list({'menu_id': menu_id, 'quantity': quantity, 'price': price}) as l "
               "from r_items group by item_id)")

COURIER_ORDERS_SQL = f"""(
 with pay as (select order_id, list({{'m': payment_method, 's': payment_status, 'a': amount}}) as l from r_payment group by order_id),
 trip as (select d.delivery_person_id, d.delivery_status, d.order_id, unnest(coalesce(
   (select any_value(p.l) from pay p where p.order_id = d.order_id), [NULL])) as p from r_deliveries d),
 own as (select t.*, (select any_value(o) from r_orders o where o.order_id = t.order_id) as o from trip t)
 select delivery_person_id, order_id, o.customer_id as customer_id, o.order_date as order_date, o.order_status as order_status,
 o.total_price as total_price, {CUSTOMER_OF.format("name", "own.o")} as customer_name,
 {CUSTOMER_OF.format("phone_number", "own.o")} as customer_phone, {CUSTOMER_OF.format("address", "own.o")} as delivery_address,
 delivery_status, case when p.m is null or p.m = '' then 'Not specified' else p.m end as payment_method,
 case when p.s is null or p.s = '' then 'Pending' else p.s end as payment_status,
 cast(case when p.a is null or p.a = 0 then o.total_price else p.a end as decimal(18,2)) as payment_amount
 from own where o.customer_id in (select customer_id from r_customer))"""


@register("deliveries_bucket", "select * from " + COURIER_ORDERS_SQL + " x where delivery_status='Out for Delivery'")
def q_deliveries_bucket(spark, d):
    return R.deliveries_bucket(R.courier_orders(tables(spark, d)), "pending")


@register("customer_feedback_for_order",
          "select p.order_id, p.customer_id, f.rating_id, f.rating_score, f.feedback_text from "
          "(select distinct 'O'||o_orderkey as order_id, 'C'||(o_custkey + o_orderkey%2) as customer_id from orders) p "
          "left join " + FIRST_FEEDBACK_SQL + " f on f.order_id=p.order_id "
          "where exists (select 1 from r_orders o where o.order_id=p.order_id and o.customer_id=p.customer_id)")
def q_customer_feedback_for_order(spark, d):
    return R.customer_feedback_for_order(tables(spark, d), Q.ownership_pairs(spark, d))


@register("employees_list", "select employee_id, name, role, phone_number, salary from r_employee")
def q_employees_list(spark, d):
    return R.employees_list(tables(spark, d))


# J: joins -----------------------------------------------------------------------
@register("order_details", BASKETS_SQL + f""", spread AS (select o.*, unnest((select any_value(b.l) from baskets b
 where b.item_id = o.item_id)) as x from r_orders o), line AS (select spread.*, x.menu_id as menu_id from spread)
select order_id, customer_id, total_price, order_status, order_date, item_id, x.quantity as quantity,
 {CUSTOMER_OF.format("name", "line")} as customer_name, {CUSTOMER_OF.format("email", "line")} as customer_email,
 {CUSTOMER_OF.format("phone_number", "line")} as phone_number, {CUSTOMER_OF.format("address", "line")} as address,
 {ITEM_OF.format("item_name", "line")} as item_name, {ITEM_OF.format("price", "line")} as price,
 {ITEM_OF.format("description", "line")} as description
from line where customer_id in (select customer_id from r_customer) and menu_id in (select menu_id from r_menu)""")
def q_order_details(spark, d):
    return R.order_details(tables(spark, d))


@register("all_orders", BASKETS_SQL + f""", spread AS (select o.*, unnest(coalesce(
 (select any_value(b.l) from baskets b where b.item_id = o.item_id), [NULL])) as x from r_orders o),
 line AS (select spread.*, x.menu_id as menu_id from spread)
select order_id, customer_id, total_price, order_status, order_date, {CUSTOMER_OF.format("name", "line")} as customer_name,
 {CUSTOMER_OF.format("email", "line")} as customer_email, menu_id, x.quantity as quantity, x.price as item_price,
 {ITEM_OF.format("item_name", "line")} as item_name, {ITEM_OF.format("description", "line")} as description,
 {ITEM_OF.format("category", "line")} as category from line
group by all""")
def q_all_orders(spark, d):
    return R.all_orders(tables(spark, d))


@register("customer_orders", BASKETS_SQL + f""", line AS (select o.*, unnest(
 (select any_value(b.l) from baskets b where b.item_id = o.item_id)) as x from r_orders o),
 known AS (select line.*, x.menu_id as menu_id, (select arg_min({{'m': p.payment_method, 's': p.payment_status}}, p.payment_id)
   from r_payment p where p.order_id = line.order_id) as p from line where x.menu_id in (select menu_id from r_menu))
select order_id, customer_id, order_date, order_status, total_price, {ITEM_OF.format("item_name", "known")} as item_name,
 x.quantity as quantity, x.price as item_price, case when p.m is null or p.m = '' then 'Not specified' else p.m end
 as payment_method, case when p.s is null or p.s = '' then 'Pending' else p.s end as payment_status from known""")
def q_customer_orders(spark, d):
    return R.customer_orders(tables(spark, d))


@register("active_deliveries", f""", out AS (select d.*, (select any_value(o) from r_orders o where o.order_id = d.order_id) as o,
 (select max(employee_id) from r_delivery c where c.delivery_id = d.delivery_person_id) as employee_id
 from r_deliveries d where delivery_status = 'Out for Delivery')
select delivery_id, order_id, delivery_person_id, delivery_status, delivery_time, o.customer_id as customer_id,
 o.total_price as total_price, o.order_status as order_status, {CUSTOMER_OF.format("name", "out.o")} as customer_name,
 {CUSTOMER_OF.format("address", "out.o")} as address, {CUSTOMER_OF.format("phone_number", "out.o")} as phone_number,
 (select max(e.name) from r_employee e where e.employee_id = out.employee_id) as delivery_person_name,
 (select max(e.phone_number) from r_employee e where e.employee_id = out.employee_id) as delivery_person_phone
 from out where o.customer_id in (select customer_id from r_customer) and employee_id in (select employee_id from r_employee)""")
def q_active_deliveries(spark, d):
    return R.active_deliveries(tables(spark, d))


@register("courier_orders", "select * from " + COURIER_ORDERS_SQL + " x")
def q_courier_orders(spark, d):
    return R.courier_orders(tables(spark, d))


@register("unassigned_orders", f""", waiting AS (select order_id from r_orders where order_status='Pending'
 except select order_id from r_deliveries where delivery_status='Out for Delivery'),
 own AS (select o.* from r_orders o where order_id in (select order_id from waiting))
select order_id, customer_id, total_price, order_status, order_date, {CUSTOMER_OF.format("name", "own")} as customer_name,
 {CUSTOMER_OF.format("address", "own")} as address, {CUSTOMER_OF.format("phone_number", "own")} as phone_number
 from own where customer_id in (select customer_id from r_customer)""")
def q_unassigned_orders(spark, d):
    return R.unassigned_orders(tables(spark, d))


@register("available_couriers_asis", """, busy AS (select list(delivery_person_id) as ids, count(*) as n from r_deliveries
 where delivery_status='Out for Delivery')
select d.employee_id, (select max(e.name) from r_employee e where e.employee_id = d.employee_id) as name,
 (select max(e.phone_number) from r_employee e where e.employee_id = d.employee_id) as phone_number, d.rating
 from r_delivery d where d.employee_id in (select employee_id from r_employee where role='Delivery')
 and (select n = 0 or len(list_filter(ids, lambda x: x is not null and x <> d.employee_id)) = n from busy)""")
def q_available_couriers_asis(spark, d):
    return R.available_couriers_asis(tables(spark, d))


@register("available_couriers", """select e.employee_id, e.name, e.phone_number, d.rating
 from r_employee e join r_delivery d on e.employee_id=d.employee_id
 where e.role='Delivery' and not exists (select 1 from r_deliveries x where x.delivery_person_id=d.delivery_id
 and x.delivery_status='Out for Delivery')""")
def q_available_couriers(spark, d):
    return R.available_couriers(tables(spark, d))


@register("feedback_list", f"""select f.*, {CUSTOMER_OF.format("name", "f")} as customer_name,
 cast(least(5, greatest(0, ceil(f.rating_score))) as int) as full_stars
from r_feedback f where f.customer_id in (select customer_id from r_customer)""")
def q_feedback_list(spark, d):
    return R.feedback_list(tables(spark, d))


@register("courier_profile", """, staff AS (select map(list(employee_id), list({'name': name, 'phone_number': phone_number})) as by_id
 from r_employee)
select by_id[employee_id].name as name, by_id[employee_id].phone_number as phone_number, delivery_id, employee_id
 from r_delivery, staff where map_contains(by_id, employee_id)""")
def q_courier_profile(spark, d):
    return R.courier_profile(tables(spark, d))


@register("customer_order_lines", """select o.order_id, o.customer_id, o.item_id, o.total_price, o.order_status, o.order_date,
 i.menu_id, m.item_name, m.price from r_orders o join r_items i on o.item_id=i.item_id join r_menu m on i.menu_id=m.menu_id""")
def q_customer_order_lines(spark, d):
    return R.customer_order_lines(tables(spark, d))


@register("orders_with_feedback_flag", """select o.order_id, o.customer_id, o.order_status, o.order_date,
 f.rating_id is not null as has_feedback, f.rating_id, f.rating_score, f.feedback_text
 from r_orders o left join """ + FIRST_FEEDBACK_SQL + " f on o.order_id=f.order_id")
def q_orders_with_feedback_flag(spark, d):
    return R.orders_with_feedback_flag(tables(spark, d))


@register("pending_ratings", """select o.order_id, o.customer_id, d.delivery_person_id, e.name as courier_name
 from r_orders o join r_deliveries d on o.order_id=d.order_id
 left join r_delivery dl on dl.delivery_id=d.delivery_person_id left join r_employee e on e.employee_id=dl.employee_id
 where o.order_status='Completed' and d.delivery_status='Delivered'
 and not exists (select 1 from r_feedback f where f.order_id=o.order_id)""")
def q_pending_ratings(spark, d):
    return R.pending_ratings(tables(spark, d))


@register("resolve_cart_lines", ", " + CART_LINES_SQL + """, names AS (select item_name, min(menu_id) as menu_id from r_menu group by item_name)
select l.item_name, l.request_seq, l.customer_id, l.line_no, l.quantity, l.price, n.menu_id, n.menu_id is not null as resolved
from cart_lines l left join names n on l.item_name=n.item_name""")
def q_resolve_cart_lines(spark, d):
    lines = Q.cart_lines(spark, d).drop("payment_method")
    return R.resolve_cart_lines(lines, tables(spark, d)["menu"])


# A: aggregates -----------------------------------------------------------------
@register("dashboard_stats", """select (select count(*) from r_orders) as total_orders,
 (select count(*) from r_customer) as total_customers, (select count(*) from r_menu) as menu_items""")
def q_dashboard_stats(spark, d):
    return R.dashboard_stats(tables(spark, d))


@register("sales_summary", "select coalesce(cast(sum(total_price) as decimal(38,2)), 0) as total_sales, coalesce("
          + MEAN.format("total_price") + ", 0.0) as avg_order_value, count(*) as total_orders from r_orders")
def q_sales_summary(spark, d):
    return R.sales_summary(tables(spark, d))


@register("sales_by_status", "select order_status, count(*) as count, cast(sum(total_price) as decimal(38,2)) as total "
                             "from r_orders group by order_status")
def q_sales_by_status(spark, d):
    return R.sales_by_status(tables(spark, d))


@register("top_items", """, sold AS (select item_id, count(*) as n, sum(total_price) as total from r_orders group by item_id),
 named AS (select (select max(m.item_name) from r_menu m where m.menu_id = i.menu_id) as item_name, i.quantity,
 (select n from sold s where s.item_id = i.item_id) as n, (select total from sold s where s.item_id = i.item_id) as total
 from r_items i where i.menu_id in (select menu_id from r_menu)),
 summed AS (select item_name, cast(sum(n) as bigint) as order_count, cast(sum(quantity * n) as bigint) as total_quantity,
 cast(sum(total) as decimal(38,2)) as total_revenue from named where n is not null group by item_name)
select item_name, order_count, total_quantity, total_revenue from (select *, row_number() over
 (order by total_revenue is not null, total_revenue desc, item_name is null, item_name) as place from summed) where place <= 5""")
def q_top_items(spark, d):
    return R.top_items(tables(spark, d))


@register("top_items_by_line", """select m.item_name, count(o.order_id) as order_count, cast(sum(i.quantity) as bigint) as total_quantity,
 cast(sum(i.price) as decimal(38,2)) as total_revenue
 from r_menu m join r_items i on m.menu_id=i.menu_id join r_orders o on i.item_id=o.item_id
 group by m.item_name order by total_revenue desc nulls first, m.item_name asc nulls last limit 5""")
def q_top_items_by_line(spark, d):
    return R.top_items_by_line(tables(spark, d))


@register("category_distribution", "select category, count(*) as item_count, cast(sum(price) as decimal(38,2)) as total_value "
                                   "from r_menu group by category")
def q_category_distribution(spark, d):
    return R.category_distribution(tables(spark, d))


@register("customer_stats", """, own AS (select customer_id from r_orders where customer_id in (select customer_id from r_customer))
select (select count(distinct customer_id) from r_customer) as total_customers,
 coalesce((select count(*)::double / nullif(count(distinct customer_id), 0)::double from own), 0.0) as avg_orders_per_customer,
 coalesce((select count(*) from own group by customer_id order by 1 desc limit 1), 0) as max_orders""")
def q_customer_stats(spark, d):
    return R.customer_stats(tables(spark, d))


@register("top_customers", """select c.name, c.email, count(o.order_id) as order_count, cast(sum(o.total_price) as decimal(38,2)) as total_spent
 from r_customer c join r_orders o on c.customer_id=o.customer_id group by c.name, c.email
 order by total_spent desc nulls first, c.name asc nulls last, c.email asc nulls last limit 5""")
def q_top_customers(spark, d):
    return R.top_customers(tables(spark, d))


@register("daily_stats", """select cast(order_date as date) as order_day, count(distinct order_id) as order_count,
 cast(sum(total_price) as decimal(38,2)) as total_revenue from r_orders group by cast(order_date as date)
 order by order_day desc nulls first limit 7""")
def q_daily_stats(spark, d):
    return R.daily_stats(tables(spark, d))


@register("status_distribution", "select order_status, count(distinct order_id) as count from r_orders group by order_status")
def q_status_distribution(spark, d):
    return R.status_distribution(tables(spark, d))


@register("customers_with_order_count", "select c.customer_id, c.name, c.email, c.phone_number, c.address, "
          "cast(coalesce(o.order_count, 0) as bigint) as order_count from r_customer c left join "
          + ORDERS_PER_CUSTOMER_SQL + " o on c.customer_id=o.customer_id")
def q_customers_with_order_count(spark, d):
    return R.customers_with_order_count(tables(spark, d))


@register("customer_profile", """select c.customer_id, c.name, c.email, c.phone_number, c.address,
 cast(coalesce(o.n, 0) as bigint) as total_orders, coalesce(o.s, cast(0 as decimal(38,2))) as total_spent
 from r_customer c left join (select customer_id, count(*) n, cast(sum(total_price) as decimal(38,2)) s from r_orders
 group by customer_id) o on c.customer_id=o.customer_id""")
def q_customer_profile(spark, d):
    return R.customer_profile(tables(spark, d))


@register("basket_totals", """select i.item_id, coalesce(cast(sum(m.price*i.quantity) as decimal(38,2)), cast(0 as decimal(38,2))) as total_price
 from r_items i left join r_menu m on i.menu_id=m.menu_id group by i.item_id""")
def q_basket_totals(spark, d):
    return R.basket_totals(tables(spark, d))


@register("cart_merge", ", " + CART_LINES_SQL + """select request_seq, customer_id, item_name, cast(sum(quantity) as bigint) as quantity
 from cart_lines group by request_seq, customer_id, item_name""")
def q_cart_merge(spark, d):
    return R.cart_merge(Q.cart_lines(spark, d))


@register("cart_summary", ", " + CART_LINES_SQL + """, q AS (select *, least(99, greatest(1, coalesce(try_cast(cast(quantity as varchar) as int), 1))) as qq from cart_lines)
select request_seq, customer_id, cast(sum(qq) as bigint) as item_count, count(distinct item_name) as distinct_items,
 cast(sum(price*qq) as decimal(38,2)) as cart_total from q group by request_seq, customer_id""")
def q_cart_summary(spark, d):
    return R.cart_summary(Q.cart_lines(spark, d))


@register("cart_line_totals", ", " + CART_LINES_SQL + """select request_seq, line_no, item_name, cast(case when quantity is null
 or quantity < 1 then 1 when quantity > 99 then 99 else quantity end as int) as quantity, price, cast(price * case
 when quantity is null or quantity < 1 then 1 when quantity > 99 then 99 else quantity end as decimal(38,2)) as sub_total
 from cart_lines""")
def q_cart_line_totals(spark, d):
    return R.cart_line_totals(Q.cart_lines(spark, d))


@register("order_items_label", """select o.order_id, string_agg(m.item_name || ' (' || cast(i.quantity as varchar) || ')', ', '
 order by m.item_name, i.quantity) as items_label
 from r_orders o join r_items i on o.item_id=i.item_id join r_menu m on i.menu_id=m.menu_id group by o.order_id""")
def q_order_items_label(spark, d):
    return R.order_items_label(tables(spark, d))


@register("order_bill", """select o.order_id, cast(sum(i.price) as decimal(38,2)) as bill
 from r_orders o join r_items i on o.item_id=i.item_id group by o.order_id""")
def q_order_bill(spark, d):
    return R.order_bill(tables(spark, d))


@register("courier_mean_rating", "select d.delivery_person_id, count(f.rating_score) as rating_count, "
          + MEAN.format("f.rating_score") + " as mean_rating from r_feedback f join r_deliveries d "
          "on f.order_id=d.order_id group by d.delivery_person_id")
def q_courier_mean_rating(spark, d):
    return R.courier_mean_rating(tables(spark, d))


_MAXK = ("select '{t}' as table_name, cast(coalesce(max(try_cast(nullif(regexp_replace({c}, '[^0-9]', '', 'g'), '') "
         "as bigint)), 0) as bigint) as max_key from r_{t}")


@register("max_keys", "\nunion all\n".join(_MAXK.format(t=t, c=c) for t, c in R.KEY_COLUMNS))
def q_max_keys(spark, d):
    return R.max_keys(tables(spark, d))


# W: windows ----------------------------------------------------------------------
@register("numbered_customers", "select c.customer_id, c.name, c.email, c.phone_number, c.address, "
          "cast(coalesce(o.order_count, 0) as bigint) as order_count, row_number() over (order by c.name, c.customer_id) "
          "as row_no from r_customer c left join " + ORDERS_PER_CUSTOMER_SQL + " o on c.customer_id=o.customer_id")
def q_numbered_customers(spark, d):
    return R.numbered_customers(tables(spark, d))


@register("courier_index", "select delivery_id, employee_id, row_number() over (order by delivery_id) as courier_no "
                           "from r_delivery")
def q_courier_index(spark, d):
    return R.courier_index(tables(spark, d))


@register("order_labels", """select o.order_id, o.customer_id, o.order_status,
 case lower(o.order_status) when 'completed' then 'completed' when 'processing' then 'processing'
 when 'cancelled' then 'cancelled' else 'pending' end as status_class,
 printf('%.2f', o.total_price::double) as total_text, strftime(o.order_date, '%-d/%-m/%Y') as day_text, l.items_label
 from r_orders o left join (select o.order_id, string_agg(m.item_name || ' (' || cast(i.quantity as varchar) || ')', ', '
 order by m.item_name, i.quantity) as items_label from r_orders o join r_items i on o.item_id=i.item_id
 join r_menu m on i.menu_id=m.menu_id group by o.order_id) l on o.order_id=l.order_id""")
def q_order_labels(spark, d):
    return R.order_labels(tables(spark, d))


# Nested replies and parameter variants ------------------------------------------------
@register("order_details_nested", None)
def q_order_details_nested(spark, d):
    """J1 nested: one row per order with its lines as an array of structs."""
    return R.order_details_nested(tables(spark, d))


@register("all_orders_nested", None)
def q_all_orders_nested(spark, d):
    """J2 nested: orders without lines keep an empty array."""
    return R.all_orders_nested(tables(spark, d))


@register("customer_orders_nested", None)
def q_customer_orders_nested(spark, d):
    """J3 nested: order history with payment defaults and lines."""
    return R.customer_orders_nested(tables(spark, d))


def _lines_text(df, fields: list[str]):
    """A nested reply with its lines as one text (``field|field;field|field``) and their number."""
    from pyspark.sql import functions as F
    text = F.transform("items", lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields]))
    return df.withColumn("n_lines", F.size("items")).withColumn("lines", F.array_join(text, ";")).drop("items")


def _agg_lines(fields: list[str], real: str = "true") -> str:
    row = "concat_ws('|', " + ", ".join(f"cast({f} as varchar)" for f in fields) + ")"
    return (f"cast(count(*) filter ({real}) as int) as n_lines, coalesce(string_agg({row}, ';' order by {', '.join(fields)}) "
            f"filter ({real}), '') as lines")


@register("order_details_nested_text", "select o.order_id, o.customer_id, c.name as customer_name, c.email as customer_email, "
          "c.phone_number, c.address, o.total_price, o.order_status, o.order_date, "
          + _agg_lines(["m.item_name", "i.item_id", "i.quantity", "m.price", "m.description"])
          + " from r_menu m, r_items i, r_customer c, r_orders o where o.item_id=i.item_id and i.menu_id=m.menu_id "
            "and c.customer_id=o.customer_id group by all")
def q_order_details_nested_text(spark, d):
    """J1 nested, lines as text."""
    return _lines_text(R.order_details_nested(tables(spark, d)), ["item_name", "item_id", "quantity", "price", "description"])


@register("all_orders_nested_text", "select o.order_id, o.customer_id, c.name as customer_name, c.email as customer_email, o.total_price, "
          "o.order_status, o.order_date, " + _agg_lines(["m.menu_id", "m.item_name", "m.category", "i.quantity", "i.price", "m.description"],
                                                        "m.menu_id is not null and m.item_name is not null")
          + " from r_orders o left join r_customer c on c.customer_id=o.customer_id left join r_items i on i.item_id=o.item_id "
            "left join r_menu m on m.menu_id=i.menu_id group by all")
def q_all_orders_nested_text(spark, d):
    """J2 nested, lines as text."""
    return _lines_text(R.all_orders_nested(tables(spark, d)), ["menu_id", "item_name", "category", "quantity", "price", "description"])


@register("customer_orders_nested_text", "select o.order_id, o.customer_id, o.order_date, o.order_status, o.total_price, "
          "coalesce(nullif(p.payment_method,''),'Not specified') as payment_method, coalesce(nullif(p.payment_status,''),'Pending') "
          "as payment_status, " + _agg_lines(["m.item_name", "i.quantity", "i.price"])
          + " from r_menu m, r_items i, r_orders o left join " + FIRST_PAYMENT_SQL + " p on p.order_id=o.order_id "
            "where o.item_id=i.item_id and i.menu_id=m.menu_id group by all")
def q_customer_orders_nested_text(spark, d):
    """J3 nested, lines as text."""
    return _lines_text(R.customer_orders_nested(tables(spark, d)), ["item_name", "quantity", "price"])


@register("courier_profile_role", """, staff AS (select map(list(employee_id), list({'name': name, 'phone_number': phone_number})) as by_id
 from r_employee where role='Delivery')
select by_id[employee_id].name as name, by_id[employee_id].phone_number as phone_number, delivery_id, employee_id
 from r_delivery, staff where map_contains(by_id, employee_id)""")
def q_courier_profile_role(spark, d):
    return R.courier_profile(tables(spark, d), require_role=True)


@register("menu_search_terms", f""", terms AS ({Q.request_sql("menu_terms")})
select t.term_id, t.term, m.menu_id as id, m.item_name as name, m.category, m.price, m.description,
 m.availability_status, m.image_link as image from r_menu m join terms t on m.availability_status='Available'
 and (regexp_matches(m.item_name, t.term, 'i') or regexp_matches(m.category, t.term, 'i')
 or regexp_matches(m.description, t.term, 'i'))""")
def q_menu_search_terms(spark, d):
    """P3 batch: words, parts and patterns of the menu as search terms."""
    return R.menu_search_terms(tables(spark, d), Q.request_frame(spark, d, "menu_terms"))
