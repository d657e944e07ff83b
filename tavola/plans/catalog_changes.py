"""Registered queries for the guarded change batches.

Request batches are derived from the test tables (``sources.requests``) so that
every rule of a batch meets a request that breaks it; each query returns the
operator's verdicts or one of its new tables. The sequential order state machine
(C8) is replayed in SQL with a recursive CTE per order, claims (C1, C2, C14) by rounds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tavola.functions.keys import random_order_code
from tavola.operators import changes as C
from tavola.operators.validate import ROW_RULES, UNIQUE_KEYS, rule_name, validate
from tavola.plans.catalog import register, tables
from tavola.plans.catalog_checks import violations_sql
from tavola.schema import (AVAILABILITY, CATEGORIES, DELIVERY_STATUSES, EMAIL_PATTERN, PAYMENT_METHODS, PHONE_PATTERN, ROLES,
                           SCHEMAS)
from tavola.session import written
from tavola.sources import requests as Q
from tavola.sources.requests import request_sql

AS_OF_SQL = "TIMESTAMP '2024-04-01 12:00:00'"


def _in(vals) -> str:
    return "(" + ", ".join("'" + v + "'" for v in vals) + ")"


def _pad(prefix: str, n: str) -> str:
    return f"'{prefix}'||lpad(cast({n} as varchar), cast(greatest(3, length(cast({n} as varchar))) as integer), '0')"


def _blank(c: str) -> str:
    return f"({c} is null or cast({c} as varchar)='')"


def _req(name: str) -> str:
    """The requests as CTE ``req``, with ``seq_why``: no number, or one used twice."""
    return f""", req AS (select q.*, case when request_seq is null then 'missing_request_seq'
 when count(*) over (partition by request_seq) > 1 then 'repeated_request_seq' end as seq_why from ({request_sql(name)}) q)
"""


def _first_wins(key: str, src: str) -> str:
    """Verdicts of deletes: after the first that passes, the row is gone."""
    return f"""select request_seq, {key}, reason is null as accepted, reason from (select *, coalesce(why, case when request_seq <>
 min(case when why is null then request_seq end) over (partition by {key}) then 'not_found' end) as reason from {src}) v"""


def _newcomers(*names: str) -> str:
    return "".join(f", n_{n} AS (select {', '.join(c for c in SCHEMAS[n].names)} from r_{n} union all {request_sql('new_' + n)})\n"
                   for n in names)


def _refreshed(status: str, touched: str) -> str:
    """Orders with new statuses; totals of touched orders are those of their baskets."""
    return f"""select o.order_id, o.customer_id, o.item_id, cast(case when o.order_id in (select order_id from {touched})
 then (select sum(i.price) from r_items i where i.item_id=o.item_id) else o.total_price end as decimal(18,2)) as total_price,
 {status} as order_status, o.order_date from r_orders o"""


# C3 / C4 / C5 -----------------------------------------------------------------------
def _cust_del_sql(guard: str, reason: str) -> str:
    return _newcomers("customer", "feedback") + _req("customer_deletes") + f""", chk AS (select r.*, case when seq_why is not null then seq_why
 when exists (select 1 from r_orders o where o.customer_id=r.customer_id {guard}) then '{reason}'
 when exists (select 1 from r_orders o where o.customer_id=r.customer_id)
   or exists (select 1 from n_feedback f where f.customer_id=r.customer_id) then 'referenced'
 when not exists (select 1 from n_customer c where c.customer_id=r.customer_id) then 'not_found' end as why
 from req r), fin AS ({_first_wins("customer_id", "chk")})
"""


def _deletes(spark, d, apply, **how):
    return apply(Q.with_newcomers(spark, d, tables(spark, d)), Q.request_frame(spark, d, "customer_deletes"), **how)


@register("account_delete_batch", _cust_del_sql("and o.order_status in ('Pending','Processing')", "active_orders") + "select * from fin")
def q_account_delete_batch(spark, d):
    return _deletes(spark, d, C.apply_account_deletes).verdicts


@register("customer_delete_batch", _cust_del_sql("", "has_orders") + "select * from fin")
def q_customer_delete_batch(spark, d):
    return _deletes(spark, d, C.apply_customer_deletes).verdicts


@register("active_order_guard_batch", _cust_del_sql("and o.order_status in ('Pending','Preparing','Ready')", "active_orders")
          + "select * from fin")
def q_active_order_guard_batch(spark, d):
    return _deletes(spark, d, C.apply_active_order_guard).verdicts


@register("customer_delete_remaining", _cust_del_sql("", "has_orders") + """select customer_id, name, email, phone_number, address
 from n_customer where customer_id not in (select customer_id from fin where accepted)""")
def q_customer_delete_remaining(spark, d):
    """C4's new customer table (accepted deletes removed)."""
    return _deletes(spark, d, C.apply_customer_deletes).tables["customer"]


# C13 ----------------------------------------------------------------------------------
MENU_DEL_SQL = _newcomers("menu") + _req("menu_deletes") + f""", chk AS (select r.*, case when seq_why is not null then seq_why
 when not exists (select 1 from n_menu m where m.menu_id=r.menu_id) then 'not_found'
 when exists (select 1 from r_items i where i.menu_id=r.menu_id) then 'ordered' end as why from req r),
 fin AS ({_first_wins("menu_id", "chk")})
"""


def _menu_deletes(spark, d):
    return C.apply_menu_deletes(Q.with_newcomers(spark, d, tables(spark, d)), Q.request_frame(spark, d, "menu_deletes"))


@register("menu_delete_batch", MENU_DEL_SQL + "select * from fin")
def q_menu_delete_batch(spark, d):
    return _menu_deletes(spark, d).verdicts


@register("menu_delete_remaining", MENU_DEL_SQL + "select * from n_menu where menu_id not in (select menu_id from fin where accepted)")
def q_menu_delete_remaining(spark, d):
    """C13's new menu."""
    return _menu_deletes(spark, d).tables["menu"]


# C9 -----------------------------------------------------------------------------------
DELIVERY_STATUS_SQL = _req("delivery_statuses") + """, fin AS (select r.*, case when seq_why is not null then seq_why
 when not exists (select 1 from r_deliveries d where d.order_id=r.order_id and d.delivery_person_id=r.delivery_person_id)
 then 'not_found_or_unauthorized' when r.status is null or r.status not in """ + _in(DELIVERY_STATUSES) + """
 then 'invalid_status' end as reason from req r),
acc AS (select * from fin where reason is null)
"""


def _delivery_statuses(spark, d):
    t = tables(spark, d)
    return C.apply_delivery_status(t, Q.request_frame(spark, d, "delivery_statuses", deliveries=t["deliveries"]))


@register("delivery_status_batch", DELIVERY_STATUS_SQL + "select request_seq, order_id, delivery_person_id, status, "
          "reason is null as accepted, reason from fin")
def q_delivery_status_batch(spark, d):
    return _delivery_statuses(spark, d).verdicts


@register("delivery_status_deliveries", DELIVERY_STATUS_SQL + """, last AS (select order_id, delivery_person_id,
 arg_max(status, request_seq) as s from acc group by all)
select d.delivery_id, d.order_id, d.delivery_person_id, coalesce(l.s, d.delivery_status) as delivery_status,
 case when l.s is not null then """ + AS_OF_SQL + """ else d.delivery_time end as delivery_time
from r_deliveries d left join last l on l.order_id=d.order_id and l.delivery_person_id=d.delivery_person_id""")
def q_delivery_status_deliveries(spark, d):
    """C9's new deliveries."""
    return _delivery_statuses(spark, d).tables["deliveries"]


@register("delivery_status_orders", DELIVERY_STATUS_SQL + ", done AS (select distinct order_id from acc where status='Delivered')\n"
          + _refreshed("case when o.order_id in (select order_id from done) then 'Completed' else o.order_status end", "done"))
def q_delivery_status_orders(spark, d):
    """C9's new orders."""
    return _delivery_statuses(spark, d).tables["orders"]


# C10 ----------------------------------------------------------------------------------
ASSIGN_SQL = _newcomers("employee") + _req("assignments") + """,
cour AS (select employee_id, min(delivery_id) as c from r_delivery group by employee_id),
busy AS (select distinct delivery_person_id as c from r_deliveries where delivery_status='Out for Delivery'),
chk AS (select r.*, cour.c as courier_id, case when seq_why is not null then seq_why when e.employee_id is null then 'employee_not_found'
 when e.role is null or e.role<>'Delivery' then 'not_delivery_person' when cour.c is null then 'no_courier_record'
 when b.c is not null then 'courier_busy' when o.order_id is null then 'order_not_found' end as why
 from req r left join n_employee e on e.employee_id=r.delivery_person_id left join cour on cour.employee_id=r.delivery_person_id
 left join busy b on b.c=cour.c left join r_orders o on o.order_id=r.order_id),
fin AS (select *, coalesce(why, case when request_seq <> min(case when why is null then request_seq end)
 over (partition by courier_id) then 'courier_busy' end) as reason from chk)
"""


def _assignments(spark, d):
    return C.apply_assignments(Q.with_newcomers(spark, d, tables(spark, d)), Q.request_frame(spark, d, "assignments"))


@register("assignment_batch", ASSIGN_SQL + "select request_seq, order_id, delivery_person_id, courier_id, "
          "reason is null as accepted, reason from fin")
def q_assignment_batch(spark, d):
    return _assignments(spark, d).verdicts


@register("assignment_new_deliveries", ASSIGN_SQL + """, mx AS (select coalesce(max(try_cast(substr(delivery_id, 2) as bigint)), 0) as m
 from r_deliveries), acc AS (select *, row_number() over (order by request_seq) as pos from fin where reason is null)
select """ + _pad("D", "mx.m + acc.pos") + """ as delivery_id, order_id, courier_id as delivery_person_id,
 'Out for Delivery' as delivery_status, """ + AS_OF_SQL + " as delivery_time from acc, mx")
def q_assignment_new_deliveries(spark, d):
    return _assignments(spark, d).extra["new_deliveries"]


@register("assignment_orders", ASSIGN_SQL + ", moved AS (select order_id from fin where reason is null)\n"
          + _refreshed("case when o.order_id in (select order_id from moved) then 'Processing' else o.order_status end", "moved"))
def q_assignment_orders(spark, d):
    """C10's new orders."""
    return _assignments(spark, d).tables["orders"]


# Claims: one holder for each e-mail or phone, request by request ---------------------------
def _claims_sql(kinds: list[str], held: str | None) -> str:
    """CTE ``answer(seq, how_<kind>)`` of ``ask(seq, actor, can, <kinds>)``, by rounds until nothing changes.

    The rule as it stands: another's accepted claim of the value came before, and its
    actor has had no accepted request since; or another held it and has had none yet."""
    def taken(k: str) -> str:
        return (f"exists (select 1 from rounds x where x.{k}=t.{k} and x.acc and x.seq<t.seq and x.actor<>t.actor and not exists "
                "(select 1 from rounds y where y.actor=x.actor and y.acc and y.seq>x.seq and y.seq<t.seq))")

    def had(k: str) -> str:
        if held is None:
            return "false"
        return (f"exists (select 1 from {held} h where h.{k}=t.{k} and h.actor<>t.actor and not exists "
                "(select 1 from rounds y where y.actor=h.actor and y.acc and y.seq<t.seq))")

    cols = ", ".join(kinds)
    how = ", ".join(f"case when {taken(k)} then 'taken' when {had(k)} then 'held' end as how_{k}" for k in kinds)
    names = ", ".join(f"how_{k}" for k in kinds)
    free = " and ".join(f"how_{k} is null" for k in kinds)
    none = ", ".join("cast(null as varchar)" for _ in kinds)
    return f""", rounds(i, seq, actor, can, {cols}, acc, {names}, changed) AS (
 select 0, seq, actor, can, {cols}, can, {none}, true from ask
 union all
 select i + 1, seq, actor, can, {cols}, can and {free}, {names}, bool_or((can and {free}) <> acc) over ()
 from (select t.i, t.seq, t.actor, t.can, {', '.join('t.' + k for k in kinds)}, t.acc, {how} from rounds t where t.changed) z),
answer AS (select seq, {names} from rounds where i = (select max(i) from rounds))
"""


# C1 -----------------------------------------------------------------------------------
REG_SQL = _req("registrations") + """, chk AS (select r.*, case when seq_why is not null then seq_why when """ + " or ".join(
    _blank(c) for c in ("name", "email", "phone_number", "address")) + """
 then 'missing_fields' when exists (select 1 from r_customer c where c.email=r.email) then 'email_registered'
 when exists (select 1 from r_customer c where c.phone_number=r.phone_number) then 'phone_registered'
 when not regexp_matches(r.phone_number, '""" + PHONE_PATTERN + """') then 'invalid_phone'
 when not regexp_matches(r.email, '""" + EMAIL_PATTERN + """') then 'invalid_email'
 when length(name) > 50 then 'name_too_long' when length(email) > 100 then 'email_too_long'
 when length(address) > 200 then 'address_too_long' end as why from req r),
ask AS (select request_seq as seq, cast(request_seq as varchar) as actor, true as can, email, phone_number from chk where why is null)
""" + _claims_sql(["email", "phone_number"], None) + """, fin AS (select chk.*, coalesce(why, case when how_email is not null then 'email_in_batch'
 when how_phone_number is not null then 'phone_in_batch' end) as reason
 from chk left join answer on answer.seq=chk.request_seq and why is null)
"""


def _registrations(spark, d):
    return C.apply_registrations(tables(spark, d), Q.request_frame(spark, d, "registrations"))


@register("registration_batch", REG_SQL + "select request_seq, name, email, phone_number, address, "
          "reason is null as accepted, reason from fin", recursive=True)
def q_registration_batch(spark, d):
    return _registrations(spark, d).verdicts


@register("registration_new_customers", REG_SQL + """, mx AS (select coalesce(max(try_cast(substr(customer_id, 2) as bigint)), 10)
 as m from r_customer), acc AS (select *, row_number() over (order by request_seq) as pos from fin where reason is null)
select """ + _pad("C", "mx.m + acc.pos") + " as customer_id, name, email, phone_number, address from acc, mx", recursive=True)
def q_registration_new_customers(spark, d):
    return _registrations(spark, d).extra["new_customers"]


# C2 -----------------------------------------------------------------------------------
PROFILE_SQL = _req("profiles") + """, chk AS (select r.*, case when seq_why is not null then seq_why when """ + " or ".join(
    _blank("r." + c) for c in ("name", "email", "phone_number", "address")) + """ then 'missing_fields' end as why,
 case when not exists (select 1 from r_customer c where c.customer_id=r.customer_id) then 'not_found'
 when not regexp_matches(r.phone_number, '""" + PHONE_PATTERN + """') then 'invalid_phone'
 when not regexp_matches(r.email, '""" + EMAIL_PATTERN + """') then 'invalid_email'
 when length(name) > 50 then 'name_too_long' when length(email) > 100 then 'email_too_long'
 when length(address) > 200 then 'address_too_long' end as late from req r),
ask AS (select request_seq as seq, customer_id as actor, late is null as can, email, phone_number from chk where why is null),
had AS (select customer_id as actor, email, phone_number from r_customer)
""" + _claims_sql(["email", "phone_number"], "had") + """, fin AS (select chk.*, coalesce(why,
 case how_email when 'held' then 'email_in_use' when 'taken' then 'email_in_batch' end,
 case how_phone_number when 'held' then 'phone_in_use' when 'taken' then 'phone_in_batch' end, late) as reason
 from chk left join answer on answer.seq=chk.request_seq and why is null),
last AS (select customer_id, arg_max(name, request_seq) as n, arg_max(email, request_seq) as e, arg_max(phone_number, request_seq) as p,
 arg_max(address, request_seq) as a from fin where reason is null group by customer_id)
"""


def _profiles(spark, d):
    return C.apply_profile_updates(tables(spark, d), Q.request_frame(spark, d, "profiles"))


@register("profile_update_batch", PROFILE_SQL + "select request_seq, customer_id, name, email, phone_number, address, "
          "reason is null as accepted, reason from fin", recursive=True)
def q_profile_update_batch(spark, d):
    return _profiles(spark, d).verdicts


@register("profile_update_customers", PROFILE_SQL + """select c.customer_id, coalesce(l.n, c.name) as name, coalesce(l.e, c.email) as email,
 coalesce(l.p, c.phone_number) as phone_number, coalesce(l.a, c.address) as address
 from r_customer c left join last l on l.customer_id=c.customer_id""", recursive=True)
def q_profile_update_customers(spark, d):
    """C2's new customers."""
    return _profiles(spark, d).tables["customer"]


@register("profile_change_audit", PROFILE_SQL + """select c.customer_id, """ + AS_OF_SQL + """ as change_date, 'email' as column_name,
 c.email as old_value, l.e as new_value, cast(null as varchar) as reason from r_customer c join last l on l.customer_id=c.customer_id
 where c.email is distinct from l.e""", recursive=True)
def q_profile_change_audit(spark, d):
    """E-mail changes made by the profile batch (old and new value per customer)."""
    t = tables(spark, d)
    return C.change_audit(t["customer"], _profiles(spark, d).tables["customer"], "customer_id", "email")


# C11 ----------------------------------------------------------------------------------
FEEDBACK_SQL = _req("feedbacks") + """, fb AS (select r.*, case when seq_why is not null then seq_why
 when """ + _blank("r.order_id") + " or r.rating_score is null or r.rating_score=0 or " + _blank("r.feedback_text") + """
 then 'missing_fields' when r.rating_score<1 or r.rating_score>5 then 'rating_out_of_range'
 when length(r.feedback_text)>500 then 'text_too_long'
 when not exists (select 1 from r_orders o where o.order_id=r.order_id and o.customer_id=r.customer_id) then 'order_not_found'
 end as reason from req r)
"""


def _feedbacks(spark, d):
    return C.apply_feedback(tables(spark, d), Q.request_frame(spark, d, "feedbacks"))


@register("feedback_batch", FEEDBACK_SQL + "select request_seq, order_id, customer_id, rating_score, feedback_text, "
          "reason is null as accepted, reason from fb")
def q_feedback_batch(spark, d):
    return _feedbacks(spark, d).verdicts


@register("feedback_after_batch", FEEDBACK_SQL + """, acc AS (select * from fb where reason is null),
last AS (select order_id, arg_max(rating_score, request_seq) as sc, arg_max(feedback_text, request_seq) as tx,
 arg_min(customer_id, request_seq) as c, min(request_seq) as first from acc group by order_id),
mx AS (select coalesce(max(try_cast(substr(rating_id, 2) as bigint)), 0) as m from r_feedback),
fresh AS (select l.*, mx.m + row_number() over (order by l.first) as n from last l, mx
 where not exists (select 1 from r_feedback f where f.order_id=l.order_id))
select f.rating_id, f.order_id, f.customer_id, coalesce(l.sc, f.rating_score) as rating_score,
 case when l.order_id is not null then l.tx else f.feedback_text end as feedback_text
from r_feedback f left join last l on l.order_id=f.order_id
union all select """ + _pad("F", "n") + """, order_id, c, sc, tx from fresh""")
def q_feedback_after_batch(spark, d):
    """C11's new feedback table (updates applied, new rows keyed)."""
    return _feedbacks(spark, d).tables["feedback"]


# C12 ----------------------------------------------------------------------------------
MENU_UPD_SQL = _req("menu_updates") + """, fin AS (select r.*, case when seq_why is not null then seq_why
 when r.name is null or trim(r.name)='' then 'missing_name' when r.price is null or r.price<=0 then 'invalid_price'
 when r.category is null or r.category not in """ + _in(CATEGORIES) + """ then 'invalid_category'
 when r.availability_status is not null and r.availability_status not in """ + _in(AVAILABILITY) + """ then 'invalid_availability'
 when length(r.name) > 100 then 'name_too_long' when length(r.description) > 500 then 'description_too_long'
 when not exists (select 1 from r_menu m where m.menu_id=r.menu_id) then 'not_found' end as reason from req r)
"""


def _menu_updates(spark, d):
    return C.apply_menu_updates(tables(spark, d), Q.request_frame(spark, d, "menu_updates"))


@register("menu_update_batch", MENU_UPD_SQL + "select request_seq, menu_id, name, description, price, category, availability_status, "
          "reason is null as accepted, reason from fin")
def q_menu_update_batch(spark, d):
    return _menu_updates(spark, d).verdicts


@register("menu_update_menu", MENU_UPD_SQL + """, last AS (select * from fin f where reason is null and request_seq =
 (select max(request_seq) from fin g where g.menu_id=f.menu_id and g.reason is null))
select m.menu_id, coalesce(l.name, m.item_name) as item_name, coalesce(l.category, m.category) as category,
 cast(coalesce(l.price, m.price) as decimal(10,2)) as price, coalesce(l.description, m.description) as description,
 case when l.menu_id is null then m.availability_status else l.availability_status end as availability_status, m.image_link
from r_menu m left join last l on l.menu_id=m.menu_id""")
def q_menu_update_menu(spark, d):
    """C12's new menu."""
    return _menu_updates(spark, d).tables["menu"]


# C6 / C7 -------------------------------------------------------------------------------
CART_CHECK_SQL = f""", lines AS ({request_sql("faulty_lines")}),
names AS (select item_name, min(menu_id) as menu_id from r_menu group by item_name),
heads AS (select q.*, case when request_seq is null then 'missing_request_seq' when count(*) over (partition by request_seq) > 1
 then 'repeated_request_seq' end as seq_why from (select distinct cart, request_seq, item_id, customer_id, payment_method from lines) q),
ml AS (select l.cart, l.item_name, n.menu_id, m.price, sum(l.quantity) as quantity, bool_or(l.quantity is null or l.quantity < 1) as faulty
 from lines l left join names n on n.item_name=l.item_name left join r_menu m on m.menu_id=n.menu_id
 where l.line_no is not null group by all),
st AS (select cart, bool_or(menu_id is null) as unknown, bool_or(faulty) as faulty, count(item_name) as n,
 bool_or(quantity > 2147483647) as over, sum(price * quantity) as total from ml group by cart)
"""
PLACE_SQL = CART_CHECK_SQL + """, chk AS (select c.*, st.total, case when seq_why is not null then seq_why
 when coalesce(st.n,0)=0 then 'empty_cart' when st.unknown then 'unknown_item' when st.faulty then 'bad_quantity'
 when st.over then 'quantity_overflow' when st.total is null or st.total <= 0 then 'invalid_total'
 when not exists (select 1 from r_customer x where x.customer_id=c.customer_id) then 'customer_not_found'
 when c.payment_method is null or c.payment_method not in """ + _in(PAYMENT_METHODS) + """ then 'invalid_payment_method'
 end as reason from heads c left join st on st.cart=c.cart),
acc AS (select *, row_number() over (order by request_seq) as pos from chk where reason is null),
mx AS (select (select coalesce(max(try_cast(nullif(regexp_replace(order_id,'[^0-9]','','g'),'') as bigint)),0) from r_orders) as o0,
 (select coalesce(max(try_cast(nullif(regexp_replace(payment_id,'[^0-9]','','g'),'') as bigint)),0) from r_payment) as p0,
 (select coalesce(max(try_cast(nullif(regexp_replace(item_id,'[^0-9]','','g'),'') as bigint)),0) from r_items) as i0)
"""


def _placed(spark, d):
    return C.place_orders(tables(spark, d), Q.faulty_carts(spark, d))


@register("place_orders_batch", PLACE_SQL + """select chk.request_seq, chk.customer_id, chk.payment_method,
 chk.reason is null as accepted, chk.reason, case when acc.pos is not null then """ + _pad("O", "mx.o0 + acc.pos") + """ end
 as order_id from chk left join acc on acc.cart=chk.cart cross join mx""")
def q_place_orders_batch(spark, d):
    return _placed(spark, d).verdicts


@register("place_orders_new_orders", PLACE_SQL + "select " + _pad("O", "mx.o0 + acc.pos") + " as order_id, acc.customer_id, "
          + _pad("I", "mx.i0 + acc.pos") + " as item_id, cast(acc.total as decimal(18,2)) as total_price, 'Pending' as order_status, "
          + AS_OF_SQL + " as order_date from acc cross join mx")
def q_place_orders_new_orders(spark, d):
    return _placed(spark, d).extra["new_orders"]


@register("place_orders_items", PLACE_SQL + "select item_id, menu_id, quantity, price from r_items union all select "
          + _pad("I", "mx.i0 + acc.pos") + """, ml.menu_id, cast(ml.quantity as int), cast(ml.price * ml.quantity as decimal(18,2))
 from acc join ml on ml.cart=acc.cart cross join mx""")
def q_place_orders_items(spark, d):
    """C7's new basket lines, after the stored ones."""
    return _placed(spark, d).tables["items"]


@register("place_orders_new_payments", PLACE_SQL + "select " + _pad("P", "mx.p0 + acc.pos") + " as payment_id, "
          + _pad("O", "mx.o0 + acc.pos") + """ as order_id, cast(acc.total as decimal(18,2)) as amount,
 case when lower(payment_method)='cash' then 'Pending' else 'Completed' end as payment_status, payment_method, """ + AS_OF_SQL
          + " as transaction_date from acc cross join mx")
def q_place_orders_new_payments(spark, d):
    return _placed(spark, d).extra["new_payments"]


BASKET_SQL = CART_CHECK_SQL + """, pre AS (select c.*, case when seq_why is not null then seq_why when item_id is null then 'missing_item_id'
 when st.unknown then 'unknown_item' when coalesce(st.n,0)=0 then 'empty_basket' when st.faulty then 'bad_quantity' end as why
 from heads c left join st on st.cart=c.cart),
want AS (select p.cart, p.item_id, ml.menu_id, ml.quantity, ml.price from pre p join ml on ml.cart=p.cart where p.why is null),
toomany AS (select w.item_id, w.menu_id from want w group by w.item_id, w.menu_id having sum(w.quantity) + coalesce((select sum(i.quantity)
 from r_items i where i.item_id=w.item_id and i.menu_id=w.menu_id), 0) > 2147483647),
fin AS (select pre.*, coalesce(why, case when cart in (select w.cart from want w join toomany x on x.item_id=w.item_id
 and x.menu_id=w.menu_id) then 'quantity_overflow' end) as reason from pre)
"""


def _baskets(spark, d):
    return C.apply_basket_lines(tables(spark, d), Q.faulty_carts(spark, d))


@register("basket_lines_batch", BASKET_SQL + "select request_seq, item_id, reason is null as accepted, reason from fin")
def q_basket_lines_batch(spark, d):
    return _baskets(spark, d).verdicts


@register("basket_lines_items", BASKET_SQL + """, adds AS (select item_id, menu_id, sum(quantity) as a from want
 where cart in (select cart from fin where reason is null) group by 1, 2)
select coalesce(i.item_id, a.item_id) as item_id, coalesce(i.menu_id, a.menu_id) as menu_id,
 cast(coalesce(i.quantity,0)+coalesce(a.a,0) as int) as quantity,
 cast(case when a.a is not null then m.price*(coalesce(i.quantity,0)+a.a) else i.price end as decimal(18,2)) as price
from r_items i full outer join adds a on i.item_id=a.item_id and i.menu_id=a.menu_id
left join r_menu m on m.menu_id=coalesce(i.menu_id, a.menu_id)""")
def q_basket_lines_items(spark, d):
    return _baskets(spark, d).tables["items"]


# The sequential state machine, replayed in SQL by a recursive CTE per order ----------
def _status_sql(mode: str) -> str:
    from tavola.schema import ORDER_STATUSES, OTHER, transitions
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in transitions(mode))
    known = _in(ORDER_STATUSES)
    return _req("statuses") + f""", pre AS (select r.*, case when seq_why is not null then seq_why
 when r.status is null or r.status not in {known} then 'invalid_status'
 when o.order_id is null then 'order_not_found' end as why from req r left join r_orders o on o.order_id=r.order_id),
cand AS (select request_seq, order_id, status, row_number() over (partition by order_id order by request_seq) as rn
 from pre where why is null),
allowed(f, t) AS (VALUES {pairs}),
walk(order_id, rn, state) AS (
 select o.order_id, cast(0 as bigint), o.order_status from r_orders o where o.order_id in (select order_id from cand)
 union all
 select c.order_id, c.rn, case when a.f is not null then c.status else w.state end
 from walk w join cand c on c.order_id=w.order_id and c.rn=w.rn+1
 left join allowed a on a.f=(case when w.state in {known} then w.state else '{OTHER}' end) and a.t=c.status),
folded AS (select c.request_seq, c.order_id, c.status, exists (select 1 from allowed a
 where a.f=(case when w.state in {known} then w.state else '{OTHER}' end) and a.t=c.status) as accepted
 from cand c join walk w on w.order_id=c.order_id and w.rn=c.rn-1),
verdicts AS (select request_seq, order_id, status, false as accepted, why as reason from pre where why is not null
 union all select request_seq, order_id, status, accepted,
 case when not accepted then 'invalid_transition' end as reason from folded)
"""


def _statuses(spark, d, mode="lenient"):
    return C.apply_order_status(tables(spark, d), Q.request_frame(spark, d, "statuses"), mode=mode)


@register("order_status_batch", _status_sql("lenient") + "select * from verdicts", recursive=True)
def q_order_status_batch(spark, d):
    return _statuses(spark, d).verdicts


@register("order_status_strict_batch", _status_sql("strict") + "select * from verdicts", recursive=True)
def q_order_status_strict_batch(spark, d):
    return _statuses(spark, d, mode="strict").verdicts


@register("order_status_orders", _status_sql("lenient") + """, final AS (select order_id, arg_max(status, request_seq) as s
 from verdicts where accepted group by order_id)
""" + _refreshed("coalesce((select s from final where final.order_id=o.order_id), o.order_status)", "final"), recursive=True)
def q_order_status_orders(spark, d):
    """C8's new orders (last accepted status, totals of their baskets)."""
    return _statuses(spark, d).tables["orders"]


@register("order_status_deliveries", _status_sql("lenient") + """, last AS (select order_id, arg_max(status, request_seq) as s
 from verdicts where accepted and status in ('Completed','Cancelled') group by order_id)
select d.delivery_id, d.order_id, d.delivery_person_id, case l.s when 'Completed' then 'Delivered'
 when 'Cancelled' then 'Cancelled' else d.delivery_status end as delivery_status, d.delivery_time
from r_deliveries d left join last l on l.order_id=d.order_id""", recursive=True)
def q_order_status_deliveries(spark, d):
    """C8's new deliveries table (Completed/Cancelled orders propagate)."""
    return _statuses(spark, d).tables["deliveries"]


# C14 / C15 -------------------------------------------------------------------------------
EMP_SQL = _req("employees") + """, chk AS (select r.*,
 exists (select 1 from r_employee e where e.employee_id=r.employee_id) as known,
 exists (select 1 from r_delivery d join r_deliveries x on x.delivery_person_id=d.delivery_id
   and x.delivery_status='Out for Delivery' where d.employee_id=r.employee_id) as active,
 exists (select 1 from r_delivery d where d.employee_id=r.employee_id) as has_courier from req r),
plain AS (select chk.*, case when seq_why is not null then seq_why
 when op in ('insert','update') and (role is null or role not in """ + _in(ROLES) + """) then 'invalid_role'
 when op in ('insert','update') and (name is null or trim(name)='') then 'missing_name'
 when op in ('insert','update') and length(name) > 30 then 'name_too_long'
 when op in ('insert','update') and phone_number is null then 'missing_phone'
 when op in ('insert','update') and salary <= 0 then 'invalid_salary'
 when op='update' and not known then 'not_found'
 when op='delete' and active then 'active_deliveries'
 when op='delete' and not known then 'not_found'
 when op='delete' and has_courier then 'referenced'
 when op not in ('insert','update','delete') or op is null then 'invalid_op' end as w from chk),
static AS (select *, coalesce(w, case when op in ('update','delete') and request_seq > min(case when op='delete' and w is null
 then request_seq end) over (partition by employee_id) then 'not_found' end) as why from plain),
ask AS (select request_seq as seq, case when op='insert' then 'new '||request_seq else 'old '||employee_id end as actor, true as can,
 case when op<>'delete' then cast(phone_number as varchar) end as phone from static where why is null),
had AS (select 'old '||employee_id as actor, cast(phone_number as varchar) as phone from r_employee)
""" + _claims_sql(["phone"], "had") + """, fin AS (select static.*, coalesce(why, case when how_phone is not null then 'duplicate_phone' end)
 as reason from static left join answer on answer.seq=static.request_seq and why is null),
mx AS (select coalesce(max(try_cast(substr(employee_id, 2) as bigint)), 0) as m from r_employee),
ins AS (select fin.*, mx.m + row_number() over (order by request_seq) as n from fin, mx where op='insert' and reason is null)
"""


def _employees(spark, d):
    return C.apply_employee_changes(tables(spark, d), Q.request_frame(spark, d, "employees"))


@register("employee_batch", EMP_SQL + "select request_seq, op, employee_id, name, role, phone_number, salary, "
          "reason is null as accepted, reason from fin", recursive=True)
def q_employee_batch(spark, d):
    return _employees(spark, d).verdicts


@register("employee_after_batch", EMP_SQL + """, last AS (select employee_id, arg_max(name, request_seq) as n, arg_max(role, request_seq) as r,
 arg_max(phone_number, request_seq) as p, arg_max(salary, request_seq) as s from fin where op='update' and reason is null group by employee_id)
select e.employee_id, coalesce(l.n, e.name) as name, coalesce(l.r, e.role) as role, coalesce(l.p, e.phone_number) as phone_number,
 cast(coalesce(l.s, e.salary) as decimal(18,2)) as salary from r_employee e left join last l on l.employee_id=e.employee_id
 where e.employee_id not in (select employee_id from fin where op='delete' and reason is null)
union all select """ + _pad("E", "n") + ", name, role, phone_number, salary from ins", recursive=True)
def q_employee_after_batch(spark, d):
    """C14's new employees."""
    return _employees(spark, d).tables["employee"]


@register("new_employee_routes", EMP_SQL + """select 'delivery' as target, """ + _pad("E", "n") + " as employee_id, " + _pad("D", "n") + """ as new_id
 from ins where role='Delivery'
union all select 'chef', """ + _pad("E", "n") + ", " + _pad("E", "n") + """ from ins where role='Chef'""", recursive=True)
def q_new_employee_routes(spark, d):
    """Courier and chef rows for the employees the batch inserted."""
    routed = C.route_new_employees(_employees(spark, d).extra["new_employees"])
    return routed["delivery"].select(F.lit("delivery").alias("target"), "employee_id",
                                     F.col("delivery_id").alias("new_id")).unionByName(
        routed["chef"].select(F.lit("chef").alias("target"), "employee_id", F.col("employee_id").alias("new_id")))


# What the batches publish keeps the rules ----------------------------------------------------
def _after(batch: str, table: str, published: str, recursive: bool, result):
    """Register how many rows of a published table break each of its rules (all of them 0
    but for the lengths of the adapter's keys)."""
    rules = ([rule_name(k, c) for tb, k, c, _ in ROW_RULES if tb == table] + ["duplicate_key"]
             + [rule_name("duplicate_unique", c) for tb, c in UNIQUE_KEYS if tb == table])

    def query(spark, d):
        t = tables(spark, d)
        found = validate({**dict(t.items()), table: written(result(spark, d).tables[table], "published")}, only=(table,))
        every = spark.createDataFrame([(r,) for r in rules], "rule string")
        return every.join(found.groupBy("rule").agg(F.count(F.lit(1)).alias("n")), "rule", "left").select(
            "rule", F.coalesce("n", F.lit(0).cast("long")).alias("violations"))

    register(f"{batch}_after_violations", published + "select rule, count(v.r) as violations from (VALUES "
             + ", ".join(f"('{r}')" for r in rules) + ") x(rule) left join (select rule as r from ("
             + violations_sql(table, f"p_{table}") + ") y(t, k, rule)) v on v.r=x.rule group by rule", recursive=recursive)(query)


_after("registrations", "customer", REG_SQL + """, mx AS (select coalesce(max(try_cast(substr(customer_id, 2) as bigint)), 10)
 as m from r_customer), acc AS (select *, row_number() over (order by request_seq) as pos from fin where reason is null),
p_customer AS (select * from r_customer union all select """ + _pad("C", "mx.m + acc.pos") + """, name, email, phone_number, address from acc, mx)
""", True, _registrations)
_after("profiles", "customer", PROFILE_SQL + """, p_customer AS (select c.customer_id, coalesce(l.n, c.name) as name, coalesce(l.e, c.email)
 as email, coalesce(l.p, c.phone_number) as phone_number, coalesce(l.a, c.address) as address
 from r_customer c left join last l on l.customer_id=c.customer_id)
""", True, _profiles)
_after("menu_updates", "menu", MENU_UPD_SQL + """, p_menu AS (select m.menu_id, coalesce(l.name, m.item_name) as item_name,
 coalesce(l.category, m.category) as category, coalesce(l.price, m.price) as price, coalesce(l.description, m.description) as description,
 case when l.menu_id is null then m.availability_status else l.availability_status end as availability_status, m.image_link
 from r_menu m left join (select * from fin f where reason is null and request_seq = (select max(request_seq) from fin g
 where g.menu_id=f.menu_id and g.reason is null)) l on l.menu_id=m.menu_id)
""", False, _menu_updates)
_after("employees", "employee", EMP_SQL + """, last AS (select employee_id, arg_max(name, request_seq) as n, arg_max(role, request_seq) as r,
 arg_max(phone_number, request_seq) as p, arg_max(salary, request_seq) as s from fin where op='update' and reason is null group by employee_id),
p_employee AS (select e.employee_id, coalesce(l.n, e.name) as name, coalesce(l.r, e.role) as role, coalesce(l.p, e.phone_number)
 as phone_number, coalesce(l.s, e.salary) as salary from r_employee e left join last l on l.employee_id=e.employee_id
 where e.employee_id not in (select employee_id from fin where op='delete' and reason is null)
union all select """ + _pad("E", "n") + """, name, role, phone_number, salary from ins)
""", True, _employees)


# C17 / K2 ------------------------------------------------------------------------------
def _draw(seed: int, n: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || coalesce({key}, '')), 1, 12))::bigint % {n})"


@register("random_assignment", """, ranks AS (select delivery_id, employee_id, (select count(*) from r_delivery y
 where y.delivery_id <= x.delivery_id) as courier_no from r_delivery x),
 picked AS (select order_id, """ + _draw(1, "(select count(*) from r_delivery)", "order_id") + """ + 1 as courier_no
 from r_orders where order_status='Pending')
select order_id, courier_no, (select max(delivery_id) from ranks r where r.courier_no = p.courier_no) as delivery_id,
 (select max(employee_id) from ranks r where r.courier_no = p.courier_no) as employee_id from picked p""")
def q_random_assignment(spark, d):
    """C17: a courier drawn per Pending order."""
    t = tables(spark, d)
    return C.random_assignment(t, t["orders"].filter(F.col("order_status") == "Pending"), seed=1)


@register("order_codes", ", coded AS (select order_id, " + " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', {_draw(7 + i, '25', 'order_id')}::int + 1, 1)" for i in range(3))
    + f" || lpad({_draw(10, '1000', 'order_id')}::varchar, 3, '0') as order_code from r_orders) "
      "select order_id, order_code, count(*) over (partition by order_code) as code_uses from coded")
def q_order_codes(spark, d):
    """K2: a 3-letter, 3-digit code per order with the number of orders sharing it."""
    coded = random_order_code(tables(spark, d)["orders"].select("order_id"), "order_id", seed=7)
    dup = coded.groupBy("order_code").agg(F.count(F.lit(1)).alias("code_uses"))
    return coded.join(dup, "order_code")


@register("customer_codes", ", coded AS (select customer_id, split_part(name, '#', 1) as first_name, split_part(name, '#', 2) "
          "as last_name, substr(split_part(name, '#', 1), 1, 1) || substr(split_part(name, '#', 2), 1, 1) || "
          f"lpad({_draw(11, '1000', 'customer_id')}::varchar, 3, '0') as customer_code from r_customer) "
          "select *, count(*) over (partition by customer_code) as code_uses from coded")
def q_customer_codes(spark, d):
    """K2 (initials form): first letters of the two name parts and three drawn digits."""
    from tavola.functions.keys import initials_code
    c = tables(spark, d)["customer"].select("customer_id", F.split("name", "#").alias("_p"))
    c = c.select("customer_id", F.col("_p")[0].alias("first_name"), F.col("_p")[1].alias("last_name"))
    coded = initials_code(c, "first_name", "last_name", "customer_id", seed=11, name="customer_code")
    dup = coded.groupBy("customer_code").agg(F.count(F.lit(1)).alias("code_uses"))
    return coded.join(dup, "customer_code")
