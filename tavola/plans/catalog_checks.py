"""Registered queries for derivations (D1-D4) and data-quality rules."""

from __future__ import annotations

import re

from tavola.operators import derive as D
from tavola.operators import validate as V
from tavola.plans.catalog import register, tables
from tavola.schema import PRIMARY_KEYS
from tavola.sources import requests as Q


# D: derivations -------------------------------------------------------------------
@register("price_items", """select i.item_id, i.menu_id, i.quantity, cast(m.price*i.quantity as decimal(18,2)) as price
 from r_items i left join r_menu m on i.menu_id=m.menu_id""")
def q_price_items(spark, d):
    t = tables(spark, d)
    return D.price_items(t["items"], t["menu"])


BASKET_SUMS_SQL = "(select item_id, cast(sum(price) as decimal(18,2)) as s from r_items group by item_id)"


@register("total_orders", "select o.order_id, o.customer_id, o.item_id, b.s as total_price, o.order_status, o.order_date "
          "from r_orders o left join " + BASKET_SUMS_SQL + " b on o.item_id=b.item_id")
def q_total_orders(spark, d):
    t = tables(spark, d)
    return D.total_orders(t["orders"], t["items"])


@register("amount_payments", """select p.payment_id, p.order_id, cast(o.total_price as decimal(18,2)) as amount,
 p.payment_status, p.payment_method, p.transaction_date from r_payment p left join r_orders o on p.order_id=o.order_id""")
def q_amount_payments(spark, d):
    t = tables(spark, d)
    return D.amount_payments(t["payment"], t["orders"])


@register("mark_paid", """select o.order_id, o.customer_id, o.item_id, o.total_price,
 case when exists (select 1 from r_payment p where p.order_id=o.order_id) then 'Paid' else o.order_status end as order_status,
 o.order_date from r_orders o""")
def q_mark_paid(spark, d):
    t = tables(spark, d)
    return D.mark_paid(t["orders"], t["payment"])


@register("derived_payments", """, li AS (select i.item_id, cast(m.price*i.quantity as decimal(18,2)) as price
 from r_items i left join r_menu m on i.menu_id=m.menu_id),
 tot AS (select o.order_id, b.s as total_price from r_orders o left join
 (select item_id, cast(sum(price) as decimal(18,2)) s from li group by item_id) b on o.item_id=b.item_id)
select p.payment_id, p.order_id, cast(t.total_price as decimal(18,2)) as amount, p.payment_status, p.payment_method,
 p.transaction_date from r_payment p left join tot t on p.order_id=t.order_id""")
def q_derived_payments(spark, d):
    """D1 -> D2 -> D3 chained: payment amounts recomputed from current menu prices."""
    return D.apply_derivations(tables(spark, d))["payment"]


# V: validation -----------------------------------------------------------------------
def _sql_cond(kind: str, col: str, arg) -> str:
    if kind == "regex":
        return f"{col} is not null and not regexp_matches(cast({col} as varchar), '{arg}')"
    if kind == "positive":
        return f"{col} is not null and {col} <= 0"
    if kind == "range":
        return f"{col} is not null and not ({col} between {arg[0]} and {arg[1]})"
    if kind == "allowed":
        vals = ", ".join("'" + v + "'" for v in arg)
        return f"{col} is not null and {col} not in ({vals})"
    if kind == "not_null":
        return f"{col} is null"
    if kind == "max_len":
        return f"{col} is not null and length(cast({col} as varchar)) > {arg}"
    raise ValueError(kind)


def _sql_key(table: str, alias: str = "") -> str:
    a = alias + "." if alias else ""
    return "concat_ws('/', " + ", ".join(f"cast({a}{k} as varchar)" for k in PRIMARY_KEYS[table]) + ")"


def _violation_parts() -> list[str]:
    parts = [f"select '{tb}' as table_name, {_sql_key(tb)} as row_key, '{V.rule_name(k, c)}' as rule from r_{tb} "
             f"where {_sql_cond(k, c, a)}" for tb, k, c, a in V.ROW_RULES]
    for tb, pk in PRIMARY_KEYS.items():
        parts.append(f"select '{tb}', {_sql_key(tb)}, 'duplicate_key' from r_{tb} group by {', '.join(pk)} "
                     "having count(*) > 1")
    for tb, c in V.UNIQUE_KEYS:
        parts.append(f"select '{tb}', cast({c} as varchar), 'duplicate_unique:{c}' from r_{tb} where {c} is not null "
                     f"group by {c} having count(*) > 1")
    for child, col, parent, pcol in V.FOREIGN_KEYS:
        parts.append(f"select '{child}', {_sql_key(child, 'c')}, 'fk:{col}' from r_{child} c where c.{col} is not null "
                     f"and not exists (select 1 from r_{parent} p where p.{pcol}=c.{col})")
    parts += [
        "select 'items', item_id, 'orphan_basket' from (select distinct item_id from r_items) i "
        "where not exists (select 1 from r_orders o where o.item_id=i.item_id)",
        "select 'orders', concat_ws('/', order_id), 'order_without_basket' from r_orders o "
        "where not exists (select 1 from r_items i where i.item_id=o.item_id)",
        # A row is compared with every owner of its key, and reported once.
        "select 'items', concat_ws('/', i.item_id, i.menu_id), 'line_price_changed' from r_items i where exists (select 1 from "
        "r_menu m where i.menu_id=m.menu_id and i.price is distinct from cast(m.price*i.quantity as decimal(18,2)))",
        "select 'orders', concat_ws('/', o.order_id), 'total_mismatch' from r_orders o left join (select item_id, "
        "cast(sum(price) as decimal(18,2)) s from r_items group by item_id) b on o.item_id=b.item_id "
        "where o.total_price is distinct from b.s",
        "select 'payment', concat_ws('/', p.payment_id), 'amount_mismatch' from r_payment p where exists (select 1 from r_orders o "
        "where p.order_id=o.order_id and p.amount is distinct from cast(o.total_price as decimal(18,2))) or (p.amount is not null "
        "and not exists (select 1 from r_orders o where p.order_id=o.order_id))",
        "select 'orders', order_id, 'double_assignment' from r_deliveries where delivery_status='Out for Delivery' "
        "and order_id is not null group by order_id having count(*) > 1",
        "select 'orders', concat_ws('/', o.order_id, i.menu_id), 'item_unavailable' from r_orders o join r_items i "
        "on o.item_id=i.item_id join r_menu m on i.menu_id=m.menu_id where o.order_status='Pending' "
        "and m.availability_status <> 'Available'",
        "select 'orders', concat_ws('/', o.customer_id, i.menu_id), 'duplicate_pending' from r_orders o join r_items i "
        "on o.item_id=i.item_id where o.order_status='Pending' group by o.customer_id, i.menu_id having count(*) > 1",
        "select 'deliveries', concat_ws('/', d.delivery_id), 'state_mismatch' from r_deliveries d where exists (select 1 from r_orders o "
        "where d.order_id=o.order_id and ((o.order_status='Completed' and d.delivery_status<>'Delivered') or "
        "(d.delivery_status='Delivered' and o.order_status<>'Completed') or (o.order_status='Cancelled' and "
        "d.delivery_status<>'Cancelled') or (d.delivery_status='Cancelled' and o.order_status<>'Cancelled')))",
    ]
    return parts


def violations_sql(table: str | None = None, name: str | None = None) -> str:
    """All rules, or those of one table under another name."""
    parts = [p for p in _violation_parts() if table is None or p.startswith(f"select '{table}'")]
    text = "\nunion all\n".join(parts)
    return text if name is None else re.sub(rf"\br_{table}\b", name, text)


VIOLATIONS_SQL = violations_sql()


@register("violations", VIOLATIONS_SQL)
def q_violations(spark, d):
    return V.validate(tables(spark, d))


@register("violation_counts", "select table_name, rule, count(*) as violations from (" + VIOLATIONS_SQL
          + ") v group by table_name, rule")
def q_violation_counts(spark, d):
    return V.violation_counts(tables(spark, d))


def _faulty_sql() -> str:
    """The same rules over tables with faults of every kind (``requests.FAULTS``)."""
    from tavola.schema import SCHEMAS
    ctes = "".join(f", f_{t} AS ({Q.faulty_sql(t, 'r_' + t, SCHEMAS[t].names)})\n" for t in PRIMARY_KEYS)
    rules = VIOLATIONS_SQL
    for t in PRIMARY_KEYS:
        rules = re.sub(rf"\br_{t}\b", f"f_{t}", rules)
    return ctes + rules


@register("violations_of_faulty_tables", _faulty_sql())
def q_violations_of_faulty_tables(spark, d):
    """V1-V12 and V14 where every rule is broken by some rows, keys with two owners included."""
    return V.validate(Q.faulty_tables(tables(spark, d)))


@register("cart_line_checks", f", lines AS ({Q.request_sql('text_lines')})" + """, chk AS (select request_seq, line_no, unnest([
 case when item_name is null or trim(item_name)='' then 'missing_name' end,
 case when try_cast(price as double) is null then 'bad_price' end,
 case when try_cast(quantity as int) is null then 'bad_quantity' end]) as rule from lines)
select request_seq, line_no, rule from chk where rule is not null""")
def q_cart_line_checks(spark, d):
    return V.validate_cart_lines(Q.request_frame(spark, d, "text_lines"))
