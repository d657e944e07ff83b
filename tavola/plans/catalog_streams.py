"""Registered queries for the streaming views (T1-T3) and the sinks.

The streaming queries drain the ``events`` table as a change stream
(``availableNow``) and return the view folded from the sink folder; their SQL
is the equivalent batch computation. Sink queries write to the shared
checkpoint folder and read the result back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tavola.operators import reports as R
from tavola.plans.catalog import CART_LINES_SQL, FIRST_PAYMENT_SQL, register, tables
from tavola.schema import PRIMARY_KEYS, SCHEMAS
from tavola.session import scratch_path
from tavola.sources import requests as Q
from tavola.sources import sinks as S
from tavola.sources.tables import table_dump
from tavola.streaming import views as T


def _events_stream(spark, d):
    schema = spark.read.parquet(f"{d.rstrip('/')}/events.parquet").schema
    return T.change_stream(spark, d, schema, file_glob="events.parquet")


@register("live_order_board", """select user_id, status, last_ts, n_events from (select user_id, event_type as status,
 max(ts) over (partition by user_id) as last_ts, count(*) over (partition by user_id) as n_events,
 row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) x where rn=1""")
def q_live_order_board(spark, d):
    view = T.live_order_board(_events_stream(spark, d), key="user_id", status="event_type", ts="ts", tie="event_id")
    return T.run_to_completion(spark, view, "user_id", "live_order_board")


@register("stream_order_bill", """select user_id, cast(sum(cast(value as decimal(18,2))) as decimal(38,2)) as bill,
 count(*) as n_lines from (select * from events where event_type='purchase' qualify row_number() over
 (partition by event_id order by ts) = 1) x group by user_id""")
def q_stream_order_bill(spark, d):
    lines = _events_stream(spark, d).filter(F.col("event_type") == "purchase")
    view = T.stream_order_bill(lines, key="user_id", line="event_id", amount="value", ts="ts")
    return T.run_to_completion(spark, view, "user_id", "stream_order_bill")


@register("stream_courier_rating", """select user_id, count(cast(value as decimal(18,2))) as rating_count,
 cast(sum(cast(value as decimal(18,2))) as decimal(38,2)) as rating_sum,
 sum(cast(value as decimal(18,2)))::double / count(cast(value as decimal(18,2)))::double as mean_rating
 from events group by user_id""")
def q_stream_courier_rating(spark, d):
    view = T.stream_courier_rating(_events_stream(spark, d), key="user_id", rating="value")
    return T.run_to_completion(spark, view, "user_id", "stream_courier_rating")


# Sinks ------------------------------------------------------------------------------------
@register("json_report_roundtrip", """select o.order_id, o.customer_id, o.order_date, o.order_status, o.total_price,
 coalesce(nullif(p.payment_method,''),'Not specified') as payment_method,
 coalesce(nullif(p.payment_status,''),'Pending') as payment_status, m.item_name, i.quantity, i.price as item_price
 from r_orders o join r_items i on o.item_id=i.item_id join r_menu m on i.menu_id=m.menu_id
 left join """ + FIRST_PAYMENT_SQL + " p on o.order_id=p.order_id")
def q_json_report_roundtrip(spark, d):
    """The nested order history written as JSON and read back, flattened."""
    nested = R.customer_orders_nested(tables(spark, d))
    path = scratch_path(spark, f"reports/customer_orders-{uuid.uuid4().hex}")
    S.write_report(nested, path)
    back = spark.read.schema(nested.schema).json(path)
    return (back.select("order_id", "customer_id", "order_date", "order_status", "total_price", "payment_method",
                        "payment_status", F.explode("items").alias("it"))
            .select("order_id", "customer_id", "order_date", "order_status", "total_price", "payment_method",
                    "payment_status", F.col("it.item_name").alias("item_name"), F.col("it.quantity").alias("quantity"),
                    F.col("it.price").alias("item_price")))


@register("carts_json_roundtrip", ", " + CART_LINES_SQL + "select request_seq, customer_id, payment_method, item_name, "
          "quantity from cart_lines")
def q_carts_json_roundtrip(spark, d):
    """S3: cart payloads written as JSON lines, read with the cart schema, flattened."""
    path = scratch_path(spark, f"carts/carts-{uuid.uuid4().hex}")
    S.write_report(Q.carts(spark, d), path)
    return S.cart_lines_of(S.read_carts(spark, path)).drop("line_no")


@register("load_customers", "select customer_id, name, email, phone_number, case when customer_id like '%7' then null "
          "else address end as address from r_customer")
def q_load_customers(spark, d):
    """Customers stored with some empty addresses and loaded again (empty texts are NULL)."""
    from tavola.sources.tables import load_tables
    out = scratch_path(spark, f"loads/l-{uuid.uuid4().hex}")
    c = tables(spark, d)["customer"]
    c.withColumn("address", F.when(F.col("customer_id").endswith("7"), F.lit("")).otherwise(F.col("address"))) \
        .write.parquet(f"{out}/customer.parquet")
    return load_tables(spark, out, ["customer"])["customer"]


# All nine tables: a row each with the row count and a digest of the rows (the sum of the
# first 48 bits of each row's md5, the same in any order and any engine).
def _digests(frames):
    out = None
    for name, df in frames.items():
        row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns]))
        part = df.agg(F.count(F.lit(1)).alias("n_rows"),
                      F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias("digest"))
        part = part.select(F.lit(name).alias("table_name"), "n_rows", "digest")
        out = part if out is None else out.unionByName(part)
    return out


def _digests_sql(sources: dict[str, str] | None = None, extra: tuple[str, ...] = ()) -> str:
    parts = []
    for name, schema in SCHEMAS.items():
        row = "concat_ws('|', " + ", ".join(f"coalesce(cast({c} as varchar), '~')" for c in [*schema.names, *extra]) + ")"
        parts.append(f"select '{name}' as table_name, count(*) as n_rows, "
                     f"cast(sum(('0x' || substr(md5({row}), 1, 12))::bigint) as varchar) as digest from {(sources or {}).get(name, 'r_' + name)}")
    return "\nunion all ".join(parts)


@register("load_tables_digest", _digests_sql({"customer": "(select * replace (case when customer_id like '%7' then null else address end "
                                              "as address) from r_customer) c"}))
def q_load_tables_digest(spark, d):
    """All tables stored (some addresses as empty texts) and loaded again."""
    from tavola.sources.tables import load_tables
    out = scratch_path(spark, f"loads/all-{uuid.uuid4().hex}")
    for name, df in dict(tables(spark, d).items()).items():
        if name == "customer":
            df = df.withColumn("address", F.when(F.col("customer_id").endswith("7"), F.lit("")).otherwise(F.col("address")))
        df.write.parquet(f"{out}/{name}.parquet")
    return _digests(load_tables(spark, out))


@register("snapshot_tables_digest", _digests_sql())
def q_snapshot_tables_digest(spark, d):
    """A committed version of all tables, read back."""
    out = scratch_path(spark, f"snapshots/all-{uuid.uuid4().hex}")
    S.write_snapshot(tables(spark, d), out, 1)
    return _digests(S.read_snapshot(spark, out, 1))


@register("dump_tables_digest", _digests_sql())
def q_dump_tables_digest(spark, d):
    """Every table dumped in key order."""
    t = tables(spark, d)
    return _digests({n: table_dump(t, n) for n in SCHEMAS})


def _looked_up(name: str) -> str:
    key = ", ".join(f"coalesce(t.{k}, q.{k}) as {k}" for k in PRIMARY_KEYS[name])
    rest = ", ".join(f"t.{c}" for c in SCHEMAS[name].names if c not in PRIMARY_KEYS[name])
    on = " and ".join(f"t.{k}=q.{k}" for k in PRIMARY_KEYS[name])
    ask = ", ".join(f"{k} || case when length({k}) % 2 = 0 then '' else 'x' end as {k}" for k in PRIMARY_KEYS[name])
    return (f"(select {key}, {rest}, case when t.{PRIMARY_KEYS[name][0]} is null then 'false' else 'true' end as found "
            f"from (select distinct {ask} from r_{name}) q left join r_{name} t on {on}) x")


@register("lookup_tables_digest", _digests_sql({n: _looked_up(n) for n in SCHEMAS}, ("found",)))
def q_lookup_tables_digest(spark, d):
    """Keys of every table looked up, those of odd length spoilt so that they are not found."""
    t, out = tables(spark, d), {}
    for n in SCHEMAS:
        ask = t[n].select(*[F.concat(k, F.when(F.length(k) % 2 == 0, "").otherwise("x")).alias(k) for k in PRIMARY_KEYS[n]])
        out[n] = R.lookup(t, n, ask).select(*SCHEMAS[n].names, "found")
    return _digests(out)


@register("snapshot_roundtrip", "select order_id, customer_id, item_id, total_price, order_status, order_date from r_orders")
def q_snapshot_roundtrip(spark, d):
    """All tables written as a committed snapshot version, orders read back."""
    out = scratch_path(spark, f"snapshots/s-{uuid.uuid4().hex}")
    S.write_snapshot(tables(spark, d), out, 1)
    return S.read_snapshot(spark, out, 1, ["orders"])["orders"]
