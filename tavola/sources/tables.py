"""Base-table scans, the seed fixture and the star-schema adapter.

``star_tables`` turns the driver's TPC-H-style parquet tables into the nine
restaurant tables (rules fixed in FIXTURES.md, part B). It only renames and
reshapes columns; it performs none of the report logic. ``ADAPTER_SQL`` is the
same mapping as a ``WITH`` prefix for SQL engines.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tavola.functions.exprs import city_pin, db_timestamp
from tavola.schema import SCHEMAS, PRIMARY_KEYS

Tables = dict[str, DataFrame]


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project ``df`` onto the declared schema of table ``name`` (order, types).

    Oracle stores '' as NULL, so empty strings are normalised to NULL.
    """
    cols = []
    for f in SCHEMAS[name].fields:
        c = F.col(f.name)
        if f.dataType.typeName() == "string":
            c = F.nullif(c, F.lit(""))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def load_tables(spark: SparkSession, directory: str, names=None) -> Tables:
    """Read restaurant tables stored as ``<dir>/<name>.parquet`` (or folders).

    The schema is given, never inferred; Parquet prunes columns and takes
    pushed filters. Empty texts become NULL, as the source's database stores them.
    """
    out = {}
    for n in names or SCHEMAS:
        out[n] = conform(spark.read.schema(SCHEMAS[n]).parquet(f"{directory.rstrip('/')}/{n}.parquet"), n)
    return out


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class LazyTables(dict):
    """A table dict whose frames are built on first access (each query only
    pays plan construction for the tables it reads)."""

    def __init__(self, builders: dict):
        super().__init__()
        self._builders = builders

    def __missing__(self, name):
        if name not in self._builders:
            raise KeyError(name)
        df = self._builders[name]()
        self[name] = df
        return df

    def __iter__(self):
        return iter(self._builders)

    def __len__(self):
        return len(self._builders)

    def __contains__(self, name):
        return name in self._builders

    def keys(self):
        return self._builders.keys()

    def items(self):
        return [(k, self[k]) for k in self._builders]

    def values(self):
        return [self[k] for k in self._builders]

    def copy(self):
        return {k: self[k] for k in self._builders}


def star_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Restaurant tables mapped from the TPC-H-style tables in ``sf_dir``.

    All mapping rules (id prefixes, category by part type, status by order
    status, the modulo rules that pick deliveries, payments and feedback)
    are the fixture rules of FIXTURES.md B, unchanged. Frames are built
    lazily, per table.
    """
    raw = {}

    def r(name):
        if name not in raw:
            raw[name] = _raw(spark, sf_dir, name)
        return raw[name]

    def customer():
        c, nation = r("customer"), r("nation")
        # nation has 25 rows by definition of the benchmark schema: a proven bound.
        return (
            c.join(F.broadcast(nation.select("n_nationkey", "n_name")), c.c_nationkey == F.col("n_nationkey"))
            .select(
                F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("customer_id"),
                F.col("c_name").alias("name"),
                F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"))
                .alias("email"),
                (F.lit(7000000000) + F.col("c_custkey")).cast("string").alias("phone_number"),
                city_pin("n_name", "c_mktsegment").alias("address"),
            )
        )

    sk = F.col("s_suppkey")

    def employee():
        return r("supplier").select(
            F.concat(F.lit("E"), sk.cast("string")).alias("employee_id"),
            F.col("s_name").alias("name"),
            F.when(sk % 3 == 0, "Delivery").when(sk % 3 == 1, "Chef").otherwise("Manager").alias("role"),
            (F.lit(6000000000) + sk).cast("decimal(10,0)").alias("phone_number"),
            F.greatest(F.col("s_acctbal"), F.lit(1.0)).cast("decimal(18,2)").alias("salary"),
        )

    def menu():
        pk, pt = F.col("p_partkey"), F.col("p_type")
        return r("part").select(
            F.concat(F.lit("M"), pk.cast("string")).alias("menu_id"),
            F.col("p_name").alias("item_name"),
            F.when(pt == "ECONOMY", "Veg Starter").when(pt == "SMALL", "Non-Veg Starter")
            .when(pt == "MEDIUM", "Veg Main Course").when(pt == "PROMO", "Non-Veg Main Course")
            .when(pt == "STANDARD", "Desserts").otherwise("Drinks").alias("category"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
            F.concat(F.col("p_brand"), F.lit(" "), pt).alias("description"),
            F.when(pk % 10 == 9, "Not Available").otherwise("Available").alias("availability_status"),
            F.concat(F.lit("images/m"), pk.cast("string"), F.lit(".png")).alias("image_link"),
        )

    def items():
        # One basket line per (order, part): the key of the items table.
        return (
            r("lineitem").groupBy("l_orderkey", "l_partkey")
            .agg(F.sum(F.col("l_quantity").cast("int")).cast("int").alias("quantity"),
                 F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("price"))
            .select(F.concat(F.lit("I"), F.col("l_orderkey").cast("string")).alias("item_id"),
                    F.concat(F.lit("M"), F.col("l_partkey").cast("string")).alias("menu_id"),
                    "quantity", "price")
        )

    ok = F.col("o_orderkey")
    st = F.col("order_status")

    def o():
        if "_o" not in raw:
            raw["_o"] = r("orders").select(
                ok,
                F.concat(F.lit("O"), ok.cast("string")).alias("order_id"),
                F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("customer_id"),
                F.concat(F.lit("I"), ok.cast("string")).alias("item_id"),
                F.col("o_totalprice").cast("decimal(18,2)").alias("total_price"),
                F.when(ok % 20 == 0, "Cancelled").when(F.col("o_orderstatus") == "P", "Pending")
                .when(F.col("o_orderstatus") == "O", "Processing").otherwise("Completed").alias("order_status"),
                F.col("o_orderdate").alias("order_date"),
                F.col("o_orderpriority"),
            )
        return raw["_o"]

    def orders():
        return o().select("order_id", "customer_id", "item_id", "total_price", "order_status", "order_date")

    def couriers():
        return r("supplier").filter(sk % 3 == 0)

    def delivery():
        return couriers().select(
            F.concat(F.lit("D"), sk.cast("string")).alias("delivery_id"),
            F.concat(F.lit("E"), sk.cast("string")).alias("employee_id"),
            (F.lit(1) + (sk % 41) * F.lit(Decimal("0.1"))).cast("decimal(2,1)").alias("rating"),
        )

    def deliveries():
        # Courier count as a scalar subquery (evaluated once, no join).
        n_couriers = couriers().select(F.count(F.lit(1))).scalar()
        return (
            o().filter((st == "Completed") | ((st == "Cancelled") & (ok % 40 == 0))
                       | ((st == "Processing") & (ok % 499).isin(2, 5)))
            .select(
                F.concat(F.lit("D"), ok.cast("string")).alias("delivery_id"),
                "order_id",
                F.concat(F.lit("D"), (F.lit(3) * (ok % n_couriers)).cast("string")).alias("delivery_person_id"),
                F.when(st == "Completed", "Delivered").when(st == "Cancelled", "Cancelled")
                .otherwise("Out for Delivery").alias("delivery_status"),
                F.when(st == "Completed", F.col("order_date") + F.expr("INTERVAL 2 HOURS")).alias("delivery_time"),
            )
        )

    def payment():
        pr = F.col("o_orderpriority")
        return o().filter(ok % 10 != 0).select(
            F.concat(F.lit("P"), ok.cast("string")).alias("payment_id"),
            "order_id",
            F.col("total_price").cast("decimal(18,2)").alias("amount"),
            F.when(pr.isin("4-NOT SPECIFIED", "5-LOW"), "Pending").otherwise("Completed").alias("payment_status"),
            F.when(pr == "1-URGENT", "Credit Card").when(pr == "2-HIGH", "Debit Card").when(pr == "3-MEDIUM", "UPI")
            .otherwise("Cash").alias("payment_method"),
            F.col("order_date").alias("transaction_date"),
        )

    def feedback():
        return o().filter((st == "Completed") & (ok % 3 == 0)).select(
            F.concat(F.lit("F"), ok.cast("string")).alias("rating_id"),
            "order_id",
            "customer_id",
            (F.lit(1) + (ok % 41) * F.lit(Decimal("0.1"))).cast("decimal(2,1)").alias("rating_score"),
            F.when(ok % 6 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("score for "), F.col("order_id"))).alias("feedback_text"),
        )

    return LazyTables({"customer": customer, "employee": employee, "menu": menu, "items": items, "orders": orders,
                       "delivery": delivery, "deliveries": deliveries, "payment": payment, "feedback": feedback})


# The adapter as SQL CTEs (FIXTURES.md B), for engines that see the raw tables.
# ``r_items.price`` is cast back to decimal(18,2) as in the Spark form and
# ``r_menu`` carries the same image link.
ADAPTER_SQL = """WITH
r_customer AS (select 'C'||c_custkey as customer_id, c_name as name, lower(replace(c_name,'#','.'))||'@example.com' as email, cast(7000000000+c_custkey as varchar) as phone_number, n_name||'-'||c_mktsegment as address from customer join nation on c_nationkey=n_nationkey),
r_employee AS (select 'E'||s_suppkey as employee_id, s_name as name, case s_suppkey%3 when 0 then 'Delivery' when 1 then 'Chef' else 'Manager' end as role, cast(6000000000+s_suppkey as decimal(10,0)) as phone_number, cast(greatest(s_acctbal,1.0) as decimal(18,2)) as salary from supplier),
r_menu AS (select 'M'||p_partkey as menu_id, p_name as item_name, case p_type when 'ECONOMY' then 'Veg Starter' when 'SMALL' then 'Non-Veg Starter' when 'MEDIUM' then 'Veg Main Course' when 'PROMO' then 'Non-Veg Main Course' when 'STANDARD' then 'Desserts' else 'Drinks' end as category, cast(p_retailprice as decimal(10,2)) as price, p_brand||' '||p_type as description, case when p_partkey%10=9 then 'Not Available' else 'Available' end as availability_status, 'images/m'||p_partkey||'.png' as image_link from part),
r_items AS (select 'I'||l_orderkey as item_id, 'M'||l_partkey as menu_id, cast(sum(cast(l_quantity as int)) as int) as quantity, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) as price from lineitem group by l_orderkey,l_partkey),
r_orders AS (select 'O'||o_orderkey as order_id, 'C'||o_custkey as customer_id, 'I'||o_orderkey as item_id, cast(o_totalprice as decimal(18,2)) as total_price, case when o_orderkey%20=0 then 'Cancelled' when o_orderstatus='P' then 'Pending' when o_orderstatus='O' then 'Processing' else 'Completed' end as order_status, o_orderdate as order_date, o_orderkey from orders),
r_delivery AS (select 'D'||s_suppkey as delivery_id, 'E'||s_suppkey as employee_id, cast(1+(s_suppkey%41)*0.1 as decimal(2,1)) as rating from supplier where s_suppkey%3=0),
r_deliveries AS (select 'D'||o_orderkey as delivery_id, order_id, 'D'||(3*(o_orderkey%(select count(*) from supplier where s_suppkey%3=0))) as delivery_person_id, case order_status when 'Completed' then 'Delivered' when 'Cancelled' then 'Cancelled' else 'Out for Delivery' end as delivery_status, case when order_status='Completed' then order_date + interval '2' hour else null end as delivery_time from r_orders where order_status='Completed' or (order_status='Cancelled' and o_orderkey%40=0) or (order_status='Processing' and o_orderkey%499 in (2,5))),
r_payment AS (select 'P'||o_orderkey as payment_id, order_id, cast(total_price as decimal(18,2)) amount, case when o_orderpriority in ('4-NOT SPECIFIED','5-LOW') then 'Pending' else 'Completed' end as payment_status, case o_orderpriority when '1-URGENT' then 'Credit Card' when '2-HIGH' then 'Debit Card' when '3-MEDIUM' then 'UPI' else 'Cash' end as payment_method, order_date as transaction_date from r_orders join (select o_orderkey k,o_orderpriority from orders) x on k=o_orderkey where o_orderkey%10<>0),
r_feedback AS (select 'F'||o_orderkey as rating_id, order_id, customer_id, cast(1+(o_orderkey%41)*0.1 as decimal(2,1)) as rating_score, case when o_orderkey%6=0 then null else 'score for '||order_id end as feedback_text from r_orders where order_status='Completed' and o_orderkey%3=0)
"""


def table_dump(t: Tables, name: str) -> DataFrame:
    """``select *`` of a table in primary-key order."""
    return t[name].orderBy(*[F.col(k).asc_nulls_last() for k in PRIMARY_KEYS[name]])


# ---------------------------------------------------------------------------
# The shipped seed rows (login rows left out; passwords never read).
# Seed inserts of the ordering system, in insert order.
SEED_EMPLOYEE = [
    ("E001", "Amit Sharma", "Manager", 6009876543, 60000),
    ("E002", "Rohan Verma", "Chef", 6009876544, 35000),
    ("E003", "Sita Nair", "Chef", 6009876545, 34000),
    ("E004", "Mohan Gupta", "Delivery", 6009876546, 20000),
    ("E005", "Vikram Das", "Delivery", 6009876547, 21000),
    ("E006", "Pooja Reddy", "Manager", 6009876548, 60000),
    ("E007", "Meera Kapoor", "Chef", 6009876549, 35000),
    ("E008", "Anjali Patil", "Chef", 6009876550, 34000),
    ("E009", "Sonia Singh", "Delivery", 6009876551, 20000),
    ("E010", "Naina Joshi", "Delivery", 6009876552, 21000),
]
SEED_CUSTOMER = [
    ("C001", "Priya Iyer", "priya.iyer@gmail.com", "7009876543", "MIT Gate 2"),
    ("C002", "Arjun Mehta", "arjun.mehta@gmail.com", "7009876544", "Tiger Circle"),
    ("C003", "Neha Raj", "neha.raj@gmail.com", "7009876545", "Padubidri"),
    ("C004", "Karthik Rao", "karthik.rao@gmail.com", "7009876546", "Malpe"),
    ("C005", "Sonali Desai", "sonali.desai@gmail.com", "7009876547", "Syndicate Circle"),
    ("C006", "Ritika Jain", "ritika.jain@gmail.com", "7009876548", "MIT Gate 2"),
    ("C007", "Ravi Kumar", "ravi.kumar@gmail.com", "7009876549", "KMC Greens"),
    ("C008", "Tanvi Bhat", "tanvi.bhat@gmail.com", "7009876550", "Syndicate Circle"),
    ("C009", "Rajesh Malhotra", "rajesh.malhotra@gmail.com", "7009876551", "Parkala"),
    ("C010", "Simran Gill", "simran.gill@gmail.com", "7009876552", "Udupi"),
]
SEED_MENU = [
    ("M001", "Veggie Delight Pizza", "Veg Main Course", 199, "Loaded veggie pizza", "Available", "images/pizza-1.png"),
    ("M002", "Alfredo Pasta", "Veg Main Course", 250, "Creamy white sauce pasta", "Available", "images/alfredo pasta.webp"),
    ("M003", "Cheese Hamburger", "Veg Main Course", 150, "Juicy burger with cheese", "Available", "images/burger-1.png"),
    ("M004", "Tiramisu", "Desserts", 200, "Italian coffee-flavored dessert", "Available", "images/tiramisu.jpeg"),
    ("M005", "Classic Cold Coffee", "Drinks", 99, "Chilled coffee with cream", "Available", "images/cold coffee.jpg"),
    ("M006", "Fresh Lime Soda", "Drinks", 40, "Refreshing lemon soda", "Available", "images/fresh lime soda.jpeg"),
    ("M007", "Spicy Chicken Wings", "Non-Veg Starter", 100, "Crispy spicy wings", "Available", "images/chicken wings.webp"),
    ("M008", "Paneer Tikka", "Veg Starter", 90, "Grilled spiced paneer", "Available", "images/paneer tikka final 2.jpg"),
    ("M009", "Gulab Jamun", "Desserts", 79, "Sweet-sugary fried balls", "Available", "images/gulab jamun.avif"),
]
SEED_ITEMS = [  # (item_id, menu_id, quantity); price is derived
    ("I001", "M001", 2), ("I002", "M004", 1), ("I003", "M005", 3), ("I004", "M002", 1),
    ("I005", "M006", 2), ("I006", "M007", 1), ("I007", "M008", 1),
]
SEED_ORDERS = [  # (order_id, customer_id, item_id, status, date); total is derived
    ("O001", "C001", "I001", "Completed", "2024-03-25"),
    ("O002", "C002", "I002", "Processing", "2024-03-26"),
    ("O003", "C003", "I003", "Completed", "2024-03-27"),
    ("O004", "C004", "I004", "Processing", "2024-03-28"),
    ("O005", "C005", "I005", "Cancelled", "2024-03-29"),
    ("O006", "C006", "I006", "Completed", "2024-03-30"),
    ("O007", "C007", "I007", "Processing", "2024-03-31"),
]
SEED_DELIVERY = [("D001", "E004", "4.5"), ("D002", "E005", "4.8"), ("D003", "E009", "4.6"), ("D004", "E010", "4.7")]
SEED_DELIVERIES = [
    ("D001", "O001", "D001", "Delivered", "2024-03-25 14:30:00"),
    ("D002", "O003", "D002", "Delivered", "2024-03-27 16:00:00"),
    ("D003", "O006", "D003", "Delivered", "2024-03-30 18:00:00"),
    ("D004", "O007", "D004", "Out for Delivery", None),
]
SEED_PAYMENT = [  # (payment_id, order_id, status, method, time); amount is derived
    ("P001", "O001", "Completed", "Credit Card", "2024-03-25 14:30:00"),
    ("P002", "O002", "Pending", "UPI", "2024-03-26 10:15:00"),
    ("P003", "O003", "Completed", "Debit Card", "2024-03-27 16:45:00"),
    ("P004", "O004", "Pending", "Cash", "2024-03-28 12:20:00"),
    ("P005", "O005", "Failed", "Credit Card", "2024-03-29 09:10:00"),
    ("P006", "O006", "Completed", "UPI", "2024-03-30 18:00:00"),
    ("P007", "O007", "Pending", "Debit Card", "2024-03-31 15:50:00"),
]
SEED_FEEDBACK = [
    ("F001", "O001", "C001", "4.8", "Delicious and fresh"),
    ("F002", "O003", "C003", "4.5", "So tasty"),
    ("F003", "O006", "C006", "4.7", "Crispy and Yummy"),
]


def raw_seed_rows() -> dict[str, list[tuple]]:
    """Seed rows in table column order, derived columns left NULL, dates and times as texts."""
    return {
        "employee": [(e, n, r, Decimal(p), Decimal(s)) for e, n, r, p, s in SEED_EMPLOYEE],
        "customer": list(SEED_CUSTOMER),
        "menu": [(m, n, c, Decimal(p), d, a, i) for m, n, c, p, d, a, i in SEED_MENU],
        "items": [(i, m, q, None) for i, m, q in SEED_ITEMS],
        "orders": [(o, c, i, None, s, d) for o, c, i, s, d in SEED_ORDERS],
        "delivery": [(d, e, Decimal(r)) for d, e, r in SEED_DELIVERY],
        "deliveries": [(d, o, p, s, t) for d, o, p, s, t in SEED_DELIVERIES],
        "payment": [(p, o, None, s, m, t) for p, o, s, m, t in SEED_PAYMENT],
        "feedback": [(r, o, c, Decimal(s), txt) for r, o, c, s, txt in SEED_FEEDBACK],
    }


def tables_from_rows(spark: SparkSession, rows: dict[str, list[tuple]]) -> Tables:
    """Tables of rows in column order. Dates and times may be texts, as in the source's inserts
    (``TO_DATE``, ``TO_TIMESTAMP``: F12)."""
    out = {}
    for name, schema in SCHEMAS.items():
        texts = [i for i, f in enumerate(schema) if f.dataType.typeName() == "timestamp_ntz"
                 and any(isinstance(r[i], str) for r in rows.get(name, []))]
        given = StructType([StructField(f.name, StringType() if i in texts else f.dataType) for i, f in enumerate(schema)])
        df = spark.createDataFrame(rows.get(name, []), given)
        for i in texts:
            c = schema[i].name
            df = df.withColumn(c, F.coalesce(db_timestamp(c), db_timestamp(c, "yyyy-MM-dd")))
        out[name] = df
    return out


def seed_tables(spark: SparkSession, derive: bool = True) -> Tables:
    """The seed rows as DataFrames; with ``derive`` the trigger rules
    (line price, order total, payment amount) fill the derived columns."""
    t = tables_from_rows(spark, raw_seed_rows())
    if derive:
        from tavola.operators.derive import apply_derivations
        t = apply_derivations(t)
    return t
