"""The trigger-maintained columns, recomputed set at a time.

* D1 ``price_items``: line price = current menu price x quantity.
* D2 ``total_orders``: order total = sum of its basket's line prices (NULL
  when the basket is empty).
* D3 ``amount_payments``: payment amount = order total.
* D4 ``mark_paid``: orders with a payment get the legacy paid status.

Joins are plain equi joins; Spark (AQE) chooses broadcast or sort-merge from
measured sizes, so a large menu is never forced into memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.sources.tables import Tables


def price_items(items: DataFrame, menu: DataFrame) -> DataFrame:
    """D1. Lines whose menu row is missing keep a NULL price (the trigger
    would fail; V11 reports the broken reference)."""
    m = menu.select(F.col("menu_id"), F.col("price").alias("_menu_price"))
    return (
        items.join(m, "menu_id", "left")
        .select("item_id", "menu_id", "quantity",
                (F.col("_menu_price") * F.col("quantity")).cast("decimal(18,2)").alias("price"))
    )


def basket_sums(items: DataFrame) -> DataFrame:
    """Sum of line prices per basket (partial aggregation before the shuffle)."""
    return items.groupBy("item_id").agg(F.sum("price").cast("decimal(18,2)").alias("_basket_total"))


def total_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """D2. ``total_price`` replaced by the basket sum (NULL if no lines)."""
    return (
        orders.join(basket_sums(items), "item_id", "left")
        .select("order_id", "customer_id", "item_id", F.col("_basket_total").alias("total_price"),
                "order_status", "order_date")
    )


def amount_payments(payment: DataFrame, orders: DataFrame) -> DataFrame:
    """D3. ``amount`` replaced by the order's total."""
    o = orders.select("order_id", F.col("total_price").alias("_total"))
    return (
        payment.join(o, "order_id", "left")
        .select("payment_id", "order_id", F.col("_total").cast("decimal(18,2)").alias("amount"),
                "payment_status", "payment_method", "transaction_date")
    )


def mark_paid(orders: DataFrame, payment: DataFrame, paid_status: str = "Paid") -> DataFrame:
    """D4. Orders that have at least one payment take ``paid_status``."""
    paid = payment.select("order_id").distinct().withColumn("_paid", F.lit(True))
    return (
        orders.join(paid, "order_id", "left")
        .select("order_id", "customer_id", "item_id", "total_price",
                F.when(F.col("_paid"), F.lit(paid_status)).otherwise(F.col("order_status")).alias("order_status"),
                "order_date")
    )


def apply_derivations(t: Tables) -> Tables:
    """D1 -> D2 -> D3 in trigger order; other tables pass through."""
    out = dict(t)
    out["items"] = price_items(t["items"], t["menu"])
    out["orders"] = total_orders(t["orders"], out["items"])
    out["payment"] = amount_payments(t["payment"], out["orders"])
    return out
