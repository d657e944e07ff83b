"""Table schemas, allowed values and the order state machine.

Types follow the relational schema of the ordering system: text ids, exact
decimals for money (never double), timestamps for DATE/TIMESTAMP columns.
Passwords are never read.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
TS = T.TimestampNTZType()  # DATE/TIMESTAMP of the source carry no zone
MONEY = T.DecimalType(18, 2)
MENU_PRICE = T.DecimalType(10, 2)
RATING = T.DecimalType(2, 1)
PHONE_NUM = T.DecimalType(10, 0)


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "employee": _st(("employee_id", S), ("name", S), ("role", S), ("phone_number", PHONE_NUM), ("salary", MONEY)),
    "customer": _st(("customer_id", S), ("name", S), ("email", S), ("phone_number", S), ("address", S)),
    "menu": _st(("menu_id", S), ("item_name", S), ("category", S), ("price", MENU_PRICE), ("description", S),
                ("availability_status", S), ("image_link", S)),
    "items": _st(("item_id", S), ("menu_id", S), ("quantity", T.IntegerType()), ("price", MONEY)),
    "orders": _st(("order_id", S), ("customer_id", S), ("item_id", S), ("total_price", MONEY), ("order_status", S),
                  ("order_date", TS)),
    "delivery": _st(("delivery_id", S), ("employee_id", S), ("rating", RATING)),
    "deliveries": _st(("delivery_id", S), ("order_id", S), ("delivery_person_id", S), ("delivery_status", S),
                      ("delivery_time", TS)),
    "payment": _st(("payment_id", S), ("order_id", S), ("amount", MONEY), ("payment_status", S),
                   ("payment_method", S), ("transaction_date", TS)),
    "feedback": _st(("rating_id", S), ("order_id", S), ("customer_id", S), ("rating_score", RATING),
                    ("feedback_text", S)),
}

TABLES = tuple(SCHEMAS)

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "employee": ("employee_id",),
    "customer": ("customer_id",),
    "menu": ("menu_id",),
    "items": ("item_id", "menu_id"),
    "orders": ("order_id",),
    "delivery": ("delivery_id",),
    "deliveries": ("delivery_id",),
    "payment": ("payment_id",),
    "feedback": ("rating_id",),
}

# The allowed values of the schema's CHECK constraints.
CATEGORIES = ("Veg Starter", "Non-Veg Starter", "Veg Main Course", "Non-Veg Main Course", "Desserts", "Drinks",
              "International")
ROLES = ("Delivery", "Chef", "Manager")
AVAILABILITY = ("Available", "Not Available")
ORDER_STATUSES = ("Pending", "Processing", "Completed", "Cancelled")
DELIVERY_STATUSES = ("Out for Delivery", "Delivered", "Cancelled")
PAYMENT_STATUSES = ("Completed", "Pending", "Failed")
PAYMENT_METHODS = ("Credit Card", "Debit Card", "UPI", "Cash")

# Validation patterns of the customer triggers.
PHONE_PATTERN = r"^[0-9]{10}$"
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"

# Text-length limits of the schema (column: max characters).
TEXT_LIMITS: dict[str, dict[str, int]] = {
    "employee": {"employee_id": 5, "name": 30, "role": 10},
    "customer": {"customer_id": 5, "name": 50, "email": 100, "phone_number": 10, "address": 200},
    "menu": {"menu_id": 5, "item_name": 100, "category": 50, "description": 500, "availability_status": 20,
             "image_link": 200},
    "items": {"item_id": 5, "menu_id": 5},
    "orders": {"order_id": 6, "customer_id": 5, "item_id": 5, "order_status": 20},
    "delivery": {"delivery_id": 5, "employee_id": 5},
    "deliveries": {"delivery_id": 5, "order_id": 5, "delivery_person_id": 5, "delivery_status": 20},
    "payment": {"payment_id": 5, "order_id": 5, "payment_status": 20, "payment_method": 20},
    "feedback": {"rating_id": 5, "order_id": 5, "customer_id": 5, "feedback_text": 500},
}

# NOT NULL columns of the schema.
NOT_NULL: dict[str, tuple[str, ...]] = {
    "employee": ("name", "phone_number"),
    "customer": ("name", "email", "phone_number", "address"),
    "menu": ("item_name", "category", "price"),
    "items": ("quantity", "price"),
    "delivery": ("employee_id",),
    "payment": ("order_id", "amount", "transaction_date"),
    "feedback": ("order_id", "customer_id"),
}

# Order state machine. Fixed values: (from, to) pairs allowed by the admin
# server (lenient) and by the admin order page (strict, terminal states).
# Server rule: Processing only from Pending; Completed only from Processing;
# Cancelled from anything but Completed; Pending from anything. OTHER stands
# for a stored status outside the four known ones.
OTHER = "__other__"
LENIENT_TRANSITIONS = (
    (OTHER, "Pending"), (OTHER, "Cancelled"),
    ("Pending", "Pending"), ("Processing", "Pending"), ("Completed", "Pending"), ("Cancelled", "Pending"),
    ("Pending", "Processing"),
    ("Processing", "Completed"),
    ("Pending", "Cancelled"), ("Processing", "Cancelled"), ("Cancelled", "Cancelled"),
)
# Page rule: Pending -> Processing/Cancelled, Processing -> Completed/Cancelled,
# Completed and Cancelled are terminal; an unknown status may go anywhere the
# server allows.
STRICT_TRANSITIONS = (
    (OTHER, "Pending"), (OTHER, "Cancelled"),
    ("Pending", "Processing"), ("Pending", "Cancelled"),
    ("Processing", "Completed"), ("Processing", "Cancelled"),
)


def transitions(mode: str = "lenient") -> tuple[tuple[str, str], ...]:
    if mode == "lenient":
        return LENIENT_TRANSITIONS
    if mode == "strict":
        return STRICT_TRANSITIONS
    raise ValueError(f"unknown transition mode {mode!r}")
