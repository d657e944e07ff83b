"""Column expressions shared by the reports.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_or(value, fallback) -> Column:
    """the ``a || b`` fallback of the page code: 0, '' and NULL all fall back."""
    v = _c(value)
    return F.coalesce(F.nullif(v, F.lit(0)), _c(fallback))


def payment_status_for(method) -> Column:
    """Cash payments start Pending, all others are Completed."""
    return F.when(F.lower(_c(method)) == "cash", F.lit("Pending")).otherwise(F.lit("Completed"))


def status_class(status) -> Column:
    """CSS class of an order status badge, ``pending`` by default."""
    s = F.lower(_c(status))
    return (F.when(s == "completed", F.lit("completed")).when(s == "processing", F.lit("processing"))
            .when(s == "cancelled", F.lit("cancelled")).otherwise(F.lit("pending")))


def money_text(x, digits: int = 2) -> Column:
    """``toFixed(n)`` text of a number."""
    return F.format_string(f"%.{digits}f", _c(x).cast("double"))


def day_text(ts) -> Column:
    """numeric day/month/year text (en-IN style, no zero padding)."""
    return F.date_format(_c(ts), "d/M/yyyy")


def full_stars(score) -> Column:
    """number of filled stars; star i (0-based) is full when i < score."""
    return F.least(F.lit(5), F.greatest(F.lit(0), F.ceil(_c(score)))).cast("int")


def clamp_quantity(q) -> Column:
    """F16: parse a quantity, default 1, clamp to 1..99."""
    n = _c(q).cast("string").try_cast("int")
    return F.least(F.lit(99), F.greatest(F.lit(1), F.coalesce(n, F.lit(1))))


def slug(x) -> Column:
    """lower-case, trimmed, whitespace runs replaced by '-'."""
    return F.regexp_replace(F.lower(F.trim(_c(x))), r"\s+", "-")


def full_name(first, last) -> Column:
    """``first || ' ' || last``."""
    return F.concat_ws(" ", _c(first), _c(last))


def city_pin(city, pin) -> Column:
    """``city || '-' || pincode`` address text."""
    return F.concat(_c(city), F.lit("-"), _c(pin))


def case_insensitive_match(col, term: str, literal: bool = False) -> Column:
    """``REGEXP_LIKE(col, term, 'i')``; ``literal`` quotes the term."""
    import re
    pattern = re.escape(term) if literal else term
    return _c(col).rlike("(?iu)" + pattern)


def plan_size_bytes(df: DataFrame) -> int | None:
    """An upper bound of the size of ``df`` in memory, or None when there is none.

    Only local rows and ranges, filtered or projected to fewer of their columns,
    have a bound. The size of a file is none: constant columns take nothing there and
    may be any length in memory. No job is run.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        if plan.nodeName() == "Project":
            made = plan.projectList()
            for i in range(made.size()):
                e = made.apply(i)
                e = e.child() if e.nodeName() == "Alias" else e
                if e.nodeName() != "AttributeReference":
                    return None  # computed columns may be longer than what they are made of
        plan = plan.children().apply(0)
    if plan.nodeName() not in ("LocalRelation", "Range"):
        return None
    return int(str(plan.stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Broadcast ``df`` only when an upper bound of its size is under ``max_bytes``.

    Otherwise the frame is returned as is: Spark joins by shuffle, or broadcasts
    it after AQE has measured its size.
    """
    size = plan_size_bytes(df)
    return F.broadcast(df) if size is not None and size <= max_bytes else df


def db_timestamp(text, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """``TO_TIMESTAMP(text, 'YYYY-MM-DD HH24:MI:SS')`` / ``TO_DATE`` as a
    zone-less timestamp; text that does not parse gives NULL."""
    return F.try_to_timestamp(_c(text), F.lit(fmt)).cast("timestamp_ntz")
