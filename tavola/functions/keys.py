"""Text keys, key allocation and row numbers.

Row numbers over a whole sorted frame are computed without a single-partition
window: the sorted frame is checkpointed (so its partitioning is fixed), each
partition is counted, and the per-partition offsets (one row per partition, a
size bound given by the partition count) are broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.session import reliable_checkpoint

# Fixed value: letters drawn by the random order code.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key_number(col: str | Column) -> Column:
    """numeric part of a text id, ``REGEXP_REPLACE(id,'[^0-9]','')`` as a long."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit("")).try_cast("long")


def key_suffix_number(col: str | Column) -> Column:
    """``TO_NUMBER(SUBSTR(id, 2))``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.substring(c, 2, 1 << 20).try_cast("long")


def pad_key(prefix: str, n: Column, width: int = 3) -> Column:
    """``prefix || LPAD(n, width, '0')`` without LPAD's truncation of long numbers."""
    s = n.cast("string")
    return F.concat(F.lit(prefix), F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0")))


def max_key(df: DataFrame, col: str, default: int = 0, suffix: bool = False) -> DataFrame:
    """One row ``max_key`` = largest numeric part of ``col`` (``default`` when empty)."""
    num = key_suffix_number(col) if suffix else key_number(col)
    return df.agg(F.coalesce(F.max(num), F.lit(default)).cast("long").alias("max_key"))


def with_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """1-based position of each row in ``order`` (``order`` must be a total order).

    Distributed: range-sorted partitions are checkpointed to the shared
    checkpoint folder, counted, and offset by the counts of earlier partitions.
    """
    pid, mid, n, first, before = "__rn_pid", "__rn_mid", "__rn_n", "__rn_first", "__rn_before"
    sorted_df = (
        df.orderBy(*order)
        .withColumn(pid, F.spark_partition_id())
        .withColumn(mid, F.monotonically_increasing_id())
        .transform(reliable_checkpoint)
    )
    counts = sorted_df.groupBy(pid).agg(F.count(F.lit(1)).alias(n), F.min(mid).alias(first))
    # One row per partition: a bounded frame, fine for an unpartitioned window.
    offsets = counts.select(
        pid, first,
        (F.sum(n).over(Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1))).alias(before),
    )
    return (
        sorted_df.join(F.broadcast(offsets), pid)
        .withColumn(name, (F.coalesce(F.col(before), F.lit(0)) + F.col(mid) - F.col(first) + 1).cast("long"))
        .drop(pid, mid, first, before)
    )


def allocate_keys(df: DataFrame, prefix: str, start: Column | int, order: list[Column],
                  name: str, width: int = 3) -> DataFrame:
    """K1: give each row the next text key ``prefix || lpad(start + position)``.

    ``start`` is the current maximum (a scalar-subquery column or an int);
    ``order`` decides which request gets which key.
    """
    start_col = start if isinstance(start, Column) else F.lit(start)
    numbered = with_row_number(df, order, "_pos")
    return numbered.withColumn(name, pad_key(prefix, (start_col + F.col("_pos")).cast("long"), width)).drop("_pos")


def seeded_draw(seed: int, n: Column | int, *cols) -> Column:
    """a repeatable draw in ``[0, n)`` from 48 bits of an md5 of ``seed`` and
    ``cols`` (NULL counts as an empty text), the same in any engine with md5."""
    nn = n if isinstance(n, Column) else F.lit(n)
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")
                                                for c in cols])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), nn.cast("long"))


def random_order_code(df: DataFrame, key: str, seed: int = 0, name: str = "order_code") -> DataFrame:
    """K2: three letters and three digits, drawn per row from a hash of ``key``.

    The source draws each letter position from [1, 26) and truncates, so the
    last letter is never drawn; the same range (25 letters) is used here.
    """
    k = F.col(key)
    letters = [F.substring(F.lit(ALPHABET), (seeded_draw(seed + i, 25, k) + 1).cast("int"), 1) for i in range(3)]
    digits = F.lpad(seeded_draw(seed + 3, 1000, k).cast("string"), 3, "0")
    return df.withColumn(name, F.concat(*letters, digits))


def initials_code(df: DataFrame, first: str, last: str, key: str, seed: int = 0,
                  name: str = "initials_code") -> DataFrame:
    """K2 (customer/employee form): first letters of the two names and 3 digits."""
    digits = F.lpad(seeded_draw(seed, 1000, F.col(key)).cast("string"), 3, "0")
    return df.withColumn(name, F.concat(F.substring(first, 1, 1), F.substring(last, 1, 1), digits))
