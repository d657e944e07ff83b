"""Importance resampling of documents towards a target distribution.

Hashed n-gram counts of the documents and of the target texts give every bucket
a gain (an array of ``buckets`` numbers); a document's weight is the mean gain of
its features. Weights plus repeatable Gumbel noise are scores, and the documents
with the highest scores are a weighted draw without replacement. The cutoff of
the draw is found by bisection over the persisted scores, then over the ids that
tie there, by exact count jobs of a few steps each. Nothing but ``buckets`` counts and
those numbers reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.functions.keys import with_row_number
from tavola.llm.common import stored, table, text_or_empty

BUCKETS = 10_000
TEXTS = 256            # texts that are taken apart at once
LEVELS = 6             # halvings of a bisection that one count job answers
LAST = (1 << 63) - 1   # null ids order last

# Word characters after lower-casing: 0-9, a-z and every byte of a character beyond ASCII.
BREAKS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of 0-9, a-z and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().translate(BREAKS).split()


def _blank_step() -> np.ndarray:
    """What the next byte, a blank, makes of the last byte of a CRC-32 (IEEE polynomial)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t[np.arange(256) ^ 0x20]


BLANK = _blank_step()


def then_blank(crc: np.ndarray) -> np.ndarray:
    """CRC-32 of each text continued by one blank."""
    raw = ~crc
    return ~(BLANK[raw & 0xFF] ^ (raw >> np.uint32(8)))


def features(texts: list[str], max_n: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words in each text, and for each run length ``(text, bucket)`` of every run."""
    words: list[bytes] = []
    n = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        ws = words_of(t)
        n[i] = len(ws)
        words += ws
    row = np.repeat(np.arange(len(texts)), n)
    crc = np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words))
    out = [(row, crc % np.uint32(buckets))]
    for k in range(2, max_n + 1):
        runs = max(0, len(words) - k + 1)
        before = then_blank(crc[:runs]).tolist()
        crc = np.fromiter(map(crc32, words[k - 1:], before), dtype=np.uint32, count=runs)
        inside = row[:runs] == row[k - 1:]
        out.append((row[:runs][inside], crc[inside] % np.uint32(buckets)))
    return n, out


def bucket_counts(texts: DataFrame, max_n: int = 2, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """Number of features in each bucket over all rows (null texts have none).

    A task adds up its own array and sends its non-zero buckets; they merge in
    one aggregation, so the driver gets at most ``buckets`` rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                for _, b in features(batch.column(0).slice(at, TEXTS).to_pylist(), max_n, buckets)[1]:
                    total += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    counted = texts.select(text_or_empty(text_col)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))`` for each of the B buckets."""
    b = float(len(source))
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def scored(docs: DataFrame, gains: np.ndarray, max_n: int = 2, seed: int = 7, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``__row`` (all columns of ``docs``), ``id, n_words, n_features, weight, score``.

    The array of gains is the only thing sent to the tasks (8 bytes a bucket).
    """
    from pyspark.sql.types import StructType

    made = "struct<n_words:long,n_features:long,weight:long,score:long>"
    arrow = pa.struct([(f, pa.int64()) for f in ("n_words", "n_features", "weight", "score")])

    @F.arrow_udf(StructType.fromDDL("n_words long, n_features long, weight long, score long"))
    def score(text: pa.Array, h: pa.Array) -> pa.Array:
        cols = [[], [], [], []]
        for at in range(0, len(text), TEXTS):
            n, runs = features(text.slice(at, TEXTS).to_pylist(), max_n, len(gains))
            count, total = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            for row, b in runs:
                count += np.bincount(row, minlength=len(n))
                total += np.bincount(row, weights=gains[b], minlength=len(n)).astype(np.int64)  # whole numbers below 2^53
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            noise = [math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))) for x in h.slice(at, TEXTS).to_pylist()]
            for col, v in zip(cols, (n, count, weight, weight + np.array(noise, dtype=np.int64)), strict=True):
                col.append(v)
        return pa.array(list(zip(*[np.concatenate(c).tolist() for c in cols], strict=True)) if len(text) else [], type=arrow)

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).cast("long").alias("id"),
                      score(text_or_empty(text_col), h).cast(made).alias("x"))
    return out.select("__row", "id", "x.*")


def least_where(low: int, high: int, enough: Callable[[list[int]], list[bool]]) -> int:
    """The least number from ``low`` to ``high`` for which ``enough`` holds (it does
    for ``high``, and for everything above one for which it does).

    Bisection, ``LEVELS`` halvings at a time: one question covers all the numbers that the
    next halvings could ask for."""
    while low < high:
        points = list(range(low, high, -(-(high - low) // (1 << LEVELS))))
        answers = enough(points)
        first = answers.index(True) if True in answers else len(points)
        low, high = points[first - 1] + 1 if first else low, points[first] if first < len(points) else high
    return low


def counted(rows: DataFrame, conditions: list) -> list[int]:
    """How many rows meet each condition: one exact count job for all of them."""
    return list(rows.agg(*[F.count(F.when(c, 1)) for c in conditions]).first())


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``rank``: 1..k for the ``k`` rows with the highest ``score``, ties to
    the smaller ``key``; null for the others.

    ``rows`` must be stored: each step of the bisection counts over it. Only the
    drawn rows are range-sorted for their ranks; the others pass as they are.
    """
    undrawn = F.lit(None).cast("long").alias("rank")
    if k <= 0:
        return rows.select("*", undrawn)
    low, high = rows.agg(F.min("score"), F.max("score")).first()

    def from_score(points):
        return [n >= k for n in counted(rows, [F.col("score") >= high - d for d in points])]

    cutoff = high - least_where(0, high - low, from_score)
    tied = rows.filter(F.col("score") == cutoff)
    need = k - rows.filter(F.col("score") > cutoff).count()
    low_key, high_key = tied.agg(F.min("key"), F.max("key")).first()

    def to_key(points):
        return [n >= need for n in counted(tied, [F.col("key") <= d for d in points])]

    last = least_where(low_key, high_key, to_key)
    drawn = (F.col("score") > cutoff) | ((F.col("score") == cutoff) & (F.col("key") <= last))
    order = [F.desc("score"), F.asc("key"), F.asc("n_features"), F.asc("weight")]
    numbered = with_row_number(rows.filter(drawn), order, "rank")
    # Rows repeated with one id at the very cutoff may be more than are needed.
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return numbered.unionByName(rows.filter(~drawn).select("*", undrawn))


def importance_draw(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, max_n: int = 2,
                    buckets: int = BUCKETS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
                    target_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """Score every row of ``docs`` by how much its word n-grams resemble ``target``
    and draw ``percent`` percent of the rows with at least ``min_words`` words.

    Returns a row for each row of ``docs``: ``id, n_words, n_features, weight, score,
    rank`` (1 = best, null = not drawn), with ``keep_rows`` also ``__row``, a struct of all
    its columns. Ids are whole numbers.

    A null or empty text has no words and no features: weight 0, never drawn.
    A null id scores like an empty id and loses every tie. Ties go to the smaller
    id; rows repeated with one id and score are drawn one after the other. Very
    long texts are taken apart whole, ``TEXTS`` texts at a time. With an empty
    target every bucket's count there is 0; empty ``docs`` give no rows. Other columns may
    have any names.
    """
    counts = bucket_counts(docs, max_n, buckets, text_col)
    gains = gains_of(counts, bucket_counts(target, max_n, buckets, target_col))
    rows = scored(docs, gains, max_n, seed, id_col, text_col)
    rows = rows.withColumn("key", F.coalesce("id", F.lit(LAST)))
    rows = stored(rows if keep_rows else rows.drop("__row"), "draw-scores")
    full = F.col("n_words") >= min_words
    eligible = rows.filter(full)
    k = percent * eligible.count() // 100
    out = ranked(eligible, k).unionByName(rows.filter(~full).withColumn("rank", F.lit(None).cast("long")))
    return out.drop("key")


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs`` alone, with their columns as they were, ranges of
    the draw's order in successive partitions (see ``importance_draw``)."""
    rows = importance_draw(docs, target, keep_rows=True, **how)
    return rows.filter("rank IS NOT NULL").select("__row.*")


def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the texts of ``benchmark``: 25 percent of those with 20 words."""
    out = importance_draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")

