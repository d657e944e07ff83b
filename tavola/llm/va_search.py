"""Exact top-k search by inner product with a vector-approximation file.

Candidates are stored in blocks. A block holds, next to its exact vectors, a
short approximation of each: every component is replaced by the number of its
cell, cells being fitted to the block. A query first scans the cells, which
bound every score from both sides, and then reads exact vectors in the order of
their bounds until the k-th result is certain.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tavola.llm.common import map_rows, stored, table

ROWS, QUERIES, BITS = 4096, 512, 6
LONG = (1 << 63) - 1


def finite(vec: Column) -> Column:
    """Not null, no null and no non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False))


def cells(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers of each component and the least and largest value of each
    cell, for cells of about equal population in every dimension."""
    n, d = x.shape
    code = np.empty((n, d), dtype=np.uint8)
    low, high = np.zeros((1 << bits, d)), np.zeros((1 << bits, d))
    for j in range(d):
        marks = np.unique(np.quantile(x[:, j], np.arange(1, 1 << bits) / (1 << bits), method="higher"))
        c = np.searchsorted(marks, x[:, j], side="right")
        code[:, j] = c
        lo, hi = np.full(1 << bits, np.inf), np.full(1 << bits, -np.inf)
        np.minimum.at(lo, c, x[:, j])
        np.maximum.at(hi, c, x[:, j])
        used = hi >= lo
        low[used, j], high[used, j] = lo[used], hi[used]
    return code, low, high


def scores(x: np.ndarray, q: np.ndarray, safe: bool) -> np.ndarray:
    """Exact integer inner products as longs (values beyond a long stop at its ends)."""
    if safe:
        return (x @ q).astype(np.int64)
    exact = x.astype(object) @ q.astype(object)
    return np.array([max(-LONG - 1, min(LONG, int(v))) for v in exact], dtype=np.int64)


def search_block(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, code, low, high, k: int):
    """``(query row, vec_id, score)`` of the k best of one block for each query.

    ``x`` and ``q`` hold integers as longs. Bounds are floats, exact while the
    sum of products stays below 2**53; beyond that every vector is read.
    """
    big = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    safe = big < 2.0 ** 53
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    if safe:
        dims = np.arange(x.shape[1])
        kind = np.float32 if big < 2.0 ** 24 else np.float64
        lo, hi = low[code, dims].astype(kind), high[code, dims].astype(kind)
        up, down = np.maximum(qf, 0).astype(kind), np.minimum(qf, 0).astype(kind)
        best, worst = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
    else:
        best = worst = np.full((len(q), len(x)), np.inf)
    for i in range(len(q)):
        other = x_id != q_id[i]
        n = int(other.sum())
        if not n:
            continue
        bound = best[i]
        at = np.flatnonzero(other)
        if safe and n > k:  # k scores are at least the k-th largest lower bound
            least = np.partition(worst[i][at], n - k)[n - k]
            at = at[bound[at] >= least]
        at = at[np.argsort(-bound[at], kind="stable")]
        kept = np.zeros(0, dtype=np.int64)
        found = np.zeros(0, dtype=np.int64)
        done = 0
        while done < len(at):
            if len(found) >= k and safe and bound[at[done]] < np.partition(found, len(found) - k)[len(found) - k]:
                break  # certain: no unread vector reaches the k-th score (equal bounds are still read)
            take = at[done: done + 4 * k]
            source = xf if safe else x
            found = np.concatenate((found, scores(source[take], qf[i] if safe else q[i], safe)))
            kept = np.concatenate((kept, take))
            done += len(take)
        order = np.lexsort((x_id[kept], -found.astype(object) if not safe else -found))[:k]
        yield i, x_id[kept[order]], found[order]


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner
    products of ``floor(scale * x)`` for every row whose id is divisible by
    ``every``, over all rows of another id; ties go to the smaller id.

    Rows take no part when the vector is null or holds a null or non-finite
    component, or the id is null. Rows repeated with the same id and vector
    count once; rows of one id with other vectors are searched each for itself.
    Vectors of different lengths meet as if the shorter one ended in zeros. A
    query without candidates returns nothing; a score beyond the range of a
    long stops at its end. Other columns are ignored.

    Rows are dealt by hash into blocks of about ``ROWS`` candidates and
    ``QUERIES`` queries; every pair of a query block and a candidate block is
    one bounded piece of work, merged by a ranking of at most ``k`` rows for
    each query and block.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & finite(F.col("v")))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    rows = stored(rows.dropDuplicates(["id", "v"]).withColumn("tie", F.xxhash64("v")), "va-rows")
    n, n_q, dim = rows.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1)), F.max(F.size("v"))).first()
    n_blocks, q_blocks, dim = max(1, math.ceil(n / ROWS)), max(1, math.ceil(n_q / QUERIES)), dim or 0

    def matrix(lists) -> np.ndarray:
        out = np.zeros((len(lists), dim), dtype=np.int64)
        for i, v in enumerate(lists):
            out[i, : len(v)] = v
        return out

    def pack_candidates(part: pd.DataFrame) -> pd.DataFrame:
        x = matrix(part["v"])
        code, low, high = cells(x.astype(np.float64), BITS)
        return pd.DataFrame({"block": [int(part["block"].iloc[0])], "x_id": [part["id"].to_numpy(np.int64).tobytes()],
                             "code": [code.tobytes()], "low": [low.tobytes()], "high": [high.tobytes()],
                             "x": [x.tobytes()]})

    def pack_queries(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"q_block": [int(part["q_block"].iloc[0])],
                             "q_id": [part["id"].to_numpy(np.int64).tobytes()],
                             "q_tie": [part["tie"].to_numpy(np.int64).tobytes()], "q": [matrix(part["v"]).tobytes()]})

    deal = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), "id", "tie"), F.lit(m)).cast("int")
    blocks = (rows.withColumn("block", deal(n_blocks, 1)).groupBy("block").applyInPandas(
        pack_candidates, "block int, x_id binary, code binary, low binary, high binary, x binary"))
    queries = (rows.filter(F.col("id") % every == 0).withColumn("q_block", deal(q_blocks, 2)).groupBy("q_block")
               .applyInPandas(pack_queries, "q_block int, q_id binary, q_tie binary, q binary"))
    pairs = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "block")

    def make():
        def each(cols):
            for q_id, q_tie, q, x_id, code, low, high, x in zip(*cols, strict=True):
                q_id, q_tie, x_id = (np.frombuffer(b, np.int64) for b in (q_id, q_tie, x_id))
                cell = [np.frombuffer(b, np.float64).reshape(1 << BITS, dim) for b in (low, high)]
                hits = list(search_block(np.frombuffer(q, np.int64).reshape(-1, dim), q_id,
                                         np.frombuffer(x, np.int64).reshape(-1, dim), x_id,
                                         np.frombuffer(code, np.uint8).reshape(-1, dim), *cell, k))
                if hits:
                    row = np.repeat([h[0] for h in hits], [len(h[1]) for h in hits])
                    yield {"query_id": q_id[row], "tie": q_tie[row], "vec_id": np.concatenate([h[1] for h in hits]),
                           "score": np.concatenate([h[2] for h in hits])}
        return each

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row is a pair of blocks
    found = map_rows(pairs.select("q_id", "q_tie", "q", "x_id", "code", "low", "high", "x"),
                     "query_id long, tie long, vec_id long, score long", make)
    order = Window.partitionBy("query_id", "tie").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op3_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every query row."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
