"""Approximate nearest neighbours by cosine with an adaptive dimension scan.

Unit vectors are rotated by a random orthogonal matrix and kept, for each list
of a coarse index, in column blocks. A query scans its probed lists a few
columns at a time; after each step a hypothesis test on the partial distance
abandons candidates that are unlikely to come within the best distance so far.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tavola.llm.common import map_rows, stored, table
from tavola.llm.va_search import finite

SAMPLE, LISTS, ROWS, QUERIES, STEP, EPSILON = 20_000, 256, 4096, 512, 16, 2.1
PROBE_RECALL = 0.97


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (first by their largest component, so that the
    squares neither overflow nor vanish)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, seed: int = 11, turns: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(turns):
        near = (x @ c.T).argmax(axis=1)
        for j in range(k):
            mine = x[near == j]
            if len(mine):
                m = mine.sum(axis=0)
                norm = np.sqrt((m * m).sum())
                if norm > 0:
                    c[j] = m / norm
    return c


def lists_to_probe(x: np.ndarray, c: np.ndarray, k: int) -> int:
    """Fewest probed lists whose members hold ``PROBE_RECALL`` of the true
    neighbours of some sample rows among the sample."""
    near = (x @ c.T).argmax(axis=1)
    q = x[:: max(1, len(x) // 200)]
    sims = q @ x.T
    true = np.argpartition(-sims, min(k, sims.shape[1] - 1), axis=1)[:, : k + 1]
    order = np.argsort(-(q @ c.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None, :].repeat(len(q), 0), axis=1)
    depth = np.sort(np.take_along_axis(place, near[true], axis=1).ravel())
    return int(depth[min(len(depth) - 1, math.ceil(PROBE_RECALL * len(depth)))]) + 1


class Index:
    """The fitted part (bounded: ``LISTS`` centroids and one rotation)."""

    def __init__(self, sample: np.ndarray, k: int):
        d = sample.shape[1]
        q, r = np.linalg.qr(np.random.default_rng(5).standard_normal((d, d)))
        self.rotation = q * np.sign(np.diag(r))
        x = unit(sample) @ self.rotation
        n = max(1, min(LISTS, len(x) // 40))
        self.centroids = k_means(x, n)
        self.probes = lists_to_probe(x, self.centroids, k) if n > 1 else 1

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return unit(x) @ self.rotation


def scan(cols: np.ndarray, q: np.ndarray, x_id: np.ndarray, q_id: int, k: int) -> np.ndarray:
    """Rows of one column block that may be among the ``k`` nearest of ``q``.

    ``cols`` has a row for each rotated dimension. A candidate is abandoned
    after ``t`` of ``d`` dimensions when its partial distance, scaled by
    ``d / t``, exceeds the best k-th distance by the factor ``(1 + EPSILON /
    sqrt(t))**2``: under a random rotation a true neighbour fails that test
    with a small probability only.
    """
    d, n = cols.shape
    alive = np.flatnonzero(x_id != q_id)
    if len(alive) <= k:
        return alive
    head = alive[: 16 * k]
    dist = ((cols[:, head] - q[:, None]) ** 2).sum(axis=0)
    limit = np.partition(dist, k - 1)[k - 1]
    part = np.zeros(len(alive))
    for s in range(0, d, STEP):
        e = min(d, s + STEP)
        part += ((cols[s:e, alive] - q[s:e, None]) ** 2).sum(axis=0)
        slack = 1e-6 if e == d else limit * ((1 + EPSILON / math.sqrt(e)) ** 2 - 1) + 1e-6
        keep = part * (d / e if e < d else 1.0) <= limit + slack
        alive, part = alive[keep], part[keep]
    if len(alive) > k:  # all distances are complete now
        alive = alive[part <= np.partition(part, k - 1)[k - 1] + 1e-6]
    return alive


def nearest(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found by cosine for
    every row whose id is divisible by ``every``, among rows of another id.

    The coarse index is fitted on a sample of at most ``SAMPLE`` rows (those of
    smallest hash), every row is indexed. Rows take no part when the id or
    vector is null, the vector is empty or zero or holds a null or non-finite
    component, or its length is not the most frequent one. Rows repeated with
    the same id and vector count once. Scores are cosines of the original
    vectors in double precision; ties go to the smaller id. Queries probe more
    lists than fitted until those hold more than ``k`` rows, so that a query has
    fewer results only when there are fewer candidates.

    Lists are cut by hash into blocks of about ``ROWS`` rows, the queries of a
    list into blocks of ``QUERIES``: a list with a third of all rows is many
    pieces of work.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    rows = stored(rows.dropDuplicates(["id", "v"]).withColumn("tie", F.xxhash64("v")), "scan-rows")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not common:
        return empty
    dim, n = common[0]["d"], common[0]["count"]
    rows = rows.filter(F.size("v") == dim)
    picked = F.xxhash64(F.lit(3), "id", "tie")
    share = min(1.0, 1.2 * SAMPLE / n)  # about as many rows as needed reach the ordered limit
    sample = (rows.filter(F.pmod(picked, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(picked, "id")
              .limit(SAMPLE).select("v").collect())
    ix = Index(np.array([r["v"] for r in sample]), k)  # travels with the functions below: LISTS * dim numbers
    spark = df.sparkSession

    def assign():
        def each(cols):
            ids, ties, vecs = cols
            v = np.array(vecs)
            x = ix.rotate(v)
            yield {"id": ids, "tie": ties, "list": (x @ ix.centroids.T).argmax(axis=1),
                   "x": [r.tobytes() for r in x], "v": [r.tobytes() for r in v]}
        return each

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    indexed = stored(map_rows(rows.select("id", "tie", "v"), "id long, tie long, list int, x binary, v binary", assign),
                     "scan-indexed")
    sizes = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}  # at most LISTS rows
    chunks = {c: max(1, math.ceil(s / ROWS)) for c, s in sizes.items()}

    def probe():
        size = np.array([sizes.get(c, 0) for c in range(len(ix.centroids))])

        def each(cols):
            ids, ties, xs, vs = cols
            order = np.argsort(-(np.frombuffer(b"".join(xs)).reshape(len(ids), -1) @ ix.centroids.T), axis=1)
            out = {"id": [], "tie": [], "list": [], "chunk": [], "x": [], "v": []}
            for i, o in enumerate(order):
                enough = int(np.searchsorted(np.cumsum(size[o]), k + 1)) + 1
                for c in o[: max(ix.probes, enough)].tolist():
                    for chunk in range(chunks.get(c, 0)):
                        for name, value in (("id", ids[i]), ("tie", ties[i]), ("list", c), ("chunk", chunk),
                                            ("x", xs[i]), ("v", vs[i])):
                            out[name].append(value)
                if len(out["id"]) > 20_000:
                    yield out
                    out = {name: [] for name in out}
            yield out
        return each

    chunk_of = F.create_map(*[F.lit(x) for c in sorted(chunks) for x in (c, chunks[c])])
    cand = indexed.withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "id", "tie"), chunk_of[F.col("list")]).cast("int"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(part["x"])).reshape(len(part), dim)
        return pd.DataFrame({"list": [part["list"].iloc[0]], "chunk": [part["chunk"].iloc[0]],
                             "x_id": [part["id"].to_numpy(np.int64).tobytes()],
                             "cols": [np.ascontiguousarray(x.T).tobytes()], "xv": [b"".join(part["v"])]})

    def pack_queries(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"list": [part["list"].iloc[0]], "chunk": [part["chunk"].iloc[0]],
                             "q_id": [part["id"].to_numpy(np.int64).tobytes()],
                             "q_tie": [part["tie"].to_numpy(np.int64).tobytes()],
                             "q": [b"".join(part["x"])], "qv": [b"".join(part["v"])]})

    blocks = cand.groupBy("list", "chunk").applyInPandas(pack, "list int, chunk int, x_id binary, cols binary, xv binary")
    asked = map_rows(indexed.filter(F.col("id") % every == 0).select("id", "tie", "x", "v"),
                     "id long, tie long, list int, chunk int, x binary, v binary", probe)
    # Each (list, chunk) has at most all queries: cut them into blocks by hash.
    q_blocks = max(1, math.ceil(n / every / QUERIES))
    asked = (asked.withColumn("piece", F.pmod(F.xxhash64(F.lit(2), "id", "tie"), F.lit(q_blocks)))
             .groupBy("list", "chunk", "piece")
             .applyInPandas(pack_queries, "list int, chunk int, q_id binary, q_tie binary, q binary, qv binary"))
    pairs = asked.join(blocks, ["list", "chunk"])

    def search():
        def each(cols):
            for q_id, q_tie, q, qv, x_id, x, xv in zip(*cols, strict=True):
                q_id, q_tie, x_id = (np.frombuffer(b, np.int64) for b in (q_id, q_tie, x_id))
                q, qv, xv = (np.frombuffer(b).reshape(-1, dim) for b in (q, qv, xv))
                x = np.frombuffer(x).reshape(dim, -1)
                out = {"query_id": [], "tie": [], "vec_id": [], "score": []}
                for i in range(len(q_id)):
                    at = scan(x, q[i], x_id, q_id[i], k)
                    if not len(at):
                        continue
                    # exactly the measure, on the original vectors
                    a, b = xv[at], qv[i]
                    score = cosine(a, b)
                    order = np.lexsort((x_id[at], -score))[:k]
                    out["query_id"] += [q_id[i]] * len(order)
                    out["tie"] += [q_tie[i]] * len(order)
                    out["vec_id"] += x_id[at][order].tolist()
                    out["score"] += score[order].tolist()
                if out["query_id"]:
                    yield out
        return each

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # a row is a pair of blocks
    found = map_rows(pairs.select("q_id", "q_tie", "q", "qv", "x_id", "cols", "xv"),
                     "query_id long, tie long, vec_id long, score double", search)
    order = Window.partitionBy("query_id", "tie").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` with ``b``; each row alone, so equal rows get equal values."""
    big_a, big_b = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max()
    if big_a.max() > 1e140 or big_a.min() < 1e-140 or not 1e-140 < big_b < 1e140:
        a, b = a / big_a, b / big_b  # squares would leave the range of doubles
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * math.sqrt((b * b).sum()))


def op5_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of all vectors for every query row."""
    return nearest(table(spark, sf_dir, "embeddings"))
