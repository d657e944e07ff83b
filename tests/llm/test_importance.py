"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import pytest

from tavola.llm import importance_draw as I

DOCS = "doc_id long, text string, score double, rank int, id string, weight string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, "x", None) for i, t in rows], DOCS)


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets(t):
    w = words(t)
    return [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, target, percent=25):
    s, t = [0] * 10000, [0] * 10000
    for _, x in rows:
        for b in buckets(x):
            s[b] += 1
    for x in target:
        for b in buckets(x):
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, x in rows:
        bs = buckets(x)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    full = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(full[: percent * len(full) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def case(n=300):
    rng = random.Random(6)
    vocabulary = ["the", "Ünï", "x1", "ÄB", "don't", "a_b", "ß", "漢字", "q", "Zz9"] + [f"w{i}" for i in range(200)]
    text = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", " \n", "\x00"]) for _ in range(k))
    rows = [(i, text(rng.randrange(0, 60))) for i in range(n)]
    rows += [(1000, None), (1001, ""), (1002, " .,"), (1003, text(30_000)), (None, text(40)), (5, rows[5][1]), (8, text(40)), (8, text(40))]
    return rows, [text(30) for _ in range(20)] + [None]


def got(df):
    return sorted(((r["id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


def benchmark(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_draw_equals_brute_force(spark):
    rows, target = case()
    assert got(I.importance_draw(frame(spark, rows), benchmark(spark, target))) == brute(rows, target)
    assert got(I.importance_draw(frame(spark, rows), benchmark(spark, []), percent=60)) == brute(rows, [], 60)


def test_query(spark, tmp_path):
    rows, target = case(100)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark(spark, target).write.parquet(str(tmp_path / "benchmark.parquet"))
    df = I.op13_importance_draw(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=str) == brute(rows, target)


@pytest.mark.parametrize("scores", [[5] * 40, list(range(40)), [1, 1, 1, 9, 9, 9, 9, -7, -7, -(1 << 40)] * 4])
@pytest.mark.parametrize("k", [0, 1, 5, 13, 40])
def test_bisection_with_ties(spark, scores, k):
    from tavola.llm.common import stored
    rng = random.Random(k)
    keys = [rng.choice([i, i, 3, (1 << 62) + i, -i]) for i in range(len(scores))]
    rows = [(s, key, 0, i) for i, (s, key) in enumerate(zip(scores, keys))]
    df = stored(spark.createDataFrame(rows, "score long, key long, n_features long, weight long"), "test-ranked")
    want = {r[3]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1], r[3]))[:k])}
    assert {r["weight"]: r["rank"] for r in I.ranked(df, k).collect() if r["rank"] is not None} == want


def test_crc_of_a_blank():
    import numpy as np
    for w in (b"", b"a", "漢".encode(), b"x" * 50):
        assert int(I.then_blank(np.array([zlib.crc32(w)], dtype=np.uint32))[0]) == zlib.crc32(w + b" ")


def test_longer_runs():
    n, runs = I.features(["a b c d", "", "e", "f g h"], 3, 1 << 31)
    assert n.tolist() == [4, 0, 1, 3]
    assert [zlib.crc32(x) % (1 << 31) for x in (b"a b c", b"b c d", b"f g h")] == runs[2][1].tolist()
    assert runs[2][0].tolist() == [0, 0, 3]


def test_resampled_rows_keep_their_columns(spark):
    rows, target = case()
    docs = frame(spark, rows)
    out = I.resample(docs, benchmark(spark, target))
    assert out.columns == docs.columns
    want = [i for i, _, _, _, rank in brute(rows, target) if rank is not None]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(want)


def test_no_rows(spark):
    assert I.importance_draw(frame(spark, []), benchmark(spark, ["a b"])).count() == 0
