"""Source mixing, weak supervision and the pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tavola.llm import weak_toxicity
from tavola.llm.source_mix import mix, mixed
from tavola.llm.weak_toxicity import LabelModel, N_VOTERS, fit_linear, held_out, score_toxicity, without_toxic

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


# ---- mixing

def mix_case():
    rng = random.Random(3)
    rows = [(i, " ".join("w%d" % rng.randrange(99) for _ in range(rng.randrange(1, 40))),
             rng.choice(["b", "b", "b", "b", "a", "é", "Z", None])) for i in range(400)]
    rows += [(500, None, "b"), (501, "", "a"), (502, " \n", None), (503, "tiny words", "small"), (7, rows[7][1], rows[7][2]),
             (None, "null id", "b"), (504, None, "only empty")]
    return rows


def brute_targets(rows):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + words(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, total = set(), sum(size.values())
    while True:
        share = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * share > 3 * size[s]}
        if not more:
            return size, {s: float(3 * size[s]) if s in full else weight[s] * share for s in order}
        full |= more


def test_mix(spark):
    rows = mix_case()
    size, target = brute_targets(rows)
    got = mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        s = r["source"]
        assert r["source_size"] == size[s] and math.isclose(r["target"], target[s], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        epochs = int(target[s] // size[s]) if size[s] else 0
        assert r["size"] == 0 or r["taken"] // r["size"] in (epochs, epochs + 1)  # complete epochs first
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in size)
    again = mix(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_selection_is_efraimidis_spirakis(spark):
    rows = [(i, "one two", "a" if i % 2 else "b") for i in range(60)]
    got = {r["doc_id"]: r["taken"] for r in mix(frame(spark, rows)).collect()}

    def key(i):
        tie = hashlib.md5(b"one two").hexdigest()
        u = (int(hashlib.md5(f"7|{i}|{tie}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        return -math.log(u) / 1.1
    # weights 1 and 2 of 120 words: a gets 40 of its 60, b 80 of its 60
    for s, rest, epochs in (("a", 40, 0), ("b", 20, 1)):
        own = sorted((i for i, _, x in rows if x == s), key=key)
        assert all(got[i] == 2 * epochs + (2 if 2 * n + 1 <= rest else 0) for n, i in enumerate(own))


def test_mixed_rows(spark):
    rows = mix_case()
    docs = frame(spark, rows)
    out = mixed(docs)
    assert out.columns == docs.columns
    want = sum(r["taken"] // r["size"] for r in mix(docs).collect() if r["size"])
    assert out.count() == want
    assert mixed(frame(spark, [])).count() == 0 and mix(frame(spark, [])).count() == 0


# ---- toxicity

def tox_case(n=900):
    rng = random.Random(8)
    bad = ["vile%d" % i for i in range(8)]
    rows, labels = [], []
    for i in range(n):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(10, 60))]
        toxic = rng.random() < 0.15
        if toxic:
            text += rng.sample(bad, 4)
            rng.shuffle(text)
        rows.append((i, " ".join(text), "s"))
        if rng.random() < 0.8:
            labels.append((i, 1, int(toxic)))
        rows[-1] += (toxic,)
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = tox_case()
    docs = frame(spark, [r[:3] for r in rows] + [(5000, None, "s"), (5001, "", "s"), (None, "vile1 vile2 vile3 vile4", None)])
    docs = docs.withColumnRenamed("lang", "score")  # a clashing name
    lab = spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1), (9999, 1, 1)], LABELS)
    out = {r["doc_id"]: r for r in score_toxicity(docs, lab).withColumn("h", held_out(docs["doc_id"])).collect()}
    right = sum((out[i]["__tox_score"] >= 0.7) == toxic for i, _, _, toxic in rows if out[i]["h"])
    assert right / sum(out[i]["h"] for i, *_ in rows) > 0.97
    assert all(out[i]["h"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert all(0 <= r["__tox_score"] <= 1 for r in out.values())
    assert out[5000]["__tox_score"] == out[5001]["__tox_score"] < 0.7 <= out[None]["__tox_score"]
    kept = {r["doc_id"] for r in without_toxic(docs, lab).collect()}
    assert kept == {i for i, r in out.items() if r["__tox_score"] < 0.7}


def test_held_out_labels_are_not_learned_from(spark):
    rows, labels = tox_case(400)
    docs = frame(spark, [r[:3] for r in rows])
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (sorted((r["doc_id"], r["__tox_score"]) for r in score_toxicity(docs, spark.createDataFrame(x, LABELS)).collect())
            for x in (labels, flipped))
    assert a == b


def test_copies_of_a_long_text_take_no_features(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(1200):  # 60 toxic words of their own, each in few rows
        toxic = i % 4 == 0
        text = [f"w{rng.randrange(300)}" for _ in range(25)] + [f"{k}vile" for k in rng.sample(range(60), 6)] * toxic
        rows.append((i, " ".join(text), "s", toxic))
        labels.append((i, 1, int(toxic)))
    copied = " ".join(f"{k}common" for k in range(900))
    docs = frame(spark, [r[:3] for r in rows] + [(2000 + i, copied, "s") for i in range(600)])
    scorer = weak_toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    assert sum(scorer.weights.get(f"w:{k}vile", 0) > 0 for k in range(60)) == 60
    assert not any("common" in t for t in scorer.weights)
    out = {r["doc_id"]: r["__tox_score"] for r in score_toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()}
    h = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum((out[r[0]] >= 0.7) == r[3] for r in h) / len(h) > 0.97 and out[2000] < 0.7


def test_lexicons_from_all_labelled_rows(spark, monkeypatch):
    rows, labels = tox_case()
    docs, lab = frame(spark, [r[:3] for r in rows]), spark.createDataFrame(labels, LABELS)
    want = weak_toxicity.fit(docs, lab).weights
    monkeypatch.setattr(weak_toxicity, "LABELLED", 60)  # bounds the decision point alone
    got = weak_toxicity.fit(docs, lab).weights
    assert got == want and sum(got.get(f"w:vile{i}", 0) > 0 for i in range(8)) == 8
    monkeypatch.setattr(weak_toxicity, "SENT", 0)
    assert weak_toxicity.fit(docs, lab).weights == want


def test_without_labels_or_rows(spark):
    rows, labels = tox_case(30)
    docs = frame(spark, [r[:3] for r in rows])
    none = spark.createDataFrame([], LABELS)
    assert without_toxic(docs, none).count() == 30
    assert score_toxicity(frame(spark, []), none).count() == 0
    assert score_toxicity(frame(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_label_model_recovers_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    y = rng.random(60000) < 0.2
    inside, outside = rng.uniform(0.4, 0.8, N_VOTERS), rng.uniform(0.01, 0.1, N_VOTERS)
    votes = rng.random((len(y), N_VOTERS)) < np.where(y[:, None], inside, outside)
    copied = rng.random(len(y)) < 0.9
    votes[:, 1] = np.where(copied, votes[:, 0], votes[:, 1])  # a voter that mostly repeats another
    v = votes.astype(float)
    m = LabelModel(len(y), v.T @ v, 0.2)
    assert np.abs(m.inside[2:] - inside[2:]).max() < 0.05 and np.abs(m.outside[2:] - outside[2:]).max() < 0.03
    assert m.correlation[0, 1] > 0.3 and (np.abs(m.correlation[2:, 2:]) > 0).sum() == 0
    assert ((m.posterior(v) >= 0.5) == y).mean() > 0.97


def test_linear_fit():
    target = np.array([0.95, 0.9, 0.05, 0.1] * 20)
    rows = [np.array(x, dtype=np.int32) for x in ([0], [0, 1], [1], [])] * 20
    w, b = fit_linear(rows, 2, target, l2=0.01)
    assert w[0] > 2 and abs(w[1]) < 1 and b < 0
    assert weak_toxicity.decision_point(np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0])) == 1.5


# ---- pipeline

@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(4)
    rows, labels = tox_case(300)
    rows = [(i, t, f"s{i % 12}") for i, t, _, _ in rows]
    for i in range(60):  # shared line, exact and near copies
        rows.append((1000 + i, f"the shared line\nown {i} " + " ".join(f"v{rng.randrange(999)}" for _ in range(40)), f"s{i % 12}"))
    for i in range(10):
        t = rows[300 + i][1].split("\n")[1]
        rows += [(2000 + i, t, "s1"), (3000 + i, t + " end", "s2")]
    rows += [(4000, None, "s1"), (4001, "", None), (4002, "alone", None)]
    d = str(tmp_path_factory.mktemp("corpus"))
    frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages(spark, corpus):
    d, rows = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, None
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns and docs.dtypes == spark.read.parquet(f"{d}/documents.parquet").dtypes
        path = f"{d}/{name}"
        docs.write.parquet(path)
        docs, before = spark.read.parquet(path), docs
        seen[name] = docs.collect()
    vile = {i for i, t, _ in rows if t and t.count("vile") == 4}
    assert not vile & {r["doc_id"] for r in seen["toxicity"]}
    assert len(seen["toxicity"]) >= len(rows) - len(vile) - 3
    shared = [r["doc_id"] for r in seen["line_dedup"] if "the shared line" in (r["text"] or "")]
    assert shared == [1000] and len(seen["line_dedup"]) == len(seen["toxicity"])
    ids = {r["doc_id"] for r in seen["near_duplicates"]}
    assert not ids & set(range(2000, 2010)) - {2000} and not ids & set(range(3000, 3010)) - {3000}
    assert {4000, 4001, 4002} <= ids and set(range(1001, 1060)) <= ids
    out = corpus_pipeline.run(spark, d).collect()
    assert sorted((r["doc_id"], r["n_pieces"]) for r in out) == sorted(
        (r["doc_id"], r["n_pieces"]) for r in corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{d}/mixing"), d).collect())
    assert all(r["round_trip"] for r in out) and len(out) == len(seen["mixing"])


def test_empty_corpus(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
