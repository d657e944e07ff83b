"""Toxicity by weak supervision.

Many voters (lexicons of words and of word beginnings, text patterns) vote on
every document. A generative label model estimates each voter's accuracies and
the correlations between voters from the agreement of their votes over the
whole corpus, without labels; its posterior labels train a linear classifier.

Known labels are used in three places only: to collect the lexicons, for the
class balance, and to place the decision point; never from held-out rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm.common import map_rows, small_batches, stored, table, text_or_empty

LABELLED, TRAINED = 40_000, 12_000      # most rows that place the decision point and that fit the classifier
SENT = 2_000_000                        # most labelled ids sent to every executor
VOTERS, SUPPORT, PURITY = 24, 4, 0.8
FEATURES = 500_000                      # terms of the classifier; far more than pass the gain test in TRAINED rows
DECISION = 0.7
CACHE = 400_000
STRIP = ".,;:!?\"'()[]{}<>*_-–—…¡¿«»“”"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def terms_of(raw: str) -> tuple[str, ...]:
    """Features of one white-space-separated token: the word and two beginnings."""
    w = raw.lower().strip(STRIP)
    if not w:
        return ()
    out = ("w:" + w,) if len(w) <= 40 else ()
    if len(w) > 4:
        out += ("p4:" + w[:4],)
    if len(w) > 5:
        out += ("p5:" + w[:5],)
    return out


def voter_of(term: str) -> int:
    """Voters ``0 .. VOTERS - 1``: half of them word lexicons, a quarter each beginnings of 4 and of 5."""
    import zlib

    h = zlib.crc32(term.encode("utf-8", "surrogatepass"))
    half, quarter = VOTERS // 2, VOTERS // 4
    return h % half if term[0] == "w" else (half if term[1] == "4" else half + quarter) + h % quarter


def patterns_of(text: str) -> int:
    """Pattern voters, as the bits above the lexicons."""
    shout, marks = text.isupper(), text.count("!")
    return (shout | (marks * 200 > len(text)) << 1 | ("!!" in text or "??" in text) << 2 | ("@" in text) << 3) << VOTERS


N_VOTERS = VOTERS + 4


def gain_of(toxic: Column, clean: Column, base: float) -> Column:
    """Log-likelihood ratio (G squared) of a term's class counts against the
    class balance; negative for terms of the clean class."""
    n = toxic + clean
    part = lambda x, share: F.when(x > 0, x * F.ln(x / (n * F.lit(share)))).otherwise(0.0)
    return 2 * (part(toxic, base) + part(clean, 1 - base)) * F.signum(toxic - n * F.lit(base))


class PerToken(dict):
    """A bounded memo of a function of one token."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, raw):
        if len(self) > CACHE:
            self.clear()
        v = self.f(raw)
        if len(raw) <= 64:
            self[raw] = v
        return v


class LabelModel:
    """Two-class model of binary voters, fitted to first and second moments.

    Given the class, most voters are independent; then the covariance of two
    voters is ``p (1 - p) d_i d_j`` with ``d`` = vote rate in the class minus
    vote rate outside. ``d`` is fitted to the off-diagonal covariances; pairs
    that stand out from that fit are correlated beyond the class: they leave
    the fit, and a voter's weight is divided by one plus its correlations.
    """

    def __init__(self, n: int, both: np.ndarray, balance: float, turns: int = 6):
        m = len(both)
        rate = both.diagonal() / max(n, 1)
        cov = both / max(n, 1) - np.outer(rate, rate)
        used = ~np.eye(m, dtype=bool)
        p = balance
        scale = p * (1 - p)
        d = np.sqrt(np.clip(rate * (1 - rate), 1e-9, None))
        self.correlation = np.zeros((m, m))
        sd = np.sqrt(np.clip(rate * (1 - rate), 1e-9, None))
        for _ in range(turns):
            for _ in range(200):
                num = (used * cov / scale) @ d
                den = used @ (d * d)
                d = 0.5 * d + 0.5 * num / np.clip(den, 1e-12, None)
            rest = (cov - scale * np.outer(d, d)) / np.outer(sd, sd)
            off = np.abs(rest[~np.eye(m, dtype=bool)])
            limit = max(0.05, 4 * np.median(off))
            stands = (np.abs(rest) > limit) & ~np.eye(m, dtype=bool)
            used = ~np.eye(m, dtype=bool) & ~stands
            used |= (used.sum(axis=1) < 3)[:, None] & ~np.eye(m, dtype=bool)
            self.correlation = np.where(stands, np.clip(rest, -1, 1), 0.0)
        if d[:VOTERS].sum() < 0:
            d = -d
        inside = np.clip(rate + (1 - p) * d, 1e-4, 1 - 1e-4)
        outside = np.clip(rate - p * d, 1e-4, 1 - 1e-4)
        share = 1 / (1 + np.clip(self.correlation, 0, None).sum(axis=1))
        live = (rate > 0) & (rate < 1)
        self.inside, self.outside = inside, outside
        self.yes = np.where(live, share * np.log(inside / outside), 0.0)
        self.no = np.where(live, share * np.log((1 - inside) / (1 - outside)), 0.0)
        self.start = math.log(p / (1 - p))

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        z = self.start + bits @ self.yes + (1 - bits) @ self.no
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bits_of(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(N_VOTERS) & 1).astype(np.float64)


def fit_linear(rows: list[np.ndarray], m: int, target: np.ndarray, turns: int = 200, rate: float = 0.3, l2: float = 0.5):
    """Logistic regression on the features (of ``m``) that a row has: ``(weights, bias)``."""
    base = float(np.clip(target.mean(), 1e-6, 1 - 1e-6)) if len(target) else 0.5
    index = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(m), math.log(base / (1 - base))
    gw, gb = np.full(m, 1e-8), 1e-8
    for _ in range(turns):  # AdaGrad on the whole sample
        z = np.bincount(owner, weights=w[index], minlength=len(rows)) + b
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.bincount(index, weights=e[owner], minlength=m) + l2 * w
        gw += g * g
        gb += float(e.sum()) ** 2
        w -= rate * g / np.sqrt(gw)
        b -= rate * float(e.sum()) / math.sqrt(gb)
    return w, b


def decision_point(z: np.ndarray, y: np.ndarray) -> float:
    """The score limit with the best F1 (the middle of the gap at it)."""
    order = np.argsort(-z, kind="stable")
    zs, ys = z[order], y[order]
    hit = np.cumsum(ys)
    f1 = 2 * hit / (np.arange(1, len(ys) + 1) + max(1, ys.sum()))
    f1[:-1][zs[:-1] == zs[1:]] = -1  # equal scores fall on one side
    best = int(f1.argmax())
    return float((zs[best] + zs[best + 1]) / 2) if best + 1 < len(zs) else float(zs[-1]) - 1


class Scorer:
    """Linear classifier over tokens of whole texts."""

    def __init__(self, weights: dict[str, float], bias: float, at: float, slope: float):
        self.weights, self.bias, self.at, self.slope = weights, bias, at, slope

    def broadcast(self, spark: SparkSession):
        """The numbers behind it, for the executors (bounded by the terms of the fitted rows)."""
        return spark.sparkContext.broadcast((self.weights, self.bias, self.at, self.slope))

    def raw(self):
        get = self.weights.get

        memo = PerToken(lambda raw: tuple(t for t in terms_of(raw) if get(t)))

        def z(text: str) -> float:
            has = {t for w in set(text.split()) for t in memo[w]}
            return math.fsum(map(get, has)) + self.bias  # fsum: the same in any order
        return z

    def score(self, z: float) -> float:
        x = self.slope * (z - self.at) + math.log(DECISION / (1 - DECISION))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Voters, label model and classifier (see the module docstring).

    Lexicons come from all labelled rows that are not held out, the decision
    point from at most ``LABELLED`` of them, the classifier from at most
    ``TRAINED`` rows (those of smallest hash, none held out); votes and their
    moments are taken over all documents. Labels that
    are null, or of ids with contradicting labels in equal number, are ignored.
    Without labels of both classes every document scores 0.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
             .agg(F.avg(F.col("toxic").cast("double")).alias("y")).filter("y <> 0.5 AND id IS NOT NULL"))
    known = known.filter(~held_out(F.col("id"))).withColumn("y", (F.col("y") > 0.5).cast("int"))
    every = stored(known, "tox-labels")
    known = every.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(LABELLED)
    # At most LABELLED ids: sent to every executor, so that no text is shuffled.
    known = stored(rows.join(F.broadcast(known), "id").select("y", "text"), "tox-known")
    small_batches(docs.sparkSession, 4000)  # fewer partial counts
    every = rows.join(F.broadcast(every) if every.count() <= SENT else every, "id").select("y", "text")

    def words():
        memo = PerToken(terms_of)

        def each(cols):
            out = {}
            for y, text in zip(*cols, strict=True):
                for t in {t for w in set(text.split()) for t in memo[w]}:
                    c = out.setdefault(t, [0, 0])
                    c[y] += 1
            yield {"term": list(out), "clean": [c[0] for c in out.values()], "toxic": [c[1] for c in out.values()]}
        return each

    total = {r["y"]: r["count"] for r in every.groupBy("y").count().collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n0 or not n1:
        return Scorer({}, 0.0, 30.0, 1.0)
    counts = map_rows(every, "term string, clean long, toxic long", words).groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    base = n1 / (n0 + n1)
    gain = gain_of(F.col("toxic"), F.col("clean"), base)
    counts = stored(counts.filter(F.col("toxic") >= SUPPORT), "tox-terms")
    tested = max(2, counts.count())  # the limit rises with the number of terms tried
    pure = F.col("toxic") >= F.lit(PURITY) * (F.col("toxic") + F.col("clean"))
    lexicon = [r["term"] for r in counts.filter((F.col("toxic") >= SUPPORT) & pure & (gain >= 2 * math.log(tested)))
               .select("term").collect()]
    vote = {t: 1 << voter_of(t) for t in lexicon}
    bc = docs.sparkSession.sparkContext.broadcast(vote)  # the terms that pass

    def mask_of():
        get = bc.value.get

        def of(raw):
            m = 0
            for t in terms_of(raw):
                m |= get(t, 0)
            return m
        memo = PerToken(of)

        def mask(text):
            m = patterns_of(text)
            for w in set(text.split()):
                m |= memo[w]
            return m
        return mask

    def moments():
        mask = mask_of()

        def each(cols):
            b = bits_of(np.array([mask(t) for t in cols[0]], dtype=np.int64))
            yield {"n": [len(b)], "both": [(b.T @ b).astype(np.int64).ravel().tolist()]}
        return each

    small_batches(docs.sparkSession)
    seen = map_rows(rows.select("text"), "n long, both array<long>", moments)
    n = F.sum("n").alias("n")
    sums = seen.select("n", F.posexplode("both").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), n).collect()
    both = np.zeros(N_VOTERS * N_VOTERS)
    for r in sums:  # one row for each pair of voters
        both[r["at"]] = r["x"]
    model = LabelModel(sums[0]["n"], both.reshape(N_VOTERS, N_VOTERS), min(0.5, max(0.005, n1 / (n0 + n1))))

    def sampled():
        mask = mask_of()

        def each(cols):
            post = model.posterior(bits_of(np.array([mask(t) for t in cols[0]], dtype=np.int64)))
            yield {"post": np.rint(post * 1e6).astype(np.int64), "text": cols[0]}
        return each

    pick = F.xxhash64(F.lit(2), "id", "text")
    share = min(1.0, 1.5 * TRAINED / max(1, sums[0]["n"]))
    some = (rows.filter(~held_out(F.col("id"))).filter(F.pmod(pick, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
            .orderBy(pick, "id").limit(TRAINED).select("text"))
    some = stored(map_rows(some, "post long, text string", sampled), "tox-sample")
    small_batches(docs.sparkSession, 4000)

    def sample_terms():
        memo = PerToken(terms_of)

        def each(cols):
            out = {}
            for post, text in zip(*cols, strict=True):
                for t in {t for w in set(text.split()) for t in memo[w]}:
                    c = out.setdefault(t, [0, 0])
                    c[0] += 1
                    c[1] += post
            yield {"term": list(out), "n": [c[0] for c in out.values()], "post": [c[1] for c in out.values()]}
        return each

    # Features: terms whose share of posterior labels differs clearly from the
    # sample's, counted over different texts (equal texts have equal posteriors).
    texts = stored(some.groupBy(F.xxhash64("text").alias("th")).agg(F.first("post").alias("post"), F.first("text").alias("text"))
                   .select("post", "text"), "tox-texts")  # at most TRAINED rows
    counts = map_rows(texts, "term string, n long, post long", sample_terms).groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("post").alias("post")).filter(F.col("n") >= SUPPORT)
    counts = stored(counts, "tox-sample-terms")
    mean = texts.agg(F.avg("post")).first()[0]
    base = min(1 - 1e-6, max(1e-6, (mean or 0) / 1e6))
    gain = F.abs(gain_of(F.col("post") / 1e6, F.col("n") - F.col("post") / 1e6, base))
    terms = [r["term"] for r in counts.filter(gain >= 2 * math.log(max(2, counts.count())))
             .orderBy(F.desc(gain), "term").limit(FEATURES).select("term").collect()]
    place = {t: i for i, t in enumerate(terms)}

    def vectors():
        get = place.get
        memo = PerToken(lambda raw: tuple(i for i in map(get, terms_of(raw)) if i is not None))

        def each(cols):
            yield {"post": cols[0], "has": [np.array(sorted({i for w in set(x.split()) for i in memo[w]}), dtype=np.int32)
                                            .tobytes() for x in cols[1]]}
        return each

    got = map_rows(some, "post long, has binary", vectors).toPandas()
    w, bias = fit_linear([np.frombuffer(x, np.int32) for x in got["has"]], len(terms), got["post"].to_numpy(float) / 1e6)
    weights = {t: float(w[i]) for t, i in place.items()}
    scorer = Scorer(weights, bias, 0.0, 1.0)
    held = scorer.broadcast(docs.sparkSession)

    def raw_scores():
        z = Scorer(*held.value).raw()

        def each(cols):
            yield {"y": cols[0], "z": [z(t) for t in cols[1]]}
        return each

    zs = map_rows(known.select("y", "text"), "y int, z double", raw_scores).toPandas()  # at most LABELLED rows
    z, y = zs["z"].to_numpy(float), zs["y"].to_numpy(float)
    at = decision_point(z, y)
    return Scorer(weights, bias, at, max(1.0, 4.0 / max(1e-6, float(np.std(z)))))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__tox_score`` added: 0 to 1, toxic from ``DECISION`` on.

    A null text scores as the empty one. Ids may be null or repeated and other
    columns may have any names: scores depend on the text alone, and the input
    is passed through without a join.
    """
    held = fit(docs, labels, id_col, text_col).broadcast(docs.sparkSession)
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*held.value)
        z = scorer.raw()
        for texts in batches:
            yield pd.Series([scorer.score(z(t or "")) for t in texts], dtype=float)

    return docs.withColumn("__tox_score", score(F.col(text_col).cast("string")))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``DECISION``, with its columns."""
    return score_toxicity(docs, labels, id_col, text_col).filter(F.col("__tox_score") < DECISION).drop("__tox_score")


def op10_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    out = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__tox_score").alias("score"),
                      (F.col("__tox_score") >= DECISION).cast("int").alias("predicted"))
