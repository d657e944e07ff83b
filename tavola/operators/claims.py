"""Exclusive claims in request order, set at a time.

Requests are made by actors (a customer, an employee, a sign-up) and claim values that
one actor at a time may hold (an e-mail, a phone). A request passes if nobody else
holds any of its values at that moment; its actor then holds its values and
gives up the ones held before. That is a sequential rule: whether a request passes
depends on earlier ones, and through values that are given up on others' requests.

It is solved by rounds. A request's answer is a function of the answers to earlier
requests, so there is exactly one assignment of answers that agrees with itself, and
rounds that work out all answers from the previous round's reach it: after round n
every request whose chain of dependencies is at most n long is right. Each round
is a few running aggregates; nothing is collected but the number of changed answers.

Hot values: the requests of a value (or an actor) are cut into range-sorted chunks, a window
never covers more than one chunk, and a chunk's outcome is carried to the later chunks
of its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.session import written

BEFORE_ALL = -(1 << 63)   # number of the rows that stand for what is held before the batch


def _laid_out(rows: DataFrame, key: str) -> DataFrame:
    """Attach ``_p_<key>``: the range partition of (key, seq); its number grows with both."""
    return rows.repartitionByRange(F.col(key).asc(), F.col("seq").asc()).withColumn(f"_p_{key}", F.spark_partition_id())


def _spanning(rows: DataFrame, key: str) -> DataFrame | None:
    """Chunks (key, partition) of keys that lie in more than one partition, None without any.

    At most two for each partition boundary, so the frame may be broadcast."""
    p = f"_p_{key}"
    ends = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(p).alias("_lo"), F.max(p).alias("_hi")).filter("_lo < _hi")
    chunks = written(ends.select(key, F.explode(F.sequence("_lo", "_hi")).alias(p)), "claim-chunks")
    return chunks if chunks.limit(1).count() else None


def _running(rows: DataFrame, key: str, value: Column, name: str, chunks: DataFrame | None, backwards: bool = False) -> DataFrame:
    """``name``: the largest ``value`` in the rows of the same key that come before by ``seq``
    (``backwards``: the smallest in those that come after); null when there is none."""
    p, best = f"_p_{key}", F.min if backwards else F.max
    order = F.desc if backwards else F.asc
    here = Window.partitionBy(key, p).orderBy(order("seq")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_v", value).withColumn(name, best("_v").over(here))
    if chunks is not None:
        c = chunks.select(F.col(key).alias("_k"), F.col(p).alias("_pp"))
        on = (F.col(key) == F.col("_k")) & (F.col(p) == F.col("_pp"))
        ends = c.join(out.filter("_v IS NOT NULL").join(F.broadcast(c), on, "left_semi").groupBy(key, p)
                      .agg(best("_v").alias("_end")), on, "left").drop(key, p)
        earlier = Window.partitionBy("_k").orderBy(order("_pp")).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("_carry", best("_end").over(earlier)).drop("_end").filter("_carry IS NOT NULL")
        out = out.join(F.broadcast(carried), on, "left")
        pick = F.least if backwards else F.greatest
        out = out.withColumn(name, pick(name, "_carry")).drop("_k", "_pp", "_carry")
    return out.drop("_v")


def resolve_claims(requests: DataFrame, kinds: list[str], held: DataFrame | None = None, releases: bool = True) -> DataFrame:
    """Answers of ``requests(seq, actor, can, <kinds>)``: the same rows with ``accepted`` and
    for each kind ``blocked_<kind>``: null, ``held`` (since before the batch) or ``taken`` (in it).

    ``seq`` is unique and not null. A request with ``can`` false is never accepted, but told what
    blocks it. A null value claims nothing (its actor gives the earlier value up). ``held(actor,
    <kinds>)`` names the holders before the batch; where two hold one value, the one that
    keeps it longest counts. ``releases=False`` says that no actor has two requests.
    """
    rows = requests.select("seq", "actor", F.coalesce("can", F.lit(False)).alias("can"), *kinds).withColumn("_own", F.lit(False))
    if held is not None:
        # Holders matter only where a request names a value of theirs.
        wanted = None
        for k in kinds:
            named = rows.select(F.col(k)).filter(F.col(k).isNotNull()).distinct()
            part = held.join(named, k, "left_semi").select("actor", *kinds)
            wanted = part if wanted is None else wanted.unionByName(part)
        wanted = wanted.distinct()
        rows = rows.unionByName(wanted.select(F.lit(BEFORE_ALL).alias("seq"), "actor", F.lit(True).alias("can"), *kinds,
                                              F.lit(True).alias("_own")))
    keys = [*kinds, *(["actor"] if releases else [])]
    for key in keys:
        rows = _laid_out(rows, key)
    rows = written(rows.withColumn("accepted", F.col("can")), "claims")
    chunks = {key: _spanning(rows, key) for key in keys}

    never = F.lit((1 << 63) - 1)
    while True:
        now = rows
        if releases:
            now = _running(now, "actor", F.when(F.col("accepted"), F.col("seq")), "_gone", chunks["actor"], backwards=True)
            # What is held before the batch ends with the holder's first accepted request, too.
        gone = F.coalesce(F.col("_gone"), never) if releases else never
        blocked = {}
        for k in kinds:
            claim = F.when(F.col("accepted") & F.col(k).isNotNull(), F.struct(F.col("seq"), gone.alias("gone"), F.col("actor")))
            now = _running(now, k, claim, f"_last_{k}", chunks[k])
            last = F.col(f"_last_{k}")
            stands = F.col(k).isNotNull() & (last["actor"] != F.col("actor")) & (last["gone"] > F.col("seq"))
            blocked[k] = F.when(F.coalesce(stands, F.lit(False)), F.when(last["seq"] == BEFORE_ALL, "held").otherwise("taken"))
        for k in kinds:
            now = now.withColumn(f"blocked_{k}", blocked[k])
        free = F.lit(True)
        for k in kinds:
            free = free & F.col(f"blocked_{k}").isNull()
        now = now.withColumn("_new", F.col("_own") | (F.col("can") & free))
        now = now.select(*[c for c in rows.columns if not c.startswith("blocked_")], *[f"blocked_{k}" for k in kinds], "_new")
        now = written(now, "claims")
        changed = now.filter(F.col("_new") != F.col("accepted")).limit(1).count()
        rows = now.withColumn("accepted", F.col("_new")).drop("_new")
        if not changed:
            return rows.filter(~F.col("_own")).select("seq", "actor", *kinds, "accepted", *[f"blocked_{k}" for k in kinds])
