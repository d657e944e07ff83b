"""N-gram Jaccard join with parity sketches.

Every shingle flips one bit of a document's sketch, so the Hamming distance of
two sketches is at most the size of the symmetric difference of the two shingle
sets. Sets of similar size meet in a size band whose sketches have the same
parts; two sets with Jaccard similarity of at least ``T`` percent differ in at
most ``D`` shingles there, so by the pigeonhole principle enough parts agree.
A part is represented by the exclusive-or of random numbers of its odd bits.
Agreeing parts give candidates, whole sketches reject, exact sets verify.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tavola.llm.common import forget, map_rows, small_batches, stored, table, text_or_empty
from tavola.llm.components import components

PART_BITS = 1 << 24            # bits of a part; few are odd and none is stored, so width costs nothing
SPARE = 0.4                    # parts that a set may leave out, as a share of the rest
PARTNERS = 8                   # classes that a class is compared with in the first turn
SMALL, PIECE = 16, 2048        # classes of a small bucket; most classes of a piece of a larger one
SHARE, DEAL = 128, 16          # a piece has so many classes until there are so many pieces, then it grows to ``PIECE``
FOLD = 32                      # longs of the whole (folded) sketch
BROADCAST_ROWS = 2_000_000     # most class ids (16 bytes each) that are sent to every executor
CHARS = 1 << 20                # of texts whose sets are made at once (a longer text alone)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (well-known multiply and shift constants)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def times(a: int, b: int) -> np.uint64:
    return U(a * b & (1 << 64) - 1)


def factors(words: int) -> np.ndarray:
    return mix(np.arange(1, words + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text (A-Z lower-cased,
    words end at ASCII white space); a shorter text is one n-gram."""
    return shingle_sets([text], words)[0]


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of many texts: their sets one after another, and the size of each."""
    import xxhash

    parts = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    count = np.fromiter(map(len, parts), np.int64, len(parts))
    h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(parts)), np.uint64, int(count.sum()))
    # Every n-gram has a length of its own; a text with fewer words is as long as that.
    k = np.minimum(count, words)
    sets = [np.zeros(0, np.uint64)]
    sizes = np.zeros(len(parts), np.int64)
    f = factors(words)
    first = np.cumsum(count) - count
    for length in np.unique(k[k > 0]):
        docs = np.flatnonzero(k == length)
        runs = count[docs] - length + 1
        at, doc = ranges(first[docs], runs)
        s = np.full(len(at), U(length), dtype=np.uint64)
        for j in range(int(length)):
            s += mix(h[at + j] + f[j]) * f[j]
        s = mix(s)
        ends = np.cumsum(runs).tolist()
        for lo, hi in zip([0, *ends], ends, strict=False):
            s[lo: hi].sort()
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])))
        sizes[docs] = np.bincount(doc[new], minlength=len(docs))
        sets.append(s[new])
        k[docs] = -len(sets) + 1  # where these sets are
    if len(sets) <= 2:
        return sets[-1], sizes
    # Sets of several lengths go back to the order of the texts.
    out = np.zeros(int(sizes.sum()), np.uint64)
    start = np.cumsum(sizes) - sizes
    for i in range(1, len(sets)):
        docs = np.flatnonzero(k == -i)
        out[ranges(start[docs], sizes[docs])[0]] = sets[i]
    return out, sizes


def portions(texts: list[str]) -> Iterator[slice]:
    """Runs of texts with ``CHARS`` characters at most, or one text."""
    at, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > CHARS:
            yield slice(at, i)
            at, held = i, 0
        held += len(x)
    if at < len(texts):
        yield slice(at, len(texts))


def ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers ``start[i]`` to ``start[i] + size[i]`` (exclusive) of all ``i``, and each one's ``i``."""
    i = np.repeat(np.arange(len(size)), size)
    return np.arange(len(i)) + np.repeat(start - (np.cumsum(size) - size), size), i


STARTS: dict[int, list[int]] = {}
SHAPES: dict[tuple[int, int], tuple[int, int, int]] = {}


def band_starts(t: int) -> list[int]:
    """Least sizes of the bands: a set and any set that is at least ``t`` percent
    as large lie in the same band or in neighbouring ones."""
    if t not in STARTS:
        out = [1]
        while out[-1] < 1 << 40:
            out.append(out[-1] * 100 // t + 1)
        STARTS[t] = out
    return STARTS[t]


def band_of(n: int, t: int) -> int:
    import bisect

    return bisect.bisect_right(band_starts(t), n) - 1


def band_shape(j: int, t: int) -> tuple[int, int, int]:
    """``(D, parts, skipped)`` of band ``j``.

    ``D`` is the largest symmetric difference of a linked pair of the band. Up
    to ``D = 3`` there are so few parts that one of them differs in one bit at
    most. Beyond, ``parts = D + 1 + skipped``: at least ``skipped + 1`` parts agree.
    All sets leave out the first ``skipped`` of their parts in one and the same order
    (those that most sets have come first, as they say least). The last of the agreeing
    parts has ``skipped`` others before it in both sets, so neither leaves it out.
    """
    if (j, t) not in SHAPES:
        largest = band_starts(t)[j + 1] - 1
        d = (100 - t) * 2 * largest // (100 + t)
        skipped = max(2, round(SPARE * (d + 1))) if d > 3 else 0
        SHAPES[j, t] = d, d + 1 + skipped if d > 3 else (d + 2) // 2, skipped
    return SHAPES[j, t]


def band_keys(s: np.ndarray, j: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one set in band ``j``, and whether each is of a whole part (else
    of a part with one bit flipped)."""
    key, whole, _ = keys_of_sets(s, np.array([len(s)]), j, t)
    return key, whole


def keys_of_sets(s: np.ndarray, sizes: np.ndarray, j: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``band_keys`` of many sets, one after another in ``s``, and each key's set."""
    d, parts, _ = band_shape(j, t)
    if d == 0:  # equal sets only: they are one class already
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
    h = mix(s ^ U(j + 1))
    part = ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)
    bit = (h & U(PART_BITS - 1)) + part.astype(np.uint64) * U(PART_BITS)
    z = mix(bit + times(j + 1, 0xD6E8FEB86659FD93))
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = of * parts + part
    order = np.argsort(place)
    count = np.bincount(place, minlength=parts * len(sizes))
    xor = np.zeros(parts * len(sizes), dtype=np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        xor[some] = np.bitwise_xor.reduceat(z[order], (np.cumsum(count) - count)[some])
    salt = mix(np.arange(parts, dtype=np.uint64) + times(j + 1, 0xA0761D6478BD642F))
    key, owner = mix(xor + np.tile(salt, len(sizes))), np.repeat(np.arange(len(sizes)), parts)
    if d <= 3:
        flipped = mix((xor[place] ^ z) + salt[part])
        whole = np.arange(len(key) + len(flipped)) < len(key)
        return np.concatenate((key, flipped)), whole, np.concatenate((owner, of))
    return key, np.ones(len(key), dtype=bool), owner


def set_ids(s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """63 bits (even number) for each set, none empty: equal sets are one class."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    each = np.bitwise_xor.reduceat(mix(s + U(0x5851F42D4C957F2D)), np.cumsum(sizes) - sizes)
    return (mix(each + sizes.astype(np.uint64)) & ~U(1)).view(np.int64)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def folded(s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole sketch of each set, folded to ``FOLD`` longs."""
    out = np.zeros((len(sizes), FOLD), np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    for at in range(0, len(sizes), 64):
        some = sizes[at: at + 64]
        bit = (s[ends[at]: ends[at + len(some)]] % U(64 * FOLD)).astype(np.int64)
        bit += np.repeat(np.arange(len(some)) * (64 * FOLD), some)
        odd = np.bincount(bit, minlength=64 * FOLD * len(some)) & 1
        out[at: at + 64] = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, FOLD)
    return out


def few(df: DataFrame) -> DataFrame:
    """A stored side of a join, sent to every executor if it is bounded."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def meeting(left: DataFrame) -> DataFrame:
    """``key, sid, whole, c, size``: the buckets in which classes of the larger buckets
    ``left(key, hub, sid, whole, c, size)`` meet.

    Near copies of one text are together in most of its buckets. The buckets with one hub
    become one, in which two classes meet once, unless that makes more pairs than the
    buckets had (few classes are in two of them)."""
    own = stored(left.groupBy("hub", "sid").agg(F.max("whole").alias("whole"), F.min("c").alias("c"), F.sum("size").alias("met")),
                 "parity-hubs")
    hubs = own.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.sum("met").alias("met"))
    hubs = few(stored(hubs.filter(F.col("size").cast("double") * F.col("size") <= F.col("met")).select("hub", "size"), "parity-one"))
    one = own.join(hubs, "hub").select(F.col("hub").alias("key"), "sid", "whole", "c", "size")
    return one.unionByName(left.join(hubs, "hub", "left_anti").select("key", "sid", "whole", "c", "size"))


def dealt(members: DataFrame) -> DataFrame:
    """``key, i, j, side, sid, c, n, whole, main, sketch``: the runs ``i, j`` of a bucket in
    which a class is, as one of the rest (side 0) and as one of all (side 1); ``main`` says
    that it is of the component that most classes of the bucket are in."""
    members = stored(members, "parity-members")
    most = members.groupBy("key", "c").agg(F.count(F.lit(1)).alias("most")).groupBy("key").agg(
        F.max(F.struct("most", "c")).alias("m"), F.sum("most").alias("all"))
    most = few(stored(most.select("key", "m.most", F.col("m.c").alias("main"), "all").filter(F.col("most") < F.col("all")), "parity-main"))

    def pieces(count):
        return F.greatest(F.least(F.lit(DEAL).cast("long"), F.ceil(count / SHARE)), F.ceil(count / PIECE))

    def own(count):
        return F.pmod(F.hash("sid"), pieces(count)).cast("long")

    def every(count):
        return F.sequence(F.lit(0).cast("long"), pieces(count) - 1)

    def run(side, i, j):
        return F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))

    rest, all_ = F.col("all") - F.col("most"), F.col("all")
    rows = members.join(most, "key").withColumn("main", F.col("c") == F.col("main"))
    right = F.transform(every(rest), lambda i: run(1, i, own(all_)))
    both = F.concat(F.transform(every(all_), lambda j: run(0, own(rest), j)), right)
    rows = rows.withColumn("to", F.explode(F.when(F.col("main"), right).otherwise(both)))
    return rows.select("key", "to.i", "to.j", "to.side", "sid", "c", "n", "whole", "main", "sketch")


def block_pairs(members: DataFrame, t: int) -> DataFrame:
    """``a, b``: classes of a bucket, one there as a whole part, in different components,
    whose sizes and sketches allow a link; from ``members(key, sid, whole, c, size, n, sketch)``.

    Classes of the component that most of a bucket's classes are in need not meet each
    other: the rest meet all. Both are dealt into pieces, and every piece of the rest meets
    every piece of all in one run of a sorted partition, as two blocks of sketches in
    memory. Up to ``DEAL`` pieces of ``PIECE`` classes a class goes to ``DEAL`` runs at most,
    however large its bucket."""
    runs = dealt(members).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def run(batches):
        def meet(parts):
            side, sid, c, n, whole, main, sketch = (np.concatenate(p) for p in zip(*parts, strict=True))
            x, y = side == 0, side == 1
            for at in range(0, int(x.sum()), 32):
                rows = np.flatnonzero(x)[at: at + 32]
                apart = np.bitwise_count(sketch[rows][:, None, :] ^ sketch[y][None, :, :]).sum(axis=2, dtype=np.int64)
                na, nb = n[rows][:, None], n[y][None, :]
                ok = ((np.minimum(na, nb) * 100 >= np.maximum(na, nb) * t) & (apart * (100 + t) <= (100 - t) * (na + nb))
                      & (c[rows][:, None] != c[y][None, :]) & (whole[rows][:, None] | whole[y][None, :])
                      & (main[y][None, :] | (sid[rows][:, None] < sid[y][None, :])))
                i, j = np.nonzero(ok)
                if len(i):
                    a, b = sid[rows][i], sid[y][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j, side, sid, c, n, whole, main = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(9))
            sketch = batch.column(9).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(key), -1)
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            for lo, hi in zip(starts, [*starts[1:], len(key)], strict=True):
                this = key[lo], i[lo], j[lo]
                if this != name and held:
                    yield from meet(held)
                    held = []
                name = this
                held.append(tuple(v[lo: hi] for v in (side, sid, c, n, whole, main, sketch)))
        if held:
            yield from meet(held)

    return runs.mapInArrow(run, "a long, b long")


def jaccard_classes(docs: DataFrame, words: int, t: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``id, n_shingles, th`` (hash of the text),
    ``sid`` (class of equal sets, null without words) and ``comp`` (component of
    linked classes). See ``jaccard_components``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def describe():
        forget()  # the caches of other operators: memory is needed for sorting from here on

        def each(cols):
            for some in portions(cols[1]):
                s, sizes = shingle_sets(cols[1][some], words)
                none = sizes == 0
                sid = np.zeros(len(sizes), np.int64)
                sid[~none] = set_ids(s, sizes[~none])
                starts = np.concatenate(([0], np.cumsum(np.where(none, 0, FOLD))))
                sketch = pa.ListArray.from_arrays(pa.array(starts, pa.int32(), mask=np.append(none, False)),
                                                  pa.array(folded(s, sizes[~none]).reshape(-1)))
                yield {"id": cols[0][some], "th": cols[2][some], "n": pa.array(sizes), "sid": pa.array(sid, mask=none),
                       "sketch": sketch}
        return each

    known = stored(map_rows(rows.withColumn("th", F.xxhash64("text")),
                            f"id {kind}, th long, n long, sid long, sketch array<long>", describe), "parity-docs")
    classes = stored(known.filter("sid IS NOT NULL").groupBy("sid").agg(
        F.min("th").alias("th"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "parity-classes")

    def keys():
        seen = set()  # classes that this task has had: copies emit their keys once a task

        def each(cols):
            for some in portions(cols[0]):
                s, sizes = shingle_sets(cols[0][some], words)
                full = np.flatnonzero(sizes)
                sids, starts = set_ids(s, sizes[full]), (np.cumsum(sizes) - sizes)[full]
                new = []
                for i, sid in enumerate(sids.tolist()):
                    if sid not in seen:
                        seen.add(sid)
                        new.append(i)
                sids, starts, sizes = sids[new], starts[new], sizes[full][new]
                own = np.array([band_of(n, t) for n in sizes.tolist()], dtype=np.int64)
                for band in np.unique(np.concatenate((own, own + 1))).tolist():
                    here = np.flatnonzero((own == band) | (own == band - 1))
                    k, whole, of = keys_of_sets(s[ranges(starts[here], sizes[here])[0]], sizes[here], band, t)
                    if len(k):
                        yield {"key": pa.array(k.view(np.int64)), "v": pa.array(sids[here][of] | whole.astype(np.int64)),
                               "slot": pa.array(np.full(len(k), band << 24 | band_shape(band, t)[2], dtype=np.int64))}
        return each

    entries = map_rows(rows.select("text"), "key long, v long, slot long", keys)
    by_key = Window.partitionBy("key")

    def shared(e: DataFrame) -> DataFrame:
        """Entries whose key two classes have, one of them as a whole part; the
        least of these is the head of the bucket."""
        return (e.withColumn("head", F.min(F.when(F.col("whole"), F.col("sid"))).over(by_key))
                .withColumn("low", F.min("sid").over(by_key)).withColumn("high", F.max("sid").over(by_key))
                .filter("head IS NOT NULL AND low <> high").drop("low", "high"))

    # One shuffle of all entries, by key; what follows has shared keys only.
    sid = F.col("v").bitwiseAND(F.lit(-2)).alias("sid")
    whole = (F.col("v").bitwiseAND(F.lit(1)) == 1).alias("whole")
    bucket = shared(entries.select("key", sid, whole, "slot").withColumn("size", F.count(F.lit(1)).over(by_key)))
    bucket = bucket.drop("head").dropDuplicates(["key", "sid", "whole"])
    # Each class leaves out as many of its parts as it may, those in the largest buckets.
    spare = F.col("slot").bitwiseAND(F.lit((1 << 24) - 1))
    by_class = Window.partitionBy("sid", "slot").orderBy(F.desc("size"), "key")
    bucket = bucket.withColumn("place", F.row_number().over(by_class)).filter(F.col("place") > spare)
    bucket = shared(bucket.select("key", "sid", "whole")).withColumn("size", F.count(F.lit(1)).over(by_key))
    bucket = stored(bucket, "parity-buckets")

    narrow = classes.select("sid", "n", "sketch")
    apart = sum((F.bit_count(F.col("xa")[i].bitwiseXOR(F.col("xb")[i])) for i in range(FOLD)), F.lit(0))
    # Sizes and whole sketches that allow a link.
    may_link = ((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * t)
                & (apart * (100 + t) <= (100 - t) * (F.col("na") + F.col("nb"))))

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs ``a, b`` whose sizes and whole sketches allow a link."""
        x = narrow.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("xa"))
        y = narrow.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("xb"))
        return pairs.join(x, "a").join(y, "b").filter(may_link).select("a", "b")

    def exact_sets(pairs: DataFrame) -> DataFrame:
        """``sid, bytes`` of the classes in ``pairs``, from one text of each."""
        sids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        wanted = stored(classes.join(sids, "sid").select("th", F.col("sid").alias("want")), "parity-wanted")
        side = few(wanted)

        def sets_of():
            done = set()  # copies: one set a task

            def each(cols):
                for text, want in zip(*cols, strict=True):
                    if want not in done:
                        done.add(want)
                        yield {"sid": [want], "bytes": [shingles(text, words).tobytes()]}
            return each

        out = map_rows(rows.withColumn("th", F.xxhash64("text")).join(side, "th").select("text", "want"),
                       "sid long, bytes binary", sets_of)
        return stored(out.dropDuplicates(["sid"]), "parity-sets")

    def verified(p: DataFrame) -> DataFrame:
        """Those of the (stored) pairs whose exact sets are linked."""
        sets = exact_sets(p)
        p = p.join(sets.select(F.col("sid").alias("a"), F.col("bytes").alias("sa")), "a")
        p = p.join(sets.select(F.col("sid").alias("b"), F.col("bytes").alias("sb")), "b")

        def check():
            def each(cols):
                out = {"a": [], "b": []}
                for a, b, sa, sb in zip(*cols, strict=True):
                    x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= t * (len(x) + len(y) - both):
                        out["a"].append(a)
                        out["b"].append(b)
                if out["a"]:
                    yield out
            return each
        return map_rows(p.select("a", "b", "sa", "sb"), "a long, b long", check)

    # First turn: in each bucket a class meets the hub (the class that shares most
    # over all its buckets: of a group of near copies the one changed least), the
    # head, and its neighbour in an order drawn for the bucket. It is compared
    # with the ``PARTNERS`` classes it meets most often: a number of pairs linear in the classes.
    central = bucket.groupBy(F.col("sid").alias("c_sid")).agg(F.sum("size").alias("central"))
    hubs = bucket.join(central, F.col("sid") == F.col("c_sid")).withColumn("hub", F.max(
        F.when(F.col("whole"), F.struct("central", "sid"))).over(by_key)["sid"]).select("sid", F.col("hub").alias("other"))
    drawn = Window.partitionBy("key").orderBy(F.xxhash64("key", "sid"), "whole")
    met = bucket.withColumn("near", F.lag("sid").over(drawn)).withColumn("near_whole", F.lag("whole").over(drawn))
    met = (met.select("sid", F.col("head").alias("other")).unionByName(hubs)
           .unionByName(met.filter("whole OR near_whole").select("sid", F.col("near").alias("other")))
           .filter("sid <> other"))
    votes = met.groupBy("sid", "other").agg(F.count(F.lit(1)).alias("count"))
    most = Window.partitionBy("sid").orderBy(F.desc("count"), F.xxhash64("sid", "other"))
    best = votes.withColumn("place", F.row_number().over(most)).filter(F.col("place") <= PARTNERS)
    best = best.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()
    first = stored(verified(stored(close(best), "parity-close")), "parity-first")
    comp = components(first)

    # Second turn: classes of a bucket that are still in different components, all with
    # all in small buckets. Larger ones with one hub are taken together and their classes
    # dealt out in pieces; two pieces meet as blocks of sketches, of which only pairs that
    # may link come out.
    named = bucket.drop("size", "head").join(comp, bucket["sid"] == comp["v"], "left").join(
        central, F.col("sid") == F.col("c_sid")).select("key", "sid", "whole", F.coalesce("c", "sid").alias("c"), "central")
    spread = named.withColumn("low", F.min("c").over(by_key)).withColumn("high", F.max("c").over(by_key))
    spread = spread.withColumn("hub", F.max(F.struct("central", "sid")).over(by_key)["sid"]).filter("low <> high")
    left = stored(spread.withColumn("size", F.count(F.lit(1)).over(by_key)).drop("low", "high", "central"), "parity-left")
    small = left.filter(F.col("size") <= SMALL)
    x = small.filter("whole").select("key", F.col("sid").alias("a"), F.col("c").alias("ca"))
    y = small.select("key", F.col("sid").alias("b"), F.col("c").alias("cb"), F.col("whole").alias("wb"))
    pairs = x.join(y, "key").filter("ca <> cb AND (a < b OR NOT wb)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = close(pairs).unionByName(block_pairs(meeting(left.filter(F.col("size") > SMALL)).join(narrow, "sid"), t)).distinct()
    second = stored(verified(stored(pairs, "parity-close")), "parity-second")
    comp = components(first.unionByName(second))
    out = known.join(comp, known["sid"] == comp["v"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), "th", "sid", F.coalesce("c", "sid").alias("comp"))


def jaccard_components(docs: DataFrame, words: int = 5, t: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` for every row: its number of distinct
    word ``words``-grams and the smallest id it is linked with over any number of
    links (itself included). Two rows link when the Jaccard similarity of their
    sets is at least ``t`` percent.

    A text with fewer words is one n-gram; a null, empty or blank text has no
    set, links with nothing and is its own component. Repeated rows are linked
    (equal sets). Null ids never name a component unless it has no other id.
    Other columns are ignored.

    Equal sets are one class, so a group of copies costs no pairs. Each class is
    first compared with the few classes it shares most with; classes of a bucket
    meet each other only where that left them in different components, so no link between different texts
    is lost and groups of near copies are not expanded.
    """
    rows = stored(jaccard_classes(docs, words, t, id_col, text_col), "parity-result")
    least = rows.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("id").alias("least"))
    return rows.join(least, "comp", "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, t: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row
    with the smallest id (then text hash) stays; null ids come last. Rows
    without words link with nothing and stay; rows repeated with the same id and
    text stay once.
    """
    rows = jaccard_classes(docs, words, t, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th"))
    linked = rows.filter("comp IS NOT NULL").groupBy("comp").agg(first.alias("x")).select("x.id", "x.th")
    keep = stored(linked.unionByName(rows.filter("comp IS NULL").select("id", "th").distinct()), "parity-keep")
    keep = keep.select(F.col("id").alias("__pj_id"), F.col("th").alias("__pj_th"))
    out = docs.withColumn("__pj_hash", F.xxhash64(text_or_empty(text_col)))
    out = out.join(keep, out[id_col].eqNullSafe(F.col("__pj_id")) & (out["__pj_hash"] == F.col("__pj_th")), "left_semi")
    return out.dropDuplicates([id_col, "__pj_hash"]).drop("__pj_hash")


def op8_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 4-word shingles at a similarity of 0.85."""
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, t=85)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
"""
