"""Token-id files: patched frame-of-reference blocks in document order.

A file row ("segment") holds consecutive documents. Its payload is one stream
of ids in blocks of 128: each block stores its minimum, the differences packed
at the width that covers the 90th percentile of the block, and an exception
list (position, difference) for the wider ones. A table of block starts at the
head of the payload lets one block be read without the others.

Payload (little endian): magic ``PFR1``, u32 ids, u32 blocks; per block u32
minimum, u8 width, u8 exceptions, u32 start in 64-bit words, u32 first
exception; then the packed words, the exception positions (u8) and differences
(u32).
"""

from __future__ import annotations

import gc
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tavola.llm.common import Cache, forget, map_rows, per_worker, pieces_of, stored, table, text_or_empty

BLOCK, LANES, PERCENTILE = 128, 2, 0.9
MAGIC = b"PFR1"
SEGMENT_IDS = 1 << 18


def pack(ids: np.ndarray) -> bytes:
    """One payload from ids (any length, each below 2**32)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return MAGIC + struct.pack("<II", 0, 0)
    full = np.full(blocks * BLOCK, ids[-1], dtype=np.uint32)
    full[:n] = ids
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1)
    diff = full - low[:, None]
    bits = np.frexp(diff.astype(np.float64))[1].astype(np.uint8)
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.partition(bits, at, axis=1)[:, at]
    outlier = bits > width[:, None]
    starts = np.concatenate(([0], np.cumsum(LANES * width.astype(np.int64))))
    words = np.zeros(starts[-1], dtype=np.uint64)
    per_lane = BLOCK // LANES
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        w = int(w)
        v = (diff[rows] & np.uint32((1 << w) - 1)).astype(np.uint64).reshape(len(rows), LANES, per_lane)
        v = np.ascontiguousarray(v.transpose(2, 0, 1))
        out = np.zeros((w, len(rows), LANES), dtype=np.uint64)
        for i in range(per_lane):
            word, off = divmod(i * w, 64)
            out[word] |= v[i] << np.uint64(off)
            if off + w > 64:
                out[word + 1] |= v[i] >> np.uint64(64 - off)
        words[starts[rows][:, None] + np.arange(LANES * w)] = out.transpose(1, 2, 0).reshape(len(rows), LANES * w)
    exceptions = outlier.sum(axis=1)
    first = np.concatenate(([0], np.cumsum(exceptions)))[:-1]
    where = np.nonzero(outlier)
    return b"".join((
        MAGIC, struct.pack("<II", n, blocks), low.astype("<u4").tobytes(), width.tobytes(),
        exceptions.astype(np.uint8).tobytes(), starts[:-1].astype("<u4").tobytes(), first.astype("<u4").tobytes(),
        words.astype("<u8").tobytes(), where[1].astype(np.uint8).tobytes(), diff[where].astype("<u4").tobytes()))


class Payload:
    """Reader of one payload."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token payload")
        self.n, self.blocks = struct.unpack_from("<II", data, 4)
        at, b = 12, self.blocks

        def take(kind, count):
            nonlocal at
            x = np.frombuffer(data, kind, count, at)
            at += x.nbytes
            return x
        self.low, self.width, self.exceptions = take("<u4", b), take("u1", b), take("u1", b)
        self.start, self.first = take("<u4", b), take("<u4", b)
        self.words = take("<u8", int(LANES * self.width.astype(np.int64).sum()))
        total = int(self.exceptions.astype(np.int64).sum())
        self.position, self.value = take("u1", total), take("<u4", total)

    def read(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the given blocks, one row each."""
        out = np.zeros((len(rows), BLOCK), dtype=np.uint32)
        per_lane = BLOCK // LANES
        for w in np.unique(self.width[rows]):
            if not w:
                continue
            at = np.flatnonzero(self.width[rows] == w)
            w = int(w)
            src = self.words[self.start[rows[at]].astype(np.int64)[:, None] + np.arange(LANES * w)]
            src = np.ascontiguousarray(src.reshape(len(at), LANES, w).transpose(2, 0, 1))
            v, mask = np.empty((per_lane, len(at), LANES), dtype=np.uint32), np.uint64((1 << w) - 1)
            for i in range(per_lane):
                word, off = divmod(i * w, 64)
                x = src[word] >> np.uint64(off)
                if off + w > 64:
                    x = x | (src[word + 1] << np.uint64(64 - off))
                v[i] = x & mask
            out[at] = v.transpose(1, 2, 0).reshape(len(at), BLOCK)
        count = self.exceptions[rows].astype(np.int64)
        if count.any():
            row = np.repeat(np.arange(len(rows)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            src = np.repeat(self.first[rows].astype(np.int64), count) + k
            out[row, self.position[src]] = self.value[src]
        return out + self.low[rows][:, None]

    def block(self, b: int) -> np.ndarray:
        """One block alone, found through the table of starts."""
        return self.read(np.array([b]))[0][: min(BLOCK, self.n - b * BLOCK)]

    def all(self) -> np.ndarray:
        return self.read(np.arange(self.blocks)).reshape(-1)[: self.n] if self.n else np.zeros(0, np.uint32)


# Stretches of one optional run of ASCII white space and what follows it. The
# byte-level split pattern never joins characters across the start of such a
# run, so each stretch has the same ids alone as in the text.
STRETCH = re.compile("[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]")
# Nothing but single blanks and line ends between stretches: plain splitting will do.
UNEVEN = r"[ \n]{2}|[\t\r\x0b\x0c\x00]"
# A stretch with at most one blank in front: between line ends it has the ids it has alone.
PLAIN = re.compile(r" ?[^ \t\n\r\x0b\x0c]+\Z")
# A stretch of one word of Latin letters and the marks after it: the byte-level pattern
# parts it there and nowhere else.
WORDS = r"\A ?[A-Za-zÀ-ÖØ-öø-ɏ]+[.,;:!?()\"-]*\z"
MARKS = re.compile(r"[.,;:!?()\"-]+")
LINES = 256                             # stretches that the library gets as one text
CACHE_BYTES, LONGEST = 256 << 20, 48    # of a worker that encodes; texts of at most so many characters
ROWS = 500                              # texts that are handled at once


def byte_level() -> dict[int, str]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


BYTE_LEVEL = np.array([ord(c) for _, c in sorted(byte_level().items())], dtype="<u2")


class TextIds:
    """Ids (little-endian u32 bytes) of whole texts from the tokenizers library,
    asked once for each different stretch that the bounded cache still holds."""

    def __init__(self, vocabulary: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(vocabulary)
        self.model = Tokenizer(self.lib.model)  # the library's model without a look for words
        with open(vocabulary, encoding="utf-8") as f:
            told = json.load(f)
        special = [t["content"] for t in told["added_tokens"]]
        self.parted = self.parts(told)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.seen = Cache(CACHE_BYTES)
        self.line_end, = self.lib.encode("\n", add_special_tokens=False).ids

    @staticmethod
    def parts(told: dict) -> tuple[int, int] | None:
        """Ids of two bytes that no text holds and no longer token does, if the vocabulary
        is plain byte-level BPE: between them the library's model sees words apart."""
        model, split, vocab = told["model"], told["pre_tokenizer"] or {}, told["model"]["vocab"]
        plain = (model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                 and not split.get("add_prefix_space") and not told["normalizer"] and not told["post_processor"]
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                    "byte_fallback", "ignore_merges")))
        if not plain or "þ" not in vocab or "ÿ" not in vocab or any(len(t) > 1 and ("þ" in t or "ÿ" in t) for t in vocab):
            return None
        return vocab["ÿ"], vocab["þ"]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        ids = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        data = np.fromiter(chain.from_iterable(ids), dtype="<u4").tobytes()
        ends = list(accumulate(map(len, ids)))
        return [data[4 * a: 4 * b] for a, b in zip([0, *ends], ends, strict=False)]

    def apart(self, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch. Plain ones go to the library together, a line end between any
        two: none of them holds one, and no token goes over it, so its id parts theirs."""
        found, stretches_ = self.words(stretches) if self.parted else ({}, stretches)
        plain = [p for p in stretches_ if PLAIN.match(p)]
        lines = [plain[at: at + LINES] for at in range(0, len(plain), LINES)]
        for line, data in zip(lines, self.encode(["\n".join(x) for x in lines]), strict=True):
            ends = np.flatnonzero(np.frombuffer(data, "<u4") == self.line_end).tolist()
            starts, ends = [0, *[e + 1 for e in ends]], [*ends, len(data) // 4]
            found.update((p, data[4 * a: 4 * b]) for p, a, b in zip(line, starts, ends, strict=True))
        other = [p for p in stretches if p not in found]
        found.update(zip(other, self.encode(other), strict=True))
        return [found[p] for p in stretches]

    def words(self, stretches: list[str]) -> tuple[dict[str, bytes], list[str]]:
        """Ids of the stretches that are one word and the marks after it, and the other
        stretches. The model gets many at once, parted by bytes that it joins with nothing,
        so the library need not look for words in them."""
        is_word = pc.match_substring_regex(pa.array(stretches, pa.large_string()), WORDS).to_numpy(zero_copy_only=False)
        some, other = list(compress(stretches, is_word)), list(compress(stretches, ~is_word))
        stretch_end, word_end = self.parted
        lines = [MARKS.sub("\ue000\\g<0>", "\ue001".join(some[at: at + LINES])).encode()
                 .replace(b"\xee\x80\x80", b"\xfe").replace(b"\xee\x80\x81", b"\xff") for at in range(0, len(some), LINES)]
        lines = [BYTE_LEVEL[np.frombuffer(x, np.uint8)].tobytes().decode("utf-16-le") for x in lines]
        ids = [[*e.ids, stretch_end] for e in self.model.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(ids), "<u4")
        ids = ids[ids != word_end]
        ends = np.flatnonzero(ids == stretch_end).tolist()
        data = ids.tobytes()
        found = {p: data[4 * a: 4 * b] for p, a, b in zip(some, [0, *[e + 1 for e in ends]], ends, strict=False)}
        if not len(found) == len(some) == len(ends):
            raise ValueError("the model joined words with the bytes between them")
        return found, other

    @staticmethod
    def stretches(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The stretches of all texts one after another, and how many each text has."""
        count = np.zeros(len(texts), np.int64)
        even = pa.array(texts, pa.large_string())
        uneven = pc.match_substring_regex(even, UNEVEN).to_numpy(zero_copy_only=False)
        even = even.filter(pa.array(~uneven))
        even = pc.replace_substring(pc.replace_substring(even, " ", "\0 "), "\n", "\0\n\0")
        even = pc.split_pattern(even, "\0")
        odd = [STRETCH.findall(t) for t in compress(texts, uneven)]
        count[~uneven], count[uneven] = pc.list_value_length(even).to_numpy(), list(map(len, odd))
        if not odd:
            return even.flatten(), count
        # They stand in the order of the texts.
        parts = pa.concat_arrays([even.flatten(), pa.array(list(chain.from_iterable(odd)), pa.large_string())])
        order = np.argsort(np.repeat(np.concatenate((np.flatnonzero(~uneven), np.flatnonzero(uneven))),
                                     np.concatenate((count[~uneven], count[uneven]))), kind="stable")
        return parts.take(pa.array(order)), count

    def __call__(self, texts: list[str]) -> list[bytes]:
        # Nothing here makes cycles, and the collector would look through all stretches each time.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self.ids(texts)
        finally:
            if collects:
                gc.enable()

    def ids(self, texts: list[str]) -> list[bytes]:
        seen, out, split, whole = self.seen, [b""] * len(texts), [], []
        for i, t in enumerate(texts):
            (whole if OTHER_SPACE.search(t) or self.special and self.special.search(t) else split).append(i)
        for i, x in zip(whole, self.encode([texts[i] for i in whole]), strict=True):
            out[i] = x
        if not split:
            return out
        # The different stretches of all these texts are looked up, then each stands where it is.
        stretches, count = self.stretches([texts[i] for i in split])
        coded = stretches.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        made = list(map(seen.young.get, names))
        missing = [i for i, x in enumerate(made) if x is None]
        back = {}
        for i in missing:
            x = made[i] = seen.old.pop(names[i], None)
            if x is not None:
                back[names[i]] = x
        seen.add(back)
        new = [i for i in missing if made[i] is None]
        asked = [names[i] for i in new]
        fresh = self.apart(asked)
        for i, x in zip(new, fresh, strict=True):
            made[i] = x
        ids = np.frombuffer(b"".join(made), "<u4")
        length = np.fromiter(map(len, made), np.int64, len(made)) // 4
        at = coded.indices.to_numpy()
        size = length[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        data = ids[np.arange(ends[-1]) + np.repeat((np.cumsum(length) - length)[at] - ends[:-1], size)].tobytes()
        ends = (4 * ends[np.concatenate(([0], np.cumsum(count)))]).tolist()
        for i, a, b in zip(split, ends, ends[1:], strict=False):
            out[i] = data[a: b]
        seen.add({p: x for p, x in zip(asked, fresh, strict=True) if len(p) <= LONGEST})
        return out


FILE = "part int, segment int, before long, n_ids long, doc_ids array<{id}>, lengths array<long>, payload binary"


def write_token_files(df: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, write the files in ascending
    id order below the shared folder and return the written rows.

    Rows are range-sorted by (id, hash of the text), so no task gets more than
    its share even when ids repeat; null ids come first; a null text is empty
    (its only id is ``end_id``). A segment closes after ``SEGMENT_IDS`` ids or
    4,096 documents, so a task holds one segment and one batch of texts.
    """
    kind = df.schema[id_col].dataType.simpleString()
    src = (df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
           .withColumn("tie", F.xxhash64("text")))
    src = src.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = FILE.format(id=kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(("ids", vocabulary), lambda: TextIds(vocabulary))
        part = TaskContext.get().partitionId()
        ids, lengths, parts, held, before, segment = [], [], [], 0, 0, 0

        def close():
            row = [part, segment, before, held, ids, lengths, pack(np.frombuffer(b"".join(parts), "<u4"))]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in (piece for whole in batches for piece in pieces_of(whole, ROWS)):
            cols = [c.to_pylist() for c in batch.columns]
            for doc, x in zip(cols[0], encode(cols[1]), strict=True):
                ids.append(doc)
                lengths.append(len(x) // 4 + 1)
                parts += (x, end)
                held += lengths[-1]
                if held >= SEGMENT_IDS or len(ids) >= 4096:
                    yield close()
                    before, segment = before + held, segment + 1
                    ids, lengths, parts, held = [], [], [], 0
        if ids:
            yield close()

    return stored(src.mapInArrow(run, schema), "token-files", compression="none")


def _placed(files: DataFrame) -> DataFrame:
    """Segments with ``first``, the number of ids before them."""
    # One row for each written partition, so the unpartitioned window and the
    # broadcast are bounded by the number of partitions.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("total"))
    offsets = totals.select("part", F.coalesce(
        F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return files.join(F.broadcast(offsets), "part").withColumn("first", F.col("offset") + F.col("before"))


def read_token_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents read back from written files: id, ``start`` (ids of all
    documents before it), ``n_tokens`` and the unsigned crc32 of its ids."""
    rows = _placed(files).select("first", "doc_ids", "lengths", "payload")
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def make():
        forget()  # what the writers' cache takes is needed elsewhere now

        def each(cols):
            for first, ids, lengths, payload in zip(*cols, strict=True):
                data = memoryview(Payload(payload).all().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(data[4 * (e - n): 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                yield {id_col: ids, "start": (first + ends - np.array(lengths)).tolist(), "n_tokens": lengths,
                       "ids_crc32": crc}
        return each

    return map_rows(rows, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long", make, rows=16)


def read_ids(files: DataFrame, start: int, stop: int) -> DataFrame:
    """``position, token``: the ids at positions ``start`` to ``stop`` (exclusive) of all ids in
    order. Of the segments that overlap only the blocks that do are unpacked, found
    through their table of starts."""
    rows = _placed(files).select("first", "n_ids", "payload").filter((F.col("first") < stop) & (F.col("first") + F.col("n_ids") > start))

    def make():
        def each(cols):
            for first, n, payload in zip(*cols, strict=True):
                data, low, high = Payload(payload), max(start - first, 0), min(stop - first, n)
                blocks = np.arange(low // BLOCK, -(-high // BLOCK))
                ids = data.read(blocks).reshape(-1)[low - blocks[0] * BLOCK: high - blocks[0] * BLOCK]
                yield {"position": np.arange(first + low, first + high).tolist(), "token": ids.tolist()}
        return each

    return map_rows(rows, "position long, token long", make, rows=16)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of every whole document under byte_bpe_50k.json, read them back."""
    import public_tokenizers

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"),
                                              public_tokenizers.path("byte_bpe_50k.json")))
