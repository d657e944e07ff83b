"""Encoding and decoding with a SentencePiece model by a streaming Viterbi pass.

For every position of the text the pass keeps the last piece of the best
segmentation up to there and a pointer to where that piece starts. Only as many
positions as the longest piece has characters can still be continued; as soon
as the paths back from all of them meet in one boundary, the ids before it are
committed and forgotten, so the state stays small for texts of any length.

The model's merges define which segmentation is best: a piece ``t`` may follow
the piece ``p`` exactly if the characters of ``p + t`` alone merge into ``p, t``.
Prefixes of a text then have one valid last piece each, and the committed ids
are those that merging the whole text gives.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm.common import map_rows, per_worker, small_batches, table, text_or_empty

SPACE = "▁"
NORMAL, CONTROL, BYTE = 1, 3, 6          # fixed values: piece types of the model format
CACHE_ROWS, LONGEST = 1_200_000, 40
UNIT = re.compile(f"({SPACE}*)([^{SPACE}]*)")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one serialised protocol-buffer message."""
    def varint(i):
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, i
    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, i = varint(i)
            value = data[i: i + size]
            i += size
        yield key >> 3, value


class PieceModel:
    """Pieces of a model file: ids and bytes for normal text, merges by score.

    Models of the byte-fallback merge kind without text normalisation are
    read (identity rule, leading blank added, blanks kept).
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.ids: dict[str, int] = {}
        score: dict[str, float] = {}
        self.byte = [0] * 256
        self.text: list[bytes] = []
        rules = {}
        for number, value in fields(data):
            if number == 1:
                p = dict(fields(value))
                piece, kind = p[1].decode(), p.get(3, NORMAL)
                i = len(self.text)
                self.text.append(b"" if kind == CONTROL else piece.replace(SPACE, " ").encode())
                if kind == NORMAL:
                    self.ids[piece] = i
                    score[piece] = struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0]
                elif kind == BYTE:
                    b = int(piece[1:-1], 16)
                    self.byte[b] = i
                    self.text[i] = bytes([b])
            elif number == 3:
                rules = dict(fields(value))
        if rules.get(1) != b"identity" or rules.get(3, 1) != 1 or rules.get(4, 1) != 0:
            raise ValueError("only models with the identity rule, a leading blank and kept blanks are read")
        blanks = [p for p in self.ids if not p.strip(SPACE)]
        if any(SPACE in p[1:] for p in self.ids if p not in blanks):
            raise ValueError("a piece goes over a word boundary")
        self.longest = max(map(len, self.ids))
        # Beginnings of pieces: True for a whole piece.
        self.starts = {p[:k]: False for p in self.ids for k in range(1, len(p))} | dict.fromkeys(self.ids, True)
        self.blank = self.ids[SPACE]
        self.seen: dict[str, bytes] = {}
        self.runs: dict[int, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, tuple[str, str] | None] = {}
        # Equal scores (runs of blanks) have one rank.
        place = {x: i for i, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: place[x] for p, x in score.items()}
        self.widest = 0

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces by merging the pair of highest score (then leftmost) until none
        is left, and the last pair merged."""
        sym: list[str | None] = list(text)
        n, rank, heap, pair = len(sym), self.rank, [], None
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))

        def push(i, j):
            r = rank.get(sym[i] + sym[j])
            if r is not None:
                heapq.heappush(heap, (r, i, sym[i], sym[j]))
        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            pair = (a, b)
            sym[i], sym[j] = a + b, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                push(i, right[i])
            if left[i] >= 0:
                push(left[i], i)
        return [s for s in sym if s is not None], pair

    def halves(self, t: str) -> tuple[str, str] | None:
        """The two pieces that merge into ``t`` last; None if ``t`` does not come
        about by merging or its parts are ranked after it."""
        h = self.parts.get(t, 0)
        if h == 0:
            whole, h = self.merged(t)
            if whole != [t] or h is None or max(self.rank.get(h[0], -1), self.rank.get(h[1], -1)) >= self.rank[t] \
                    or any(len(x) > 1 and self.halves(x) is None for x in h):
                h = None
            self.parts[t] = h
        return h

    def alone(self, t: str) -> bool:
        """Whether the characters of ``t`` merge into ``t``."""
        return len(t) == 1 or self.halves(t) is not None or self.merged(t)[0] == [t]

    def follows(self, p: str, t: str) -> bool:
        """Whether ``p + t`` merges into ``p, t``.

        The two pieces are taken apart in the reverse of the order in which
        merging forms them. Whenever two parts stand at the boundary, they must
        not merge before the next part on either side does (of equal ranks the
        left one goes first).
        """
        rank, halves = self.rank, self.halves
        if len(p) > 1 and halves(p) is None or len(t) > 1 and halves(t) is None:
            return self.merged(p + t)[0] == [p, t]
        until_p = until_t = 1 << 60
        while True:
            m = rank.get(p + t)
            if m is not None and m < until_p and m <= until_t:
                return False
            rp, rt = rank[p] if len(p) > 1 else -1, rank[t] if len(t) > 1 else -1
            if rp < 0 and rt < 0:
                return True
            if rp > rt:
                until_p, p = rp, self.parts[p][1]
            else:
                until_t, t = rt, self.parts[t][0]

    def viterbi(self, text: str) -> Iterator[str]:
        """Pieces of a text, committed as early as possible; the state covers the
        positions from the last committed boundary on."""
        longest, starts, pairs, n = self.longest, self.starts, self.pairs, len(text)
        base = 0
        last: dict[int, str | None] = {0: None}   # position -> last piece; its length points back
        for at in range(n):
            # ``last[at]`` is final: try every piece that starts here.
            p = last[at]
            for end in range(at + 1, min(n, at + longest) + 1):
                t = text[at:end]
                kind = starts.get(t)
                if kind is None:
                    if end == at + 1:
                        last[end] = t  # a character without a piece merges with nothing
                    break
                if kind and end not in last:
                    ok = pairs.get((p, t))
                    if ok is None:
                        if len(pairs) > CACHE_ROWS:
                            pairs.clear()
                        ok = pairs[p, t] = self.alone(t) and (p not in self.ids or self.follows(p, t))
                    if ok:
                        last[end] = t
            if at - base >= 4 * longest:
                # Positions that can still be reached or continued, back to one boundary.
                live = {x for x in last if x > at}
                live |= set(range(at + 1 - longest, at + 1))
                while len(live) > 1:
                    x = max(live)
                    live.remove(x)
                    live.add(x - len(last[x]))
                done = live.pop()
                if done > base:
                    yield from self.back(last, base, done)
                    last = {x: q for x, q in last.items() if x >= done}
                    base = done
                self.widest = max(self.widest, len(last))
        yield from self.back(last, base, len(text))

    @staticmethod
    def back(last: dict, start: int, end: int) -> list[str]:
        out = []
        while end > start:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def id_bytes(self, pieces) -> bytes:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return np.array(out, dtype="<u4").tobytes()

    def word(self, w: str) -> bytes:
        """Ids of one blank and a stretch without blanks."""
        x = self.id_bytes(self.viterbi(SPACE + w))
        if len(w) <= LONGEST:
            if len(self.seen) > CACHE_ROWS:
                self.seen.clear()
            self.seen[w] = x
        return x

    def run(self, k: int) -> bytes:
        """Ids of ``k`` blanks alone (their merges all have one score, the leftmost first)."""
        x = self.runs.get(k)
        if x is None:
            x = self.id_bytes(self.merged(SPACE * k)[0])
            if k <= 256:
                self.runs[k] = x
        return x

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers.

        No piece goes over a blank that follows another character, so every path
        passes there: the text is handled from blank to blank.
        """
        if not text:
            return b""
        seen, word = self.seen, self.word
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            out = []
            for w in text.split(" "):
                x = seen.get(w)
                out.append(word(w) if x is None else x)
            return b"".join(out)
        out, first = [], struct.pack("<I", self.blank)
        for m in UNIT.finditer(SPACE + text.replace(" ", SPACE)):
            k, w = len(m[1]), m[2]
            if not w:
                out.append(self.run(k))
                continue
            x = seen.get(w)
            x = word(w) if x is None else x
            if k > 1:  # the last blank joins the word if it can, the others each other
                x = self.run(k) + x[4:] if x[:4] == first else self.run(k - 1) + x
            out.append(x)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces put together, without the leading blank."""
        data = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """``id, n_pieces, ids_crc32, decoded_md5, round_trip`` and (``ids``) the
    array of ids for every row, in any order.

    ``ids_crc32`` is the unsigned crc32 of the ids as little-endian 32-bit
    integers; ``round_trip`` tells whether decoding the ids gives the text
    (it does unless the text itself holds the blank mark U+2581). A null text is
    empty: no ids, decoded to the empty text. Null and repeated ids stay; other
    columns are ignored. Characters without a piece become byte pieces.
    """
    import hashlib

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        m = per_worker(("pieces", model), lambda: PieceModel(model))

        def each(cols):
            data = [m.encode(t) for t in cols[1]]
            text = [m.decode(x) for x in data]
            out = {id_col: cols[0], "n_pieces": [len(x) // 4 for x in data], "ids_crc32": list(map(zlib.crc32, data)),
                   "decoded_md5": [hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in text],
                   "round_trip": [a == b for a, b in zip(text, cols[1], strict=True)]}
            if ids:
                ends = np.cumsum([0, *out["n_pieces"]], dtype=np.int32)
                out["ids"] = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(data), "<i4"))
            yield out
        return each

    schema = f"`{id_col}` {kind}, n_pieces long, ids_crc32 long, decoded_md5 string, round_trip boolean"
    return map_rows(df.select(F.col(id_col), text_or_empty(text_col).alias(text_col)),
                    schema + ", ids array<int>" * ids, make)


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded with piece_bpe_32k.model and decoded again."""
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)
