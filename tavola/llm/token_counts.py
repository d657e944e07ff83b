"""Token counts by heap-and-linked-list byte-pair merging.

The pieces of a text come from the vocabulary file's own normaliser and split
pattern; each piece is then merged with a heap of (rank, position) over a
doubly linked list of symbols. Only the number of merges is kept: the count is
``initial symbols - merges`` and no token id is ever looked up.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm.common import map_rows, per_worker, small_batches, table

# Characters for which Python's Unicode tables and the tokenizer library's are
# known to agree (every code point below the limit was compared); a text with
# any other character is normalised and split by the library itself. The
# separators 0x1c-0x1f and 0x85 are left out: the two disagree on white space.
ODD = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\u052f]")
# Fixed value: the split pattern of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHE_ROWS = 1_000_000


def byte_chars() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    code = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
    return [chr(code[b]) for b in range(256)]


class MergeCounter:
    """Counts tokens of one piece under a merge list (ranks = list order)."""

    def __init__(self, merges, vocab, suffix: str = ""):
        # merge of two symbols -> rank; symbols are kept as strings
        self.rank = {}
        for i, m in enumerate(merges):
            a, b = m if not isinstance(m, str) else m.split(" ")
            self.rank[a, b] = i
        self.vocab, self.suffix = vocab, suffix

    def count(self, piece: str) -> int:
        """``piece`` in the vocabulary's byte characters."""
        sym = list(piece)
        if self.suffix and sym:
            sym[-1] += self.suffix
        sym = [s for s in sym if s in self.vocab]  # no unknown token: such a symbol is left out
        n = len(sym)
        if n < 2:
            return n
        rank, heap = self.rank, []
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        for i in range(n - 1):
            r = rank.get((sym[i], sym[i + 1]))
            if r is not None:
                heap.append((r, i, sym[i], sym[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one side has merged with something else meanwhile
            sym[i], sym[j] = a + b, None
            k = right[i] = right[j]
            merges += 1
            if k < n:
                left[k] = i
                r = rank.get((sym[i], sym[k]))
                if r is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            h = left[i]
            if h >= 0:
                r = rank.get((sym[h], sym[i]))
                if r is not None:
                    heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return n - merges


class TextCounter:
    """Token count of whole texts for a vocabulary file of the word-end kind."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.lib = Tokenizer.from_file(path)
        special = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pieces = regex.compile(SPLIT).findall
        self.bytes = byte_chars()
        m = model["model"]
        self.merge = MergeCounter(m["merges"], m["vocab"], m.get("end_of_word_suffix") or "")
        self.seen: dict[str, int] = {}

    def piece(self, p: str) -> int:
        return self.merge.count("".join(self.bytes[b] for b in p.encode("utf-8", "surrogatepass")))

    def word(self, w: str) -> int:
        """One white-space-free stretch of normalised text."""
        n = sum(map(self.piece, self.pieces(w)))
        if len(w) <= 64:
            self.seen[w] = n
        return n

    def plain(self, text: str) -> int:
        if ODD.search(text):
            norm = self.lib.normalizer.normalize_str(text)
            return sum(self.merge.count(p) for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(norm))
        norm = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if len(self.seen) > CACHE_ROWS:
            self.seen.clear()
        get, total = self.seen.get, 0
        for w in norm.split():
            n = get(w)
            total += self.word(w) if n is None else n
        return total

    def __call__(self, text: str) -> int:
        if self.special and "<" in text and (hits := self.special.findall(text)):
            return len(hits) + sum(map(self.plain, self.special.split(text)))
        return self.plain(text)


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for every row of ``df``.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids
    stay as they are; other columns are ignored. ``vocabulary`` is a path that
    every executor can open. A text is handled whole, whatever its length; the
    memory beyond it is a bounded cache of short words.
    """
    small_batches(df.sparkSession)

    def make():
        count = per_worker(("count", vocabulary), lambda: TextCounter(vocabulary))

        def each(cols):
            ids, texts = cols
            texts = [t or "" for t in texts]
            n = list(map(count, texts))
            yield {id_col: ids, "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
                   "n_tokens": n, "over_limit": [x > limit for x in n]}
        return each

    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    return map_rows(src, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean", make)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document under word_bpe_49k.json."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
