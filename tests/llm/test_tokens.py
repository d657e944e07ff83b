"""Token counts, token files and piece codec against the public libraries."""

import hashlib
import os
import zlib

import numpy as np
import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import public_tokenizers as P  # noqa: E402

from tavola.llm.piece_viterbi import PieceModel, encode  # noqa: E402
from tavola.llm.token_counts import TextCounter, count_tokens  # noqa: E402
from tavola.llm.common import Cache  # noqa: E402
from tavola.llm.token_files import TextIds, pack, Payload, read_ids, read_token_files, write_token_files  # noqa: E402

WORDS, BYTES, PIECES = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    "Hello world, it's fine.", "", " ", "\n", "  two  blanks \n\n here\t ", "a<|endoftext|>b <|startoftext|>c",
    "ΑΣ ΑΣΑ Straße İi", "日本語のテキスト 😀👍🏽", "é  x　y", "a\x1cb!\x85!", "x" * 3000, "ab\x00c", "▁a▁▁b",
    "<0x41><s>", "12 345 6.7", "don't I'LL we'RE", "   lead", "trail   ", "word " * 4000, "a     b", "नमस्ते ﬁ Ⅷ"]
# clashing names, a null text, a null id, repeated rows
ROWS = [(i, t, i, "x") for i, t in enumerate(TEXTS)] + [(3, "\n", 3, "x"), (None, "null id", 0, "y"), (90, None, 0, None)]
SCHEMA = "doc_id long, text string, n_tokens int, start string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(WORDS)
    want = sorted(((i, len((t or "").encode()), n, n > 2048) for (i, t, _, _), n in
                   zip(ROWS, [len(e.ids) for e in lib.encode_batch([r[1] or "" for r in ROWS], add_special_tokens=False)],
                       strict=True)), key=str)
    got = sorted((tuple(r) for r in count_tokens(docs, WORDS).collect()), key=str)
    assert got == want
    assert any(r[3] for r in got)


def test_count_of_every_low_code_point():
    from tokenizers import Tokenizer
    lib, count = Tokenizer.from_file(WORDS), TextCounter(WORDS)
    texts = [f"a{chr(c)}b{chr(c)}{chr(c)} 1" for c in range(0x700)]
    assert [count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(BYTES)
    ids = TextIds(BYTES)
    for _ in range(2):  # second time from the cache
        got = [np.frombuffer(x, "<u4").tolist() for x in ids(TEXTS)]
        assert got == [e.ids for e in lib.encode_batch(TEXTS, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 4000])
@pytest.mark.parametrize("top", [1, 2, 1 << 16, 1 << 32])
def test_payload_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint32)
    ids[:: 37] = 0
    p = Payload(pack(ids))
    assert (p.all() == ids).all()
    for b in range(p.blocks):
        assert (p.block(b) == ids[128 * b: 128 * (b + 1)]).all()


def test_outliers_are_exceptions():
    ids = np.arange(128, dtype=np.uint32) % 8
    ids[[5, 77]] = 1 << 30
    p = Payload(pack(ids))
    assert p.width[0] == 3 and p.exceptions[0] == 2 and (p.all() == ids).all()
    with pytest.raises(ValueError):
        Payload(b"nothing")


def test_files_in_id_order(spark, docs):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(BYTES)
    files = write_token_files(docs, BYTES)
    got = sorted((tuple(r) for r in read_token_files(files).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])  # null ids first
    at, texts = 0, {}
    for i, t, _, _ in ROWS:
        data = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4").tobytes()
        texts[i] = (len(data) // 4, zlib.crc32(data))
    for i, start, n, crc in got:
        assert start == at and (n, crc) == texts[i]
        at += n


def test_any_range_of_ids(spark, docs, monkeypatch):
    from tavola.llm import token_files
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 300)
    files = write_token_files(docs, BYTES)
    total = files.agg({"n_ids": "sum"}).first()[0]
    every = {r["position"]: r["token"] for r in read_ids(files, 0, total).collect()}
    assert sorted(every) == list(range(total)) and files.count() > 1
    for start, stop in ((0, 1), (5, 5), (127, 130), (290, 700), (total - 3, total + 9)):
        got = {r["position"]: r["token"] for r in read_ids(files, start, stop).collect()}
        assert got == {i: every[i] for i in range(start, min(stop, total))}


def test_cache_is_bounded_by_bytes():
    cache = Cache(100_000)
    made = {f"word{i}": bytes(1 + i % 40) for i in range(5000)}
    for k, v in made.items():
        if cache.young.get(k) is None and cache.again(k) is None:
            cache.add({k: v})
        cache.young.get("word0") or cache.again("word0") or cache.add({"word0": made["word0"]})  # asked for all the time
        held = cache.young | cache.old
        assert sum(Cache.ENTRY + len(a) + len(b) for a, b in held.items()) <= 100_000 + 300
        assert all(made[a] == b for a, b in held.items())
    assert "word0" in cache.young | cache.old and len(cache.young | cache.old) > 150


@pytest.mark.parametrize("limit", [0, 2000])
def test_a_small_cache_changes_nothing(spark, docs, limit):
    ids = TextIds(BYTES)
    want = ids([t or "" for _, t, _, _ in ROWS])
    ids.seen = Cache(limit)
    for _ in range(2):
        assert [ids([t or ""])[0] for _, t, _, _ in ROWS] == want


def test_codec_equals_the_library(spark, docs):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r for r in encode(docs, PIECES).collect()}
    for i, t, _, _ in ROWS:
        want = lib.encode(t or "")
        r = got[i]
        assert r["ids"] == want and r["n_pieces"] == len(want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, dtype="<u4").tobytes())
        assert r["decoded_md5"] == hashlib.md5(lib.decode(want).encode()).hexdigest()
        assert r["round_trip"] == ("▁" not in (t or ""))


def test_stream_keeps_a_bounded_window():
    import random
    import sentencepiece
    lib, m = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceModel(PIECES)
    text = "".join(random.Random(1).choice("abcdefghijklmnopqrstéж日") for _ in range(20000))
    out = list(m.viterbi("▁" + text))
    assert 0 < m.widest < 20 * m.longest  # committed long before the end
    assert m.id_bytes(out) == np.array(lib.encode(text), dtype="<u4").tobytes()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert count_tokens(none, WORDS).count() == 0
    assert read_token_files(write_token_files(none, BYTES)).count() == 0
    assert encode(none, PIECES).count() == 0


def test_words_reach_the_model_apart(monkeypatch):
    """Words and marks after them are not looked for again by the library; all ids equal its own."""
    encode = TextIds(BYTES)
    texts = ["Straße, naïve. Ça va?! (el) niño; é É Ŷ 'tis don't it's \"so\" a-b x_y 12, a1 ªb µ. ٣ 中文, ǅ ȷ þ ÿ þÿ.", "Wort", "",
             "plain words only, and marks.) after --them;\n next\n\nline. end"]
    asked, library = [], encode.encode
    monkeypatch.setattr(encode, "encode", lambda x: (asked.extend(x), library(x))[1])
    got = encode(texts)
    from tokenizers import Tokenizer

    want = [Tokenizer.from_file(BYTES).encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert "plain" not in " ".join(asked) and "Straße" not in " ".join(asked)
    monkeypatch.setattr(encode, "parted", None)
    encode.seen = Cache(1 << 20)
    assert encode(texts) == got
    import gc
    assert gc.isenabled()


def test_stretches_of_many_texts_are_coded_together(monkeypatch):
    """Even, uneven and special texts of one batch keep their order, each different stretch is
    looked up once a batch, and all ids equal the library's own."""
    from tokenizers import Tokenizer

    encode, lib = TextIds(BYTES), Tokenizer.from_file(BYTES)
    texts = [x for t in TEXTS for x in (t, "one two one", "even words, one\nline (two).", "tab\tand  blanks one", "", "two ")]
    asked, words = [], encode.words
    monkeypatch.setattr(encode, "words", lambda x: (asked.extend(x), words(x))[1])
    got = [np.frombuffer(x, "<u4").tolist() for x in encode(texts)]
    assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert len(asked) == len(set(asked)) and " one" in asked
    stretches, count = encode.stretches(["a b", "c  d", "", "e\nf", "\t"])
    assert stretches.to_pylist() == ["a", " b", "c", "  d", "", "e", "\n", "f", "\t"] and count.tolist() == [2, 2, 1, 3, 1]
    assert encode([]) == [] and encode(["<|endoftext|>"]) == [np.array(lib.encode("<|endoftext|>").ids, "<u4").tobytes()]
