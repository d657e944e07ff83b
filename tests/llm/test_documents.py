"""Line spread, personal data, near-duplicates and components against brute force."""

import math
import random
import re

import numpy as np
import pytest

from tavola.llm import disclosure, line_spread, parity_join
from tavola.llm.components import components
from tavola.llm.disclosure import KINDS, base_spans, luhn, sanitise
from tavola.llm.line_spread import remove_spread_lines, without_boilerplate
from tavola.llm import parity_join
from tavola.llm.parity_join import band_keys, band_of, band_shape, band_starts, jaccard_components, one_of_each, shingles

SCHEMA = "doc_id long, text string, source string, n_chars int, lang string, n_lines int, th long, head string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, None if t is None else len(t), "en", 7, 1, "h") for i, t, s in rows], SCHEMA)


# ---- lines

def spread_case():
    rows = [(i, f"own line {i}\nShared line\n\n  padded {i % 3}\t", f"s{i % 12}") for i in range(40)]
    rows += [(100 + i, "three sites\nunique %d" % i, f"t{i}") for i in range(3)]
    rows += [(200, None, "s1"), (201, "", "s1"), (202, "\n \n", "s2"), (203, "Shared line", None), (5, rows[5][1], "s5"),
             (None, "Shared line\nnull id", "s3"), (204, "x\n" * 3000 + "Shared line", "s4")]
    return rows


def test_spread_lines(spark):
    rows = spread_case()
    key = lambda x: re.sub(r"^[ \t\r]+|[ \t\r]+$", "", x)
    sites, first = {}, {}
    for i, t, s in rows:
        for pos, x in enumerate((t or "").split("\n")):
            if key(x):
                sites.setdefault(key(x), set()).add(s)
                at = (i is None, i or 0, pos)
                first[key(x)] = min(first.get(key(x), at), at)
    want = []
    for i, t, s in rows:
        lines = [] if t is None else t.split("\n")
        gone = [key(x) != "" and len(sites[key(x)]) >= 10 and first[key(x)] != (i is None, i or 0, p) for p, x in enumerate(lines)]
        want.append((i, None if t is None else "\n".join(x for x, g in zip(lines, gone, strict=True) if not g),
                     sum(key(x) != "" for x in lines), sum(gone)))
    out = remove_spread_lines(frame(spark, rows))
    assert out.columns[:-2] == frame(spark, []).columns
    got = [(r["doc_id"], r["text"], r["__n_lines"], r["__n_removed"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(g[3] for g in got) > 40


def test_near_threshold_lines_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(line_spread, "LG_K", 4)     # a coarse sketch ...
    monkeypatch.setattr(line_spread, "BAND", 0.99)  # ... so that every line is near the threshold
    test_spread_lines(spark)


def test_long_lines_go_from_two_sites_on(spark):
    line = lambda w, n: " ".join(f"{w}{i}" for i in range(n))
    rows = [(0, line("a", 50) + "\nown 0", "s1"), (1, "own 1\n  " + line("a", 50) + "\t", "s2"), (2, line("a", 50) + "\nown 2", "s1"),
            (3, line("b", 60) + "\nown 3", "s1"), (4, line("b", 60) + "\nown 4", "s1"),  # one site
            (5, line("d", 70) + "\nown 5", None), (6, line("d", 70) + "\nown 6", "s1")]
    rows += [(10 + i, line("c", 49) + f"\nown {i}", f"s{i}") for i in range(9)]  # short and below ten sites
    out = {r["doc_id"]: r for r in without_boilerplate(frame(spark, rows)).collect()}
    assert {i: r["text"] for i, r in out.items()} == {i: t for i, t, _ in rows} | {1: "own 1", 2: "own 2", 6: "own 6"}
    assert out[1]["n_chars"] == 5
    got = remove_spread_lines(frame(spark, rows), long_sites=None)
    assert got.filter("__n_removed > 0").count() == 0


def test_stage_keeps_content(spark):
    rows = spread_case()
    out = without_boilerplate(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    got = {(r["doc_id"], r["source"]): r for r in out.collect()}
    assert (203, None) not in got            # nothing of its own
    assert (200, "s1") in got and (201, "s1") in got and (202, "s2") in got
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)
    assert without_boilerplate(frame(spark, [])).count() == 0


# ---- personal data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or
                    k == 2 and 14 <= len(digits) <= 19 and luhn(digits) or k == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_matches():
    rng = random.Random(2)
    hits = 0
    for _ in range(20000):
        t = "".join(rng.choice("aB.@@-+ 12345 ().%_é,1.1") for _ in range(rng.randrange(60)))
        t += rng.choice(["", "", "4111 1111 1111 1111", "10.0.0.1", "+1 (988) 555-2485", "300.1.1.1"]) + t[:5]
        assert base_spans(t) == brute(t)
        hits += len(brute(t))
    assert hits > 3000
    for t in ("a" * 100000 + "@", "1" * 100000, "1 " * 50000, "+1" * 50000, "@" * 50000, "9" * 50000 + ".1.1.1"):
        base_spans(t)  # linear


def test_terms_that_disclose(spark):
    # "zorba" stands only beside one address, "the" everywhere.
    rows = [(i, f"the note é of zorba for ann@mail.example.org and the rest {i}", "s") for i in range(4)]
    rows += [(10 + i, f"the plain é text number {i} of the rest for you and the note", "s") for i in range(60)]
    rows += [(100, "the once word xylo bob@mail.example.org", "s"), (101, None, "s"), (102, "", "s"), (None, "the 10.0.0.1", "s"),
             (0, rows[0][1], "s"), (103, "zorba far away", "s")]
    out = {(r["doc_id"], r["n_email"]): r for r in sanitise(frame(spark, rows), with_text=True).collect()}
    r = out[(0, 1)]
    t = rows[0][1]
    s, z = t.index("ann@"), t.index("zorba")
    assert r["base_spans"] == f"email:{s}:{s + 20}"
    assert r["spans"] == f"term:{z}:{z + 5},email:{s}:{s + 20}"
    assert "zorba" not in r["sanitised"] and "[EMAIL]" in r["sanitised"] and "the note é of" in r["sanitised"]
    assert out[(100, 1)]["spans"] == out[(100, 1)]["base_spans"]   # below the support
    assert out[(101, 0)]["spans"] == "" and out[(103, 0)]["sanitised"] == "zorba far away"
    assert out[(None, 0)]["base_spans"] == "ip:4:12"
    assert len(KINDS) == 5
    got = sanitise(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(map(str, (g["base_spans"] for g in got))) == sorted(
        ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in brute(x or "")) for _, x, _ in rows)
    assert sanitise(frame(spark, [])).count() == 0


def rare_case():
    rows = [(i, f"the plain text number {i} of the rest for you", "s") for i in range(600)]
    rows += [(700, "the qulf wrote as solo@mail.example.org for you", "s")]
    rows += [(710 + i, f"the vimmo {i} text of duo@mail.example.org for you", "s") for i in range(2)]
    # Five copies of a text are one text; "trab" stands in forty other texts too.
    rows += [(720 + i, "the plain trab for copy@mail.example.org", "s") for i in range(5)]
    return rows + [(730 + i, f"the trab {i} of the rest", "s") for i in range(40)]


def test_terms_of_entities_of_one_and_two_texts(spark):
    rows = rare_case()
    out = {r["doc_id"]: r for r in sanitise(frame(spark, rows), with_text=True).collect()}
    assert "qulf" not in out[700]["sanitised"] and "the " in out[700]["sanitised"] and "for you" in out[700]["sanitised"]
    assert all("vimmo" not in out[710 + i]["sanitised"] and " text of " in out[710 + i]["sanitised"] for i in range(2))
    assert all(out[720 + i]["spans"] == out[720 + i]["base_spans"] for i in range(5))


def test_terms_far_from_the_entity_and_in_other_documents(spark):
    rng = random.Random(6)
    fill = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    rows = [(i, fill(40), "s") for i in range(600)]
    # The name stands in the first line, the address 120 words further, the name again at the end.
    rows += [(700 + i, f"Xandra w1\n{fill(120)}\nxan@mail.example.org {fill(60)} xandra", "s") for i in range(4)]
    rows += [(800, "w2 xandra w3 " + fill(20), "s"), (801, "xandras " + fill(20), "s"), (None, "Xandra", "s"), (800, "XANDRA", "s")]
    out = sanitise(frame(spark, rows), with_text=True, everywhere=True).collect()
    assert len(out) == len(rows)
    assert sum(r["sanitised"].lower().count("xandra") for r in out) == 1  # another word
    assert all(r["spans"].count("term:") == (2 if r["n_email"] else 1) for r in out if r["doc_id"] in range(700, 704)
               or r["doc_id"] in (None, 800))
    assert all(r["spans"] == "" for r in out if r["doc_id"] in range(600))
    here = {(r["doc_id"], r["n_email"]): r["spans"] for r in sanitise(frame(spark, rows)).collect()}
    assert here[(801, 0)] == here[(None, 0)] == "" and all(here[(700 + i, 1)].count("term:") == 2 for i in range(4))


def test_bounds_of_workers_change_nothing(spark, monkeypatch):
    rows = rare_case()
    want = sorted(map(str, sanitise(frame(spark, rows), everywhere=True).collect()))
    for name in ("HELD", "ROUND", "COPIED", "BROADCAST_ROWS"):
        monkeypatch.setattr(disclosure, name, 1)
    assert sorted(map(str, sanitise(frame(spark, rows), everywhere=True).collect())) == want


def test_statistics_equal_brute_force(spark):
    """Shares of information, counted over different texts from their definition."""
    rows = rare_case()
    base = disclosure.found(frame(spark, rows), "doc_id", "text")
    holders = base.filter("size(entities) > 0").dropDuplicates(["th"])
    texts = {r["th"]: r for r in base.collect()}
    frequency = disclosure.document_frequency(frame(spark, rows), holders.selectExpr("explode(terms.term) AS term").distinct(), "text")
    df = {r["term"]: r["df"] for r in frequency.collect()}
    got = {(r["entity"], r["term"]): r["share"] for r in disclosure.disclosing(holders, frequency, len(texts)).collect()}
    of, together = {}, {}
    for r in texts.values():
        for e in r["entities"]:
            of.setdefault(e, set()).add(r["th"])
            for t in {x["term"] for x in r["terms"]}:
                together.setdefault((e, t), set()).add(r["th"])
    n = len(texts)
    for (e, t), share in got.items():
        n_e, n_te = len(of[e]), len(together[e, t])
        f = max(df[t], n_te)
        assert n_te >= min(disclosure.SUPPORT, n_e)
        assert abs(share - math.log2(n * n_te / (n_e * f)) / math.log2(n / n_e)) < 1e-9 and share >= disclosure.GENERALISE
    assert got


# ---- near-duplicates

def grams(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, t):
    sets = [grams(x, k) for _, x, _ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= t * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(sets[i]), r[0] if not sets[i] else least.get(root(i))) for i, r in enumerate(rows)]


def near_case(seed, sizes=(3, 6, 9, 14, 30, 80, 200)):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in sizes:
        for _ in range(4):
            base = [rng.choice(vocab) for _ in range(size)]
            for _ in range(8):
                x = list(base)
                for _ in range(rng.randrange(1 + max(1, size // 25))):
                    at = rng.randrange(len(x))
                    x[at: at + 1] = rng.choice(([], [rng.choice(vocab)], [x[at], rng.choice(vocab)]))
                rows.append((n, " ".join(x), "s"))
                n += 1
    rows += [(n, None, "s"), (n + 1, "", "s"), (n + 2, " \t\n", "s"), (n + 3, "W0 w1", "s"), (n + 4, "w0\nw1", "s"),
             (2, rows[2][1], "s"), (None, rows[40][1], "s"), (n + 5, "é É", "s"), (n + 6, "É É", "s")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,t", [(4, 85), (5, 80), (2, 50)])
def test_components_equal_brute_force(spark, k, t):
    rows = near_case(k)
    got = [tuple(r) for r in jaccard_components(frame(spark, rows), k, t).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows, k, t), key=str)


@pytest.mark.parametrize("small,piece,partners", [(1, 3, 1), (0, 512, 0)])
def test_second_turn_in_blocks(spark, monkeypatch, small, piece, partners):
    """Hardly a first turn, every bucket met in blocks."""
    for name, v in (("SMALL", small), ("PIECE", piece), ("PARTNERS", partners)):
        monkeypatch.setattr(parity_join, name, v)
    test_components_equal_brute_force(spark, 4, 85)


def test_blocks_emit_what_the_join_emits(spark):
    """Sketches with the highest bits set, sizes and components that forbid a link."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(parity_join.FOLD)]
    members = []
    for sid in range(0, 120, 2):
        x = [v ^ (1 << rng.randrange(64) if rng.random() < rng.choice([0.1, 0.9]) else 0) for v in base]
        members.append((1, sid, rng.random() < 0.7, sid % 10, 60, rng.choice([100, 110, 140]), x))
    signed = [(*m[:6], [parity_join.signed(v) for v in m[6]]) for m in members]
    df = spark.createDataFrame(signed, "key long, sid long, whole boolean, c long, size long, n long, sketch array<long>")
    want = set()
    for a in members:
        for b in members:
            apart = sum(bin(p ^ q).count("1") for p, q in zip(a[6], b[6]))
            if a[2] and a[3] != b[3] and min(a[5], b[5]) * 100 >= max(a[5], b[5]) * 85 and apart * 185 <= 15 * (a[5] + b[5]):
                want.add((min(a[1], b[1]), max(a[1], b[1])))
    assert {tuple(r) for r in parity_join.block_pairs(df, 85).collect()} == want and want


def test_every_linked_pair_shares_a_key():
    rng = random.Random(5)
    pairs = 0
    for _ in range(300):
        n = rng.randrange(5, 400)
        a = [f"x{rng.randrange(10 ** 6)}" for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(1 + n // 12)):
            b[rng.randrange(len(b))] = "y%d" % rng.randrange(10 ** 6)
        x, y = shingles(" ".join(a), 1), shingles(" ".join(b), 1)
        both = len(set(x.tolist()) & set(y.tolist()))
        if 100 * both < 80 * (len(x) + len(y) - both) or both == len(x) == len(y):
            continue
        pairs += 1
        common = False
        for j in {band_of(len(x), 80), band_of(len(y), 80)}:
            (kx, wx), (ky, wy) = band_keys(x, j, 80), band_keys(y, j, 80)
            common |= bool(set(kx[wx].tolist()) & set(ky.tolist()) or set(kx.tolist()) & set(ky[wy].tolist()))
        assert common
    assert pairs > 100


def test_bands():
    for t in (50, 80, 85):
        starts = band_starts(t)
        for n in range(1, 2000):
            assert starts[band_of(n, t)] <= n
            assert band_of(n * 100 // t, t) - band_of(n, t) <= 1
        assert all(band_shape(j, t)[1] >= 1 for j in range(30))


def test_one_of_each(spark):
    rows = near_case(9)
    out = one_of_each(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    comp = brute_components(rows, 5, 80)
    want = {(i, t) for (i, t, _), (_, n, c) in zip(rows, comp, strict=True) if not n or i is not None and i == c}
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)
    assert one_of_each(frame(spark, [])).count() == 0 and jaccard_components(frame(spark, [])).count() == 0


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    edges += [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for x in up)
    assert parity_join.BROADCAST_ROWS > 0


def test_shuffle_join_in_place_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BROADCAST_ROWS", 0)
    test_components_equal_brute_force(spark, 4, 85)


def test_large_buckets_of_one_hub_meet_once(spark, monkeypatch):
    """Near copies that are together in many buckets meet in one, the classes of its main
    component not among themselves; twice the classes make about twice the rows."""
    rng, rows = random.Random(8), []
    base = [f"b{i}" for i in range(150)]
    for n in range(120):
        x = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 4, 5, 6])):
            x[at] = f"n{n}x{at}"
        rows.append((n, " ".join(x), "s"))
    given, blocks = [], parity_join.block_pairs
    monkeypatch.setattr(parity_join, "block_pairs", lambda m, t: (given.append(m), blocks(m, t))[1])
    got = [tuple(r) for r in jaccard_components(frame(spark, rows), 4, 85).collect()]
    assert sorted(got) == sorted(brute_components(rows, 4, 85))
    members = given[0].collect()
    assert members and len(members) < 2 * len({r["sid"] for r in members})

    def runs(n):
        m = [(1, 2 * i, True, 0 if i % 3 else 2 * i, n, 100, [0] * parity_join.FOLD) for i in range(n)]
        return parity_join.dealt(spark.createDataFrame(
            m, "key long, sid long, whole boolean, c long, size long, n long, sketch array<long>")).count()
    assert runs(14000) <= 2.2 * runs(7000)


def test_buckets_of_one_hub_with_other_classes_stay_apart(spark):
    left = [(key, 0, sid, True, sid, 40) for key in (1, 2, 3) for sid in [0, *range(100 * key, 100 * key + 39)]]
    df = spark.createDataFrame(left, "key long, hub long, sid long, whole boolean, c long, size long")
    assert {(r["key"], r["sid"]) for r in parity_join.meeting(df).collect()} == {(x[0], x[2]) for x in left}


def test_terms_sought_elsewhere_equal_all_terms(monkeypatch):
    """Without listing the terms of a text that nothing wanted stands in, or those not wanted."""
    long = "z" * 64
    texts = ["", "One two one-two ONE", "one", f"{long} {long}z {long.upper()}", "a_b a b\x1fa\x00A a\tb", "Été été İi one ſ K ½ one",
             "x" * 70 + " two", " ".join(f"w{i % 30}" for i in range(90))]
    wanted = {"one": 1, "two": 1, long: 1, "a": 1, "a_b": 1, "été": 1, "i̇i": 1, **{f"w{i}": 1 for i in range(25)}}
    for text in texts:
        every = disclosure.terms_of(text, ())
        assert disclosure.text_terms(text) == set(every)
        assert disclosure.places_of(text, wanted) == {t: at for t, at in every.items() if t in wanted}
    monkeypatch.setattr(disclosure, "terms_of", None)
    assert disclosure.places_of("One two", wanted) == {"one": [0, 3], "two": [4, 7]}


def test_sets_and_keys_of_many_texts_at_once(monkeypatch):
    """Texts described together have the sets, ids, sketches and keys that each has alone."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["", " \x0b\x0c ", "A a\x1cb", "É é e", "one", "one two three four", "ONE Two three\tfour", "\ud800 a b c d"]
    rng.shuffle(texts)
    for words in (1, 4):
        s, sizes = parity_join.shingle_sets(texts, words)
        parts = [x.encode("utf-8", "surrogatepass").lower().split() for x in texts]
        grams = [{tuple(p[i: i + words]) for i in range(max(len(p) - words + 1, 1))} if p else set() for p in parts]
        assert sizes.tolist() == [len(g) for g in grams]
        ends = np.cumsum(sizes).tolist()
        sets = [s[a:b] for a, b in zip([0, *ends], ends)]
        for x, one in zip(texts, sets, strict=True):
            assert (parity_join.shingles(x, words) == one).all() and (np.diff(one.astype(object)) > 0).all()
        same = {(tuple(sorted(a)), tuple(sorted(b))) for a, x in zip(grams, sets) for b, y in zip(grams, sets) if np.array_equal(x, y)}
        assert all(a == b for a, b in same)
        full = [x for x in sets if len(x)]
        ids, sketches = parity_join.set_ids(s, sizes[sizes > 0]), parity_join.folded(s, sizes[sizes > 0])
        for x, sid, sketch in zip(full, ids, sketches, strict=True):
            n = np.array([len(x)])
            assert parity_join.set_ids(x, n) == [sid] and sid % 2 == 0 and (parity_join.folded(x, n) == sketch).all()
        for band in (2, 5, 20):
            key, whole, of = parity_join.keys_of_sets(s, sizes[sizes > 0], band, 85)
            for i, x in enumerate(full):
                k, w = band_keys(x, band, 85)
                assert sorted(zip(k.tolist(), w.tolist())) == sorted(zip(key[of == i].tolist(), whole[of == i].tolist()))
    monkeypatch.setattr(parity_join, "CHARS", 50)
    runs = list(parity_join.portions(texts))
    assert [x for r in runs for x in texts[r]] == texts and len(runs) > 5
    assert all(r.stop - r.start == 1 or sum(map(len, texts[r])) <= 50 for r in runs) and not list(parity_join.portions([]))


def test_keys_leave_in_few_batches(spark, monkeypatch):
    """Keys of many documents leave a task together, not as one batch for each document and band."""
    given, map_rows = {}, parity_join.map_rows

    def watched(df, schema, make, rows=None):
        if schema.startswith("key long"):
            given["batches"] = len(list(make()([[" ".join(f"w{i}_{k}" for k in range(50)) for i in range(300)]])))
        return map_rows(df, schema, make, rows)
    monkeypatch.setattr(parity_join, "map_rows", watched)
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_components(docs, 4, 85).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 0, 3)] and given["batches"] <= 2
