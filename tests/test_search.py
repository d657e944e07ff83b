"""Posting-list search equals testing every term on every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tavola.operators.search import literal_runs, matching_texts, rows_matching

TERMS = ["ring", "RING", "r.ng", "^blue", "bolt$", "bolt|nut", "(red|blue) ring", "wid?get", "wid+get", "a", "", ".", "[a-c]olt", "x{0,2}ring",
         r"no\.1", r"\d+", r"\bring\b", "k", "s", "i", "é", "bé", "strasse", "ſ", "ri(n)g", "q[^]]*", "zzz", "no.1 ", "  ", "ab*c", "a+b", "ing?"]
TEXTS = ["Blue Ring", "red bolt", "BOLT", "nut no.1", "no11", "widget", "wiget", "widddget", "Kelvin K", "long ſ", "dot İx ı",
         "café BÉ", "Straße", "", " ", "q]x", "abc ac", "aab", "ring ring", "strİng RİNG"]


def java_matches(spark, terms, texts):
    """What the pattern engine itself says for every pair."""
    a = spark.createDataFrame([(t,) for t in terms], "term string")
    b = spark.createDataFrame([(t,) for t in texts], "text string")
    hit = F.regexp_like("text", F.concat(F.lit("(?iu)"), F.col("term")))
    return {(r.term, r.text) for r in a.crossJoin(b).filter(hit).collect()}


def found(df):
    return sorted((r.term, r.text) for r in df.collect())


def test_patterns(spark):
    terms = [(i, t) for i, t in enumerate(TERMS)] + [(90, None)]
    got = found(matching_texts(spark.createDataFrame([(t,) for t in TEXTS + TEXTS + [None]], "text string"),
                               spark.createDataFrame(terms, "term_id int, term string")))
    assert len(got) == len(set(got))
    assert set(got) == java_matches(spark, TERMS, TEXTS)


def test_literal_parts(spark):
    terms = ["ring", "R", "", "no.1", "É", "a b", "ß", "İ", "zz"]
    got = found(matching_texts(spark.createDataFrame([(t,) for t in TEXTS], "text string"),
                               spark.createDataFrame(list(enumerate(terms)), "term_id int, term string"), literal=True))
    low = {t: spark.createDataFrame([(t,)], "t string").select(F.lower("t")).first()[0] for t in TEXTS + terms}
    assert set(got) == {(t, x) for t in terms for x in TEXTS if low[t] in low[x]}


@pytest.mark.parametrize("pattern,runs", [("ring", ["ring"]), ("r.ng", ["r", "ng"]), ("a|b", []), ("(x)yz", ["yz"]), ("abc?d", ["ab", "d"]),
                                          (r"a\.b", ["a", "b"]), (r"a\x41", []), ("[ab]cd", ["cd"]), ("a[", []), ("a[^]b]cd", []),
                                          ("Kab+", ["kab"]), ("é12", ["12"]), ("ab{2}c", ["a", "c"]), ("(?i)abc", [])])
def test_literal_runs(spark, pattern, runs):
    assert spark.createDataFrame([(pattern,)], "p string").select(literal_runs(F.col("p"))).first()[0] == runs


def test_random_words(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    rows = [(f"k{i}", " ".join(word() for _ in range(rng.randrange(4))), word()) for i in range(200)]
    terms = [(i, word()) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, one string, two string")
    out = rows_matching(df, "key", [F.col("one"), F.col("two")], spark.createDataFrame(terms, "term_id int, term string"))
    got = sorted((r.term_id, r.key) for r in out.collect())
    assert got == sorted((i, k) for i, t in terms for k, a, b in rows if re.search(t, a) or re.search(t, b))


def test_no_nested_loop(spark, seed):
    from tavola.operators.reports import menu_search_terms
    plan = menu_search_terms(seed, spark.createDataFrame([(1, "a"), (2, ".")], "term_id int, term string"))
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_postings_grow_with_matches(spark, monkeypatch):
    """Numbers as terms: every text shares short pieces with every term, hardly any a long one."""
    from tavola.operators import search
    kept = []
    monkeypatch.setattr(search, "written", lambda df, name: kept.append(df) or df)
    texts = spark.range(2000).select(F.format_string("#o%d customer#%09d pending", "id", F.col("id") % 500).alias("text"))
    terms = spark.range(400).select(F.col("id").alias("term_id"), F.when(F.col("id") % 2 == 0, F.format_string("#O%d ", "id")).otherwise(
        F.format_string("%09d", "id")).alias("term"))
    got = sorted((r.term_id, int(r.text[2:r.text.index(" ")])) for r in matching_texts(texts, terms, literal=True).collect())
    assert got == sorted([(i, i) for i in range(0, 400, 2)] + [(i, j) for i in range(1, 400, 2) for j in range(i, 2000, 500)])
    assert kept[0].count() < 20 * len(got)     # terms times texts: 800000


def test_terms_are_written_and_rows_meet_sets_of_texts(spark, monkeypatch):
    """Terms are taken apart once each, not once for every row they come from; rows that share a key count as one."""
    from tavola.operators import search
    kept = {}
    plain = search.written
    monkeypatch.setattr(search, "written", lambda df, name: kept.setdefault(name, plain(df, name)))
    df = spark.createDataFrame([("a", "red ring", "ring of red"), ("a", "ring", None), ("b", "red ring", "ring of red"), ("c", None, None),
                                (None, "bolt", "red"), (None, "bolt", "bolt"), ("d", "of", "x")], "key string, one string, two string")
    terms = spark.range(3000).selectExpr("id % 3 as term_id", "element_at(array('ring', 'red|of', 'bolt'), cast(id % 3 + 1 as int)) as term")
    got = rows_matching(df, "key", [F.col("one"), F.col("two")], terms)
    assert sorted((r.term_id, r.key or "-") for r in got.collect()) == [(0, "a"), (0, "b"), (1, "-"), (1, "a"), (1, "b"), (1, "d"), (2, "-")]
    assert got.columns == ["term_id", "term", "key", "one", "two"]
    assert kept["search-terms"].count() == 3
    assert kept["text-sets"].count() == 6 and kept["text-hits"].count() == 7
