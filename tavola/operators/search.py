"""Batches of search terms against texts, by posting lists.

A pattern can only match a text that holds the literal characters the pattern needs, so
pieces of these find candidates by an equi-join with the pieces of the texts; the pattern
itself then decides. A term is looked up by its rarest piece, of the greatest of
``LENGTHS`` that its literal characters allow: the longer a piece, the fewer texts hold
it, so candidates grow with the matches and not with terms times texts. Texts give
pieces of the lengths that some term asks for, and only those that may be asked for: a
bit set of fixed size that every task gets drops the others before any shuffle. Each
different text is taken apart and tested once, however many rows show it.

A term that needs no literal character has to be tested on every text: such terms
meet the texts under ``SALTS`` numbers, so that no task gets all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.session import written

LENGTHS, SALTS = (1, 2, 3, 4, 6, 8, 12, 16), 64
ROWS_A_TASK = 20_000
AGAIN_BITS = 20     # a set of at most 2**20 numbers of 4 bytes goes to every task
SLOT_BITS = 24      # 2**24 bits of asked pieces, as at most 2**18 words, go to every task
GAP = "\u0001"      # stands for whatever is not a literal character
# Letters that match an ASCII letter when case is ignored, and those letters.
FOLDED, PLAIN = "\u017f\u212a\u0130\u0131", "skii"


def folded(c: Column) -> Column:
    """Text in which two characters that match when case is ignored are equal, where one is ASCII."""
    return F.lower(F.translate(c, FOLDED, PLAIN))


def literal_runs(pattern: Column) -> Column:
    """Runs of ASCII characters that every match of the regular expression holds (folded).

    Careful rather than complete: alternatives, groups, classes and anything optional
    count as gaps, unusual syntax as a pattern without literals."""
    odd = (pattern.contains("|") | pattern.contains("(?") | pattern.rlike(r"\\[^\W_dDsSwWbBAzZ]"))
    c = F.regexp_replace(pattern, r"(?s)\\.", GAP)
    c = F.regexp_replace(c, r"\[[^\[\]]+\]", GAP)
    for _ in range(4):
        c = F.regexp_replace(c, r"\([^()]*\)", GAP)
    odd = odd | c.rlike(r"[\[\]()]")
    c = F.regexp_replace(c, r"(?s).(?:[?*]|\{[^}]*\})[?+]?", GAP)
    c = F.regexp_replace(c, r"[+.^$]|[^\x20-\x7E]", GAP)
    runs = F.filter(F.split(folded(c), GAP), lambda r: r != "")
    return F.when(odd, F.array().cast("array<string>")).otherwise(runs)


def _pieces(text: Column, n: Column) -> Column:
    """All pieces of ``n`` characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
                  ).otherwise(F.array().cast("array<string>"))


def _slot(piece: str) -> tuple[Column, Column]:
    """Word and bit of a piece in the set of asked ones."""
    h = F.xxhash64(piece).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    return F.shiftright(h, 6), h.bitwiseAND(F.lit(63)).cast("int")


def _all_texts(salt: Column) -> Column:
    """The piece under which every text is found (no text holds it)."""
    return F.concat(F.lit(GAP), salt.cast("string"))


def matching_texts(texts: DataFrame, terms: DataFrame, literal: bool = False) -> DataFrame:
    """``term_id, term, text``: the different texts of ``texts(text)`` that each of ``terms(term_id, term)``
    matches: as a regular expression without regard to case, or (``literal``) as a part of the
    lower-case text. Null texts and terms match nothing; an empty term matches every text.
    """
    texts = texts.select("text").filter("text IS NOT NULL").distinct()
    terms = terms.select("term_id", "term").filter("term IS NOT NULL").distinct()
    if literal:
        runs = F.filter(F.split(F.regexp_replace(folded(F.col("term")), r"[^\x20-\x7E]", GAP), GAP), lambda r: r != "")
    else:
        runs = literal_runs(F.col("term"))
    t = terms.withColumn("_runs", runs)
    # Pieces of one length: the longest that some run has (0: none, found under the salts).
    longest = F.coalesce(F.array_max(F.transform("_runs", lambda r: F.length(r))), F.lit(0))
    n = F.lit(0)
    for k in LENGTHS:
        n = F.when(longest >= k, F.lit(k)).otherwise(n)
    t = t.withColumn("_n", n)
    t = t.withColumn("_pieces", F.when(F.col("_n") > 0, F.array_distinct(F.flatten(F.transform("_runs", lambda r: _pieces(r, F.col("_n")))))))
    asked = t.filter("_n > 0").select("term_id", "term", F.explode("_pieces").alias("piece"))
    every = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), _all_texts)
    anywhere = t.filter("_n = 0").select("term_id", "term", F.explode(every).alias("piece"))

    # Two bounded frames: the lengths asked for, and the words of the bit set.
    lengths = t.select("_n").distinct()
    word, bit = _slot("piece")
    words = (asked.select("piece").unionByName(anywhere.select("piece")).select(word.alias("_word"), bit.alias("_bit"))
             .groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits")))
    n = F.col("_n")
    last = F.when(n == 0, F.lit(1)).otherwise(F.length("_plain") - n + 1)
    piece = F.when(n == 0, _all_texts(F.pmod(F.xxhash64("text"), F.lit(SALTS)))).otherwise(F.substring("_plain", F.col("_i"), n))
    postings = (texts.withColumn("_plain", folded(F.col("text"))).join(F.broadcast(lengths)).filter(last > 0)
                .withColumn("_i", F.explode(F.sequence(F.lit(1), last))).select("text", piece.alias("piece"))
                .withColumn("_word", word).join(F.broadcast(words), "_word").filter(F.getbit("_bits", bit) == 1)
                .select("text", "piece").distinct())
    postings = written(postings, "postings")    # counted and joined: taken apart once
    # The rarest piece of each term. A piece that no text holds settles the term.
    count = postings.groupBy("piece").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (asked.join(count, "piece", "left").groupBy("term_id", "term")
              .agg(F.min_by("piece", F.struct(F.coalesce("_n", F.lit(0)), F.col("piece"))).alias("piece")))
    candidates = rarest.unionByName(anywhere.select(*rarest.columns)).join(postings, "piece")
    if literal:
        hit = F.lower("text").contains(F.lower(F.col("term")))
    else:
        hit = F.regexp_like("text", F.concat(F.lit("(?iu)"), F.col("term")))
    return candidates.filter(hit).select("term_id", "term", "text")


def rows_matching(rows: DataFrame, key: str, columns: list[Column], terms: DataFrame, literal: bool = False) -> DataFrame:
    """``term_id, term`` and the columns of ``rows``, once for each term that matches one of its
    ``columns`` (texts). ``key`` is the rows' primary key; rows that share it count as one."""
    # Written: conditions on a term's pieces would else be tested for every row that the term comes from.
    terms = written(terms.select("term_id", "term").filter("term IS NOT NULL").distinct(), "search-terms")
    if len(columns) > 1:
        return _rows_matching_sets(rows, key, columns, terms, literal)
    shown = rows.withColumn("_text", columns[0]).filter("_text IS NOT NULL")
    hits = matching_texts(shown.select(F.col("_text").alias("text")), terms, literal)
    hits = hits.select(F.col("term_id").alias("_id"), F.col("term").alias("_term"), F.col("text").alias("_hit"))
    out = shown.join(hits, F.col("_text") == F.col("_hit")).dropDuplicates([key, "_id", "_term"])
    return out.select(F.col("_id").alias("term_id"), F.col("_term").alias("term"), *rows.columns)


def _rows_matching_sets(rows: DataFrame, key: str, columns: list[Column], terms: DataFrame, literal: bool) -> DataFrame:
    """``rows_matching`` for rows of several texts. A term that several texts of a row match is
    counted once for each different set of texts, so the rows, with all their columns, only meet
    the terms of their set. Only rows whose key may be there again are compared after that:
    hashes of these keys, cut to ``AGAIN_BITS`` bits, are a set of bounded size."""
    shown = rows.withColumn("_texts", F.array_sort(F.array_distinct(F.array_compact(F.array(*columns)))))
    sets = written(shown.select("_texts").distinct(), "text-sets")
    each = sets.withColumn("_text", F.explode("_texts"))
    hits = matching_texts(each.select(F.col("_text").alias("text")), terms, literal)
    hits = hits.select(F.col("term_id").alias("_id"), F.col("term").alias("_term"), F.col("text").alias("_text"))
    hits = written(each.join(hits, "_text").select("_texts", "_id", "_term").distinct(), "text-hits")   # read by both kinds of rows

    def slot() -> Column:
        return F.xxhash64(key).bitwiseAND(F.lit((1 << AGAIN_BITS) - 1)).cast("int")

    again = F.broadcast(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(slot().alias("_slot")).distinct())
    out = (F.col("_id").alias("term_id"), F.col("_term").alias("term"), *rows.columns)
    # One row may match many terms: rows are dealt out by their number, however few bytes they take.
    once = shown.join(again, slot() == F.col("_slot"), "left_anti").repartition(max(1, -(-rows.count() // ROWS_A_TASK)))
    twice = shown.join(again, slot() == F.col("_slot"), "left_semi").join(hits, "_texts").dropDuplicates([key, "_id", "_term"])
    return once.join(hits, "_texts").select(*out).unionByName(twice.select(*out))
