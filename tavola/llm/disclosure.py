"""Personal data and the terms that disclose it.

Pattern matches (e-mail, ip, card, phone) are the protected entities. How
strongly a term reveals an entity is estimated from their co-occurrence in the
corpus: pointwise mutual information of "the term stands in a text with the
entity", against the information content of the entity itself. Terms above a
threshold are generalised, the strongest are removed, wherever they stand.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm.common import map_rows, small_batches, stored, table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 3           # texts in which term and entity stand together (all of them, if the entity has fewer)
CHANCE = 0.05         # most that may be expected, for each entity, of terms that stand with it by accident
COPIED = 2_000_000                # most hashes of copied texts sent to every executor
HELD = 200_000                    # most frequent terms, and entities, that a worker knows while it lists pairs
ROUND = 500_000                   # most disclosing terms that a worker looks for in one pass over all texts
BROADCAST_ROWS = 500_000          # most wanted terms (64 characters each at most) sent to every executor
GENERALISE, REMOVE = 0.75, 0.95   # share of the entity's information that the term gives

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
# A run of digits is entered at its start only: from inside it the pattern fails
# or succeeds alike, and possessive repeats keep long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"\w+")
NOT_DIGIT = re.compile(r"[^0-9]+")
# ASCII texts: lower case, and a blank for all that is not of a word.
ASCII_WORDS = bytes(ord(chr(c).lower()) if c < 128 and WORD.match(chr(c)) else 32 for c in range(256))
FEW = 16              # terms that are sought one by one in an ASCII text


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from the @."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not LOCAL_END.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base matches, in order; kinds as in ``KINDS``."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text: str, kind: int, start: int, end: int) -> str:
    value = text[start:end]
    return KINDS[kind] + ":" + (value.lower() if kind == 0 else value if kind == 1 else NOT_DIGIT.sub("", value))


def words_outside(text: str, spans) -> list[tuple[str, int, int]]:
    """``(term, start, end)`` of the words of at most 64 characters that do not
    overlap a base span."""
    taken = []
    for s, _, e in spans:
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out, i = [], 0
    for m in WORD.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if b - a <= 64 and (i == len(taken) or b <= taken[i][0]):
            out.append((m[0].lower(), a, b))
    return out


def terms_of(text: str, spans) -> dict[str, list[int]]:
    """The terms of a text outside base spans; starts and ends of each by turns."""
    out = {}
    for term, a, b in words_outside(text, spans):
        out.setdefault(term, []).extend((a, b))
    return out


def bare(text: str) -> str | None:
    """An ASCII text in lower case with a blank for each character that is not of a word."""
    return text.encode().translate(ASCII_WORDS).decode() if text.isascii() else None


def text_terms(text: str) -> set[str]:
    """The terms of a text without base spans."""
    low = bare(text)
    if low is not None:
        return {w for w in low.split() if len(w) <= 64}
    return {w.lower() for w in set(WORD.findall(text)) if len(w) <= 64}


def places_of(text: str, wanted) -> dict[str, list[int]]:
    """Those of ``terms_of(text, ())`` that are in ``wanted``."""
    low = bare(text)
    if low is None:
        found = {w: w.lower() for w in set(WORD.findall(text)) if len(w) <= 64}
        found = {w: t for w, t in found.items() if t in wanted}
        words = ((found[m[0]], *m.span()) for m in WORD.finditer(text) if m[0] in found) if found else ()
    else:
        some = [w for w in set(low.split()) if len(w) <= 64 and w in wanted]
        if len(some) > FEW:
            found = set(some)
            words = ((m[0], *m.span()) for m in WORD.finditer(low) if m[0] in found)
        else:
            low, words = f" {low} ", []
            for t in some:
                at = low.find(f" {t} ")
                while at >= 0:
                    words.append((t, at, at + len(t)))
                    at = low.find(f" {t} ", at + len(t) + 1)
    out = {}
    for t, a, b in words:
        out.setdefault(t, []).extend((a, b))
    return out


def digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def general(term: str) -> str:
    """The class that stands for a generalised term."""
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[WORD]"


def found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base rows of all documents; those with base matches have their entities
    and all their terms with positions."""
    small_batches(docs.sparkSession, 2000)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def scan():
        def each(cols):
            out = {c: [] for c in ("id", "th", "counts", "base", "entities", "terms")}
            for doc, th, text in zip(*cols, strict=True):
                spans = base_spans(text)
                out["id"].append(doc)
                out["th"].append(th)
                out["counts"].append([sum(k == i for _, k, _ in spans) for i in range(4)])
                out["base"].append([list(x) for x in spans])
                out["entities"].append(sorted({entity(text, k, s, e) for s, k, e in spans}))
                out["terms"].append([{"term": t, "at": at} for t, at in terms_of(text, spans).items()] if spans else [])
            yield out
        return each

    return stored(map_rows(rows.select("id", F.xxhash64("text").alias("th"), "text"),
                           f"id {kind}, th long, counts array<long>, base array<array<int>>, entities array<string>, "
                           "terms array<struct<term: string, at: array<int>>>", scan), "pii-base")


def document_frequency(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """``term, df``: in how many different texts each wanted term occurs, over all
    rows. Terms of single texts are summed in each batch; terms of texts with
    copies go with the text's hash, so that each text counts once."""
    rows = docs.select(text_or_empty(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    copies = stored(rows.groupBy("th").count().filter("count > 1").select("th", F.col("th").alias("copied")), "pii-copies")
    copies = F.broadcast(copies) if copies.count() <= COPIED else copies

    def count():
        def each(cols):
            single, copied = {}, {}
            for text, th in zip(*cols, strict=True):
                if th in copied:
                    continue
                spans = base_spans(text)
                words = set(terms_of(text, spans)) if spans else text_terms(text)
                if th is not None:
                    copied[th] = words
                    continue
                for w in words:
                    single[w] = single.get(w, 0) + 1
            yield {"term": list(single), "th": [None] * len(single), "df": list(single.values())}
            for th, words in copied.items():
                yield {"term": list(words), "th": [th] * len(words), "df": [1] * len(words)}
        return each

    partial = map_rows(rows.join(copies, "th", "left").select("text", "copied"), "term string, th long, df long", count)
    wanted = stored(wanted, "pii-wanted")
    few = wanted.count() <= BROADCAST_ROWS
    if few:
        partial = partial.join(F.broadcast(wanted), "term", "left_semi")
    each_text = partial.groupBy("term", "th").agg(F.sum("df").alias("df"))
    out = each_text.groupBy("term").agg(F.sum(F.when(F.col("th").isNull(), F.col("df")).otherwise(1)).alias("df"))
    return out if few else out.join(wanted, "term", "left_semi")


def log_chance(n_te: Column, n_e: Column, share: Column) -> Column:
    """Logarithm of a bound on the probability that a term that stands in this
    share of all texts stands in ``n_te`` or more of ``n_e`` texts by accident
    (Hoeffding; exact if it stands in all of them)."""
    rest = n_e - n_te
    miss = F.when(rest > 0, rest * F.ln(rest / (n_e * (1 - share)))).otherwise(0.0)
    return F.when(n_te > n_e * share, -(n_te * F.ln(n_te / (n_e * share)) + miss)).otherwise(0.0)


def together(holders: DataFrame, of_entity: DataFrame, frequency: DataFrame, n_texts: int) -> DataFrame:
    """``entity, term, n_te``: in how many of the texts that hold entities the two
    stand together; only pairs whose share can reach ``GENERALISE``.

    A share of ``g`` needs ``df <= n_e ** g * n_texts ** (1 - g)``. Workers drop
    terms by it before pairs are shuffled: they know the ``HELD`` most frequent
    terms and entities and take the others at the bound that surely holds for them.
    Entities of one and the same text only are alike: one of them stands for all.
    """
    least = max(n_texts, 1) ** (1 - GENERALISE)
    often = {r["term"]: r["df"] for r in frequency.filter(F.col("df") > least).orderBy(F.desc("df"), "term").limit(HELD).collect()}
    known = {r["entity"]: r["n_e"] for r in of_entity.filter("n_e > 1").orderBy(F.desc("n_e"), "entity").limit(HELD)
             .select("entity", "n_e").collect()}
    others = min(known.values()) if len(known) == HELD else 1
    bc = holders.sparkSession.sparkContext.broadcast((often, known))

    def pairs():
        often, known = bc.value

        def each(cols):
            out = {}
            for entities, terms in zip(*cols, strict=True):
                single = [e for e in entities if e not in known]
                if others == 1:
                    single = single[:1]
                df = [(t, often.get(t, 0)) for t in terms]
                for e in [*single, *(e for e in entities if e in known)]:
                    limit = least * known.get(e, others) ** GENERALISE * (1 + 1e-9)
                    for t, n in df:
                        if n <= limit:
                            out[e, t] = out.get((e, t), 0) + 1
                if len(out) > 200_000:
                    yield {"entity": [e for e, _ in out], "term": [t for _, t in out], "n_te": list(out.values())}
                    out = {}
            yield {"entity": [e for e, _ in out], "term": [t for _, t in out], "n_te": list(out.values())}
        return each

    found = map_rows(holders.select("entities", F.col("terms.term").alias("terms")), "entity string, term string, n_te long", pairs)
    return found.groupBy("entity", "term").agg(F.sum("n_te").alias("n_te"))


def disclosing(holders: DataFrame, frequency: DataFrame, n_texts: int) -> DataFrame:
    """``entity, term, share``: terms that give at least ``GENERALISE`` of the
    information of an entity, ``share = PMI(term, entity) / IC(entity)``, and do
    not stand with it by accident. All counts are of different texts."""
    of_entity = stored(holders.select(F.explode("entities").alias("entity"), F.size("terms").alias("tried"))
                       .groupBy("entity").agg(F.count("*").alias("n_e"), F.sum("tried").alias("tried")), "pii-entities")
    total = F.lit(float(max(n_texts, 1)))
    pairs = together(holders, of_entity, frequency, n_texts)
    pairs = pairs.join(of_entity, "entity").filter(F.col("n_te") >= F.least(F.lit(SUPPORT), "n_e"))
    pairs = pairs.join(frequency, "term").withColumn("df", F.greatest("df", "n_te"))
    content = F.log2(total / F.col("n_e"))
    pmi = F.log2(total * F.col("n_te") / (F.col("n_e") * F.col("df")))
    chance = log_chance(F.col("n_te"), F.col("n_e"), F.col("df") / total) + F.ln(F.greatest("tried", F.lit(1)))
    return (pairs.filter((content > 0) & (chance <= math.log(CHANCE)))
            .select("entity", "term", (pmi / content).alias("share")).filter(F.col("share") >= GENERALISE))


def elsewhere(docs: DataFrame, strong: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, th, at, gone``: where terms of ``strong`` (``term, gone``) stand in texts
    without base matches. One pass over all texts for each ``ROUND`` terms."""
    small_batches(docs.sparkSession, 2000)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, th long, at array<int>, gone boolean"
    rounds = -(-strong.count() // ROUND)
    out = docs.sparkSession.createDataFrame([], schema)
    for k in range(rounds):
        part = strong.filter(F.pmod(F.xxhash64("term"), F.lit(rounds)) == k)
        held = docs.sparkSession.sparkContext.broadcast({r["term"]: r["gone"] for r in part.collect()})

        def scan(held=held):
            gone = held.value

            def each(cols):
                out = {c: [] for c in ("id", "th", "at", "gone")}
                for doc, th, text in zip(*cols, strict=True):
                    places = places_of(text, gone)
                    if not places or base_spans(text):
                        continue
                    for t, at in places.items():
                        for c, x in zip(out, (doc, th, at, gone[t]), strict=True):
                            out[c].append(x)
                yield out
            return each
        out = out.unionByName(map_rows(rows, schema, scan))
    return out


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
             everywhere: bool = False) -> DataFrame:
    """A row for each row of ``docs``: ``id``, ``n_email n_ip n_card n_phone``,
    ``base_spans`` and ``spans`` (``kind:start:end``, code points, end exclusive,
    by start and then kind) and, ``with_text``, the ``sanitised`` text: base
    matches become ``[KIND]``, disclosing terms a class word or nothing.

    A term becomes a ``term`` span at every place outside base matches when, in
    the whole corpus, it discloses an entity: it stands in at least ``SUPPORT``
    different texts with it (in all texts of an entity that has fewer), more
    often than by accident (``CHANCE``), and its mutual information with it
    reaches ``GENERALISE`` of the entity's information content; from ``REMOVE``
    on it is removed instead of generalised. Common words occur without the
    entity too and stay below. With ``everywhere`` this holds for all documents,
    otherwise for those that hold the entity.

    Null texts count as empty. Copies of a text count as one text. Null ids are
    kept; other columns are ignored. Only documents that hold entities enter the
    statistics of pairs; document frequencies are summed in each batch before
    they are shuffled.
    """
    base = found(docs, id_col, text_col)
    holding = base.filter(F.size("entities") > 0)
    holders = stored(holding.select("th", "entities", "terms").dropDuplicates(["th"]), "pii-holders")
    inside = stored(holders.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("inside")), "pii-inside")
    frequency = stored(document_frequency(docs, inside.select("term"), text_col), "pii-frequency")
    strong = stored(disclosing(holders, frequency, base.select("th").distinct().count()), "pii-terms")
    gone = (F.max("share") >= REMOVE).alias("gone")
    places = holding.select("id", "th", F.explode("terms").alias("x")).select("id", "th", "x.*")
    if everywhere:
        all_gone = stored(strong.groupBy("term").agg(gone), "pii-gone")
        hits = places.join(all_gone, "term").select("id", "th", "at", "gone")
        # Terms of texts with entities alone need not be looked for in the others.
        wide = all_gone.join(frequency, "term").join(inside, "term").filter("df > inside").select("term", "gone")
        hits = hits.unionByName(elsewhere(docs, stored(wide, "pii-wide"), id_col, text_col))
    else:
        mine = (holding.select("th", F.explode("entities").alias("entity")).distinct().join(strong, "entity")
                .groupBy("th", "term").agg(gone))
        hits = places.join(mine, ["th", "term"]).select("id", "th", "at", "gone")
    hits = hits.groupBy("id", "th").agg(F.collect_set(F.struct("at", "gone")).alias("terms"))
    hits = hits.select(F.col("id").alias("h_id"), F.col("th").alias("h_th"), "terms")
    kind = docs.schema[id_col].dataType.simpleString()

    def render():
        def each(cols):
            out = {c: [] for c in names}
            for doc, counts, spans, terms, text in zip(*cols, strict=True):
                spans = [tuple(x) for x in spans]
                more = {(a, 4, b): t["gone"] for t in terms or () for a, b in zip(t["at"][::2], t["at"][1::2], strict=True)}
                for k, n in zip(("n_email", "n_ip", "n_card", "n_phone"), counts, strict=True):
                    out[k].append(n)
                out[id_col].append(doc)
                out["base_spans"].append(digest(spans))
                out["spans"].append(digest([*spans, *more]))
                if with_text:
                    parts, at = [], 0
                    for s, k, e in sorted([*spans, *more]):
                        if s >= at:
                            parts += [text[at:s], general(text[s:e]) if k == 4 and not more[s, k, e] else
                                      "" if k == 4 else f"[{KINDS[k].upper()}]"]
                        at = max(at, e)
                    out["sanitised"].append("".join(parts) + text[at:])
            yield out
        return each

    names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", *["sanitised"] * with_text]
    schema = (f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"
              + ", sanitised string" * with_text)
    rows = base.drop("entities", "terms")
    rows = rows.join(hits, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")), "left")
    if with_text:
        texts = docs.select(F.col(id_col).alias("t_id"), text_or_empty(text_col).alias("text"))
        texts = texts.withColumn("t_th", F.xxhash64("text")).dropDuplicates(["t_id", "t_th"])
        rows = rows.join(texts, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("th") == F.col("t_th")))
    else:
        rows = rows.withColumn("text", F.lit(""))
    return map_rows(rows.select("id", "counts", "base", "terms", "text"), schema, render)


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole document and the terms that disclose it."""
    out = sanitise(table(spark, sf_dir, "documents"), everywhere=True)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                      F.sha2("base_spans", 256).alias("base_sha256"), "spans")
