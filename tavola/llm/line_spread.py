"""Cross-site boilerplate lines by distinct-site spread.

Every line hash gets a HyperLogLog sketch of the sites it occurs on; partial
sketches merge in the aggregation. Lines whose estimate lies near the threshold
get an exact distinct count; the rest are decided by the estimate.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tavola.llm.common import stored, table

MIN_SITES = 10
LONG_WORDS, LONG_SITES = 50, 2  # lines of so many words are boilerplate from so many sites on
LG_K = 12
# Four standard errors of a sketch with 2**LG_K registers (1.04 / sqrt(4096)).
BAND = 0.065


def line_key(line: Column) -> Column:
    """What makes two lines the same: the line without outer blanks."""
    return F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")


def exploded(rows: DataFrame, min_sites: int, long_sites: int | None) -> DataFrame:
    """``doc, tie, site, pos, h, h2, need`` of every line that is not blank; the hash
    is 128 bits wide (two independent longs), ``need`` the sites that make the line
    boilerplate."""
    lines = rows.select("doc", "tie", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", line_key(F.col("line"))).filter("line <> ''")
    need = F.lit(min_sites)
    if long_sites is not None:  # a line of so many words has a blank between them
        long = F.when(F.length("line") >= 2 * LONG_WORDS - 1, F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")) >= LONG_WORDS)
        need = F.when(long, F.lit(min(min_sites, long_sites))).otherwise(need)
    return lines.select("doc", "tie", "site", "pos", F.xxhash64("line").alias("h"),
                        F.xxhash64(F.lit(1), F.reverse("line")).alias("h2"), need.alias("need"))


def spread_lines(lines: DataFrame) -> DataFrame:
    """Hashes ``h, h2`` of the lines that occur on at least ``need`` sites.

    A null site counts as a site of its own.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col("site")), F.lit("-"))
    sketch = lines.groupBy("h", "h2", "need").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(site, F.lit(LG_K))).alias("sites"), F.count(F.lit(1)).alias("n"))
    low, high = F.col("need") * (1 - BAND), F.col("need") * (1 + BAND)
    # A line with fewer occurrences than the threshold cannot reach it.
    candidates = stored(sketch.filter((F.col("n") >= F.col("need")) & (F.col("sites") >= low)), "line-sketches")
    near = candidates.filter(F.col("sites") <= high).select("h", "h2")
    exact = (lines.join(near, ["h", "h2"], "left_semi").select("h", "h2", "need", site.alias("site")).distinct()
             .groupBy("h", "h2", "need").count().filter(F.col("count") >= F.col("need")).select("h", "h2"))
    return candidates.filter(F.col("sites") > high).select("h", "h2").unionByName(exact)


@F.pandas_udf(StringType())
def without_lines(text: pd.Series, drop: pd.Series) -> pd.Series:
    """The text without the lines at the (sorted) positions in ``drop``."""
    def cut(t, d):
        if t is None or d is None:
            return t
        gone = set(d)
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return pd.Series([cut(t, d) for t, d in zip(text, drop, strict=True)], dtype=object)


def remove_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text",
                        site_col: str = "source", long_sites: int | None = LONG_SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed and two added columns,
    ``__n_lines`` and ``__n_removed`` (of lines that are not blank).

    A line is boilerplate when it occurs on at least ``min_sites`` sites, or
    ``long_sites`` (None: no rule of their own) from ``LONG_WORDS`` words on. Its
    first occurrence (smallest id, then text hash, then position) stays, so no
    content is lost; every other occurrence goes. Lines are compared without
    outer blanks; blank lines are never removed. Null and empty texts stay as
    they are with 0 lines. Rows repeated with the same id and text are treated
    alike (the first occurrence stays in each of them). Null ids sort last.
    Other columns of ``docs`` are kept as they are.
    """
    tie = F.xxhash64(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).alias("doc"), tie.alias("tie"), F.col(site_col).cast("string").alias("site"),
                       F.col(text_col).cast("string").alias("text"))
    lines = stored(exploded(rows, min_sites, long_sites), "lines")  # narrow: hashes and positions, no text
    spread = stored(spread_lines(lines), "spread-lines")
    # Hot lines: occurrences meet in one partial minimum per task before the shuffle.
    at = F.struct(F.col("doc").isNull().alias("n"), "doc", "tie", "pos")
    found = lines.drop("site", "need").join(spread, ["h", "h2"], "left_semi")
    found = stored(found, "spread-found")
    first = found.groupBy("h", "h2").agg(F.min(at).alias("keep"))
    drops = (found.join(first, ["h", "h2"]).filter(~F.col("keep").eqNullSafe(at))
             .groupBy("doc", "tie").agg(F.array_sort(F.collect_set("pos")).alias("drop")))
    drops = drops.select(F.col("doc").alias("__ls_doc"), F.col("tie").alias("__ls_tie"), F.col("drop").alias("__ls_drop"))
    out = docs.withColumn("__ls_key", tie)
    out = out.join(drops, out[id_col].eqNullSafe(F.col("__ls_doc")) & out["__ls_key"].eqNullSafe(F.col("__ls_tie")),
                   "left")
    text = out[text_col]
    n_lines = F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: line_key(x) != "")), F.lit(0))
    cut = F.when(F.col("__ls_drop").isNull(), text).otherwise(
        without_lines(F.when(F.col("__ls_drop").isNotNull(), text), F.col("__ls_drop")))
    kept = [cut.alias(c) if c == text_col else out[c] for c in docs.columns]
    return out.select(*kept, n_lines.cast("long").alias("__n_lines"),
                      F.coalesce(F.size("__ls_drop"), F.lit(0)).cast("long").alias("__n_removed"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text",
                        site_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with shortened texts (and ``length_col``, if there, kept true).

    Rows of which no line is left go: all their content stays where it occurs
    first. Rows that had no lines before are kept.
    """
    out = remove_spread_lines(docs, min_sites, id_col, text_col, site_col)
    out = out.filter((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_lines")))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col("__n_removed") > 0, F.length(text_col).cast(kind))
                             .otherwise(F.col(length_col)))
    return out.drop("__n_lines", "__n_removed")


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines it keeps, as a digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = remove_spread_lines(docs, long_sites=None)  # one threshold for all lines, as OP6_SQL has it
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.md5("text").alias("text_md5"),
                      F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_kept"))


OP6_SQL = f"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
b AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce('s' || source, '-')) >= {MIN_SITES}),
f AS (SELECT key, min((doc_id, pos)) AS keep FROM k WHERE key IN (SELECT key FROM b) GROUP BY key),
m AS (
  SELECT k.*, f.key IS NOT NULL AND (k.doc_id, k.pos) <> f.keep AS gone
  FROM k LEFT JOIN f ON k.key = f.key),
d AS (
  SELECT doc_id, count(*) FILTER (key <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
    string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM m GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(d.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(d.n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN t.text IS NOT NULL THEN md5(coalesce(d.kept, '')) END AS text_md5,
  CAST(coalesce(length(d.kept), 0) AS BIGINT) AS n_chars_kept
FROM documents t LEFT JOIN d ON t.doc_id = d.doc_id
"""
