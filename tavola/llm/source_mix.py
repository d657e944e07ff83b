"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words. Complete epochs of the source come
first; what is left of the target is filled by weighted sampling without
replacement: every document draws ``-ln(u) / quality``, a source's documents
are taken in ascending order of that key until their words reach the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tavola.functions.keys import with_row_number
from tavola.llm.common import stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """Quality weight of a text: a tenth plus its share of letters and spaces."""
    other = F.length(F.regexp_replace(text, r"[\p{L} ]+", ""))
    return F.lit(0.1) + F.coalesce(1 - other / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))


def uniform(seed: int, *cols: Column) -> Column:
    """A repeatable number in (0, 1) from 53 bits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = 3) -> DataFrame:
    """Targets of the sources from ``source, source_size`` (one row each).

    Sources in code point order, null last, weigh ``weights`` repeating and
    share the sum of all sizes; a target above ``cap`` times its source's size
    stops there and the excess is shared again until none is above. Adds
    ``rank`` (from 0) and ``target``.
    """
    ranked = with_row_number(sizes, [F.col("source").isNull(), F.col("source")], "rank")
    ranked = ranked.select("source", "source_size", (F.col("rank") - 1).alias("rank"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("w", w.cast("long")), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    # A source that is full stays full in later turns, so ``share`` (words for a
    # unit of weight) only rises and the turns end; each reads one row of sums.
    while True:
        full = F.col("w") * F.lit(share) > F.col("source_size") * cap
        r = ranked.agg(F.sum(F.when(full, F.col("source_size") * cap)).alias("given"),
                       F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        new = (total - (r["given"] or 0)) / r["open"] if r["open"] else share
        if not total or new <= share:
            break
        share = new
    full = F.col("w") * F.lit(share) > F.col("source_size") * cap
    return ranked.withColumn("target", F.when(full, (F.col("source_size") * cap).cast("double"))
                             .otherwise(F.col("w") * F.lit(share)))


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """``id, source, size, source_size, target, taken`` for every row.

    ``size`` is the number of words (null text: 0), ``taken`` the words the mix
    takes of the row: ``epochs * size`` with ``epochs = floor(target /
    source_size)``, plus ``size`` when the row is selected for the rest. The
    selection takes rows in key order while at least half of the row's words
    fit, so a source ends within half a document of its target. Rows
    without words take nothing. Repeated rows draw the same key; sorting ties
    are broken by id and text hash, and full ties are alike. Null ids and
    sources are kept (a null source is a source).

    Within a source the order is global: rows are range-sorted by (source, key)
    over many tasks, each task's sums per source are added up in a small table
    (a row for each task and source in it), and running sums start from there.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       words_of(text).alias("size"), quality_of(text).alias("quality"),
                       F.coalesce(F.md5(text), F.lit("")).alias("tie"))
    rows = stored(rows.withColumn("key", -F.ln(uniform(seed, F.col("id"), F.col("tie"))) / F.col("quality")),
                  "mix-rows")
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = stored(sources.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    ranked = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    part = (ranked.repartitionByRange("rank", "key", "id", "tie")
            .sortWithinPartitions("rank", "key", "id", "tie")
            .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    part = stored(part, "mix-sorted")
    sums = part.groupBy("rank", "part").agg(F.sum("size").alias("sum"))
    before = sums.select("rank", "part", F.coalesce(F.sum("sum").over(
        Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("size").over(
        Window.partitionBy("rank", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = part.withColumn("inside", inside).join(before, ["rank", "part"])
    chosen = (F.col("size") > 0) & (F.col("base") + F.col("inside") + F.col("size") / 2 <= F.col("rest"))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                         (F.col("epochs") * F.col("size") + F.when(chosen, F.col("size")).otherwise(0))
                         .cast("long").alias("taken"), "tie")


def mixed(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """The rows the mix takes, each as often as it takes it, with the columns of
    ``docs``. Rows repeated with the same id, source and text are put out
    together (other columns from one of them)."""
    taken = mix(docs, seed, id_col, text_col, source_col).filter("taken > 0")
    taken = taken.groupBy(F.col(id_col).alias("__mx_id"), F.col(source_col).alias("__mx_source"), F.col("tie").alias("__mx_tie")).agg(
        F.sum(F.col("taken") / F.col("size")).cast("int").alias("__mx_times"))
    taken = stored(taken, "mix-taken")
    out = docs.withColumn("__mx_hash", F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit("")))
    out = out.join(taken, out[id_col].eqNullSafe(F.col("__mx_id")) & (out["__mx_hash"] == F.col("__mx_tie"))
                   & out[source_col].cast("string").eqNullSafe(F.col("__mx_source")))
    out = out.dropDuplicates([id_col, source_col, "__mx_hash"])
    out = out.withColumn("__mx_turn", F.explode(F.sequence(F.lit(1), F.col("__mx_times"))))
    return out.drop("__mx_hash", "__mx_id", "__mx_source", "__mx_tie", "__mx_times", "__mx_turn")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).drop("tie")


OP9_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    0.1::DOUBLE + CASE WHEN text IS NULL THEN 0.0::DOUBLE ELSE 1 - length(regexp_replace(text, '[\p{{L}} ]+', '', 'g'))::DOUBLE
      / greatest(length(text), 1) END AS quality,
    coalesce(md5(text), '') AS tie FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '-') || '|' || tie), 1, 13))::BIGINT::DOUBLE + 0.5)
    / 4503599627370496.0::DOUBLE) / quality AS key FROM r),
s AS (
  SELECT source, source_size, [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source)),
level(n, share) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT n + 1, x FROM (
    SELECT l.n, l.share, ((SELECT sum(source_size) FROM s) - coalesce(sum(s.source_size * 3) FILTER (s.w * l.share > s.source_size * 3), 0))::DOUBLE
      / sum(s.w) FILTER (NOT s.w * l.share > s.source_size * 3) AS x
    FROM level l, s GROUP BY l.n, l.share)
  WHERE x > share),
t AS (
  SELECT s.*, CASE WHEN w * share > source_size * 3 THEN (source_size * 3)::DOUBLE ELSE w * share END AS target
  FROM s, (SELECT max(share) AS share FROM level)),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (
  SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.tie
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target,
  CAST(epochs * size + CASE WHEN size > 0 AND before + size / 2.0::DOUBLE <= rest THEN size ELSE 0 END AS BIGINT) AS taken
FROM p
"""
