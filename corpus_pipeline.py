"""Corpus preparation over ``documents``: toxic documents go, boilerplate lines
go, one document of each near-duplicate group stays, sources are mixed to their
target weights, and the mix is encoded.

Each stage takes ``(spark, docs, sf_dir)`` and works on everything the stage
before kept; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tavola.llm.common import stored, table
from tavola.llm.line_spread import without_boilerplate
from tavola.llm.parity_join import one_of_each
from tavola.llm.piece_viterbi import encode
from tavola.llm.source_mix import mixed
from tavola.llm.weak_toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not reject."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are spread over many sources (the first occurrence stays)."""
    return without_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8."""
    return one_of_each(docs, words=5, t=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, repeated as often as it takes them."""
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every remaining text (and what they decode to, as a hash)."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("pieces", pieces),
]
ORACLE_SQL = None  # a trained classifier and md5-keyed sampling over its result


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
