"""The corpus pipeline: quality, near-duplicates, benchmark passages, mixture, shards. Each stage takes (spark, docs, sf_dir).

Defined cases of all stages: a null text counts as the empty one; an empty table gives an empty result; columns beside
doc_id, text, lang and source pass through, whatever their names; rows that are repeated are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeline.llm import decontaminate, mixing, quality, simhash, sstable
from lodeline.llm.common import clean_up, given_paths, materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7. Labels of fewer than two classes teach nothing; then all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates, so ties cannot occur; one row of each id. Of rows
    without an id one of each text stays."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. An empty benchmark, or items without words, take none away."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: null domain, language and source are nodes named ""; documents of
    one order key are taken by id, then length."""
    return mixing.take(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written shards hold: doc_id, start, n_tokens, ids_crc32. Null ids come first; repeated ids repeat their key."""
    return sstable.round_trip(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixture", source_mixture),
    ("token_shards", token_shards),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet in the shared folder and read again. What a
    stage needed is deleted when its successor is written."""
    docs, before = table(spark, sf_dir, "documents"), given_paths(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        clean_up(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
