"""A corpus pipeline of five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontam, language, line_dedup, simhash
from skein.llm.queries import PATTERN, RANKS
from skein.llm.rows import text_key, without
from skein.plans.scratch import materialize


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without letters or with a vague posterior go.

    The column ``lang`` is what the source declares, and the labels to learn from;
    each half of the texts is judged by a model that learnt from the other half.
    """
    models = language.train_folds(docs)
    keyed = docs.withColumn("gone_key", text_key())
    judged = language.identify_documents(keyed, models, ["doc_id", "gone_key"])
    gone = judged.where(~F.col("accepted")).select(F.col("doc_id").alias("gone_id"), "gone_key")
    return without(docs, gone)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines repeated from earlier ones; those that lose all their lines go.

    ``n_chars`` follows the text.
    """
    left = line_dedup.dedup_lines(docs, drop_emptied=True)
    return left.withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and digests of ids and decoded bytes."""
    return bpe.encode(docs, RANKS, PATTERN, keep=("doc_id", "lang", "source"), with_decoded=False)


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The alignment, the fingerprints and the merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
