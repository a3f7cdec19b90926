"""A corpus pipeline: raw documents to token ids, one operator a stage.

Every stage is written as Parquet and read again by the next one, so a lost
executor repeats part of one stage at most.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedweave.llm import jaccard_join, mixing, pieces, quality_rules, suffix_dedup
from seedweave.llm.common import table
from seedweave.llm.queries import MIX_SEED, MIX_WEIGHTS, piece_model
from seedweave.session import provide_stage_root, write_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a rule learned from the labels rejects."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies."""
    return jaccard_join.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur elsewhere too; those of which nothing is left go."""
    cut = suffix_dedup.deduplicated(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    gone = (F.col("n_removed") > 0) & (F.btrim("text") == "")
    return cut.where(~F.coalesce(gone, F.lit(False))).select(*docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, in a global random order."""
    return mixing.shuffled(mixing.mixed(docs, MIX_WEIGHTS, seed=MIX_SEED), MIX_SEED).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids and the text that they decode to."""
    coded = pieces.encoded(docs, piece_model())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("source mixture", source_mixture),
    ("token ids", token_ids),
]

# Learned rules, components and merge rounds are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    provide_stage_root(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
