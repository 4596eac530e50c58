"""From raw documents to a mixed, tokenized corpus: five stages, each reading what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embertrail.llm import byte_bpe, line_dedup, ngram_join, quality_net, source_mix
from embertrail.llm.common import read
from embertrail.llm.queries import bpe_tokenizer
from embertrail.session import durable


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_net.keep_good(docs, read(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more found in three documents stay in the one with the largest id only."""
    index = line_dedup.add_documents(line_dedup.empty_index(spark), docs)
    kept = line_dedup.drop_repeated_lines(docs, index)
    counted = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", counted).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return ngram_join.one_of_each_group(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until their sources meet their targets."""
    return source_mix.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as byte-level BPE ids, with a check that they decode to it."""
    return byte_bpe.tokenized(docs.select("doc_id", "source", "text"), bpe_tokenizer()).drop("text")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_copies),
    ("source_mix", source_weights),
    ("byte_bpe", token_ids),
]

# A trained classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
