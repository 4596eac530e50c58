"""One query per operator, over the whole of its table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embertrail.llm import (
    byte_bpe, hard_negatives, hnsw_dedup, importance_resampling, line_dedup, ngram_join, packing, quality_net, quality_rules, source_mix, token_counts,
    toxicity_fm, url_markov,
)
from embertrail.llm.common import read


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    trusted = labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
    return quality_rules.judge_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), trusted).drop("score")


def op2_quality_rules_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier name of what op2_quality_rules does."""
    return op2_quality_rules(spark, sf_dir)


def op3_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


# Fixed: the rules that the query judges by.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op4_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("score")


def op5_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def bpe_tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return byte_bpe.tokenizer_json(byte_bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip_digests(docs, bpe_tokenizer()).drop("text")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = token_counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), pieces).drop("text")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    index = line_dedup.add_documents(line_dedup.empty_index(spark), docs)
    return line_dedup.drop_repeated_lines(docs, index, text=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    return packing.pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, ids=False)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_toxicity_fm, op2_quality_rules, op2_quality_rules_full, op3_hnsw_dedup, op4_url_markov, op5_quality_net, op6_byte_bpe, op7_source_mix,
        op8_ngram_jaccard, op9_token_counts, op10_line_dedup, op11_hard_negatives, op12_packing, op13_importance_resampling,
    )
}
