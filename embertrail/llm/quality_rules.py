"""Operator 2: quality rules and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Words and adjacent word pairs are hashed to a fixed number of buckets. Two multinomials over the buckets are counted, one
of the trusted documents and one of the whole corpus, both smoothed. A document's score is the mean, over its words and
pairs, of log(trusted share / corpus share); it is kept if it passes the base rules and the score reaches a fixed
threshold. Texts are read once: the bucket numbers are written as a table in the shared folder, and counting and scoring
read that.

Defined cases: a null or empty text has no words, fails the base rules and is not kept. Every row is judged by itself, so
repeated rows get equal results. Rows without an id are judged and are never trusted. Without trusted documents
every ratio is zero and the base rules alone decide. 3-word windows are told apart by a
64-bit hash. Other columns of `docs` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from embertrail.llm.common import SPACE
from embertrail.session import durable

# Buckets of words and of word pairs: a word's CRC-32 modulo as many values as two bytes have, and a mix of two words'
# buckets, which is never stored and so may be wider. Fixed, as are the ratios that are broadcast.
WORD_BUCKETS, PAIR_BUCKETS = 1 << 16, 1 << 20
# Fixed: the smallest two-byte number. Word buckets are stored from there on.
LOWEST = -(1 << 15)
# Occurrences added to each bucket of both multinomials, once the corpus is scaled to the target's size. What is seen once
# or twice then says little, so that documents outside the target do not lose by their rare words.
SMOOTHING = 5.0
# Mean log ratio (nats per n-gram) from which a document is kept.
THRESHOLD = -0.15
# Fixed: the white space and symbols that the base rules name.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def word_bucket(word: Column, buckets: int) -> Column:
    return (F.crc32(word.cast("binary")) % buckets + LOWEST).cast("smallint")


def base_columns(docs: DataFrame, word_buckets: int = WORD_BUCKETS) -> DataFrame:
    """`docs(doc_id, text)` with the counts of the base rules and `grams`, the bucket of every word, counted from LOWEST."""
    if word_buckets > WORD_BUCKETS:
        raise ValueError(f"word buckets are stored in two bytes, so {WORD_BUCKETS} at most")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    split = docs.select("doc_id", text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))
    long = F.size("words") > 2
    windows = F.when(
        long, F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(1))), lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("windows"),
        F.transform("words", lambda w: word_bucket(w, word_buckets)).alias("grams"),
    )
    # Only texts that repeat a window pay for the sort.
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    sorted_ = F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    placed = counted.withColumn("placed", sorted_).drop("windows")
    starts = F.transform(
        F.filter(
            F.transform("placed", lambda x, k: F.struct(
                x["i"].alias("i"),
                (F.coalesce((k > 0) & (F.get("placed", k - 1)["h"] == x["h"]), F.lit(False))
                 | F.coalesce(F.get("placed", k + 1)["h"] == x["h"], F.lit(False))).alias("again"),
            )),
            lambda x: x["again"],
        ),
        lambda x: x["i"],
    )
    marked = placed.withColumn("starts", starts).drop("placed")
    covered = F.array_distinct(F.concat("starts", F.transform("starts", lambda i: i + 1), F.transform("starts", lambda i: i + 2)))
    n_repeat = F.when(F.col("starts").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("bigint")
    return marked.withColumn("n_repeat_words", n_repeat).drop("starts")


def _numbered_grams(rows: DataFrame, word_buckets: int, pair_buckets: int, *carry: str) -> DataFrame:
    """One row per word and adjacent pair of each row, with its bucket; those of pairs begin at `word_buckets`."""
    plain = rows.select(*carry, F.transform("grams", lambda x: x.cast("int") - LOWEST).alias("grams"))
    pairs = F.when(
        F.size("grams") > 1,
        F.transform(F.slice("grams", 1, F.greatest(F.size("grams") - 1, F.lit(1))), lambda x, i: F.lit(word_buckets) + (x * 31 + F.get("grams", i + 1)) % pair_buckets),
    ).otherwise(F.array().cast("array<int>"))
    return plain.select(*carry, F.explode(F.concat("grams", pairs)).alias("gram"))


def log_ratios(rows: DataFrame, word_buckets: int, pair_buckets: int) -> DataFrame:
    """(gram, ratio) for every bucket that the corpus holds, at most one row a bucket. `rows` has `trusted` and `grams`."""
    counts = _numbered_grams(rows, word_buckets, pair_buckets, "trusted").groupBy("gram").agg(
        F.count(F.lit(1)).alias("corpus"), F.sum(F.col("trusted").cast("bigint")).alias("target")
    )
    counts = durable(counts)
    kind = F.col("gram") >= word_buckets
    totals = counts.groupBy(kind.alias("kind")).agg(F.sum("corpus").alias("all_corpus"), F.sum("target").alias("all_target"))
    scaled = F.col("corpus") * (F.col("all_target") / F.col("all_corpus"))
    return counts.join(F.broadcast(totals), kind == F.col("kind")).select(
        "gram", (F.log(F.col("target") + SMOOTHING) - F.log(scaled + SMOOTHING)).alias("ratio")
    )


def judge_quality(
    docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, word_buckets: int = WORD_BUCKETS, pair_buckets: int = PAIR_BUCKETS
) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, score and kept for every row of `docs(doc_id, text)`.

    `trusted(doc_id)` names the documents of the target.
    """
    sure = trusted.select(F.col("doc_id").alias("sure_id")).distinct()
    base = base_columns(docs, word_buckets).withColumn("row_no", F.monotonically_increasing_id())
    base = durable(base)
    # Shuffled at every size, in two bytes a word: the trusted ids have no bound that would allow a broadcast.
    flagged = base.select("row_no", "doc_id", "grams").join(sure.hint("shuffle_hash"), F.col("doc_id") == F.col("sure_id"), "left")
    rows = flagged.select("row_no", F.col("sure_id").isNotNull().alias("trusted"), "grams")
    # A task hands on one row a bucket at most, however much it reads: few large tasks shuffle less than many small ones.
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, base.rdd.getNumPartitions() // 4)
    rows = rows.coalesce(tasks)
    ratios = log_ratios(rows, word_buckets, pair_buckets)
    # Fixed size, hence broadcast. A row's n-grams lie in one task, so partial sums leave one row per document.
    scored = _numbered_grams(base, word_buckets, pair_buckets, "row_no").join(F.broadcast(ratios), "gram").groupBy("row_no").agg(F.avg("ratio").alias("score"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base.drop("grams").join(scored, "row_no", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score",
        (~failed & F.coalesce(F.col("score") >= threshold, F.lit(False))).alias("kept"),
    )
