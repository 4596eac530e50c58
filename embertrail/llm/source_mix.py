"""Operator 7: mixing sources to target weights by capped water-filling.

Every source has a size (words) and a weight. Targets share the total by weight; a target above `max_epochs` times its
source is clamped there and the excess goes to the others by weight, until none is above. A source is then repeated whole
as often as its target holds it, and the rest is taken from it once more: documents in the order of a seeded hash, up to
the one whose middle passes what is missing, so that taken words differ from the target by about half a document.

The order is never sorted per source as a whole. Sizes are added up per hash bucket, buckets per source are summed, and
only the one bucket of each source in which its cut lies is looked into.

Defined cases: a null or empty text has size 0 and a null source is a source of its own, last in order. Rows that share an
id are taken alike; all rows without an id are one. Sources of size 0 have target 0. An empty table gives an empty mix.
Column names of the result replace equal names in `docs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from embertrail.llm.common import WORD
from embertrail.operators.scale import number_rows
from embertrail.session import durable

# Hexadecimal digits of the hash that name a bucket: 4,096 buckets per source.
DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded_order(doc_id: Column, seed: str = "") -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def cycling_weights(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """(source, source_size, weight) with the weights repeating over the sources by code point, null last."""
    numbered = number_rows(sources, [F.col("source").asc_nulls_last()], "place")
    return numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))).drop("place")


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """The words per unit of weight at which all targets, clamped, add up to all sizes.

    Each round is one sum over the sources; at least one more source is clamped per round, and only three numbers reach
    the driver.
    """
    level = clamped = None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= F.col("source_size") * max_epochs
        row = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(full, F.col("source_size") * max_epochs)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.coalesce(F.sum(full.cast("int")), F.lit(0)).alias("clamped"),
        ).first()
        if row["clamped"] == clamped or not row["open"]:
            return level or 0.0
        clamped, level = row["clamped"], (row["total"] - row["held"]) / row["open"]


def source_targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Adds `target` (words) to (source, source_size, weight)."""
    level = water_level(sources, max_epochs)
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), (F.col("source_size") * max_epochs).cast("double")))


def repetitions(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """`sized(source, size, hash, bucket, ...)` with `source_size`, `target` and `times`, how often each row is taken."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = targets.select("source", "source_size", "target", whole.alias("whole"))
    plan = plan.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    buckets = buckets.withColumn("before", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
    plan = plan.withColumnRenamed("source", "_source")
    buckets = durable(buckets.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"))
    cut = (F.col("before") < F.col("extra")) & (F.col("before") + F.col("in_bucket") > F.col("extra"))
    inside = buckets.filter(cut).select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "before", "extra")
    looked = sized.join(inside, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    alike = looked.groupBy("source", "bucket", "hash").agg(F.sum("size").alias("alike"), F.first("before").alias("before"), F.first("extra").alias("extra"))
    order = Window.partitionBy("source", "bucket").orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("alike").over(order)
    last = alike.withColumn("upto", upto).filter(2 * F.col("upto") - F.col("alike") <= 2 * F.col("extra"))
    last = last.groupBy(F.col("source").alias("_s"), F.col("bucket").alias("_b")).agg(F.max("hash").alias("last_hash"))
    judged = buckets.join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")), "left").select(
        F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "source_size", "target", "whole", "last_hash",
        (F.col("before") + F.col("in_bucket") <= F.col("extra")).alias("taken_whole"),
    )
    once_more = F.col("taken_whole") | F.coalesce(F.col("hash") <= F.col("last_hash"), F.lit(False))
    joined = sized.join(judged, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    return joined.withColumn("times", F.col("whole") + once_more.cast("bigint")).drop("_source", "_bucket", "whole", "last_hash", "taken_whole")


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    order = seeded_order(F.col("doc_id"), seed)
    return durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("hash"))).withColumn("bucket", F.substring("hash", 1, DIGITS))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "") -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) for every row of `docs`."""
    sized = _sized(docs, seed)
    sources = cycling_weights(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    taken = repetitions(sized, source_targets(durable(sources), max_epochs))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "") -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken."""
    sized = _sized(docs, seed)
    sources = cycling_weights(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    times = repetitions(sized, source_targets(durable(sources), max_epochs))
    times = times.groupBy(F.col("source").alias("_of"), F.col("doc_id").alias("_doc")).agg(F.max("times").alias("_times")).filter(F.col("_times") > 0)
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_of"))
    kept = docs.join(times.hint("shuffle_hash"), same)
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
