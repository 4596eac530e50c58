"""Connected components by repeated local contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from embertrail.session import durable


def _clean(edges: DataFrame) -> DataFrame:
    ordered = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return durable(ordered.distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """`(row_id, root)` for every endpoint of `edges(a, b)`; the root is the component's smallest id.

    Each round gives every vertex a fresh pseudo-random rank and merges it into the lowest-ranked vertex of its
    neighbourhood, then keeps only edges between different merged vertices. The graph shrinks by a constant factor per
    round (in expectation) also on long chains, and a hub with many neighbours disappears in one round. Neighbourhood
    minima are partially aggregated before the shuffle.
    """
    left = _clean(edges)
    labels: DataFrame | None = None
    turn = 0
    while not left.isEmpty():
        def rank(column: str):
            return F.xxhash64(F.lit(turn), F.col(column))

        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            left.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        lowest = both.groupBy("u").agg(F.min_by("v", rank("v")).alias("v"))
        merged = durable(lowest.select("u", F.when(rank("u") <= rank("v"), F.col("u")).otherwise(F.col("v")).alias("into")))
        if labels is None:
            labels = merged.select(F.col("u").alias("row_id"), F.col("into").alias("label"))
        else:
            labels = labels.join(merged, F.col("label") == F.col("u"), "left").select(
                "row_id", F.coalesce("into", "label").alias("label")
            )
        first = merged.select(F.col("u").alias("a"), F.col("into").alias("new_a"))
        second = merged.select(F.col("u").alias("b"), F.col("into").alias("new_b"))
        left = _clean(left.join(first, "a").join(second, "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b")))
        turn += 1
    if labels is None:
        return edges.sparkSession.createDataFrame([], "row_id bigint, root bigint")
    labels = durable(labels)
    roots = labels.groupBy("label").agg(F.min("row_id").alias("root"))
    return labels.join(roots, "label").select("row_id", "root")
