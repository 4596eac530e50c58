"""Clustering runs: assignments, per-cluster snapshots and the run record."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from embertrail.functions.services import strip_space
from embertrail.functions.signatures import SIGNATURES_PER_KEY, cluster_key, message_signature
from embertrail.operators.density import NOISE, density_clusters
from embertrail.operators.scale import lookup_join, number_rows, top_rows
from embertrail.session import durable


class ClusterRun(NamedTuple):
    run: DataFrame
    assignments: DataFrame
    snapshots: DataFrame


def row_order() -> Column:
    """Log rows in time order, missing times last, ids breaking ties."""
    return F.struct(F.col("ts").isNull(), F.col("ts"), F.col("log_id"))


def centroids(members: DataFrame, by: str = "cluster_id") -> DataFrame:
    """Element-wise mean vector per group, summed partially before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col("vector")))
    return members.groupBy(by).agg(vector_to_array(mean).alias("centroid"))


def cluster_snapshots(members: DataFrame) -> DataFrame:
    """One row per cluster from `members(cluster_id, log_id, ts, service, message[, vector])`, noise left out."""
    members = members.filter(F.col("cluster_id") >= 0)
    facts = members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("log_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.min_by("message", row_order()).alias("example_message"),
        F.array_sort(F.collect_set(F.nullif("service", F.lit("")))).alias("services"),
    )
    distinct = members.select("cluster_id", message_signature(F.col("message")).alias("signature")).distinct()
    first = top_rows(distinct, ["cluster_id"], [F.col("signature")], SIGNATURES_PER_KEY)
    signatures = first.groupBy("cluster_id").agg(F.array_sort(F.collect_list("signature")).alias("signatures"))
    lowered = F.array_sort(F.array_distinct(F.transform("services", lambda s: F.lower(strip_space(s)))))
    snapshots = facts.join(signatures, "cluster_id").withColumn("cluster_key", cluster_key(lowered, F.col("signatures")))
    if "vector" in members.columns:
        snapshots = snapshots.join(centroids(members), "cluster_id")
    else:
        snapshots = snapshots.withColumn("centroid", F.array().cast("array<double>"))
    return snapshots.select(
        "cluster_id", "cluster_key", "log_count", "first_seen", "last_seen", "example_message", "services", "centroid"
    )


def cluster_order() -> list[Column]:
    return [F.desc("log_count"), F.asc("cluster_id")]


def cluster_logs(logs: DataFrame, embeddings: DataFrame, run_id: int, eps: float = 0.3, min_samples: int = 3) -> ClusterRun:
    """Density clusters over every embedded log. Logs meet their vectors once; clustering and snapshots scan what is kept."""
    rows = durable(logs.select("log_id", "ts", "service", "message").join(embeddings.select("log_id", "vector"), "log_id"))
    labels = durable(density_clusters(rows.select("log_id", "ts", "vector"), eps, min_samples))
    return clustering_run(rows, labels, run_id, eps, min_samples)


def clustering_run(rows: DataFrame, labels: DataFrame, run_id: int, eps: float, min_samples: int) -> ClusterRun:
    """Run record, assignments and snapshots for `labels(log_id, cluster_id)`."""
    run = labels.agg(
        F.lit(run_id).cast("bigint").alias("run_id"), F.lit(eps).alias("eps"), F.lit(min_samples).alias("min_samples"),
        F.count(F.lit(1)).alias("total_logs"), F.count_if(F.col("cluster_id") == NOISE).alias("noise_count"),
        F.current_timestamp().alias("created_at"),
    )
    stamp = F.lit(run_id).cast("bigint").alias("run_id")
    snapshots = cluster_snapshots(rows.join(labels, "log_id"))
    return ClusterRun(run, labels.select(stamp, "log_id", "cluster_id"), snapshots.select(stamp, "*"))


def signature_clusters(logs: DataFrame) -> DataFrame:
    """`(log_id, cluster_id, cluster_key)` by service and message signature alone, numbered by first row."""
    service = F.coalesce("service", F.lit(""))
    names = F.when(service == "", F.array().cast("array<string>")).otherwise(F.array(F.lower(strip_space(service))))
    # Read twice below; making a signature costs far more than keeping its key.
    keyed = durable(logs.select("log_id", "ts", cluster_key(names, F.array(message_signature(F.col("message")))).alias("cluster_key")))
    first = keyed.groupBy("cluster_key").agg(F.min(row_order()).alias("first"))
    numbered = number_rows(first, [F.col("first.col1"), F.col("first.ts"), F.col("first.log_id")], "n")
    ids = numbered.select("cluster_key", (F.col("n") - 1).alias("cluster_id"))
    return lookup_join(keyed.select("log_id", "cluster_key"), ids, ["cluster_key"], ["log_id"]).select(
        "log_id", "cluster_id", "cluster_key"
    )
