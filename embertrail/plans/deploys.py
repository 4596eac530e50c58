"""Deploys near a cluster's lifetime, and deploys completed with commit data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from embertrail.functions.scoring import labelled, present
from embertrail.functions.timestamps import timestamp_text
from embertrail.operators.scale import lookup_join, running_sums, top_rows
from embertrail.session import durable


def enrich_deploys(deploys: DataFrame, commits: DataFrame) -> DataFrame:
    """Deploys completed from `commits(requested_sha, sha, html_url, files, pull_branch)`; others pass unchanged."""
    found = commits.withColumnRenamed("requested_sha", "commit_key").withColumn("hit", F.lit(True))
    keyed = deploys.withColumn("commit_key", present(F.col("commit_sha")))
    joined = keyed.join(found, "commit_key", "left")
    hit = F.col("hit").isNotNull()
    replaced = {
        "commit_sha": F.coalesce("sha", "commit_sha"),
        "branch": F.when(hit, F.coalesce(present(F.col("branch")), F.col("pull_branch"))).otherwise(F.col("branch")),
        "changed_files": F.when(F.size("files") > 0, F.col("files")).otherwise(F.col("changed_files")),
        "repo_url": F.coalesce("html_url", "repo_url"),
        "provider": F.when(hit & (F.col("provider").isNull() | (F.col("provider") == "local_git")), F.lit("github")).otherwise(F.col("provider")),
    }
    return joined.select(*[replaced.get(name, F.col(name)).alias(name) for name in deploys.columns])


def deploys_near_clusters(clusters: DataFrame, deploys: DataFrame, window_minutes: int = 90, k: int = 5) -> DataFrame:
    """`(cluster_id, rank, deploy_id)`: per cluster the k first deploys of its services within the window around
    [first_seen, last_seen].

    Deploys are numbered per service in time order. A cluster's first deploy in range is then one more than the number
    of deploys before its window, read off a running count over deploys and window starts together; the k candidates
    follow by an equi join on (service, number). Nothing is compared pair by pair, and a busy service is spread over
    many tasks.
    """
    window = F.make_dt_interval(mins=F.lit(window_minutes))
    reach = clusters.filter(F.col("first_seen").isNotNull() & F.col("last_seen").isNotNull()).select(
        "cluster_id", F.explode(F.array_distinct("services")).alias("service"), (F.col("first_seen") - window).alias("at"),
        (F.col("last_seen") + window).alias("until"),
    )
    none = F.lit(None)
    events = reach.select(
        "service", "at", F.lit(0).alias("is_deploy"), F.col("cluster_id").cast("string").alias("tie"), "cluster_id", "until",
        none.cast("string").alias("deploy_id"),
    ).unionByName(
        deploys.select(
            "service", F.col("deployed_at").alias("at"), F.lit(1).alias("is_deploy"), F.col("deploy_id").alias("tie"),
            none.cast(clusters.schema["cluster_id"].dataType).alias("cluster_id"), none.cast("timestamp").alias("until"), "deploy_id",
        )
    )
    counted = durable(
        running_sums(events, ["service"], [F.col("at"), F.col("is_deploy"), F.col("tie")], {"passed": F.col("is_deploy").cast("bigint")})
    )
    numbered = counted.filter(F.col("is_deploy") == 1).select("service", F.col("passed").alias("number"), "deploy_id", F.col("at").alias("deployed_at"))
    wanted = counted.filter(F.col("is_deploy") == 0).select(
        "service", "cluster_id", "until", F.explode(F.sequence(F.col("passed") + 1, F.col("passed") + k)).alias("number")
    )
    near = lookup_join(wanted, numbered, ["service", "number"], ["cluster_id"]).filter(F.col("deployed_at") <= F.col("until"))
    return top_rows(near, ["cluster_id"], [F.asc("deployed_at"), F.asc("deploy_id")], k).select("cluster_id", "rank", "deploy_id")


def correlate_deploys(clusters: DataFrame, deploys: DataFrame, window_minutes: int = 90, k: int = 5) -> DataFrame:
    """`(cluster_id, rank, deploy_id, details)` with the sentence describing each deploy."""
    near = deploys_near_clusters(clusters, deploys, window_minutes, k)
    facts = deploys.select(
        "deploy_id", "service", "deployed_at", "version", "environment", "commit_sha", "branch", "changed_files", "repo_url"
    )
    files = F.array_join(F.slice("changed_files", 1, 5), ", ")
    details = F.concat(
        F.col("service"), F.lit(" deployed "), F.coalesce(present(F.col("version")), F.lit("unknown version")), F.lit(" to "),
        F.coalesce(present(F.col("environment")), F.lit("unknown env")), F.lit(" at "), timestamp_text(F.col("deployed_at")),
        F.lit(" (event "), F.col("deploy_id"), labelled("commit", F.col("commit_sha")), labelled("branch", F.col("branch")),
        labelled("changed_files", files), labelled("url", F.col("repo_url")), F.lit(")"),
    )
    return lookup_join(near, facts, ["deploy_id"], ["cluster_id"]).select("cluster_id", "rank", "deploy_id", details.alias("details"))
