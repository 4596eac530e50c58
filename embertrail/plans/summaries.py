"""Cluster summaries: from a template, or through prompts and generated text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from embertrail.functions.generated import parse_confidence, parse_generated
from embertrail.functions.scoring import present, summary_confidence
from embertrail.functions.timestamps import timestamp_text
from embertrail.operators.representatives import first_logs, ordered_texts
from embertrail.plans.deploys import correlate_deploys

# Fixed texts: these sentences, and those of the prompt below, must match.
TEMPLATE_CAUSE = (
    "Likely a recurring issue in the affected service path. Inspect the representative logs and recent deploys around "
    "the first occurrence."
)
GENERATED_CAUSE = "Model-generated summary; validate against representative logs and deploy history."


def dominant_levels(members: DataFrame) -> DataFrame:
    """`(cluster_id, level)`: the most frequent level, ties to the one seen first. Levels are counted before they are
    compared, so a large cluster contributes a handful of rows."""
    place = F.struct(F.col("ts").isNull(), F.col("ts"), F.col("log_id"))
    counted = members.filter(present(F.col("level")).isNotNull()).groupBy("cluster_id", "level").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first")
    )
    return counted.groupBy("cluster_id").agg(F.min_by("level", F.struct(-F.col("n"), F.col("first"))).alias("level"))


def timeline_lines(log_count: Column) -> Column:
    """First seen, last seen (where known) and how many logs there are."""
    def seen(label: str, column: str) -> Column:
        return F.concat(F.lit(f"{label}: "), timestamp_text(F.col(column)))

    observed = F.concat(F.lit("Observed "), log_count.cast("string"), F.lit(" related logs in the latest clustering run."))
    return F.array_compact(F.array(seen("First seen", "first_seen"), seen("Last seen", "last_seen"), observed))


def _representatives(members: DataFrame) -> DataFrame:
    return ordered_texts(first_logs(members, 5), "cluster_id", "rank", "message", "representative_logs")


def _with_deploys(summaries: DataFrame, clusters: DataFrame, deploys: DataFrame, window_minutes: int) -> DataFrame:
    near = ordered_texts(correlate_deploys(clusters, deploys, window_minutes), "cluster_id", "rank", "details", "deploy_correlation")
    none = F.array().cast("array<string>")
    return summaries.join(near, "cluster_id", "left").select(
        "cluster_key", "cluster_id", "description", "affected_services", "timeline", "representative_logs", "suspected_root_cause",
        "confidence", F.coalesce("deploy_correlation", none).alias("deploy_correlation"),
    )


def template_summaries(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Summaries written from a fixed template, without deploys. `members` are the clusters' logs."""
    facts = clusters.join(dominant_levels(members), "cluster_id", "left").join(_representatives(members), "cluster_id")
    level = F.lower(F.coalesce("level", F.lit("UNKNOWN")))
    return facts.select(
        "cluster_key", "cluster_id",
        F.concat(
            F.lit("Cluster "), F.col("cluster_id").cast("string"), F.lit(" groups repeated "), level,
            F.lit(" log events with the pattern '"), F.col("example_message"), F.lit("'."),
        ).alias("description"),
        F.col("services").alias("affected_services"), timeline_lines(F.col("log_count")).alias("timeline"), "representative_logs",
        F.lit(TEMPLATE_CAUSE).alias("suspected_root_cause"), summary_confidence(F.col("log_count")).alias("confidence"),
    )


def summarize_clusters(clusters: DataFrame, members: DataFrame, deploys: DataFrame, window_minutes: int = 90) -> DataFrame:
    """Template summaries of every cluster with its correlated deploys, in the `cluster_summaries` layout."""
    return _with_deploys(template_summaries(clusters, members), clusters, deploys, window_minutes)


def summary_prompts(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """`(cluster_id, prompt)`: the cluster's facts and its first eight logs."""
    unknown = F.lit("unknown")
    line = F.concat(
        F.lit("- ["), F.coalesce(timestamp_text(F.col("ts")), unknown), F.lit("] service="), F.coalesce(present(F.col("service")), unknown),
        F.lit(" level="), F.coalesce(present(F.col("level")), unknown), F.lit(" message="), F.col("message"),
    )
    lines = ordered_texts(first_logs(members, 8).withColumn("line", line), "cluster_id", "rank", "line", "lines")
    services = F.coalesce(present(F.array_join("services", ", ")), unknown)
    prompt = F.concat_ws(
        "\n",
        F.lit("You are an SRE assistant analyzing a cluster of production logs."),
        F.lit("Return exactly these fields on separate lines:"),
        *[F.lit(f"{label}:") for label in ("Description", "Affected Services", "Timeline", "Suspected Root Cause", "Confidence")],
        F.lit(""),
        F.lit("Facts:"),
        F.concat(F.lit("- Cluster ID: "), F.col("cluster_id").cast("string")),
        F.concat(F.lit("- Log Count: "), F.col("log_count").cast("string")),
        F.concat(F.lit("- First Seen: "), F.coalesce(timestamp_text(F.col("first_seen")), unknown)),
        F.concat(F.lit("- Last Seen: "), F.coalesce(timestamp_text(F.col("last_seen")), unknown)),
        F.concat(F.lit("- Services: "), services),
        F.lit(""),
        F.lit("Representative logs:"),
        F.array_join("lines", "\n"),
        F.lit(""),
        F.lit("Be concise, operational, and avoid speculation beyond the logs."),
    )
    return clusters.join(lines, "cluster_id").select("cluster_id", prompt.alias("prompt"))


def generate(prompts: DataFrame, provider: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """`(cluster_id, generated)` from a pluggable text generator, called per Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cluster_id": batch["cluster_id"], "generated": provider(batch["prompt"])})

    return prompts.mapInPandas(run, f"cluster_id {prompts.schema['cluster_id'].dataType.simpleString()}, generated string")


def generated_summaries(clusters: DataFrame, members: DataFrame, generated: DataFrame) -> DataFrame:
    """Summaries from generated text, with cluster facts wherever the text says nothing."""
    facts = clusters.join(generated, "cluster_id").join(_representatives(members), "cluster_id")
    rows = facts.withColumn("fields", parse_generated(F.coalesce("generated", F.lit(""))))
    fallback = F.concat(
        F.lit("Cluster "), F.col("cluster_id").cast("string"), F.lit(" groups repeated events matching '"), F.col("example_message"), F.lit("'.")
    )

    def or_else(found: Column, other: Column) -> Column:
        return F.when(F.size(found) > 0, found).otherwise(other)

    return rows.select(
        "cluster_key", "cluster_id", F.coalesce(present(F.col("fields.description")), fallback).alias("description"),
        or_else(F.col("fields.services"), F.col("services")).alias("affected_services"),
        or_else(F.col("fields.timeline"), timeline_lines(F.col("log_count"))).alias("timeline"), "representative_logs",
        F.coalesce(present(F.col("fields.root_cause")), F.lit(GENERATED_CAUSE)).alias("suspected_root_cause"),
        parse_confidence(F.col("fields.confidence")).alias("confidence"),
    )


def summarize_with(
    provider: Callable[[pd.Series], pd.Series], clusters: DataFrame, members: DataFrame, deploys: DataFrame, window_minutes: int = 90
) -> DataFrame:
    """Like `summarize_clusters`, with the text written by a generator."""
    generated = generate(summary_prompts(clusters, members), provider)
    return _with_deploys(generated_summaries(clusters, members, generated), clusters, deploys, window_minutes)


def stored_summaries(summaries: DataFrame, clusters: DataFrame) -> DataFrame:
    """Stored summaries of the clusters that exist in the newest run."""
    return summaries.drop("cluster_id").join(clusters.select("cluster_key", "cluster_id"), "cluster_key")
