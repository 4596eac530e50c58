"""CI failure patterns: how often each failing test fails, and whether it is flaky."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Statuses that count as a failed run.
FAILED_STATUSES = ("failed", "failure", "timed_out", "cancelled")


def ci_patterns(records: DataFrame, sequence: Column | None = None) -> DataFrame:
    """One row per (signature, test, workflow) of `records`, the result of `normalize_ci`.

    `sequence` orders the records for the first failing commit; time and id by default.
    """
    signature = F.lower(F.coalesce("failure_signature", F.nullif("test_name", F.lit("")), "message"))
    place = F.struct("ts", "log_id") if sequence is None else sequence
    grouped = records.groupBy(signature.alias("pattern"), "test_name", "workflow").agg(
        F.count_if(F.col("status").isin(*FAILED_STATUSES)).alias("failed_runs"),
        F.count(F.lit(1)).alias("total_runs"),
        F.min_by("failing_commit", F.when(F.col("failing_commit").isNotNull(), place)).alias("commit_sha"),
    )
    flaky = (F.col("failed_runs") > 0) & (F.col("failed_runs") < F.col("total_runs"))
    reason = F.concat(
        F.lit("Test "), F.coalesce(F.nullif("test_name", F.lit("")), F.lit("unknown")), F.lit(" failed in "),
        F.col("failed_runs").cast("string"), F.lit("/"), F.col("total_runs").cast("string"), F.lit(" recent CI runs"),
        F.when(flaky, F.lit(" and appears flaky")).otherwise(F.lit("")), F.lit("."),
    )
    return grouped.select("pattern", "test_name", "workflow", "failed_runs", "total_runs", flaky.alias("flaky"), "commit_sha", reason.alias("reason"))


def pattern_order() -> list[Column]:
    return [F.desc("flaky"), F.desc("failed_runs"), F.desc("total_runs"), F.asc("pattern")]
