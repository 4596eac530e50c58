"""Column layouts of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "array<double>": T.ArrayType(T.DoubleType()),
}


def _layout(columns: str) -> T.StructType:
    pairs = [column.strip().split(" ") for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LOGS = _layout(
    "log_id string, ts timestamp, service string, level string, message string, raw string, session_id bigint, "
    "deploy_id string, commit_sha string, branch string, changed_files array<string>"
)
EMBEDDINGS = _layout("log_id string, model_name string, vector array<double>, created_at timestamp")
ASSIGNMENTS = _layout("run_id bigint, log_id string, cluster_id bigint")
CLUSTER_RUNS = _layout(
    "run_id bigint, eps double, min_samples int, total_logs bigint, noise_count bigint, created_at timestamp"
)
CLUSTER_HISTORY = _layout(
    "run_id bigint, cluster_id bigint, cluster_key string, log_count bigint, first_seen timestamp, "
    "last_seen timestamp, example_message string, services array<string>, centroid array<double>"
)
CLUSTER_SUMMARIES = _layout(
    "cluster_key string, cluster_id bigint, description string, affected_services array<string>, "
    "timeline array<string>, representative_logs array<string>, suspected_root_cause string, confidence double, "
    "deploy_correlation array<string>"
)
DEPLOYS = _layout(
    "deploy_id string, deployed_at timestamp, service string, version string, environment string, "
    "commit_sha string, branch string, changed_files array<string>, repo_url string, provider string, raw string"
)
RUN_SESSIONS = _layout(
    "session_id bigint, command string, started_at timestamp, ended_at timestamp, exit_code int, git_sha string, "
    "branch string, changed_files array<string>"
)
INCIDENTS = _layout(
    "incident_id bigint, cluster_key string, cluster_id bigint, status string, severity string, title string, "
    "summary string, first_seen timestamp, last_seen timestamp, current_size bigint, confidence double"
)
EVIDENCE = _layout(
    "evidence_id bigint, incident_id bigint, evidence_type string, details string"
)
REGRESSIONS = _layout(
    "regression_id bigint, regression_type string, cluster_id bigint, cluster_key string, deploy_id string, "
    "service string, deployed_at timestamp, commit_sha string, branch string, changed_files array<string>, "
    "before_count bigint, after_count bigint, delta bigint, percent_change double, first_seen_after timestamp, "
    "severity string, confidence double, reason string, example_message string"
)

LIVE_BATCHES = _layout("stream string, batch_id bigint, run_id bigint")

# Table name -> (layout, key columns). Run tables are keyed by run_id and written one partition per run.
TABLES: dict[str, tuple[T.StructType, list[str]]] = {
    "logs": (LOGS, ["log_id"]),
    "embeddings": (EMBEDDINGS, ["log_id"]),
    "assignments": (ASSIGNMENTS, ["run_id", "log_id"]),
    "cluster_runs": (CLUSTER_RUNS, ["run_id"]),
    "cluster_history": (CLUSTER_HISTORY, ["run_id", "cluster_id"]),
    "cluster_summaries": (CLUSTER_SUMMARIES, ["cluster_key"]),
    "deploys": (DEPLOYS, ["deploy_id"]),
    "run_sessions": (RUN_SESSIONS, ["session_id"]),
    "incidents": (INCIDENTS, ["incident_id"]),
    "evidence": (EVIDENCE, ["evidence_id"]),
    "live_batches": (LIVE_BATCHES, ["stream", "batch_id"]),
    "regressions": (REGRESSIONS, ["regression_type", "cluster_key", "deploy_id"]),
}
