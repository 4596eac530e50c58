"""Deploy events from record files and from landed deployment-API responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from embertrail.functions import payload as P
from embertrail.functions.timestamps import parse_timestamp
from embertrail.operators.scale import evaluate_once
from embertrail.sources.logs import SERVICE_KEYS, arrival_columns, split_valid
from embertrail.sources.payloads import read_payloads

DEPLOY_TIME_KEYS = ("deployed_at", "timestamp", "time", "@timestamp")
FILE_KEYS = ("changed_files", "files", "modified_files")
DEPLOY_KEYS = (
    *DEPLOY_TIME_KEYS, *FILE_KEYS, *SERVICE_KEYS, "id", "deployment_id", "commit_sha", "sha", "commit", "version", "release", "build",
    "environment", "env", "branch", "ref", "repo_url", "repository", "html_url", "provider", "source",
)


def normalize_deploys(records: DataFrame, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(deploys, rejected): a usable time and a service are required. With `ordered` deploys also carry `arrival`."""
    payload = P.Fields("fields")
    opened = evaluate_once(records, fields=P.taken_out(F.col("payload"), *DEPLOY_KEYS))
    files = F.coalesce(*[P.truthy_value(payload, key) for key in FILE_KEYS])
    named = evaluate_once(
        opened, time_text=P.first_truthy(payload, *DEPLOY_TIME_KEYS),
        service=P.first_truthy(payload, *SERVICE_KEYS),
    )
    named = evaluate_once(named, deployed_at=parse_timestamp(F.col("time_text")))
    problem = F.when(F.col("deployed_at").isNull(), F.lit("no valid deploy time")).when(
        F.col("service").isNull(), F.lit("no service field")
    )
    valid, rejected = split_valid(named.withColumn("problem", F.coalesce("problem", problem)))
    valid = evaluate_once(
        valid, commit_sha=P.first_truthy_or_last(payload, "commit_sha", "sha", "commit"), raw=P.canonical_json(F.col("payload")), files=files
    )
    identifier = F.coalesce(
        P.first_truthy(payload, "id", "deployment_id"), F.nullif("commit_sha", F.lit("")), P.content_hash(F.col("raw"), 16)
    )
    deploys = valid.select(
        identifier.alias("deploy_id"),
        "deployed_at",
        "service",
        P.first_truthy_or_last(payload, "version", "release", "build").alias("version"),
        P.first_truthy_or_last(payload, "environment", "env").alias("environment"),
        "commit_sha",
        P.first_truthy_or_last(payload, "branch", "ref").alias("branch"),
        P.string_list(F.col("files")).alias("changed_files"),
        P.first_truthy_or_last(payload, "repo_url", "repository", "html_url").alias("repo_url"),
        P.first_truthy_or_last(payload, "provider", "source").alias("provider"),
        "raw",
        *(arrival_columns(records) if ordered else []),
    )
    return deploys, rejected.select("source", "record_text", "problem")


def read_deploys(spark: SparkSession, path: str, fmt: str | None = None, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    return normalize_deploys(read_payloads(spark, path, fmt), ordered)


def deploys_from_api(items: DataFrame, service: str, job_time: Column, environment: str | None = None, limit: int | None = None) -> DataFrame:
    """Deploy events from landed deployment responses, rows of `(position, payload)`."""
    payload = F.col("payload")
    rows = items.filter(F.col("problem").isNull()) if "problem" in items.columns else items
    if limit is not None:
        rows = rows.orderBy("position").limit(limit)
    sha = P.text_field(payload, "sha")
    when = parse_timestamp(P.first_truthy(payload, "updated_at", "created_at"))
    return rows.select(
        F.concat(F.lit("github-deployment-"), F.coalesce(P.text_field(payload, "id"), F.lit("None"))).alias("deploy_id"),
        F.coalesce(when, job_time).alias("deployed_at"),
        F.lit(service).alias("service"),
        F.nullif(F.substring(sha, 1, 12), F.lit("")).alias("version"),
        F.coalesce(P.truthy_field(payload, "environment"), F.lit(environment).cast("string")).alias("environment"),
        sha.alias("commit_sha"),
        P.text_field(payload, "ref").alias("branch"),
        F.array().cast("array<string>").alias("changed_files"),
        P.text_field(payload, "url").alias("repo_url"),
        F.lit("github_deployments").alias("provider"),
        P.canonical_json(payload).alias("raw"),
    )


def commits_from_api(items: DataFrame, pulls: DataFrame | None = None) -> DataFrame:
    """`(requested_sha, sha, html_url, files, pull_branch)` from landed commit and pull-request responses.

    `items` holds `(requested_sha, payload)`; `pulls` holds `(requested_sha, payload)` with the response's list.
    """
    payload = F.col("payload")
    files = F.transform(
        F.coalesce(F.try_variant_get(payload, "$.files", "array<variant>"), F.array().cast("array<variant>")),
        lambda entry: F.try_variant_get(entry, "$.filename", "string"),
    )
    commits = items.select(
        "requested_sha",
        P.truthy_field(payload, "sha").alias("sha"),
        P.truthy_field(payload, "html_url").alias("html_url"),
        F.filter(files, lambda name: name.isNotNull() & (name != "")).alias("files"),
    )
    if pulls is None:
        return commits.withColumn("pull_branch", F.lit(None).cast("string"))
    branches = pulls.select(
        "requested_sha", F.try_variant_get(payload, "$[0].head.ref", "string").alias("pull_branch")
    )
    return commits.join(branches, "requested_sha", "left")
