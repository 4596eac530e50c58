"""CI failure records from record files and from landed workflow-run responses."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from embertrail.functions import payload as P
from embertrail.functions.signatures import ci_signature
from embertrail.functions.timestamps import parse_timestamp
from embertrail.operators.scale import evaluate_once
from embertrail.sources.logs import LINKED_KEYS, arrival_columns, _linked_columns, split_valid
from embertrail.sources.payloads import read_payloads

CI_MESSAGE_KEYS = ("message", "failure_message", "log", "error", "conclusion")
CI_TIME_KEYS = ("timestamp", "started_at", "completed_at", "created_at")
CI_KEYS = (
    *CI_MESSAGE_KEYS, *CI_TIME_KEYS, *LINKED_KEYS, "test_name", "workflow", "failure_signature", "service", "level", "status", "source_type",
)
RUN_KEYS = (
    "conclusion", "jobs_url", "name", "display_title", "head_sha", "head_branch", "id", "run_number", "html_url", "logs_url", "started_at",
    "completed_at", "created_at", "updated_at",
)
JOB_KEYS = ("conclusion", "name", "id", "html_url", "logs_url", "started_at", "completed_at")
# More characters than a text can hold.
MOST_CHARS = 2**31 - 1
FAILED_CONCLUSIONS = ("failure", "timed_out", "cancelled", "action_required")


def _with_defaults(text: Column, fields: P.Fields, forced: dict[str, Column], defaults: dict[str, Column]) -> Column:
    """Canonical JSON of the payload, given by its JSON text and its fields, with fields forced, and others added where
    their key is absent. Forced fields must not be NULL.

    Where the payload has none of the forced fields, the additions are put in front of its text.
    """
    own = F.map_filter(F.from_json(text, "map<string,variant>"), lambda key, _: ~key.isin(*forced))
    added = {**forced, **{k: F.when(~P.has_key(fields, k), v) for k, v in defaults.items()}}
    more = F.to_json(F.struct(*[v.alias(k) for k, v in added.items()]))
    replaced = F.to_json(F.map_concat(own, F.from_json(more, "map<string,variant>")))
    behind = F.when(text == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(text, 2, MOST_CHARS)))
    put_in_front = F.concat(F.regexp_replace(more, r"\}\z", ""), behind)
    clash = functools.reduce(Column.__or__, (P.has_key(fields, k) for k in forced))
    return F.to_json(F.try_parse_json(F.when(clash, replaced).otherwise(put_in_front)))


def normalize_ci(records: DataFrame, job_time: Column, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ci logs, rejected). A missing or unreadable time becomes the job's start, so reruns agree.

    Next to the log columns the result keeps what the failure patterns need: signature, test, workflow, status.
    """
    valid, rejected = split_valid(records)
    payload = P.Fields("fields")
    valid = evaluate_once(valid, fields=P.taken_out(F.col("payload"), *CI_KEYS), own_text=P.canonical_json(F.col("payload")))
    message = F.coalesce(
        P.first_truthy(payload, *CI_MESSAGE_KEYS), F.lit("CI failure")
    )
    rows = evaluate_once(
        valid, message=message, test_name=P.text_field(payload, "test_name"), workflow=P.text_field(payload, "workflow"),
        time_text=P.first_truthy(payload, *CI_TIME_KEYS),
    )
    test_name, workflow = F.nullif("test_name", F.lit("")), F.nullif("workflow", F.lit(""))
    rows = evaluate_once(rows, signature=ci_signature(test_name, workflow, F.col("message")))
    stated = P.truthy_field(payload, "failure_signature")
    rows = evaluate_once(
        rows, failure_signature=F.when(P.has_key(payload, "failure_signature"), stated).otherwise(F.col("signature")),
        raw=_with_defaults(
            F.col("own_text"), payload,
            forced={"source_type": F.lit("ci")},
            defaults={
                "service": F.lit("ci"), "level": F.lit("ERROR"), "message": F.col("message"), "failure_signature": F.col("signature"),
            },
        ),
    )
    when = parse_timestamp(F.col("time_text"))
    logs = rows.select(
        F.concat(F.lit("ci-"), P.content_hash(F.col("raw"), 16)).alias("log_id"),
        F.coalesce(when, job_time).alias("ts"),
        F.coalesce(P.truthy_field(payload, "service"), F.lit("ci")).alias("service"),
        F.coalesce(P.truthy_field(payload, "level"), F.lit("ERROR")).alias("level"),
        "message",
        "raw",
        *_linked_columns(payload),
        "failure_signature",
        "test_name",
        "workflow",
        F.lower(F.coalesce(P.truthy_field(payload, "status"), F.lit("failed"))).alias("status"),
        P.first_truthy(payload, "commit_sha", "sha").alias("failing_commit"),
        *(arrival_columns(records) if ordered else []),
    )
    return logs, rejected.select("source", "record_text", "problem")


def read_ci(spark: SparkSession, path: str, job_time: Column, fmt: str | None = None, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    return normalize_ci(read_payloads(spark, path, fmt, list_keys=("runs", "failures")), job_time, ordered)


def _failed(conclusion: Column) -> Column:
    return F.lower(conclusion).isin(*FAILED_CONCLUSIONS)


def failures_from_runs(runs: DataFrame, jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """CI failure payload rows from landed responses: one per failed job of a failed run, or one for the run itself
    when none of its jobs failed.

    `runs` holds `(position, payload)`, `jobs` holds `(jobs_url, payload)`.
    """
    if limit is not None:
        runs = runs.orderBy("position").limit(limit)
    run, job = P.Fields("run"), P.Fields("job")
    opened_runs = evaluate_once(runs.select("payload"), run=P.taken_out(F.col("payload"), *RUN_KEYS)).drop("payload")
    opened_jobs = evaluate_once(jobs.select("jobs_url", "payload"), job=P.taken_out(F.col("payload"), *JOB_KEYS)).drop("payload")
    failed_runs = opened_runs.filter(_failed(P.text_field(run, "conclusion"))).withColumn("jobs_url", P.truthy_field(run, "jobs_url"))
    failed_jobs = opened_jobs.filter(_failed(P.text_field(job, "conclusion")))
    joined = evaluate_once(
        failed_runs.join(failed_jobs, "jobs_url", "left"), workflow=P.first_truthy(run, "name", "display_title"),
        job_name=P.truthy_field(job, "name"),
    )
    workflow, job_name = F.col("workflow"), F.col("job_name")
    whose = F.coalesce(workflow, F.lit("workflow"))
    message = F.when(job_name.isNotNull(), F.concat(job_name, F.lit(" failed in "), whose)).otherwise(
        F.concat(whose, F.lit(" failed"))
    )

    def own(key: str) -> Column:
        return F.when(F.col("job").isNotNull(), P.text_field(job, key)).otherwise(P.text_field(run, key))

    record = F.struct(
        workflow.alias("workflow"),
        job_name.alias("test_name"),
        F.coalesce(F.nullif(own("conclusion"), F.lit("")), F.lit("failed")).alias("status"),
        message.alias("message"),
        message.alias("failure_message"),
        F.coalesce(job_name, workflow, message).alias("failure_signature"),
        P.text_field(run, "head_sha").alias("commit_sha"),
        P.text_field(run, "head_branch").alias("branch"),
        P.text_field(run, "id").alias("run_id"),
        P.text_field(run, "run_number").alias("run_number"),
        P.text_field(job, "id").alias("job_id"),
        own("html_url").alias("html_url"),
        own("logs_url").alias("logs_url"),
        F.coalesce(F.nullif(own("started_at"), F.lit("")), P.text_field(run, "created_at")).alias("started_at"),
        F.coalesce(F.nullif(own("completed_at"), F.lit("")), P.text_field(run, "updated_at")).alias("completed_at"),
        F.lit("ci").alias("source_type"),
        F.lit("github_actions").alias("provider"),
    )
    texts = joined.select(F.lit("workflow runs").alias("source"), F.to_json(record).alias("record_text"))
    return evaluate_once(texts, payload=F.try_parse_json("record_text")).withColumn("problem", F.lit(None).cast("string"))
