"""Log records from payloads, plain text and live lines, in the `logs` layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from embertrail.functions import payload as P
from embertrail.functions.services import NAMING_KEYS, infer_service, service_from_message, strip_space
from embertrail.functions.timestamps import parse_timestamp
from embertrail.operators.scale import evaluate_once
from embertrail.schemas import LOGS
from embertrail.sources.lines import number_lines, text_lines
from embertrail.sources.payloads import format_of, read_payloads

MESSAGE_KEYS = ("message", "msg", "log", "event")
TIME_KEYS = ("timestamp", "ts", "time", "@timestamp")
SERVICE_KEYS = ("service", "service_name", "app")
LINKED_KEYS = ("session_id", "deploy_id", "commit_sha", "sha", "branch", "changed_files")
LOG_KEYS = (*MESSAGE_KEYS, *TIME_KEYS, *SERVICE_KEYS, *NAMING_KEYS, "level", "severity", *LINKED_KEYS)


def _linked_columns(payload: P.Payload) -> list[Column]:
    return [
        P.text_field(payload, "session_id").try_cast("bigint").alias("session_id"),
        P.text_field(payload, "deploy_id").alias("deploy_id"),
        P.first_truthy_or_last(payload, "commit_sha", "sha").alias("commit_sha"),
        P.text_field(payload, "branch").alias("branch"),
        P.string_list(P.raw_field(payload, "changed_files")).alias("changed_files"),
    ]


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) by the `problem` column."""
    return records.filter(F.col("problem").isNull()).drop("problem"), records.filter(F.col("problem").isNotNull())


def arrival_columns(records: DataFrame) -> list[Column]:
    """What tells the order in which records arrived, as far as the reader knows it."""
    return [F.struct(*[F.col(c) for c in ("arrival", "position") if c in records.columns]).alias("arrival")] if "arrival" in records.columns else []


def normalize_logs(records: DataFrame, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(logs, rejected) from payload rows; with `ordered` the logs also carry `arrival`, their place in the input."""
    payload = P.Fields("fields")
    opened = evaluate_once(records, fields=P.taken_out(F.col("payload"), *LOG_KEYS))
    named = evaluate_once(opened, message=P.first_truthy(payload, *MESSAGE_KEYS)).withColumn(
        "problem", F.coalesce("problem", F.when(F.col("message").isNull(), F.lit("no message field")))
    )
    valid, rejected = split_valid(named)
    valid = evaluate_once(valid, raw=P.canonical_json(F.col("payload")), time_text=P.first_truthy(payload, *TIME_KEYS))
    logs = valid.select(
        P.log_id(F.col("raw"), F.col("message")).alias("log_id"),
        parse_timestamp(F.col("time_text")).alias("ts"),
        F.coalesce(P.first_truthy(payload, *SERVICE_KEYS), infer_service(payload, F.col("message"))).alias("service"),
        P.first_truthy_or_last(payload, "level", "severity").alias("level"),
        "message",
        "raw",
        *_linked_columns(payload),
        *(arrival_columns(records) if ordered else []),
    )
    return logs, rejected.select("source", "record_text", "problem")


def logs_from_lines(lines: DataFrame, ordered: bool = False) -> DataFrame:
    """Logs from numbered plain-text lines; the line number is part of a line's identity."""
    raw = F.to_json(F.struct(F.col("line_no").alias("line_number"), F.col("line").alias("message")))
    return lines.select(
        P.log_id(raw, F.col("line")).alias("log_id"),
        F.lit(None).cast("timestamp").alias("ts"),
        service_from_message(F.col("line")).alias("service"),
        F.lit(None).cast("string").alias("level"),
        F.col("line").alias("message"),
        raw.alias("raw"),
        *[F.lit(None).cast(LOGS[name].dataType).alias(name) for name in ("session_id", "deploy_id", "commit_sha", "branch")],
        F.array().cast("array<string>").alias("changed_files"),
        *([F.struct("source", "line_no").alias("arrival")] if ordered else []),
    )


def read_logs(spark: SparkSession, path: str, fmt: str | None = None, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(logs, rejected); the format follows the suffix, anything unknown is plain text."""
    fmt = fmt or format_of(path)
    if fmt == "text":
        lines = number_lines(text_lines(spark, path))
        logs = logs_from_lines(lines, ordered)
        none = spark.createDataFrame([], "source string, record_text string, problem string")
        return logs, none
    return normalize_logs(read_payloads(spark, path, fmt), ordered)


def normalize_live_lines(lines: DataFrame, arrived_at: Column, service: str | None = None, session_id: int | None = None) -> DataFrame:
    """Logs from `(source, line_no, line)` rows that are either a JSON object or plain text.

    The arrival time and the given service fill a field only where the payload lacks its key; a given session id always
    wins. Ids hash `(source, line_no, line)`, so replaying a line gives the same row.
    """
    line = F.col("line")
    parsed = F.when(line.startswith("{"), F.try_parse_json(line))
    text_object = F.to_json(F.struct(line.alias("message")))
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    payload = P.Fields("fields")
    rows = evaluate_once(lines.withColumn("line", strip_space(F.col("line"))).filter(F.col("line") != ""), parsed=parsed)
    rows = evaluate_once(rows, payload=F.when(is_object, F.col("parsed")).otherwise(F.try_parse_json(text_object)))
    rows = evaluate_once(rows, fields=P.taken_out(F.col("payload"), *LOG_KEYS))
    rows = evaluate_once(rows, message=P.first_truthy(payload, *MESSAGE_KEYS)).filter(F.col("message").isNotNull())
    rows = evaluate_once(
        rows, time_text=P.first_truthy(payload, *TIME_KEYS),
        named=F.coalesce(P.first_truthy(payload, *SERVICE_KEYS[1:]), infer_service(payload, F.col("message"))),
    )
    given = F.when(P.has_key(payload, "service"), F.lit(None).cast("string")).otherwise(F.lit(service).cast("string"))
    identity = F.concat_ws("\u001f", "source", F.col("line_no").cast("string"), "line")
    linked = _linked_columns(payload)
    if session_id is not None:
        linked[0] = F.lit(session_id).cast("bigint").alias("session_id")
    return rows.select(
        P.log_id(identity, F.col("message")).alias("log_id"),
        F.when(P.has_key(payload, "timestamp"), parse_timestamp(F.col("time_text"))).otherwise(arrived_at).alias("ts"),
        F.coalesce(P.truthy_field(payload, "service"), given, F.col("named")).alias("service"),
        P.first_truthy_or_last(payload, "level", "severity").alias("level"),
        "message",
        P.canonical_json(F.col("payload")).alias("raw"),
        *linked,
    )
