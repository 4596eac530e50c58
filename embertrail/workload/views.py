"""Log-triage tables derived from the given star-schema tables, each in Spark and as SQL with the same meaning.

Nothing is sampled or filtered away: every event is a log row, every signup event is also a deploy, and every day is a
clustering run over that day's logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from embertrail.operators.scale import widen
from embertrail.plans.clusters import cluster_snapshots, signature_clusters
from embertrail.session import durable


# Tiles of this size make many zones and tiles meet on the given tables; larger ones are for larger tables.
CHECKED_TILE_ROWS = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return widen(spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))


def instant(ts: Column) -> Column:
    """Timestamps leave the queries as text, so both engines print the same."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def events(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def run_of(ts: Column) -> Column:
    """A run per day, numbered by the day since the epoch."""
    return F.unix_date(ts.cast("date")).cast("bigint")


def session_of() -> Column:
    return F.col("user_id") * 100_000 + run_of(F.col("ts"))


def node() -> Column:
    return F.floor(F.col("user_id") / 16).cast("bigint")


def logs(spark: SparkSession, folder: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    message = F.concat(
        F.col("event_type"), F.lit(" failed on node n"), node().cast("string"), F.lit(" code "), F.col("k").cast("string"),
        F.lit(" at 0x"), F.format_string("%x", "k"),
    )
    return events(spark, folder).select(
        F.format_string("log-%012d", "event_id").alias("log_id"), "ts", F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("service"),
        level.alias("level"), message.alias("message"), session_of().alias("session_id"),
    )


def deploys(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id").cast("string")
    files = F.when(F.col("k") % 4 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("app/file_"), F.col("k").cast("string"), F.lit(".py")), F.concat(F.lit("lib/part_"), (F.col("k") % 7).cast("string"), F.lit(".py")))
    )
    return events(spark, folder).filter(F.col("event_type") == "signup").select(
        F.format_string("deploy-%012d", "event_id").alias("deploy_id"), F.col("ts").alias("deployed_at"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("service"),
        F.when(F.col("k") % 5 != 0, F.concat(F.lit("v"), F.col("k").cast("string"))).alias("version"),
        F.when(F.col("k") % 2 == 0, F.lit("prod")).otherwise(F.lit("staging")).alias("environment"),
        F.when(F.col("k") % 6 != 0, F.substring(F.sha2(key, 256), 1, 12)).alias("commit_sha"),
        F.when(F.col("k") % 3 != 0, F.lit("main")).alias("branch"), files.alias("changed_files"),
        F.lit(None).cast("string").alias("repo_url"), F.lit("fixture").alias("provider"), F.col("props").alias("raw"),
    )


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Logs with their signature cluster."""
    rows = logs(spark, folder)
    return durable(rows.join(signature_clusters(rows), "log_id"))


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_snapshots(members(spark, folder))


def daily_history(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """One clustering run per day: the day's size and example per signature cluster."""
    rows = (members(spark, folder) if of is None else of).withColumn("run_id", run_of(F.col("ts")))
    place = F.struct("ts", "log_id")
    return rows.groupBy("run_id", "cluster_id", "cluster_key").agg(
        F.count(F.lit(1)).alias("log_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.min_by("message", place).alias("example_message"), F.array_sort(F.collect_set("service")).alias("services"),
    ).withColumn("centroid", F.array().cast("array<double>"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return logs(spark, folder).select(run_of(F.col("ts")).alias("run_id")).distinct()


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Every (cluster, day) as a cluster of its own, with that day's lifetime."""
    return daily_history(spark, folder).withColumn("cluster_id", F.col("cluster_id") * 100_000 + F.col("run_id"))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """A run session per user and day; half of them have ended, and every seventh carries a number that no log has."""
    folded = events(spark, folder).groupBy(session_of().alias("session_id")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.max("k").alias("k")
    )
    even = F.col("k") % 2 == 0
    number = F.when(F.col("k") % 7 == 0, -F.col("session_id")).otherwise(F.col("session_id"))
    return folded.select(
        number.alias("session_id"), F.concat(F.lit("run job-"), F.col("k").cast("string")).alias("command"), "started_at",
        F.when(even, F.col("ended_at")).alias("ended_at"), F.when(even, (F.col("k") % 3).cast("int")).alias("exit_code"),
        F.when(F.col("k") % 5 != 0, F.concat(F.lit("sha"), F.col("k").cast("string"))).alias("git_sha"),
    )


# ---- The same tables as SQL -------------------------------------------------------------------------------------

EVENTS = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
LOGS = """logs AS (
  SELECT 'log-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS log_id, ts, 'svc-' || (user_id % 4) AS service,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS level,
         event_type || ' failed on node n' || (user_id // 16) || ' code ' || k || ' at 0x' || printf('%x', k) AS message,
         user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS session_id
  FROM ev)"""
DEPLOYS = """deploys AS (
  SELECT 'deploy-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS deploy_id, ts AS deployed_at, 'svc-' || (user_id % 4) AS service,
         CASE WHEN k % 5 <> 0 THEN 'v' || k END AS version, CASE WHEN k % 2 = 0 THEN 'prod' ELSE 'staging' END AS environment,
         CASE WHEN k % 6 <> 0 THEN substr(sha256(CAST(event_id AS VARCHAR)), 1, 12) END AS commit_sha,
         CASE WHEN k % 3 <> 0 THEN 'main' END AS branch,
         CASE WHEN k % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['app/file_' || k || '.py', 'lib/part_' || (k % 7) || '.py'] END AS changed_files
  FROM ev WHERE event_type = 'signup')"""
SIGNATURES = r"""sigs AS (
  SELECT *, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(message)), '\b\d+\b', '<num>', 'g'),
         '0x[0-9a-f]+', '<hex>', 'g'), '\b[0-9a-f]{8,}\b', '<id>', 'g'), '\s+', ' ', 'g'), 1, 160) AS signature
  FROM logs)"""
MEMBERS = """keyed AS (SELECT *, substr(sha256(lower(service) || '|' || signature), 1, 16) AS cluster_key FROM sigs),
key_ids AS (
  SELECT cluster_key, row_number() OVER (ORDER BY first_row) - 1 AS cluster_id
  FROM (SELECT cluster_key, min(strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || log_id) AS first_row FROM keyed GROUP BY cluster_key)),
members AS (SELECT keyed.*, cluster_id FROM keyed JOIN key_ids USING (cluster_key))"""
CLUSTERS = """clusters AS (
  SELECT cluster_id, cluster_key, count(*) AS log_count, min(ts) AS first_seen, max(ts) AS last_seen,
         arg_min(message, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || log_id) AS example_message,
         list_sort(list(DISTINCT service)) AS services
  FROM members GROUP BY cluster_id, cluster_key)"""
HISTORY = """history AS (
  SELECT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS run_id, cluster_id, cluster_key, count(*) AS log_count, min(ts) AS first_seen, max(ts) AS last_seen,
         arg_min(message, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || log_id) AS example_message, min(service) AS service
  FROM members GROUP BY ALL)"""
SESSIONS = """sessions AS (
  SELECT CASE WHEN k % 7 = 0 THEN -session_id ELSE session_id END AS session_id, 'run job-' || k AS command, started_at, CASE WHEN k % 2 = 0 THEN ended_at END AS ended_at,
         CASE WHEN k % 2 = 0 THEN k % 3 END AS exit_code, CASE WHEN k % 5 <> 0 THEN 'sha' || k END AS git_sha
  FROM (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS session_id, min(ts) AS started_at, max(ts) AS ended_at, max(k) AS k
        FROM ev GROUP BY 1))"""
BASE = ",\n".join([EVENTS, LOGS])
CLUSTERED = ",\n".join([BASE, SIGNATURES, MEMBERS])


def with_tables(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def sql_instant(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
