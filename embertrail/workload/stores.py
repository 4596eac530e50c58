"""Queries that go through files and stored tables: ingest, case files, alerts, embeddings and clusters by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embertrail.functions.payload import json_text_list
from embertrail.operators.growing import GrowingClusters
from embertrail.operators.tables import append_alerts, read_table
from embertrail.plans.clusters import cluster_logs
from embertrail.plans.embed import embed_logs
from embertrail.plans.ingest import ingest_deploys, ingest_logs
from embertrail.schemas import EMBEDDINGS
from embertrail.session import durable
from embertrail.sources.cases import read_cases
from embertrail.workload import records, triage, views as V

# Cases of one file, and clusters' settings.
CASES_PER_FILE = 250


def ingested_deploys(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a deploy of its user in JSONL files that are loaded twice, completed from nations as commits.

    Of a user's events the last one in the files stays.
    """
    path, root = f"{records.scratch(spark, 'deploys')}.jsonl", records.scratch(spark, "store")
    moment = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    V.events(spark, folder).orderBy("event_id").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("deployment_id"), moment.alias("deployed_at"), F.col("event_type").alias("service"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("version"), F.concat(F.lit("c"), (F.col("k") % 40).cast("string")).alias("commit_sha"),
    ).write.json(path)
    commits = V.table(spark, folder, "nation").select(
        F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("requested_sha"), F.concat(F.lit("full-"), F.col("n_name")).alias("sha"),
        F.lit(None).cast("string").alias("html_url"), F.array(F.concat("n_name", F.lit(".py"))).alias("files"), F.lit("topic").alias("pull_branch"),
    )
    for _ in range(2):
        ingest_deploys(spark, root, path, commits=commits)
    stored = read_table(spark, root, "deploys")
    return stored.select("deploy_id", "service", "version", "commit_sha", F.coalesce("branch", F.lit("")).alias("branch"), F.array_join("changed_files", "|").alias("changed_files"))


def ingested_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item's ship mode as a JSONL log, loaded twice: equal records are one log."""
    path, root = f"{records.scratch(spark, 'logs')}.jsonl", records.scratch(spark, "store")
    V.table(spark, folder, "lineitem").select(
        F.concat(F.lit("shipped "), F.col("l_suppkey").cast("string"), F.lit(" as "), F.col("l_linestatus")).alias("message"), F.col("l_returnflag").alias("level"), F.lit("shipping").alias("service")
    ).write.json(path)
    for _ in range(2):
        ingest_logs(spark, root, path)
    return read_table(spark, root, "logs").select("service", "level", "message")


def case_file_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation cases as a folder of JSON files that hold a list each."""
    path = records.scratch(spark, "cases")
    cases = records.evaluation_cases(spark, folder).withColumn("file", F.floor(F.col("doc_id") / CASES_PER_FILE))
    cases.groupBy("file").agg(F.collect_list("case").alias("cases")).write.partitionBy("file").json(path)  # one object a file
    return records.rounded_metrics(read_cases(spark, path))


def alert_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The newest run's anomalies as alert files of two batches, the second written twice as a replay would."""
    path = records.scratch(spark, "alerts")
    found = durable(triage.anomalies_latest_run(spark, folder))
    halves = [found.filter(F.col("cluster_id") % 2 == i) for i in range(2)]
    for batch, rows in ((0, halves[0]), (1, halves[1]), (1, halves[1])):
        append_alerts(rows, path, batch)
    return spark.read.schema(found.schema).json(path).select(*found.columns)


def json_text_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties as lists held in text, beside texts that hold none."""
    k = F.col("k")
    text = F.when(k % 4 == 0, F.to_json(F.array("event_type", k.cast("string")))).when(k % 4 == 1, F.lit("[]")).when(k % 4 == 2, F.lit("not a list")).otherwise(F.col("props"))
    return V.events(spark, folder).select("event_id", F.array_join(json_text_list(text), "|").alias("items"))


def clusters_by_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors' density clusters after the last of three batches, each compared with what it lies near."""
    rows = durable(records.vector_rows(spark, folder))
    clusters = GrowingClusters(records.scratch(spark, "growing"), 0.6, 2, V.CHECKED_TILE_ROWS)
    for batch in range(3):  # what earlier batches held is skipped
        labels = clusters.add(rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(3)) <= batch).drop("vec_id"), batch + 1)
    return labels.select(F.col("log_id").cast("bigint").alias("vec_id"), "cluster_id")


def default_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The library's own vectors of every document text: how many parts they have, how many of them are set, and their length."""
    docs = V.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("log_id"), F.col("text").alias("message"))
    rows = embed_logs(docs, spark.createDataFrame([], EMBEDDINGS))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("log_id", F.size("vector").alias("width"), F.size(F.filter("vector", lambda x: x != 0)).alias("parts"), F.round(F.sqrt(total), 9).alias("length"))


def default_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """All logs embedded by the library's own vectors and clustered by density."""
    logs = V.logs(spark, folder)
    run = cluster_logs(logs, embed_logs(logs, spark.createDataFrame([], EMBEDDINGS)), run_id=1, eps=0.1, min_samples=2)
    return run.snapshots.select("cluster_id", "log_count", "example_message")


QUERIES = {
    q.__name__: q
    for q in (ingested_deploys, ingested_logs, case_file_metrics, alert_lines, json_text_lists, clusters_by_batches, default_embeddings, default_clusters)
}
