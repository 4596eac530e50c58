"""Live triage: every micro-batch of new log lines is ingested, embedded, compared with the earlier logs that lie near it,
checked for anomalies and folded into the incident table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from embertrail.operators.growing import GrowingClusters
from embertrail.operators.tables import append_alerts, merge_table, of_latest_run, read_table, write_run
from embertrail.plans.anomalies import detect_anomalies
from embertrail.plans.clusters import clustering_run
from embertrail.plans.embed import Provider, embed_logs
from embertrail.plans.incidents import promote_anomalies
from embertrail.schemas import LIVE_BATCHES
from embertrail.session import durable
from embertrail.sources.follow import follow_lines
from embertrail.sources.lines import number_lines, stream_lines
from embertrail.sources.logs import normalize_live_lines


@dataclass
class BatchResult:
    run_id: int | None
    ingested_logs: int
    embedded_logs: int
    anomaly_count: int


@dataclass
class LiveTriage:
    """Settings of one live stream; tables live under `root`."""

    root: str
    eps: float = 0.5
    min_samples: int = 2
    min_growth: int = 2
    z_threshold: float = 2.0
    match_threshold: float = 0.92
    window_minutes: int = 90
    service: str | None = None
    session_id: int | None = None
    provider: Provider | None = None
    alert_path: str | None = None
    stream: str = "live"
    on_batch: Callable[[BatchResult], None] | None = None
    on_anomalies: Callable[[DataFrame], None] | None = None

    def process_lines(self, lines: DataFrame, run_id: int) -> BatchResult:
        """One iteration over `lines(source, line_no, line, arrived_at)`. Every write replaces or merges by key, so a
        batch replayed after a failure leaves the same tables."""
        spark = lines.sparkSession
        logs = durable(normalize_live_lines(lines, F.col("arrived_at"), self.service, self.session_id))
        ingested = logs.count()
        if ingested == 0:
            return BatchResult(None, 0, 0, 0)
        merge_table(spark, self.root, "logs", logs, [F.col("ts"), F.col("raw")])
        all_logs = read_table(spark, self.root, "logs")
        fresh = durable(embed_logs(logs, read_table(spark, self.root, "embeddings"), self.provider))
        merge_table(spark, self.root, "embeddings", fresh, [F.col("created_at")])
        rows = all_logs.select("log_id", "ts", "service", "message").join(read_table(spark, self.root, "embeddings").select("log_id", "vector"), "log_id")
        clusters = GrowingClusters(f"{self.root.rstrip('/')}/growing-{self.eps:g}-{self.min_samples}", self.eps, self.min_samples)
        labels = durable(clusters.add(rows.select("log_id", "ts", "vector"), run_id))
        run = clustering_run(rows, labels, run_id, self.eps, self.min_samples)
        write_run(run.assignments, self.root, "assignments")
        write_run(run.snapshots, self.root, "cluster_history")
        write_run(run.run, self.root, "cluster_runs")
        found = self._promote(spark)
        return BatchResult(run_id, ingested, fresh.count(), found)

    def _promote(self, spark: SparkSession) -> int:
        table = lambda name: read_table(spark, self.root, name)
        runs = table("cluster_runs")
        anomalies = durable(
            detect_anomalies(table("cluster_history"), runs, self.min_growth, self.z_threshold, self.match_threshold)
        )
        count = anomalies.count()
        if not count:
            return 0
        members = table("logs").join(of_latest_run(table("assignments"), runs).select("log_id", "cluster_id"), "log_id")
        incidents, evidence = table("incidents"), table("evidence")
        done = promote_anomalies(
            anomalies, incidents, evidence, of_latest_run(table("cluster_history"), runs), members, table("run_sessions"),
            table("deploys"), self.window_minutes,
        )
        changed = durable(done.incidents.subtract(incidents))
        added = durable(done.evidence.join(evidence.select("evidence_id"), "evidence_id", "left_anti"))
        merge_table(spark, self.root, "incidents", changed, [F.col("incident_id")])
        merge_table(spark, self.root, "evidence", added, [F.col("evidence_id")])
        if self.on_anomalies:
            self.on_anomalies(anomalies)
        self._alerts = anomalies
        return count

    def run_of_batch(self, spark: SparkSession, batch_id: int) -> int:
        """The run id given to a batch of this stream before, else the next one after all stored runs and batches."""
        batches = read_table(spark, self.root, "live_batches")
        known = batches.filter((F.col("stream") == self.stream) & (F.col("batch_id") == batch_id)).first()
        if known:
            return known["run_id"]
        taken = batches.select("run_id").unionByName(read_table(spark, self.root, "cluster_runs").select(F.col("run_id").cast("bigint")))
        run_id = (taken.agg(F.max("run_id")).first()[0] or 0) + 1
        given = spark.createDataFrame([(self.stream, batch_id, run_id)], LIVE_BATCHES)
        merge_table(spark, self.root, "live_batches", given, [F.col("run_id")])
        return run_id

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For `foreachBatch`, over rows of `stream_lines` or `follow_lines`. A batch keeps its run id, so a retry overwrites."""
        self._alerts = None
        lines = batch if "line_no" in batch.columns else number_lines(batch)
        result = self.process_lines(lines, self.run_of_batch(batch.sparkSession, batch_id))
        if self.alert_path and self._alerts is not None:
            append_alerts(self._alerts, self.alert_path, batch_id)
        if self.on_batch:
            self.on_batch(result)

    def start(
        self, spark: SparkSession, folder: str, checkpoint: str, every: str | None = "2 seconds", max_files: int | None = None,
        growing: bool = False,
    ) -> StreamingQuery:
        """Follow a folder of rolled log files, or one whose files grow; `every=None` processes what is there and stops."""
        self.stream = checkpoint
        trigger = {"processingTime": every} if every else {"availableNow": True}
        lines = follow_lines(spark, folder) if growing else stream_lines(spark, folder, max_files)
        return (
            lines.writeStream.foreachBatch(self.process_batch)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start()
        )
