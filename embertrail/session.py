"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "embertrail", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for (UTC clock, AQE with skew-join splitting)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's own checkpoint folder.

    A machine-local folder is created only for a local master without that setting (tests); on a cluster a missing
    setting is an error, since executors could not read each other's files.
    """
    context = spark.sparkContext
    configured = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="embertrail-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialize `df` once as Parquet in the shared checkpoint folder and return a scan of it.

    Cuts lineage, survives the loss of executors, and gives the optimizer real sizes and prunable columns.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/embertrail-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
