"""Loading files into the stored tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from embertrail.operators.tables import merge_table
from embertrail.plans.ci import ci_patterns
from embertrail.plans.deploys import enrich_deploys
from embertrail.session import durable
from embertrail.sources.ci import read_ci
from embertrail.sources.deploys import read_deploys
from embertrail.sources.logs import read_logs


def _stored_in_order(spark: SparkSession, root: str, table: str, rows: DataFrame) -> DataFrame:
    """Merge rows, numbered by their reader, into a table; of two equal keys the later in the input wins. Returns the rows."""
    arrived = durable(rows)
    merge_table(spark, root, table, arrived, [F.col("arrival")])
    return arrived.drop("arrival")


class Ingested(NamedTuple):
    rows: DataFrame
    rejected: DataFrame


def ingest_logs(spark: SparkSession, root: str, path: str, fmt: str | None = None) -> Ingested:
    logs, rejected = read_logs(spark, path, fmt, ordered=True)
    return Ingested(_stored_in_order(spark, root, "logs", logs), rejected)


def ingest_deploys(spark: SparkSession, root: str, path: str, fmt: str | None = None, commits: DataFrame | None = None) -> Ingested:
    deploys, rejected = read_deploys(spark, path, fmt, ordered=True)
    if commits is not None:
        deploys = enrich_deploys(deploys, commits)
    return Ingested(_stored_in_order(spark, root, "deploys", deploys), rejected)


def ingest_ci(spark: SparkSession, root: str, path: str, job_time, fmt: str | None = None) -> tuple[Ingested, DataFrame]:
    """CI failures stored as logs, and the failure patterns of this batch."""
    records, rejected = read_ci(spark, path, job_time, fmt, ordered=True)
    records = _stored_in_order(spark, root, "logs", records)
    return Ingested(records, rejected), ci_patterns(records)
