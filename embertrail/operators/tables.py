"""Parquet tables: scans, run partitions and keyed merges.

A keyed table is a list of data folders named by its newest manifest. A merge writes one new folder, then one new manifest;
until that is there, readers and the next writer see the table as it was. Folders that hold replaced keys, and folders no
larger than what is written, go into the new one, so n loads leave about log2(n) folders and a row is rewritten about as
often. The manifest before the newest keeps its folders for readers under way; older ones are deleted. One writer at a time.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from embertrail.operators.scale import latest_wins, lookup_join
from embertrail.schemas import TABLES
from embertrail.session import durable

MANIFEST = "snapshot bigint, folder bigint, n bigint"
# Rows of one file of a folder, about.
FOLDER_FILE_ROWS = 1_000_000


def _path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def _read(spark: SparkSession, schema: T.StructType | str, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":  # nothing was written yet; any other failure is one
            return None
        raise


def _manifests(spark: SparkSession, root: str, table: str) -> dict[int, dict[int, int]]:
    """The folders and their rows as each manifest that is kept names them: a handful of numbers."""
    found = _read(spark, MANIFEST, f"{_path(root, table)}/manifests/*")
    held: dict[int, dict[int, int]] = {}
    for row in found.collect() if found is not None else []:
        held.setdefault(row["snapshot"], {})[row["folder"]] = row["n"]
    return held


def _folder(spark: SparkSession, root: str, table: str, folder: int) -> DataFrame:
    layout, _ = TABLES[table]
    return spark.read.schema(layout).parquet(f"{_path(root, table)}/data/{folder}")


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The stored table, empty when nothing was written yet. Columns added later read as NULL in older files."""
    layout, keys = TABLES[table]
    if "run_id" not in keys:
        manifests = _manifests(spark, root, table)
        if manifests:
            places = [f"{_path(root, table)}/data/{folder}" for folder in manifests[max(manifests)]]
            return spark.read.schema(layout).parquet(*places) if places else spark.createDataFrame([], layout)
    stored = _read(spark, layout, _path(root, table))
    return spark.createDataFrame([], layout) if stored is None else stored.select(*layout.names)


def write_run(df: DataFrame, root: str, table: str) -> None:
    """Write the run partitions in `df`; writing the same run again replaces it."""
    layout, _ = TABLES[table]
    (
        df.select(*[F.col(f.name).cast(f.dataType) for f in layout.fields])
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
        .parquet(_path(root, table))
    )


def merge_rows(current: DataFrame, incoming: DataFrame, keys: list[str], sequence: list[Column]) -> DataFrame:
    """Current rows with the incoming ones put over them; of several incoming rows of one key the last in `sequence`
    wins."""
    newest = latest_wins(incoming, keys, [c.desc() for c in sequence]).select(*current.columns)
    return current.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def merge_table(spark: SparkSession, root: str, table: str, incoming: DataFrame, sequence: list[Column]) -> None:
    """Upsert by key. New keys are appended; of stored rows only the key columns are read, and only folders that hold
    replaced keys are rewritten, apart from small ones that are put together. Merging the same rows again changes nothing."""
    layout, keys = TABLES[table]
    newest = durable(latest_wins(incoming, keys, [c.desc() for c in sequence]).select(*layout.names))
    manifests = _manifests(spark, root, table)
    folders = manifests[max(manifests)] if manifests else {}
    total, rows, joined = newest.count(), [newest], set()
    if folders:
        stored = functools.reduce(DataFrame.unionByName, (_folder(spark, root, table, f).select(*keys, F.lit(f).alias("folder")) for f in folders))
        found = lookup_join(stored, newest.select(*keys), keys, keys, "left_semi").groupBy("folder").agg(F.count(F.lit(1)).alias("n")).collect()
        for replaced in found:  # at most a row per folder
            joined.add(replaced["folder"])
            total += folders[replaced["folder"]] - replaced["n"]
            rows.append(_folder(spark, root, table, replaced["folder"]).join(newest.select(*keys), keys, "left_anti").select(*layout.names))
    for folder, n in sorted(folders.items(), key=lambda x: x[1]):
        if folder not in joined and n <= total:
            joined.add(folder)
            total += n
            rows.append(_folder(spark, root, table, folder))
    snapshot = max(manifests, default=0) + 1
    functools.reduce(DataFrame.unionByName, rows).coalesce(max(1, total // FOLDER_FILE_ROWS)).write.mode("overwrite").parquet(f"{_path(root, table)}/data/{snapshot}")
    now = {f: n for f, n in folders.items() if f not in joined} | {snapshot: total}
    listed = spark.createDataFrame([(snapshot, f, n) for f, n in now.items()], MANIFEST).coalesce(1)
    listed.write.mode("overwrite").parquet(f"{_path(root, table)}/manifests/{snapshot}")
    _forget(spark, root, table, manifests, now)


def _forget(spark: SparkSession, root: str, table: str, manifests: dict[int, dict[int, int]], now: dict[int, int]) -> None:
    """Deletes manifests before the last two, and the folders that only those name."""
    last = manifests[max(manifests)] if manifests else {}
    old = [m for m in manifests if m != max(manifests)]
    unused = {f for m in old for f in manifests[m]} - set(last) - set(now)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for place in [*(f"manifests/{m}" for m in old), *(f"data/{f}" for f in unused)]:
        path = hadoop(f"{_path(root, table)}/{place}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def latest_run(runs: DataFrame) -> DataFrame:
    """One row: the newest run and the one before it (NULL when there is none)."""
    newest = runs.select("run_id").distinct().orderBy(F.desc("run_id")).limit(2)
    return newest.agg(
        F.max("run_id").alias("run_id"),
        F.when(F.count(F.lit(1)) == 2, F.min("run_id")).alias("previous_run_id"),
    )


def of_latest_run(table: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the newest run; the one-row run table is broadcast, which prunes partitions at run time."""
    return table.join(F.broadcast(latest_run(runs).select("run_id")), "run_id", "left_semi")


def pending_embeddings(logs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Logs without a stored vector."""
    return logs.join(embeddings.select("log_id"), "log_id", "left_anti")


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct incoming rows whose key is not stored yet."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def append_alerts(anomalies: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Alerts as JSON lines. With a batch id they go to that batch's folder, and a replayed batch replaces its own."""
    if batch_id is None:
        anomalies.write.mode("append").json(path)
    else:
        anomalies.write.mode("overwrite").json(f"{path.rstrip('/')}/batch_id={batch_id}")


def write_reports(reports: DataFrame, path: str) -> None:
    """One row per report `(report_id, markdown)`, as Parquet."""
    reports.write.mode("overwrite").parquet(path)
