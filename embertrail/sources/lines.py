"""Text lines with 1-based line numbers, without putting a whole file into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"(?U)\S")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """`(source, block_start, arrived_at, value)` per line; large files stay splittable."""
    return _located(spark.read.text(path))


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The streaming form of `text_lines`, for folders that receive rolled log files."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _located(reader.text(path))


def _located(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_modification_time").alias("arrived_at"), "value",
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """`(source, line_no, line, arrived_at)`; blank lines count but are dropped.

    Rows of one file block keep their order inside a scan task, so a line's number is its distance from the block's
    first row plus the line counts of the file's earlier blocks. Only per-block counts are shuffled (one small row per
    block, partially counted on the map side).
    """
    placed = lines.withColumn("row_mark", F.monotonically_increasing_id())
    blocks = placed.groupBy("source", "block_start").agg(
        F.min("row_mark").alias("first_mark"), F.count(F.lit(1)).alias("n")
    )
    earlier = Window.partitionBy("source").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("lines_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return (
        placed.filter(~is_blank(F.col("value")))
        .join(blocks, ["source", "block_start"])
        .select(
            "source",
            (F.col("row_mark") - F.col("first_mark") + F.col("lines_before") + 1).alias("line_no"),
            F.col("value").alias("line"),
            "arrived_at",
        )
    )
