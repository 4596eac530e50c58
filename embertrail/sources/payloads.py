"""Record files as rows of `(source, payload VARIANT, problem)`.

`problem` is NULL for usable records; the others are kept as rejects, so one bad record does not stop a load.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from embertrail.functions.payload import truthy_value
from embertrail.operators.scale import evaluate_once
from embertrail.sources.lines import is_blank

_NULL_MARK = "\u0000"
CSV_ROWS = (
    "source string, arrival struct<source:string,block_start:bigint,row_mark:bigint>, record_text string, payload variant, problem string"
)


def format_of(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    return {".json": "json", ".jsonl": "jsonl", ".csv": "csv"}.get(suffix, "text")


def _is_object(column: str):
    return F.schema_of_variant(F.col(column)).startswith("OBJECT")


def _checked(records: DataFrame) -> DataFrame:
    problem = F.when(F.col("payload").isNull(), "not readable as JSON").when(
        ~_is_object("payload"), "not a JSON object"
    )
    return records.withColumn("problem", problem)


def payloads_from_text(records: DataFrame, text: str = "value") -> DataFrame:
    """One JSON record per row of text; blank rows are skipped."""
    kept = records.filter(~is_blank(F.col(text)))
    return _checked(evaluate_once(kept, payload=F.try_parse_json(text)).withColumnRenamed(text, "record_text"))


def _arrival() -> Column:
    """Where a row stands in its input: file, block, and place among the rows of its scan task."""
    return F.struct(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_mark"),
    ).alias("arrival")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), _arrival(), "value")
    return payloads_from_text(lines)


def read_json_documents(spark: SparkSession, path: str, list_keys: tuple[str, ...] = (), glob: str | None = None) -> DataFrame:
    """Whole JSON documents: an array of records, one object, or an object holding the records under one of
    `list_keys` (the first key with a truthy value decides)."""
    options = {"pathGlobFilter": glob} if glob else {}
    documents = spark.read.text(path, wholetext=True, **options).select(
        F.col("_metadata.file_path").alias("source"), _arrival(), F.col("value").alias("record_text")
    )
    return explode_documents(evaluate_once(documents, document=F.try_parse_json("record_text")), list_keys)


def explode_documents(documents: DataFrame, list_keys: tuple[str, ...] = ()) -> DataFrame:
    document = F.col("document")
    inner = F.coalesce(*[truthy_value(document, key) for key in list_keys], F.lit(None).cast("variant"))
    inner_is_list = F.coalesce(F.schema_of_variant(inner).startswith("ARRAY"), F.lit(False))
    records = F.when(F.schema_of_variant(document).startswith("ARRAY"), document).when(inner_is_list, inner)
    as_list = F.try_variant_get(records, "$", "array<variant>")
    listed = F.when(records.isNotNull(), as_list).otherwise(F.array(document))
    rest = [name for name in documents.columns if name != "document"]
    return _checked(documents.select(*rest, F.posexplode(listed).alias("position", "payload")))


def read_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """CSV with a header, every field text. Short rows are kept, rows with extra fields are rejected.

    Files of a folder may name their columns differently or in another order: files with equal first lines are read
    together, and every record carries its own file's names. `multiline=False` lets Spark split large files when no
    quoted field holds a line break.
    """
    lines = spark.read.text(path).select("value", _arrival()).filter("arrival.block_start = 0")
    heads = lines.groupBy(F.col("arrival.source").alias("source")).agg(F.min_by("value", "arrival.row_mark").alias("head"))
    groups = heads.groupBy("head").agg(F.sort_array(F.collect_list("source")).alias("files")).orderBy("head").collect()
    parts = [_read_csv_alike(spark, group["files"], multiline) for group in groups]
    if not parts:
        return spark.createDataFrame([], CSV_ROWS)
    return functools.reduce(DataFrame.unionByName, parts)


def _read_csv_alike(spark: SparkSession, path: str | list[str], multiline: bool) -> DataFrame:
    """CSV files that share one header."""
    options = dict(header=True, escape='"', multiLine=multiline, nullValue=_NULL_MARK, emptyValue="", quote='"')
    header = spark.read.options(**options).csv(path).columns
    layout = T.StructType([T.StructField(name, T.StringType()) for name in [*header, "_extra"]])
    rows = spark.read.schema(layout).option("columnNameOfCorruptRecord", "_extra").options(**options).csv(path)
    overfull = F.col("_extra").isNotNull() & F.col(header[-1]).isNotNull()
    text = F.to_json(F.struct(*[F.col(f"`{name}`") for name in header]))
    texts = rows.select(
        F.col("_metadata.file_path").alias("source"), _arrival(), text.alias("record_text"), overfull.alias("overfull")
    )
    parsed = evaluate_once(texts, payload=F.try_parse_json("record_text"))
    return parsed.select(
        "source", "arrival", "record_text", "payload", F.when(F.col("overfull"), "more fields than the header").alias("problem")
    )


def read_payloads(
    spark: SparkSession, path: str, fmt: str | None = None, list_keys: tuple[str, ...] = (), multiline: bool = True
) -> DataFrame:
    """Records of a JSONL, JSON or CSV file or folder; any other format is an error."""
    fmt = fmt or format_of(path)
    if fmt == "jsonl":
        return read_jsonl(spark, path)
    if fmt == "json":
        return read_json_documents(spark, path, list_keys)
    if fmt == "csv":
        return read_csv(spark, path, multiline)
    raise ValueError("records must be provided as JSON, JSONL or CSV")
