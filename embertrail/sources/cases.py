"""Labelled evaluation cases from a JSON file or a folder of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embertrail.functions.payload import raw_field
from embertrail.sources.payloads import read_json_documents


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per case object; list members that are not objects are ignored."""
    glob = None if path.lower().endswith(".json") else "*.json"
    records = read_json_documents(spark, path, list_keys=("cases",), glob=glob).filter(F.col("problem").isNull())
    unopened_list = F.coalesce(F.schema_of_variant(raw_field(F.col("payload"), "cases")).startswith("ARRAY"), F.lit(False))
    return records.filter(~unopened_list).drop("problem")
