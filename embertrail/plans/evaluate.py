"""Scoring triage results against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from embertrail.functions.payload import raw_field, text_field, truthy_field


def case_columns(cases: DataFrame, baseline_steps_key: str = "baseline_triage_steps", assisted_steps_key: str = "assisted_triage_steps") -> DataFrame:
    """Typed case columns from payload rows, with every fallback applied."""
    payload = F.col("payload")
    none = F.array().cast("array<string>")
    empty = F.lit("")
    report = F.lower(F.coalesce(truthy_field(payload, "report"), truthy_field(payload, "predicted_root_cause"), empty))
    is_list = lambda key: F.schema_of_variant(raw_field(payload, key)).startswith("ARRAY")
    listed = lambda key: F.transform(F.try_variant_get(payload, f"$['{key}']", "array<string>"), lambda x: F.lower(F.coalesce(x, F.lit("None"))))
    candidates = F.when(
        truthy_field(payload, "root_cause_candidates").isNotNull(), F.when(is_list("root_cause_candidates"), listed("root_cause_candidates"))
    ).when(is_list("predictions") & truthy_field(payload, "predictions").isNotNull(), listed("predictions"))
    logs = F.coalesce(F.try_variant_get(payload, "$.logs", "array<string>"), none)
    steps = lambda key: truthy_field(payload, key).try_cast("bigint")
    return cases.select(
        F.lower(F.coalesce(truthy_field(payload, "root_cause"), empty)).alias("root_cause"),
        F.lower(F.coalesce(truthy_field(payload, "trigger"), empty)).alias("trigger"),
        report.alias("report"),
        F.coalesce(candidates, F.array(report)).alias("candidates"),
        F.lower(F.coalesce(truthy_field(payload, "predicted_trigger"), report)).alias("predicted_trigger"),
        F.lower(F.array_join(logs, " ", "None")).alias("log_text"),
        F.coalesce(steps(baseline_steps_key), F.nullif(F.size(logs), F.lit(0)).cast("bigint"), F.lit(1)).alias("baseline_steps"),
        F.coalesce(steps(assisted_steps_key), F.lit(1)).alias("assisted_steps"),
    )


def names(text: Column, expected: Column) -> Column:
    """Whether the (lower-case) text holds the expected one, which must not be empty."""
    return (expected != "") & F.contains(text, expected)


def evaluate(cases: DataFrame) -> DataFrame:
    """One row of metrics from `case_columns`; all zero without cases."""
    root = F.col("root_cause")
    share = lambda hit: F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))
    saved = (F.sum("baseline_steps") - F.sum("assisted_steps")).cast("double")
    return cases.agg(
        F.count(F.lit(1)).alias("incident_count"),
        share(names(F.col("report"), root)).alias("root_cause_top1"),
        share(F.exists(F.slice("candidates", 1, 3), lambda c: names(c, root))).alias("root_cause_top3"),
        share(names(F.col("predicted_trigger"), F.col("trigger"))).alias("trigger_attribution"),
        share(names(F.col("log_text"), root)).alias("baseline_keyword_accuracy"),
        F.coalesce(F.greatest(F.lit(0.0), F.try_divide(saved, F.sum("baseline_steps").cast("double"))), F.lit(0.0)).alias("triage_reduction"),
    )
