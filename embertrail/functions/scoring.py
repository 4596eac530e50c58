"""Confidence scores, printed numbers and the sentences made from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _yes(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def regression_confidence(before: Column, after: Column, changed_files: Column, severity: Column) -> Column:
    growth = F.least(F.greatest(after - before, F.lit(0)), F.lit(10))
    score = F.lit(0.55) + growth * F.lit(0.03)
    score = score + _yes(before == 0, 0.12)
    score = score + _yes(F.size(changed_files) > 0, 0.08)
    return F.least(F.lit(0.98), score + _yes(severity == "high", 0.07))


def anomaly_confidence(severity: Column, delta: Column) -> Column:
    return F.least(F.lit(0.95), F.lit(0.55) + _yes(severity == "high", 0.1) + F.least(delta, F.lit(5)) * F.lit(0.03))


def summary_confidence(log_count: Column) -> Column:
    return F.least(F.lit(0.95), F.lit(0.45) + F.lit(0.1) * F.least(log_count, F.lit(5)))


def percent_change(before: Column, after: Column) -> Column:
    """NULL when nothing happened before."""
    return F.try_divide((after - before).cast("double"), before.cast("double")) * F.lit(100.0)


def fixed(value: Column, digits: int) -> Column:
    """Text with `digits` decimals, NULL for NULL; exact ties go to the even digit."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", F.bround(value, digits)))


def percent_text(value: Column) -> Column:
    return F.coalesce(F.concat(fixed(value, 1), F.lit("%")), F.lit("new"))


def present(text: Column) -> Column:
    """NULL for an empty text."""
    return F.nullif(text, F.lit(""))


def labelled(label: str, text: Column) -> Column:
    """` label=text`, or nothing when there is no text."""
    return F.coalesce(F.concat(F.lit(f" {label}="), present(text)), F.lit(""))


def regression_reason(
    regression_type: Column, service: Column, deploy_id: Column, commit_sha: Column, before: Column, after: Column,
    percent: Column, changed_files: Column,
) -> Column:
    # Fixed texts: these sentences must match.
    opening = (
        F.when(regression_type == "new_cluster_after_deploy", F.lit("New error cluster appeared in "))
        .when(regression_type == "frequency_spike_after_deploy", F.lit("Error cluster frequency spiked in "))
        .otherwise(F.lit("Previously seen error cluster reappeared in "))
    )
    commit = F.coalesce(F.concat(F.lit(" commit "), present(commit_sha)), F.lit(""))
    change = F.when(
        regression_type == "frequency_spike_after_deploy", F.concat(F.lit(", change="), percent_text(percent))
    ).otherwise(F.lit(""))
    files = F.when(
        F.size(changed_files) > 0,
        F.concat(F.lit(" Changed files: "), F.array_join(F.slice(changed_files, 1, 8), ", "), F.lit(".")),
    ).otherwise(F.lit(""))
    return F.concat(
        opening, service, F.lit(" after deploy "), deploy_id, commit, F.lit("; before="), before.cast("string"),
        F.lit(", after="), after.cast("string"), change, F.lit("."), files,
    )
