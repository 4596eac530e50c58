"""Reading the labelled fields out of generated summary text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from embertrail.functions.services import strip_space

# Fixed labels, as they open a line of the generated text.
LABELS = ("description", "affected services", "timeline", "suspected root cause", "confidence")
_STATE = (
    "struct<field:string,description:string,services:array<string>,timeline:array<string>,root_cause:string,"
    "confidence:string>"
)


def _label_of(line: Column) -> Column:
    label = F.lit(None).cast("string")
    for name in reversed(LABELS):
        label = F.when(F.lower(line).startswith(f"{name}:"), F.lit(name)).otherwise(label)
    return label


def _step(state: Column, line: Column) -> Column:
    label = _label_of(line)
    value = strip_space(F.regexp_replace(line, r"^[^:]*:", ""))
    continues = label.isNull()

    def scalar(name: str, current: Column) -> Column:
        return (
            F.when(label == name, value)
            .when(continues & (state["field"] == name) & (current == ""), line)
            .otherwise(current)
        )

    services = F.filter(F.transform(F.split(value, ","), strip_space), lambda item: item != "")
    bullet = strip_space(F.regexp_replace(line, r"^[- ]+", ""))
    empty = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(label, state["field"]).alias("field"),
        scalar("description", state["description"]).alias("description"),
        F.when(label == "affected services", services).otherwise(state["services"]).alias("services"),
        F.when(label == "timeline", F.when(value == "", empty).otherwise(F.array(value)))
        .when(continues & (state["field"] == "timeline"), F.concat(state["timeline"], F.array(bullet)))
        .otherwise(state["timeline"])
        .alias("timeline"),
        scalar("suspected root cause", state["root_cause"]).alias("root_cause"),
        F.when(label == "confidence", value).otherwise(state["confidence"]).alias("confidence"),
    ).cast(_STATE)


def parse_generated(text: Column) -> Column:
    """Struct of the labelled fields; lines after a label continue it."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), strip_space), lambda line: line != "")
    empty = F.array().cast("array<string>")
    start = F.struct(
        F.lit(None).cast("string").alias("field"), F.lit("").alias("description"), empty.alias("services"),
        empty.alias("timeline"), F.lit("").alias("root_cause"), F.lit("").alias("confidence"),
    ).cast(_STATE)
    return F.aggregate(lines, start, _step)


def parse_confidence(text: Column) -> Column:
    """A share between 0 and 1; values above 1 are percentages; unreadable text gives 0.7."""
    number = F.replace(strip_space(text), F.lit("%"), F.lit("")).try_cast("double")
    share = F.when(number > 1, number / 100).otherwise(number)
    return F.when(number.isNull(), F.lit(0.7)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
