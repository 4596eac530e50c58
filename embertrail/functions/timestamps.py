"""Lenient ISO-8601 reading: bad text is NULL, never an error; every value is an instant in UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed patterns: the plain form almost every record has, and the full ISO family with compact dates, any separator,
# short times, comma fractions and short offsets.
_PLAIN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?([+-]\d{2}:\d{2})?)?$"
_FULL = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(?:([+-]\d{2}):?(\d{2})?)?)?$"
)


def _rebuilt(value: Column) -> Column:
    def part(group: int, default: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(value, _FULL, group), F.lit("")), F.lit(default))

    return F.concat(
        part(1, ""), F.lit("-"), part(3, ""), F.lit("-"), part(4, ""), F.lit(" "),
        part(5, "00"), F.lit(":"), part(6, "00"), F.lit(":"), part(7, "00"), F.lit("."), part(8, "0"),
        part(9, "+00"), F.lit(":"), part(10, "00"),
    )


def parse_timestamp(text: Column) -> Column:
    """The usual form is cast directly; only other texts are taken apart (once, inside a lambda)."""
    value = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    taken_apart = F.get(F.transform(F.array(value), lambda v: F.when(v.rlike(_FULL), _rebuilt(v))), F.lit(0))
    return F.when(value.rlike(_PLAIN), value.try_cast("timestamp")).otherwise(taken_apart.try_cast("timestamp"))


def timestamp_text(ts: Column) -> Column:
    """`yyyy-mm-dd hh:mm:ss`, followed by six fraction digits only when they are not all zero."""
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
