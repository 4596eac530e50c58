"""Reading loosely typed JSON payloads held as VARIANT.

Alias chains skip *falsy* values (missing, null, "", 0, false, [], {}), not only nulls. A value's text does not tell the
number 0 from the text "0", so short values are looked at in their JSON form; long ones need no second look.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

# The JSON forms of everything that counts as absent.
FALSY_JSON = r'^(""|null|false|\[\]|\{\}|-?0(\.0*)?([eE].*)?)$'
_LONGEST_FALSY = 8
# How the texts of absent values and of booleans begin; a short text that begins otherwise needs no second look either.
_DOUBTFUL = ("", "0", "-", "f", "t", "[", "{")


class Fields(NamedTuple):
    """A column that `taken_out` made; stands for the payload in the functions of this module."""

    column: str


Payload = Column | Fields


def taken_out(payload: Column, *keys: str) -> Column:
    """The values under `keys` as a struct of VARIANTs, in one pass over the payload; NULL unless it is an object.

    A lookup by path goes through the payload's keys each time, which for a score of aliases costs more than parsing.
    """
    return F.try_variant_get(payload, "$", f"struct<{', '.join(f'`{key}`: variant' for key in dict.fromkeys(keys))}>")


def raw_field(payload: Payload, key: str) -> Column:
    """The value under `key` as VARIANT; SQL NULL only when the key is absent."""
    if isinstance(payload, Fields):
        return F.col(payload.column).getField(key)
    return F.try_variant_get(payload, f"$['{key}']", "variant")


def has_key(payload: Payload, key: str) -> Column:
    return raw_field(payload, key).isNotNull()


def _plain(payload: Payload, key: str) -> Column:
    if isinstance(payload, Fields):
        return F.try_variant_get(raw_field(payload, key), "$", "string")
    return F.try_variant_get(payload, f"$['{key}']", "string")


def _named_boolean(value: Column) -> Column:
    names = F.create_map(F.lit("true"), F.lit("True"), F.lit("false"), F.lit("False"))
    return F.try_element_at(names, F.to_json(value))


def text_field(payload: Payload, key: str) -> Column:
    """The value under `key` as text, NULL when absent or JSON null; booleans print capitalized."""
    text = _plain(payload, key)
    return F.when(text.isin("true", "false"), F.coalesce(_named_boolean(raw_field(payload, key)), text)).otherwise(text)


def truthy_field(payload: Payload, key: str) -> Column:
    """The value under `key` as text, NULL when it is falsy. A single space counts as a value."""
    text = _plain(payload, key)
    value = raw_field(payload, key)
    return F.when((F.length(text) > _LONGEST_FALSY) | ~F.substring(text, 1, 1).isin(*_DOUBTFUL), text).when(
        ~F.to_json(value).rlike(FALSY_JSON), F.coalesce(_named_boolean(value), text)
    )


def truthy_value(payload: Payload, key: str) -> Column:
    """The value under `key` as VARIANT, NULL when it is falsy."""
    value = raw_field(payload, key)
    return F.when(~F.to_json(value).rlike(FALSY_JSON), value)


def first_truthy(payload: Payload, *keys: str) -> Column:
    return F.coalesce(*[truthy_field(payload, key) for key in keys])


def first_truthy_or_last(payload: Payload, *keys: str) -> Column:
    """Like `first_truthy`, but the last alias is returned as it is, even when it is "" or 0."""
    return F.coalesce(*[truthy_field(payload, key) for key in keys[:-1]], text_field(payload, keys[-1]))


def canonical_json(payload: Column) -> Column:
    """JSON text with sorted keys and normalized numbers; equal payloads give equal text."""
    return F.to_json(payload)


def content_hash(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def log_id(payload_json: Column, message: Column) -> Column:
    return F.concat(content_hash(payload_json, 12), F.lit("-"), content_hash(message, 4))


def strip_space(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def string_list(value: Column) -> Column:
    """Array of texts from a VARIANT holding a list, a text with a JSON list, a comma-separated text, or a scalar."""
    text = strip_space(F.try_variant_get(value, "$", "string"))
    kind = F.schema_of_variant(value)
    listed = F.when(kind.startswith("ARRAY"), value).when((kind == "STRING") & text.startswith("["), F.try_parse_json(text))
    items = F.transform(F.try_variant_get(listed, "$", "array<string>"), lambda item: F.coalesce(item, F.lit("None")))
    by_comma = F.transform(F.split(text, ","), lambda item: strip_space(item))
    scalar = F.when(kind != "STRING", F.array(F.coalesce(_named_boolean(value), text)))
    every = F.coalesce(items, scalar, by_comma, F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return F.when(value.isNull(), none).otherwise(F.filter(every, lambda item: strip_space(item) != ""))


def json_text_list(text: Column) -> Column:
    """A JSON list held as text, as an array; anything else gives an empty array."""
    return F.coalesce(
        F.try_variant_get(F.try_parse_json(text), "$", "array<string>"), F.array().cast("array<string>")
    )
