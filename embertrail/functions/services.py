"""Service names read out of log text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from embertrail.functions.payload import Payload, first_truthy, strip_space

# Where a service name may stand in a message (tried in this order), and words that are never one.
SERVICE_PATTERNS = (
    r"(?U)\bservice[=:]\s*([A-Za-z0-9._-]+)",
    r"(?U)\bapp[=:]\s*([A-Za-z0-9._-]+)",
    r"(?U)^\[([A-Za-z0-9._-]+)\]",
    r"(?U)^([A-Za-z0-9._-]+)\s*[:|-]",
)
NAMING_KEYS = ("logger", "component")
NOT_SERVICES = ("info", "warn", "warning", "error", "debug", "trace", "stdout", "stderr")
_NAME = rf"^(?!(?:{'|'.join(NOT_SERVICES)})\z)[a-z0-9._-]{{1,64}}\z"


def clean_service(text: Column) -> Column:
    """Lower-cased name without brackets, or NULL when it cannot be a service name."""
    name = F.lower(F.btrim(strip_space(text), F.lit("[](){}")))
    return F.when(name.rlike(_NAME), name)


def service_from_message(message: Column) -> Column:
    return F.coalesce(*[clean_service(F.regexp_extract(message, pattern, 1)) for pattern in SERVICE_PATTERNS])


def infer_service(payload: Payload, message: Column) -> Column:
    """From the logger or component field, else from the message text."""
    return F.coalesce(clean_service(first_truthy(payload, *NAMING_KEYS)), service_from_message(message))
