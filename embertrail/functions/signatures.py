"""Message signatures (text with the changing parts masked) and the keys built on them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from embertrail.functions.services import strip_space

# What is masked, in this order, and the signature's length.
_MASKS = (
    (r"(?U)\b\d+\b", "<num>"),
    (r"(?U)0x[0-9a-f]+", "<hex>"),
    (r"(?U)\b[0-9a-f]{8,}\b", "<id>"),
    (r"(?U)\s+", " "),
)
SIGNATURE_LENGTH = 160
SIGNATURES_PER_KEY = 5


def message_signature(message: Column) -> Column:
    text = F.lower(strip_space(message))
    for pattern, mask in _MASKS:
        text = F.regexp_replace(text, pattern, mask)
    return F.substring(text, 1, SIGNATURE_LENGTH)


def cluster_key(services: Column, signatures: Column) -> Column:
    """16 hex digits over sorted lower-case service names and the first sorted signatures."""
    joined = F.concat(F.array_join(services, ","), F.lit("|"), F.array_join(signatures, "\u001f"))
    return F.substring(F.sha2(joined, 256), 1, 16)


def ci_signature(test_name: Column, workflow: Column, message: Column) -> Column:
    """The test's name, else `workflow:timeout`, else the message's first eight words."""
    lowered = F.lower(message)
    words = F.array_join(F.slice(F.split(strip_space(lowered), r"(?U)\s+"), 1, 8), " ")
    return (
        F.when(test_name.isNotNull(), test_name)
        .when(workflow.isNotNull() & lowered.contains("timeout"), F.concat(workflow, F.lit(":timeout")))
        .otherwise(words)
    )
