"""Vector and set similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed weights of the cluster similarity.
CENTROID_WEIGHT = 0.6
SERVICE_WEIGHT = 0.25
KEY_WEIGHT = 0.15


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_similarity(left: Column, right: Column) -> Column:
    """0 for an empty vector, unequal lengths or a zero vector."""
    comparable = (F.size(left) > 0) & (F.size(left) == F.size(right))
    ratio = F.try_divide(dot(left, right), norm(left) * norm(right))
    return F.when(comparable, F.coalesce(ratio, F.lit(0.0))).otherwise(F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all distinct members; 1 when both sets are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def cluster_similarity(
    left_key: Column, left_services: Column, left_centroid: Column,
    right_key: Column, right_services: Column, right_centroid: Column,
) -> Column:
    return (
        F.lit(CENTROID_WEIGHT) * cosine_similarity(left_centroid, right_centroid)
        + F.lit(SERVICE_WEIGHT) * jaccard(left_services, right_services)
        + F.lit(KEY_WEIGHT) * F.when(left_key == right_key, F.lit(1.0)).otherwise(F.lit(0.0))
    )
