"""Vectors for log messages: each distinct pending message is embedded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from embertrail.operators.scale import lookup_join
from embertrail.operators.tables import pending_embeddings
from embertrail.session import durable

Provider = Callable[[pd.Series], pd.Series]
DEFAULT_MODEL = "hashed-terms"


def hashed_vectors(messages: DataFrame, width: int = 256) -> DataFrame:
    """Unit vectors of hashed term counts; needs no model and no fitting, so batches embedded apart stay comparable."""
    words = RegexTokenizer(inputCol="message", outputCol="words", pattern=r"\W+").transform(messages)
    counts = HashingTF(inputCol="words", outputCol="counts", numFeatures=width).transform(words)
    unit = Normalizer(inputCol="counts", outputCol="unit").transform(counts)
    return unit.select("message", vector_to_array("unit").alias("vector"))


def provided_vectors(messages: DataFrame, provider: Provider, batch_size: int = 64) -> DataFrame:
    """Vectors from a pluggable provider, called with `batch_size` messages at a time inside the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                texts = batch["message"].iloc[start : start + batch_size]
                yield pd.DataFrame({"message": texts.to_numpy(), "vector": list(provider(texts))})

    return messages.mapInPandas(run, "message string, vector array<double>")


def embed_logs(
    logs: DataFrame, embeddings: DataFrame, provider: Provider | None = None, model_name: str = DEFAULT_MODEL, batch_size: int = 64
) -> DataFrame:
    """New rows for the `embeddings` table: one per log that has none yet."""
    pending = pending_embeddings(logs.select("log_id", "message"), embeddings)
    distinct = pending.select("message").distinct()
    vectors = hashed_vectors(distinct) if provider is None else provided_vectors(distinct, provider, batch_size)
    return lookup_join(pending, durable(vectors), ["message"], ["log_id"]).select(
        "log_id", F.lit(model_name).alias("model_name"), "vector", F.current_timestamp().alias("created_at")
    )
