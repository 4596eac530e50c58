"""The library's own vectors, and clusters of logs embedded by them."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF

from embertrail.plans.clusters import cluster_logs
from embertrail.plans.embed import embed_logs, hashed_vectors
from embertrail.schemas import EMBEDDINGS
from tests.test_scale import sequential_labels

MESSAGES = [
    "Timeout after 30 ms", "timeout AFTER 30 ms!", "redis reset by peer", "redis  reset -- by peer", "", "!!!", "é ü ß 漢字 naïve", "a a a b",
    *(f"worker w{i} failed on shard s{i % 3} with code {i % 2}" for i in range(12)),
]


def _vectors(spark):
    index, out = HashingTF(numFeatures=256).indexOf, {}
    for message in MESSAGES:
        counts = Counter(index(w) for w in re.split(r"[^A-Za-z0-9_]+", message.lower()) if w)
        length = math.sqrt(sum(n * n for n in counts.values()))
        out[message] = [counts.get(i, 0) / length if length else 0.0 for i in range(256)]
    return out


def test_hashed_vectors_equal_term_counts_of_unit_length(spark):
    rows = {r["message"]: list(r["vector"]) for r in hashed_vectors(spark.createDataFrame([(m,) for m in MESSAGES], "message string")).collect()}
    want = _vectors(spark)
    assert rows.keys() == want.keys()
    for message, vector in want.items():
        assert rows[message] == pytest.approx(vector)


def test_logs_embedded_by_default_are_clustered_as_their_vectors_are(spark):
    rows = [(f"{i:04d}", None, "svc", m) for i, m in enumerate(MESSAGES * 2)]
    logs = spark.createDataFrame(rows, "log_id string, ts timestamp, service string, message string")
    run = cluster_logs(logs, embed_logs(logs, spark.createDataFrame([], EMBEDDINGS)), run_id=1, eps=0.1, min_samples=2)
    vectors = _vectors(spark)
    want = sequential_labels(np.array([vectors[m] for *_, m in rows]), 0.1, 2).tolist()
    assert [r["cluster_id"] for r in run.assignments.orderBy("log_id").collect()] == want
