"""Clusters of a growing table against a whole run after every batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embertrail.operators import growing
from embertrail.operators.growing import GrowingClusters
from tests.test_scale import sequential_labels


def _frame(spark, ids, vectors):
    rows = [(f"{i:06d}", [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "log_id string, vector array<double>").withColumn("ts", F.lit(None).cast("timestamp"))


@pytest.mark.parametrize("eps,min_samples,leaf_rows", [(0.1, 3, 12), (0.02, 2, 500)])
def test_labels_equal_a_whole_run_after_every_batch(spark, tmp_path, eps, min_samples, leaf_rows):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 4))
    vectors = np.concatenate([centres[i] + 0.25 * rng.normal(size=(n, 4)) for i, n in enumerate([70, 40, 30, 8, 3])] + [np.repeat(centres[:2], 6, axis=0), rng.normal(size=(20, 4)), np.zeros((3, 4))])
    order = rng.permutation(len(vectors))  # earlier rows may come in later batches: numbers shift, clusters merge
    clusters = GrowingClusters(str(tmp_path), eps, min_samples, leaf_rows)
    upto = 0
    for version, size in enumerate((70, 1, len(vectors) - 71), start=1):
        upto += size
        held = np.sort(order[:upto])
        labels = clusters.add(_frame(spark, held, vectors[held]), version)  # rows added before are skipped
        got = {int(r["log_id"]): r["cluster_id"] for r in labels.collect()}
        assert [got[i] for i in held] == sequential_labels(vectors[held], eps, min_samples).tolist(), version
    again = {int(r["log_id"]): r["cluster_id"] for r in clusters.add(_frame(spark, held, vectors[held]), version).collect()}
    assert again == got  # a repeated batch


def test_a_batch_compares_no_more_as_history_grows(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    compared = []
    kept = growing.meet

    def meeting(rows, others, *rest):
        compared.append(rows.count() + others.count())
        return kept(rows, others, *rest)

    monkeypatch.setattr(growing, "meet", meeting)
    clusters, per_batch = GrowingClusters(str(tmp_path), 0.005, 3, 20), []
    centres = rng.normal(size=(300, 6))
    for version in range(1, 4):
        part = centres[(version - 1) * 100 : version * 100]
        vectors = np.repeat(part, 3, axis=0) + 0.01 * rng.normal(size=(300, 6))
        compared.clear()
        clusters.add(_frame(spark, range(version * 1000, version * 1000 + 300), vectors), version)
        per_batch.append(sum(compared))
    assert per_batch[-1] <= 1.5 * per_batch[1]
