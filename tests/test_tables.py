"""Keyed tables: what many loads leave behind, and what a failed load leaves alone."""

from pathlib import Path

import pytest
from pyspark.sql import DataFrame, functions as F


from embertrail.operators.tables import merge_table, read_table
from embertrail.schemas import LIVE_BATCHES


def _rows(spark, rows):
    return spark.createDataFrame(rows, LIVE_BATCHES)


def _load(spark, root, rows):
    merge_table(spark, root, "live_batches", _rows(spark, rows), [F.col("run_id")])


def _held(spark, root):
    return {(r["stream"], r["batch_id"]): r["run_id"] for r in read_table(spark, root, "live_batches").collect()}


def test_many_loads_leave_few_files(spark, tmp_path):
    root, want = str(tmp_path), {}
    for i in range(24):
        rows = [("s", 10 * i + j, i) for j in range(4)] + ([("s", 10 * (i - 3), -i)] if i % 5 == 4 else [])  # now and then an old key too
        _load(spark, root, rows)
        want.update({r[:2]: r[2] for r in rows})
    assert _held(spark, root) == want
    manifests = list(Path(root, "live_batches", "manifests").iterdir())
    folders = [p for p in Path(root, "live_batches", "data").iterdir() if p.is_dir()]
    assert len([m for m in manifests if m.is_dir()]) == 2 and len(folders) <= 10
    assert len(list(Path(root, "live_batches").rglob("*.parquet"))) <= 14


def test_a_load_that_stops_half_way_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    _load(spark, root, [("s", 1, 1), ("s", 2, 2)])
    kept = DataFrame.coalesce

    def stopping(self, n):
        if self.columns == ["snapshot", "folder", "n"]:
            raise RuntimeError("lost before the manifest")
        return kept(self, n)

    with monkeypatch.context() as patched:
        patched.setattr(type(read_table(spark, root, "live_batches")), "coalesce", stopping)
        with pytest.raises(RuntimeError):
            _load(spark, root, [("s", 2, 20), ("s", 3, 3)])
    assert _held(spark, root) == {("s", 1): 1, ("s", 2): 2}
    _load(spark, root, [("s", 2, 20), ("s", 3, 3)])
    assert _held(spark, root) == {("s", 1): 1, ("s", 2): 20, ("s", 3): 3}


def test_readers_under_way_keep_their_snapshot(spark, tmp_path):
    root = str(tmp_path)
    _load(spark, root, [("s", 1, 1)])
    before = read_table(spark, root, "live_batches")
    _load(spark, root, [("s", 1, 7), ("s", 2, 2)])
    assert [r["run_id"] for r in before.collect()] == [1]
    assert _held(spark, root) == {("s", 1): 7, ("s", 2): 2}


def test_merging_nothing_and_merging_again(spark, tmp_path):
    root = str(tmp_path)
    _load(spark, root, [])
    assert _held(spark, root) == {}
    for _ in range(3):
        _load(spark, root, [("s", 1, 1), ("s", 1, 5), ("t", 1, 2)])
    assert _held(spark, root) == {("s", 1): 5, ("t", 1): 2}
