"""Files that grow, shrink and are replaced between batches."""

import os

import pytest

from embertrail.operators.tables import read_table
from embertrail.sources.follow import GrowingFilesReader, follow_lines
from embertrail.streaming.live import LiveTriage


def _read(reader, start, end):
    rows = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            rows += list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))))
    return [(os.path.basename(a), b, c) for a, b, c in rows]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 64, 1 << 20])
def test_ranges_of_any_size_hand_out_every_line_once(tmp_path, size):
    text = "first\n\nsecond line\r\nthé third\nx\n" + "long " * 30 + "\nlast\n"
    (tmp_path / "a.log").write_bytes(text.encode())
    reader = GrowingFilesReader({"path": str(tmp_path), "rangebytes": size})
    got = _read(reader, reader.initialOffset(), reader.latestOffset())
    want, at = [], 0
    for line in text.encode().split(b"\n")[:-1]:
        want.append(("a.log", at, line.removesuffix(b"\r").decode()))
        at += len(line) + 1
    assert sorted(got) == sorted(want)


def test_growth_truncation_and_replacement(tmp_path):
    path = tmp_path / "a.log"
    reader = GrowingFilesReader({"path": str(path), "settle": 60})
    seen = [reader.initialOffset()]

    def step(text, mode):
        with open(path, mode) as file:
            file.write(text)
        seen.append(reader.latestOffset())
        return [line for _, _, line in _read(reader, *seen[-2:])]

    assert reader.latestOffset() == {"files": {}}
    assert step("one\ntwo\nthr", "a") == ["one", "two"]
    assert step("ee\nfour", "a") == ["three"]
    assert step("\n", "a") == ["four"]
    assert step("new\n", "w") == ["new"]  # shorter
    assert step("other start\nand more than there was\n", "w") == ["other start", "and more than there was"]  # longer, another first line
    assert step("", "a") == []


def test_a_last_line_without_an_end_waits_for_rest(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("one\ntwo")
    waiting, rested = GrowingFilesReader({"path": str(tmp_path), "settle": 60}), GrowingFilesReader({"path": str(tmp_path), "settle": 0})
    assert [r[2] for r in _read(waiting, waiting.initialOffset(), waiting.latestOffset())] == ["one"]
    assert [r[2] for r in _read(rested, rested.initialOffset(), rested.latestOffset())] == ["one", "two"]


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    folder, out = tmp_path / "in", []
    folder.mkdir()

    def run():
        query = (
            follow_lines(spark, str(folder), range_bytes=16).writeStream.foreachBatch(lambda rows, i: out.append(sorted(r["line"] for r in rows.collect())))
            .option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return [line for batch in out for line in batch]

    (folder / "a.log").write_text("a1\n  \na2\n")
    assert run() == ["a1", "a2"]
    with open(folder / "a.log", "a") as file:
        file.write("a3 with more text than a range\na4\n")
    (folder / "b.log").write_text("b1\n")
    out.clear()
    assert run() == ["a3 with more text than a range", "a4", "b1"]
    (folder / "a.log").write_text("again\n")
    out.clear()
    assert run() == ["again"]


def test_live_triage_of_a_growing_file(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    live = LiveTriage(root=root, eps=0.1, min_samples=2)
    for part, mode in (("[api] timeout after 30 ms\n[api] timeout after 31 ms\n", "w"), ("[api] timeout after 32 ms\n", "a")):
        with open(folder / "app.log", mode) as file:
            file.write(part)
        live.start(spark, str(folder), str(tmp_path / "mark"), every=None, growing=True).awaitTermination()
    logs = {r["message"]: r["service"] for r in read_table(spark, root, "logs").collect()}
    assert len(logs) == 3 and set(logs.values()) == {"api"}
    assert read_table(spark, root, "cluster_runs").count() == 2
