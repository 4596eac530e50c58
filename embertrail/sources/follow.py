"""Following files that grow: a streaming source that hands out the lines appended since the last batch.

An offset holds, per file, the bytes that are handed out and a checksum of the file's first line. A file that became shorter,
or whose first line changed, was truncated or replaced and is read from its start again. Only ended lines are handed out; a
last line without an end follows once the file has rested for `settle` seconds. New text is cut into byte ranges that are
read by separate tasks, each beginning at its first line start, so a burst in one file is no single task.

The offsets are all there is to remember: a restarted query goes on from its checkpoint, and a replayed batch reads the same
ranges. One entry per file is kept, so this is for folders of live files, not for archives of rolled ones (`stream_lines`).
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from embertrail.sources.lines import is_blank

SCHEMA = "source string, line_no bigint, line string, arrived_at timestamp"
NAMES = ["source", "line_no", "line", "arrived_at"]
# Bytes of appended text per task, bytes read at a time, and lines per batch of rows.
RANGE_BYTES, READ_BYTES, BATCH_LINES = 16 << 20, 1 << 20, 8192
# Bytes of the first line that are compared.
FIRST_BYTES = 1024


@dataclass
class LineRange(InputPartition):
    """The lines of `path` that start in [begin, end); text before `begin` belongs to the same appended part if `inside`."""

    path: str
    begin: int
    end: int
    inside: bool
    arrived: float


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


class _File:
    """One file as of now: where its last ended line ends, and the checksum of its first line."""

    def __init__(self, system: fs.FileSystem, info: fs.FileInfo, settle: float):
        self.seen = (info.size, info.mtime_ns)
        self.arrived = (info.mtime_ns or 0) / 1e9
        self.rested = time.time() - self.arrived >= settle
        with system.open_input_file(info.path) as file:
            head = file.read(min(FIRST_BYTES, info.size))
            self.end = info.size if self.rested else _last_line_end(file, info.size)
        first = head.find(b"\n")
        self.first = zlib.crc32(head if first < 0 else head[:first])


def _last_line_end(file, size: int) -> int:
    """The bytes up to and with the last line feed, looked for from the end."""
    high = size
    while high > 0:
        low = max(0, high - READ_BYTES)
        file.seek(low)
        at = file.read(high - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        high = low
    return 0


class GrowingFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.settle = options["path"], float(options.get("settle", 2))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.known: dict[str, _File] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        system, place = _opened(self.path)
        target = system.get_file_info(place)
        if target.type == fs.FileType.NotFound:
            return {"files": {}}
        infos = [target] if target.is_file else system.get_file_info(fs.FileSelector(place))
        for info in infos:
            if not info.is_file or info.base_name.startswith((".", "_")):
                continue
            before = self.known.get(info.path)
            if before is None or before.seen != (info.size, info.mtime_ns) or not before.rested:
                self.known[info.path] = _File(system, info, self.settle)
        return {"files": {path: {"end": f.end, "first": f.first} for path, f in sorted(self.known.items()) if f.end}}

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        ranges = []
        for path, now in end["files"].items():
            before = start["files"].get(path, {"end": 0, "first": now["first"]})
            anew = now["end"] < before["end"] or now["first"] != before["first"]
            begin = 0 if anew else before["end"]
            arrived = self.known[path].arrived if path in self.known else time.time()
            for low in range(begin, now["end"], self.range_bytes):
                ranges.append(LineRange(path, low, min(low + self.range_bytes, now["end"]), low > begin, arrived))
        return ranges

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        moment = pa.scalar(int(partition.arrived * 1e6), pa.timestamp("us", "UTC"))
        places, lines = [], []
        with system.open_input_file(partition.path) as file:
            for place, line in _lines(file, partition):
                places.append(place)
                lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                if len(lines) == BATCH_LINES:
                    yield _batch(partition.path, places, lines, moment)
                    places, lines = [], []
        if lines:
            yield _batch(partition.path, places, lines, moment)


def _batch(path: str, places: list[int], lines: list[str], moment: pa.Scalar) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(places, pa.int64()), pa.array(lines, pa.string()), pa.repeat(moment, n)], NAMES)


def _lines(file, part: LineRange) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that start in the range; the last one may end behind it."""
    at = part.begin - 1 if part.inside else part.begin
    file.seek(at)
    rest, skipping = b"", part.inside  # up to the first line feed belongs to the range before
    while at < part.end or rest or skipping:
        block = file.read(READ_BYTES)
        text = rest + block
        done = text.split(b"\n")
        rest = done.pop() if block else b""
        for line in done:
            if skipping:
                skipping = False
            elif at >= part.end:
                return
            elif block or line:
                yield at, line
            at += len(line) + 1
        if not block or (at >= part.end and not skipping):
            return


class GrowingFiles(DataSource):
    """`spark.readStream.format("growing_files").option("path", file or folder)`; options `settle` and `rangeBytes`."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingFilesReader:
        return GrowingFilesReader(dict(self.options))


def follow_lines(spark: SparkSession, path: str, settle: float = 2, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """`(source, line_no, line, arrived_at)` of a file, or of the files of a folder, as they grow.

    `line_no` is the byte at which the line starts; blank lines are dropped.
    """
    spark.dataSource.register(GrowingFiles)
    stream = spark.readStream.format("growing_files").option("path", path).option("settle", settle).option("rangeBytes", range_bytes)
    return stream.load().filter(~is_blank(F.col("line")))
