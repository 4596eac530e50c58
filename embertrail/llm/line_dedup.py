"""Operator 10: reversible line dedup over sharded cuckoo filters and exact reference tables.

The index is three tables. `postings` holds one row per (line key, document), `refs` the exact number of documents per
key and the largest of them, and `filters` one cuckoo filter per shard with the keys that reached the threshold. A line
is dropped when its key passes the shard's filter and the reference table confirms it. Adding or removing documents
changes the references of the touched keys only; a key that crosses the threshold is inserted into its shard's filter or
deleted from it, so removing a batch restores what was before it.

Defined cases: a null or empty text is one empty line. Rows that repeat a doc_id are one document. A null doc_id is a
document of its own, smaller than all others. Keys are compared by a 128-bit digest. Other columns are passed through
by `drop_repeated_lines` and never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from embertrail.llm.common import by_slices, utf8
from embertrail.session import durable

# Fixed: what is stripped at both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
SLOTS = 4
KICKS = 500
# Postings that one probing task holds at most; a shard with more, or with more than the mean shard, is split.
PROBE_ROWS = 200_000


class CuckooFilter:
    """Membership of 16-byte keys by 16-bit fingerprints in buckets of four, with deletion."""

    def __init__(self, buckets: int):
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)

    @classmethod
    def of(cls, keys: list[bytes]) -> "CuckooFilter":
        """A filter that holds `keys`, grown until all fit."""
        buckets = 1 << max(3, (len(keys) // 3).bit_length())
        while True:
            made = cls(buckets)
            if all(made.insert(k) for k in keys):
                return made
            buckets *= 2

    @classmethod
    def load(cls, data: bytes) -> "CuckooFilter":
        made = cls(0)
        made.table = np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy()
        return made

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _other(self, bucket, print_):
        """The second bucket of a fingerprint; applied twice it leads back."""
        return (bucket ^ ((print_ * 0x5BD1) & 0xFFFFFFFF)) & (len(self.table) - 1)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[10:14], "little") & (len(self.table) - 1)
        return print_, first, self._other(first, print_)

    def insert(self, key: bytes) -> bool:
        """False if no slot could be freed, after which the filter must be rebuilt larger."""
        print_, first, second = self._places(key)
        for bucket in (first, second):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        bucket = second
        for turn in range(KICKS):
            slot = turn % SLOTS
            print_, self.table[bucket, slot] = int(self.table[bucket, slot]), print_
            bucket = self._other(bucket, print_)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        return False

    def delete(self, key: bytes) -> bool:
        print_, first, second = self._places(key)
        for bucket in (first, second):
            found = np.flatnonzero(self.table[bucket] == print_)
            if len(found):
                self.table[bucket, found[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """For an (n, 16) array of key bytes, whether each may be held."""
        keys = np.ascontiguousarray(keys)
        print_ = keys[:, 8:10].copy().view("<u2").ravel().astype(np.int64)
        print_[print_ == 0] = 1
        first = keys[:, 10:14].copy().view("<u4").ravel().astype(np.int64) & (len(self.table) - 1)
        second = self._other(first, print_)
        return (self.table[first] == print_[:, None]).any(1) | (self.table[second] == print_[:, None]).any(1)


@dataclass(frozen=True)
class LineIndex:
    """The state of incremental line dedup; every field is a table."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    min_docs: int = 3
    min_chars: int = 20
    shards: int = 512


POSTINGS = "shard int, key binary, doc_id bigint"


def empty_index(spark: SparkSession, min_docs: int = 3, min_chars: int = 20, shards: int = 512) -> LineIndex:
    """An index over no documents. `shards` should keep the marked keys of a shard below some ten thousand."""
    none = spark.createDataFrame([], POSTINGS)
    refs = spark.createDataFrame([], "shard int, key binary, n_docs bigint, holder bigint")
    return LineIndex(none, refs, spark.createDataFrame([], "shard int, filter binary"), min_docs, min_chars, shards)


def _digest(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key; none if the key is too short."""
    key = line.strip(BLANKS)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()  # lower() on bytes changes A-Z only


def line_postings(docs: DataFrame, index: LineIndex) -> DataFrame:
    """One row per document and key in it."""
    min_chars, shards = index.min_chars, index.shards

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ids = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            own = {d for line in text.split(b"\n") if (d := _digest(line, min_chars))}
            keys += own
            ids += [doc_id] * len(own)
        shard = np.frombuffer(b"".join(keys), dtype="<u8")[::2] % np.uint64(shards)
        return pa.RecordBatch.from_arrays(
            [pa.array(shard.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["shard", "key", "doc_id"]
        )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(by_slices(work), POSTINGS).distinct()


def _count(postings: DataFrame) -> DataFrame:
    return postings.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder"))


def _changed_filters(index: LineIndex, before: DataFrame, after: DataFrame) -> DataFrame:
    """Filters in which the keys that crossed the threshold between two states of the touched references are changed."""
    was, now = before.filter(F.col("n_docs") >= index.min_docs), after.filter(F.col("n_docs") >= index.min_docs)
    crossed = now.join(was, ["shard", "key"], "left_anti").select("shard", "key", F.lit(1).alias("step")).unionByName(
        was.join(now, ["shard", "key"], "left_anti").select("shard", "key", F.lit(-1).alias("step"))
    )
    known = index.refs.filter(F.col("n_docs") >= index.min_docs).select("shard", "key")

    def change(key: tuple, steps: pa.Table, old: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        held = CuckooFilter.load(old["filter"][0].as_py()) if old.num_rows else None
        step = dict(zip(steps["key"].to_pylist(), steps["step"].to_pylist()))
        grown = [k for k, s in step.items() if s > 0]
        if held is None:
            held = CuckooFilter.of(grown)
        else:
            for k, s in step.items():
                if s < 0:
                    held.delete(k)
            if not all(held.insert(k) for k in grown):
                held = None
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([held and held.dump()], pa.binary())})

    touched = crossed.groupBy("shard").cogroup(
        index.filters.join(crossed.select("shard").distinct(), "shard", "left_semi").groupBy("shard")
    ).applyInArrow(change, "shard int, filter binary")
    touched = durable(touched)
    full = touched.filter(F.col("filter").isNull())  # a filter that overflowed is made anew from the exact table

    def rebuild(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([CuckooFilter.of(table["key"].to_pylist()).dump()], pa.binary())})

    marked = known.join(was.select("shard", "key"), ["shard", "key"], "left_anti").unionByName(now.select("shard", "key"))
    made = marked.join(full.select("shard"), "shard", "left_semi").groupBy("shard").applyInArrow(rebuild, "shard int, filter binary")
    kept = index.filters.join(touched, "shard", "left_anti")
    return kept.unionByName(touched.filter(F.col("filter").isNotNull())).unionByName(made)


def _updated(index: LineIndex, postings: DataFrame, touched: DataFrame) -> LineIndex:
    """The index over `postings`, where only the references of the keys in `touched` can differ."""
    keys = durable(touched.select("shard", "key").distinct())
    before = index.refs.join(keys, ["shard", "key"], "left_semi")
    after = durable(_count(postings.join(keys, ["shard", "key"], "left_semi")))
    filters = durable(_changed_filters(index, before, after))
    refs = durable(index.refs.join(keys, ["shard", "key"], "left_anti").unionByName(after))
    return LineIndex(postings, refs, filters, index.min_docs, index.min_chars, index.shards)


def add_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the lines of `docs`; documents that it holds already change nothing."""
    fresh = line_postings(docs, index)
    if index.postings.isEmpty():  # every key is touched: no need to look the touched ones up
        postings = durable(fresh)
        refs = durable(_count(postings))
        filters = durable(_changed_filters(index, index.refs, refs))
        return LineIndex(postings, refs, filters, index.min_docs, index.min_chars, index.shards)
    same = index.postings["doc_id"].eqNullSafe(F.col("new.doc_id")) & (index.postings["key"] == F.col("new.key"))
    fresh = durable(fresh.alias("new").join(index.postings, same, "left_anti"))
    return _updated(index, durable(index.postings.unionByName(fresh)), fresh)


def remove_documents(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents of `doc_ids(doc_id)`."""
    named = index.postings["doc_id"].eqNullSafe(F.col("old.doc_id"))
    old = doc_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().alias("old")
    gone = durable(index.postings.join(old, named, "left_semi"))
    return _updated(index, durable(index.postings.join(old, named, "left_anti")), gone)


def doomed_lines(index: LineIndex) -> DataFrame:
    """(doc_id, key) of all lines to drop.

    Postings meet their shard's filter; a shard with many postings (a line of a third of all documents) is split by
    document, each part with its copy of the small filter. What passes is confirmed by the exact table.
    """
    loads = index.postings.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    fair = loads.agg(F.least(F.lit(float(PROBE_ROWS)), F.greatest(F.lit(1.0), F.avg("rows"))).alias("fair"))
    loads = loads.crossJoin(F.broadcast(fair)).select("shard", F.ceil(F.col("rows") / F.col("fair")).cast("int").alias("parts"))
    sent = index.postings.join(F.broadcast(loads), "shard").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")).drop("parts")
    filters = index.filters.join(F.broadcast(loads), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def probe(rows: pa.Table, held: pa.Table) -> pa.Table:
        rows = rows.select(["shard", "key", "doc_id"])
        if not held.num_rows or not rows.num_rows:
            return rows.slice(0, 0)
        keys = np.frombuffer(b"".join(rows["key"].to_pylist()), dtype=np.uint8).reshape(-1, 16)
        return rows.filter(pa.array(CuckooFilter.load(held["filter"][0].as_py()).contains(keys)))

    passed = sent.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInArrow(probe, POSTINGS)
    exact = index.refs.filter(F.col("n_docs") >= index.min_docs).select("shard", "key", "holder")
    return passed.join(exact, ["shard", "key"]).filter(~F.col("doc_id").eqNullSafe(F.col("holder"))).select("doc_id", "key")


def drop_repeated_lines(docs: DataFrame, index: LineIndex, text: bool = True) -> DataFrame:
    """`docs` without the lines that the index dooms, plus n_lines, n_dropped and kept_sha256.

    Texts are shuffled once, by doc_id, to meet the list of their doomed keys, which is no longer than the text.
    With `text=False` only doc_id and the new columns are returned.
    """
    lists = doomed_lines(index).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("key").alias("_keys"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_sha256")] if text else ["doc_id", "text"]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    joined = docs.join(lists.hint("shuffle_hash"), F.col("doc_id").cast("bigint").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    at, min_chars = columns.index("text"), index.min_chars
    extra = "n_lines bigint, n_dropped bigint, kept_sha256 string"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, n_lines, n_dropped, digests = [], [], [], []
        for body, doomed in zip(utf8(batch.column(at)), batch.column(len(columns)).to_pylist()):
            lines = body.split(b"\n")
            doomed = set(doomed or ())
            stay = [x for x in lines if _digest(x, min_chars) not in doomed] if doomed else lines
            kept.append(b"\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            digests.append(hashlib.sha256(kept[-1]).hexdigest())
        arrays = [pa.array(kept, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(len(columns))] if text else [batch.column(0)]
        arrays += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests)]
        return pa.RecordBatch.from_arrays(arrays, [*(columns if text else ["doc_id"]), "n_lines", "n_dropped", "kept_sha256"])

    shown = docs if text else docs.select("doc_id")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema.fields), extra])
    return joined.mapInArrow(by_slices(work), schema)
