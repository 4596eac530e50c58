"""Operator 8: Jaccard self join on word n-grams by MinHash banding, verified on full n-gram sets.

1. Every text becomes its set of hashed word n-grams, a MinHash signature and one key per band. The number of bands and
   rows is the cheapest choice that reaches the target recall at the threshold. Texts with equal sets are one class.
2. Classes that share a band key are candidates. Keys meet by one shuffle; a key only hands on its members' tie to its
   smallest member, never pairs.
3. Classes that candidates connect are compared in one place. A place that would be too large is given up for the buckets
   themselves, of which those with equal members count once. Places are cut into chunks, and every task compares two
   bounded chunks on full n-gram sets by matrix products. A pair that meets in several places counts in the lowest.
4. Tasks return a link count and a tie per class, so rows stay linear however many pairs a group has.

Defined cases: words are split at ASCII white space, and A-Z are compared lower-cased. A text of 1 to n-1 words has one
n-gram of all its words; a null or empty text has none and links with nothing. Rows that repeat a doc_id are one document,
linked by its id. Rows without an id are returned with null class and component and 0 links. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embertrail.llm.common import Remembered, by_slices, utf8
from embertrail.operators.components import connected_components
from embertrail.session import durable

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.99999, 256
# Classes and n-grams that one side of a task holds, and the largest place compared as a whole.
CHUNK_ROWS, CHUNK_GRAMS = 512, 400_000
PLACE_ROWS, PLACE_GRAMS = 8_192, 8_000_000
COLUMNS = 2_048


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows per band) that find a pair at the threshold with probability `recall`, with the most rows per band
    (the fewest false candidates) that `most` hashes allow."""
    best = (1, 1)
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def word_hashes() -> Remembered:
    return Remembered(lambda word: int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"), 300_000)


def ngram_set(text: bytes, known: Remembered, n: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
    n = min(n, len(ids))
    mixed = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for step in range(n):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[step : len(ids) - n + 1 + step]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


class Banding:
    """The band keys of n-gram sets."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(17)
        self.shape = (bands, rows)
        self.times = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.mix = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        short = (grams >> np.uint64(16)).astype(np.uint32)
        least = np.full(len(self.times), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(short), 1024):
            np.minimum(least, (self.times[:, None] * short[None, at : at + 1024] + self.plus[:, None]).min(axis=1), out=least)
        key = (least.reshape(self.shape).astype(np.uint64) * self.mix[None, :]).sum(axis=1, dtype=np.uint64)
        key += np.arange(self.shape[0], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
        key *= np.uint64(0x94D049BB133111EB)
        return (key ^ (key >> np.uint64(30))).view(np.int64)


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, n_grams, keys); digest and keys are null for a text without n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, banding = word_hashes(), Banding(bands, rows)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [ngram_set(text, known, n) for text in utf8(batch.column(1))]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys = [banding.keys(s) if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "digest", "n_grams", "keys"],
            )

        yield from by_slices(work)(batches)

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id bigint, digest binary, n_grams bigint, keys array<bigint>")


def _candidates(classes: DataFrame) -> DataFrame:
    """(cls, bucket, low): the buckets of two or more classes, equal ones once, with the smallest class in them."""
    members = classes.select("cls", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("cls").alias("low"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y")
    )
    shared = buckets.filter(F.col("n") > 1).select("key", "low", F.xxhash64("n", "low", "x", "y").alias("bucket"))
    return durable(members.join(shared, "key").select("cls", "bucket", "low").distinct())


def _places(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """(cls, weight, places, routes): where each candidate class is compared; a route names a place, the class's chunk
    there and the number of chunks."""
    ties = connected_components(shared.select(F.col("cls").alias("a"), F.col("low").alias("b")))
    sized = ties.select(F.col("row_id").alias("cls"), "root").join(classes.select("cls", "weight", "n_grams"), "cls")
    loads = sized.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_grams").alias("grams"))
    fits = (F.col("rows") <= PLACE_ROWS) & (F.col("grams") <= PLACE_GRAMS)
    judged = durable(sized.join(loads.select("root", fits.alias("fits")), "root"))
    whole = judged.filter("fits").select("cls", "weight", "n_grams", F.xxhash64(F.lit("place"), "root").alias("place"))
    parts = judged.filter("not fits").select("cls", "weight", "n_grams").join(shared.select("cls", F.col("bucket").alias("place")), "cls")
    placed = durable(whole.unionByName(parts))
    chunks = placed.groupBy("place").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS), F.ceil(F.sum("n_grams") / CHUNK_GRAMS)).cast("int").alias("chunks")
    )
    route = F.struct("place", F.pmod(F.xxhash64("cls"), "chunks").cast("int").alias("chunk"), "chunks")
    return placed.join(chunks, "place").groupBy("cls", "weight").agg(F.collect_list(route).alias("routes"))


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: Fraction) -> np.ndarray:
    """A symmetric matrix that is true where a set of `left` and one of `right` (boolean marks) reach the threshold."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    several = seen > 1
    number = np.cumsum(several) - 1
    stay = several[column]
    owner, column = owner[stay], number[column[stay]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        held[owner[a:b], column[a:b] - start] = 1
        common += held @ held.T
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    met = (common * threshold.denominator >= union * threshold.numerator) & (left[:, None] & right[None, :] | right[:, None] & left[None, :])
    np.fill_diagonal(met, False)
    return met


def lowest_reachable(met: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the lowest row that links lead to."""
    lowest = np.arange(len(met))
    while len(met):
        now = np.minimum(lowest, np.where(met, lowest[None, :], len(met)).min(axis=1))
        now = now[now]
        if (now == lowest).all():
            break
        lowest = now
    return lowest


def _verify(threshold: Fraction):
    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        place, low, high = (k.as_py() for k in key)
        rows = rows.combine_chunks().sort_by("cls")
        cls, weight, chunk = (rows[c].to_numpy() for c in ("cls", "weight", "chunk"))
        grams = rows["grams"].combine_chunks()
        flat, ends = grams.flatten().to_numpy(), grams.offsets.to_numpy() - grams.offsets[0].as_py()
        met = linked([flat[a:b] for a, b in zip(ends, ends[1:])], chunk == low, chunk == high, threshold)
        met &= cls[:, None] != cls[None, :]
        lower = [(i, p) for i, own in enumerate(rows["places"].to_pylist()) for p in own if p < place]
        if lower:  # pairs that also meet in a lower place count there
            names = {p: i for i, p in enumerate(sorted({p for _, p in lower}))}
            held = np.zeros((len(cls), len(names)), dtype=np.float32)
            for i, p in lower:
                held[i, names[p]] = 1
            met &= held @ held.T == 0
        links = met.astype(np.int64) @ weight
        tie = cls[lowest_reachable(met)]
        some = links > 0
        return pa.table({"cls": pa.array(cls[some]), "links": pa.array(links[some]), "tie": pa.array(tie[some])})

    return compare


def ngram_jaccard_join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links and component_id for every row of `docs`.

    class_id is the smallest doc_id with the same n-gram set, n_links the number of other documents at the threshold or
    above, and component_id the smallest doc_id that links lead to.
    """
    signed = durable(_signed(docs, n, *choose_bands(threshold, recall)))
    usable = signed.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    grouped = usable.groupBy("digest").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("doc_id", "n_grams", "keys")).alias("first"))
    classes = durable(grouped.select("digest", "weight", F.col("first.doc_id").alias("cls"), F.col("first.n_grams").alias("n_grams"), F.col("first.keys").alias("keys")))
    routes = durable(_places(classes, _candidates(classes)).withColumn("places", F.transform("routes", lambda x: x["place"])))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = pa.array([ngram_set(text, known, n) for text in utf8(batch.column(0))], pa.list_(pa.uint64()))
            return pa.RecordBatch.from_arrays([*batch.columns[1:], sets.cast(pa.list_(pa.int64()), safe=False)], [*names, "grams"])

        yield from by_slices(work)(batches)

    names = ["cls", "weight", "places", "routes"]
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("cls"), "text").join(routes.hint("shuffle_hash"), "cls").select("text", *names)
    kinds = "cls bigint, weight bigint, places array<bigint>, routes array<struct<place:bigint,chunk:int,chunks:int>>, grams array<bigint>"
    sets = wanted.mapInArrow(grams, kinds).select("cls", "weight", "places", "grams", F.inline("routes"))
    sent = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "place", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "cls", "weight", "places", "grams"
    )
    found = durable(sent.groupBy("place", "low", "high").applyInArrow(_verify(Fraction(str(threshold))), "cls bigint, links bigint, tie bigint"))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("cls").alias("a"), F.col("tie").alias("b"))).select(F.col("row_id").alias("cls"), "root")
    known = classes.select("digest", "weight", "cls").join(counts, "cls", "left").join(roots, "cls", "left")
    by_class = known.select(
        F.col("digest").alias("_digest"), F.col("cls").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("root", "cls").alias("component_id"),
    )
    named = F.col("doc_id").isNotNull()
    joined = signed.select("doc_id", "digest").join(by_class, named & (F.col("digest") == F.col("_digest")), "left")
    return joined.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each_group(docs: DataFrame, **how) -> DataFrame:
    """The documents of `docs` that are the smallest id of their component, all columns kept; a repeated id stays once."""
    joined = durable(ngram_jaccard_join(docs, **how))
    kept = joined.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    repeated = not kept.filter(F.col("_rows") > 1).isEmpty()
    stay = kept.select(F.col("doc_id").alias("_doc"))
    found = docs.join(stay.hint("shuffle_hash"), F.col("doc_id").cast("bigint") == F.col("_doc"), "left_semi")
    found = found.dropDuplicates(["doc_id"]) if repeated else found
    return found.unionByName(docs.filter(F.col("doc_id").isNull()))
