"""Operator 13: resampling documents towards a target distribution by hashed word n-grams.

Features are runs of one and two words, each hashed to a bucket by the CRC-32 of its bytes. Both corpora are counted over
the buckets; a bucket's gain is the scaled log ratio of its smoothed target share to its smoothed corpus share, and a
document's weight is the mean gain of its features. Adding Gumbel noise of a seeded hash of the id and taking the highest
scores draws documents without replacement with odds that grow with their weights.

The CRC-32 of all features of many texts is taken at once. Without its start value the code is linear, so it is the XOR of
what each byte contributes by itself, which depends on the byte and its distance from the end: a table of fixed size.
The contributions of all bytes are looked up, one `bitwise_xor.reduceat` over the feature spans brings them together, and
a constant per length adds what the start value does. A pair's second word contributes what it does alone, so only the
first word's bytes are looked up again, farther from the end. Spans longer than the table are reduced in blocks, and
neighbouring blocks are folded together until one is left.

Defined cases: null and empty texts and texts without a word have no features, weight 0 and are never drawn. Rows without an
id are scored with an empty id and come last among equal scores. Repeated rows are scored and drawn one by one. An empty
table gives an empty result; without target texts, or with empty ones, every target count is 0. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from embertrail.operators.scale import number_rows
from embertrail.session import durable

BUCKETS = 10_000
LEAST_WORDS, DRAWN_PERCENT = 20, 25
# Distances from a span's end that the table covers. Blocks of longer spans have this length.
REACH = 128
# Bytes of text that are hashed at a time.
PIECE_BYTES = 1 << 17


def _word_bytes() -> np.ndarray:
    """The byte that each byte becomes: A-Z lower-cased, other letters, digits and non-ASCII kept, separators 0."""
    kept = np.arange(256, dtype=np.uint8)
    kept[:0x80] = 0
    for first, last, to in ((0x30, 0x39, 0x30), (0x61, 0x7A, 0x61), (0x41, 0x5A, 0x61)):
        kept[first : last + 1] = np.arange(to, to + last - first + 1)
    return kept


WORD_BYTES = _word_bytes()


@functools.cache
def position_table(reach: int = REACH) -> np.ndarray:
    """At distance * 256 + byte: what this byte contributes to the code of a span that ends `distance` bytes after it."""
    table = np.empty((reach, 256), dtype=np.uint32)
    for distance in range(reach):
        rest = bytes(distance)
        base = zlib.crc32(b"\0" + rest)
        table[distance] = [zlib.crc32(bytes([b]) + rest) ^ base for b in range(256)]
    return table.ravel()


@functools.cache
def _doubled_shift(power: int) -> np.ndarray:
    """At place * 256 + byte: the code moved on by 2 ** power bytes, for each byte at each of the code's four places."""
    if power:
        half = _doubled_shift(power - 1)
        return shifted(half, half)
    first, byte = position_table()[:256], np.arange(256, dtype=np.uint32)
    return np.concatenate([first[byte], byte, byte << 8, byte << 16]).astype(np.uint32)


def shifted(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Codes moved on by as many bytes as the table stands for."""
    return table[codes & 255] ^ table[256 + (codes >> 8 & 255)] ^ table[512 + (codes >> 16 & 255)] ^ table[768 + (codes >> 24)]


def shifted_by(codes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Each code moved on by its own number of bytes."""
    codes, power = codes.copy(), 0
    while np.any(steps >> power):
        moved = steps >> power & 1 == 1
        codes[moved] = shifted(codes[moved], _doubled_shift(power))
        power += 1
    return codes


@functools.cache
def _length_constants(most: int) -> np.ndarray:
    return np.array([zlib.crc32(bytes(n)) for n in range(most)], dtype=np.uint32)


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """What start value and final inversion add to the code of spans of these lengths."""
    out = _length_constants(2 * REACH)[np.minimum(lengths, 2 * REACH - 1)]
    far = lengths >= 2 * REACH
    if far.any():
        start = np.full(int(far.sum()), 0xFFFFFFFF, dtype=np.uint32)
        out[far] = shifted_by(start, lengths[far]) ^ np.uint32(0xFFFFFFFF)
    return out


def _places(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the bytes of all spans, one after another: where each lies, and where each span begins among them."""
    begins = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - begins, lengths), begins


def _reduced(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The linear code of short spans followed by `tails` zero bytes, length and tail together within the table."""
    if not len(starts):
        return np.empty(0, dtype=np.uint32)
    places, begins = _places(starts, lengths)
    distances = np.repeat(starts + lengths - 1 + tails, lengths) - places
    return np.bitwise_xor.reduceat(position_table()[distances * 256 + data[places]], begins)


def _folded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The linear code of long spans: blocks counted from the end, of which the first may be shorter, folded in pairs."""
    blocks = -(-lengths // REACH)
    order, begins = _places(np.zeros_like(starts), blocks)
    owner = np.repeat(np.arange(len(starts)), blocks)
    from_end = blocks[owner] - 1 - order
    ends = (starts + lengths)[owner] - from_end * REACH
    first = np.maximum(ends - REACH, starts[owner])
    codes = _reduced(data, first, ends - first, np.zeros_like(ends))
    power = REACH.bit_length() - 1
    while from_end.any():
        odd = np.flatnonzero(from_end & 1)
        codes[odd + 1] ^= shifted(codes[odd], _doubled_shift(power))
        even = from_end & 1 == 0
        codes, from_end = codes[even], from_end[even] >> 1
        power += 1
    return codes


def linear_codes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    codes, far = np.empty(len(starts), dtype=np.uint32), lengths > REACH
    near = ~far
    codes[near] = _reduced(data, starts[near], lengths[near], np.zeros(int(near.sum()), dtype=np.int64))
    if far.any():
        codes[far] = _folded(data, starts[far], lengths[far])
    return codes


def followed_codes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, alone: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The linear code of spans followed by `tails` bytes that are no part of them; `alone` is their code without those."""
    codes, near = np.empty(len(starts), dtype=np.uint32), lengths + tails <= REACH
    far = ~near
    codes[near] = _reduced(data, starts[near], lengths[near], tails[near])
    if far.any():
        codes[far] = shifted_by(alone[far], tails[far])
    return codes


@dataclass
class Features:
    """Features of some texts: the text that each belongs to and its CRC-32."""

    owners: np.ndarray
    codes: np.ndarray


def _features(data: np.ndarray, breaks: np.ndarray, skip_first: bool) -> Features:
    """Single words and adjacent pairs of bytes (separators 0). A word ends at each of the sorted `breaks` too, and pairs
    do not cross them; the feature's owner is the number of breaks up to it. `skip_first`: the first word alone is known."""
    inside = data != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = breaks[(breaks > 0) & (breaks < len(data))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    owners = np.searchsorted(breaks, starts, side="right")
    alone = linear_codes(data, starts, lengths)
    first = np.flatnonzero(owners[1:] == owners[:-1])
    tails = lengths[first + 1] + 1
    pairs = followed_codes(data, starts[first], lengths[first], alone[first], tails)
    blank = np.full(len(first), 0x20, dtype=np.uint8)
    pairs ^= followed_codes(blank, np.arange(len(first)), np.ones_like(first), position_table()[blank], tails - 1) ^ alone[first + 1]
    pairs ^= length_constants(lengths[first] + tails)
    single = alone ^ length_constants(lengths)
    if skip_first:
        owners_single, single = owners[1:], single[1:]
    else:
        owners_single = owners
    return Features(np.concatenate([owners_single, owners[first]]), np.concatenate([single, pairs]))


def text_features(column: pa.Array) -> Iterator[tuple[int, int, Features]]:
    """(first row, rows, features with owners counted from that row) of a column of texts, about PIECE_BYTES at a time.

    A longer text comes in several pieces; each begins with the last word of the one before, for the pair across.
    """
    texts = column.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1)
        low, high = int(offsets[row]), int(offsets[last])
        if high - low <= PIECE_BYTES:
            yield row, last - row, _features(WORD_BYTES[data[low:high]], offsets[row + 1 : last] - low, False)
        else:  # one long text
            yield from ((row, 1, found) for found in _long_features(data[low:high]))
        row = last


def _long_features(data: np.ndarray) -> Iterator[Features]:
    none, at, skip = np.empty(0, dtype=np.int64), 0, False
    while at < len(data):
        size = PIECE_BYTES
        while True:  # as far as the last separator; farther if the piece holds a single word
            piece = WORD_BYTES[data[at : at + size]]
            if at + size >= len(data):
                yield _features(piece, none, skip)
                return
            blanks = np.flatnonzero(piece == 0)
            words = np.flatnonzero(piece[: blanks[-1]] != 0) if len(blanks) else none
            if len(words) and (not skip or len(blanks[blanks < words[-1]])):
                break
            size *= 2
        yield _features(piece[: blanks[-1]], none, skip)
        before = blanks[blanks < words[-1]]
        at, skip = at + (int(before[-1]) + 1 if len(before) else 0), True


def _bucket_counts(texts: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, <name>): a task sends at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, found in text_features(batch.column(0)):
                counts += np.bincount(found.codes % buckets, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], ["bucket", name])

    counted = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"bucket int, {name} bigint")
    return counted.groupBy("bucket").agg(F.sum(name).alias(name))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, whether or not anything falls into it."""
    counts = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(
        _bucket_counts(docs, buckets, "s"), "bucket", "left"
    ).join(_bucket_counts(target, buckets, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    counts = durable(counts)
    totals = counts.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + buckets) / ((F.col("s") + 1.0) * (F.col("all_t") + buckets))
    return counts.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain"))


def document_weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_features and weight of every row of `docs`; `gains` holds one number a bucket, hence is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for row, rows, found in text_features(batch.column(1)):
                own = shared.value[found.codes % len(shared.value)]
                counts[row : row + rows] += np.bincount(found.owners, minlength=rows)
                sums[row : row + rows] += np.bincount(found.owners, weights=own, minlength=rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(sums // np.maximum(counts, 1))], ["doc_id", "n_features", "weight"]
            )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise from the first 8 hexadecimal digits of sha256(seed:id), in thousandths, floored."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: int = 7, buckets: int = BUCKETS
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) for every row of `docs`; `target` has column text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    gains = np.zeros(buckets, dtype=np.int64)
    for row in bucket_gains(docs, target, buckets).collect():  # `buckets` rows
        gains[row["bucket"]] = row["gain"]
    weighed = document_weights(docs, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    # n words have 2n - 1 features.
    weighed = weighed.withColumn("eligible", F.col("n_features") >= 2 * least_words - 1)
    place = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    placed = number_rows(weighed, place, "place")
    drawn = placed.agg(F.coalesce(F.floor(F.sum(F.col("eligible").cast("bigint")) * percent / 100), F.lit(0)).alias("drawn"))
    return placed.crossJoin(F.broadcast(drawn)).select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("place") <= F.col("drawn"), F.col("place")).cast("bigint").alias("rank")
    )


def resampled_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents: the rows of `docs` whose id was drawn, all rows of a repeated id if one of them was."""
    drawn = resample(docs, target, **how).filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn.hint("shuffle_hash"), F.col("doc_id").cast("bigint").eqNullSafe(F.col("_drawn")), "left_semi")
