"""Operator 5: quality scores from random-indexing word vectors and a two-layer network.

Word vectors: every token bucket has a fixed sparse random index vector; a bucket's vector is the sum of the index vectors
of its neighbours within WINDOW tokens over the whole corpus, summed by Spark. A document is pooled as the frequency-
weighted mean of its tokens' vectors. A two-layer network, trained on a bounded, hash-ordered set of labelled rows, and a
temperature fitted on labelled rows that it has not seen turn the pooled vector into a probability.

Defined cases: null and empty texts are pooled as the zero vector and still scored. Rows without an id are scored and
count as not held out. Labels join by doc_id; null labels teach nothing; a document that several label rows name teaches
with each. If one class has no labelled row, every score is the share of label 1 (0.5 without any label).
Only doc_id and text of `docs` are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embertrail.llm.common import Remembered, SLICE_ROWS, by_slices, held_out

BUCKETS, WIDTH, SPARSE, WINDOW = 8192, 64, 4, 2
# Labelled rows that the network is fitted on at most (the smallest hashes of their ids), and the share kept for calibration.
TRAIN_ROWS, CALIBRATION = 40_000, 0.15
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4
TOKEN = re.compile(r"\w+|[^\w\s]+")
FEATURES = WIDTH + 3


def _buckets() -> Remembered:
    return Remembered(lambda token: zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS, 300_000)


def token_ids(texts: list[str], known: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token of all texts, and how many each text has."""
    split = [TOKEN.findall(t) for t in texts]
    flat = np.fromiter((known[x] for tokens in split for x in tokens), dtype=np.int64, count=sum(map(len, split)))
    return flat, np.array([len(x) for x in split], dtype=np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(11)
    places = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :SPARSE]
    return places, np.where(np.arange(SPARSE) % 2 == 0, 1.0, -1.0)


def cooccurrence_sums(flat: np.ndarray, counts: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(BUCKETS, WIDTH) sums of the neighbours' index vectors; neighbours never cross documents."""
    places, signs = index
    owner = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros(BUCKETS * WIDTH)
    for step in range(1, WINDOW + 1):
        near = owner[step:] == owner[:-step]
        left, right = flat[:-step][near], flat[step:][near]
        for word, other in ((left, right), (right, left)):
            for slot in range(SPARSE):
                total += signs[slot] * np.bincount(word * WIDTH + places[other, slot], minlength=BUCKETS * WIDTH)
    return total.reshape(BUCKETS, WIDTH)


def word_sums(docs: DataFrame) -> DataFrame:
    """(bucket, n, v0..): how often each bucket occurs in the corpus and its summed neighbours.

    A partition holds one matrix of fixed size and emits at most BUCKETS rows, which Spark sums by bucket.
    """
    columns = [f"v{i}" for i in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = _buckets(), index_vectors()
        seen, total = np.zeros(BUCKETS, dtype=np.int64), np.zeros((BUCKETS, WIDTH))
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                texts = [x or "" for x in batch.column(0).slice(start, SLICE_ROWS).to_pylist()]
                flat, counts = token_ids(texts, known)
                seen += np.bincount(flat, minlength=BUCKETS)
                total += cooccurrence_sums(flat, counts, index)
        rows = np.flatnonzero(seen)
        arrays = [pa.array(rows), pa.array(seen[rows]), *(pa.array(total[rows, i].astype(np.int64)) for i in range(WIDTH))]
        yield pa.RecordBatch.from_arrays(arrays, ["bucket", "n", *columns])

    schema = ", ".join(["bucket bigint", "n bigint", *(f"{c} bigint" for c in columns)])
    sums = docs.select("text").mapInArrow(run, schema)
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns])


def word_vectors(sums: DataFrame) -> np.ndarray:
    """(BUCKETS, WIDTH) weighted word vectors; at most BUCKETS rows reach the driver."""
    held = sums.toPandas()
    vectors, n = np.zeros((BUCKETS, WIDTH)), np.zeros(BUCKETS)
    if len(held):
        at = held["bucket"].to_numpy()
        n[at] = held["n"].to_numpy()
        vectors[at] = held.iloc[:, 2:].to_numpy(dtype=float)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = n / max(1.0, n.sum())
    return (vectors * (1e-3 / (1e-3 + share))[:, None]).astype(np.float32)


def pool(flat: np.ndarray, counts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row of FEATURES values per text: the mean vector, its length, the log of the token count, and how much the
    tokens repeat."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    full = np.flatnonzero(counts)
    out = np.zeros((len(counts), FEATURES), dtype=np.float32)
    if len(full):
        out[full, :WIDTH] = np.add.reduceat(vectors[flat], starts[full], axis=0) / counts[full, None]
        out[:, WIDTH] = np.linalg.norm(out[:, :WIDTH], axis=1)
        out[:, WIDTH + 1] = np.log1p(counts)
        for i in full:
            out[i, WIDTH + 2] = len(np.unique(flat[starts[i] : starts[i] + counts[i]])) / counts[i] ** 0.8
    return out


@dataclass
class Network:
    """Standardised features, one hidden layer, a logit, and the temperature that divides it."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    last: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.first + self.bias) @ self.second + self.last

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """The network of rows `x` with labels `y` (0 or 1), trained by Adam; the last rows calibrate the temperature."""
    share = float(y.mean()) if len(y) else 0.5
    flat = Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if not len(y) or share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        flat.last = float(np.log(p / (1 - p)))
        return flat
    cut = max(1, int(len(y) * (1 - CALIBRATION)))
    rng = np.random.default_rng(5)
    net = Network(
        x[:cut].mean(0), x[:cut].std(0) + 1e-6, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0,
    )
    z = np.clip((x[:cut] - net.mean) / net.scale, -8, 8)
    params = [net.first, net.bias, net.second, np.array(0.0)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(cut), max(1, cut // BATCH)):
            w, b, v, c = params
            h = np.tanh(z[rows] @ w + b)
            p = 1 / (1 + np.exp(-np.clip(h @ v + c, -30, 30)))
            e = (p - y[rows]) / len(rows)
            back = np.outer(e, v) * (1 - h * h)
            step += 1
            for i, g in enumerate((z[rows].T @ back + DECAY * w, back.sum(0), h.T @ e + DECAY * v, e.sum())):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.first, net.bias, net.second, net.last = params[0], params[1], params[2], float(params[3])
    if cut < len(y):
        logit, truth = net.logits(x[cut:]), y[cut:]
        loss = lambda t: np.logaddexp(0, np.where(truth == 1, -logit, logit) / t).mean()
        net.temperature = float(min(np.geomspace(0.3, 5, 60), key=loss))
    return net


def _pooled(docs: DataFrame, vectors, columns: list[str], kinds, finish) -> DataFrame:
    """Maps (columns..., text) to the columns and what `finish` makes of the pooled rows."""

    def work_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _buckets()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, counts = token_ids([x or "" for x in batch.column(len(columns)).to_pylist()], known)
            return finish(batch, pool(flat, counts, vectors.value))

        yield from by_slices(work)(batches)

    return docs.select(*columns, "text").mapInArrow(work_all, kinds)


def train(docs: DataFrame, labels: DataFrame, vectors, label: str = "quality") -> Network:
    """The network fitted on at most TRAIN_ROWS labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    chosen = known.orderBy(order, "doc_id", "y").limit(TRAIN_ROWS)  # a bounded table, hence broadcast below

    def finish(batch: pa.RecordBatch, pooled: np.ndarray) -> pa.RecordBatch:
        rows = pa.FixedSizeListArray.from_arrays(pa.array(pooled.ravel(), pa.float32()), FEATURES).cast(pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], ["doc_id", "y", "x"])

    rows = _pooled(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), vectors, ["doc_id", "y"], "doc_id bigint, y int, x array<float>", finish).toPandas()
    mixed = np.array([zlib.crc32(str(i).encode()) for i in rows["doc_id"]], dtype=np.int64) * 2654435761 % 2**32
    rows = rows.assign(mixed=mixed).sort_values(["mixed", "doc_id"], kind="stable")
    x = np.stack(rows["x"].to_numpy()).astype(float) if len(rows) else np.zeros((0, FEATURES))
    return fit(x, rows["y"].to_numpy())


def _prepared(docs: DataFrame, labels: DataFrame, label: str):
    """Broadcast word vectors of the corpus and the network fitted on them."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(word_sums(docs)))
    return vectors, context.broadcast(train(docs, labels, vectors, label))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3, label: str = "quality") -> DataFrame:
    """The rows of `docs` that score at least `cut`, all columns kept and no row shuffled."""
    vectors, net = _prepared(docs, labels, label)
    names = docs.columns

    def finish(batch: pa.RecordBatch, pooled: np.ndarray) -> pa.RecordBatch:
        good = pa.array(net.value.scores(pooled.astype(float)) >= cut)
        return pa.RecordBatch.from_arrays([c.filter(good) for c in batch.columns[:-1]], names)

    return _pooled(docs, vectors, [f"`{c}`" for c in names], docs.schema, finish)


def score_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`."""
    vectors, net = _prepared(docs, labels, label)

    def finish(batch: pa.RecordBatch, pooled: np.ndarray) -> pa.RecordBatch:
        score = net.value.scores(pooled.astype(float))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = _pooled(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), vectors, ["doc_id"], "doc_id bigint, score double, predicted int", finish)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
