"""Operator 1: toxicity by a factorization machine over hashed terms.

A document is the set of its distinct lower-cased words and word beginnings (which the forms of an inflected word share),
each hashed to one of TERMS terms, as a vector of length 1. The logit is a bias, a weight per term and, for every pair of its
terms, the product of their factor vectors, so that a pair (an insult beside a group) can weigh more or less than its words
do alone. The machine is fitted on a bounded, hash-ordered set of labelled rows; its tables have a fixed size and are
broadcast to score every document.

It learns the terms that tell of the label by themselves and those that do so in pairs: words that stand near each other and
carry the label, together, clearly more often than the more telling one of them does. Both are counted by Spark. Other terms
would only serve to memorise single documents; they count neither as terms nor towards a document's length.

Defined cases: null and empty texts have no terms and score the bias. Rows without an id are scored and count as not held
out. Null labels teach nothing. If one class has no labelled row, every score is the share of label 1 (0 without any
label: nothing is called toxic then). Only doc_id and text of `docs` are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embertrail.llm.common import Remembered, by_slices, held_out
from embertrail.session import durable

TERMS, FACTORS = 1 << 17, 8
# Lengths of the word beginnings that are terms of their own.
BEGINNINGS = (4, 5)
# Labelled rows that the machine is fitted on at most: the smallest hashes of their ids.
TRAIN_ROWS = 30_000
# Terms that the machine learns: in at least so many labelled rows, and so strongly tied to the label (chi square).
LEAST_ROWS, ASSOCIATION = 5, 10.0
# Pairs: words at most so many places apart, neither in more than this share of the rows, and so strongly tied beyond their
# words (chi square against the share of the more telling word).
PAIR_REACH, COMMON, PAIR_ASSOCIATION = 5, 0.2, 25.0
# Set on splits of the learning rows: what a missed row of label 1 weighs, and the spread of the factors at the start.
LABEL_WEIGHT, START = 1.5, 0.1
EPOCHS, BATCH, RATE, DECAY = 24, 256, 0.1, 2e-4
# Steps at least, for small tables.
LEAST_STEPS = 400
# Documents whose pairs a task holds at a time, and tasks that count pairs, so that none holds too many different ones.
ROWS_OF_PAIRS, PAIR_TASKS = 32, 96
WORD = re.compile(r"\w+")


def _word_terms(word: str) -> tuple[int, ...]:
    named = [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) >= n)]
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % TERMS for x in named)


def _terms() -> Remembered:
    return Remembered(_word_terms, 150_000)


def document_terms(text: str, known: Remembered) -> list[int]:
    """The distinct terms of a text, in order."""
    return sorted({term for word in set(WORD.findall(text.lower())) for term in known[word]})


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    learned: np.ndarray | None = None  # flags of the terms that count; None: all

    def logits(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One logit per document; `terms` holds the documents' terms one after another."""
        owner = np.repeat(np.arange(len(counts)), counts)
        if self.learned is not None:
            held = self.learned[terms]
            terms, owner = terms[held], owner[held]
        return self.bias + _parts(self, terms, owner, len(counts))[0]

    def scores(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(terms, counts), -30, 30)))


def _parts(machine: Machine, terms: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document what its terms and pairs add and the sum of its factors; per term its share and its factors times that.

    The pairs of a document come from two sums: the square of the sum less the sum of squares is twice all products.
    """
    share = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=rows), 1))[owner]
    held = machine.factors[terms] * share[:, None]
    sums, squares = (np.stack([np.bincount(owner, x[:, k], rows) for k in range(FACTORS)], axis=1) for x in (held, held * held))
    alone = np.bincount(owner, machine.weights[terms] * share, rows)
    return alone + 0.5 * (sums * sums - squares).sum(1), sums, share, held


def fit(documents: list[np.ndarray], y: np.ndarray) -> Machine:
    """The machine of documents (arrays of distinct terms) with labels 0 or 1, by AdaGrad on the log loss."""
    rng = np.random.default_rng(3)
    weight = np.where(y == 1, LABEL_WEIGHT, 1.0)
    share = float((y * weight).sum() / weight.sum()) if len(y) else 0.0
    p = min(max(share, 1e-6), 1 - 1e-6)
    machine = Machine(float(np.log(p / (1 - p))), np.zeros(TERMS), np.zeros((TERMS, FACTORS)), np.zeros(TERMS, dtype=bool))
    if share in (0.0, 1.0):
        return machine
    known = np.unique(np.concatenate(documents)).astype(np.int64)
    machine.learned[known] = True
    machine.factors[known] = rng.normal(0, START, (len(known), FACTORS))
    grown_w, grown_v, grown_b = np.full(TERMS, 1e-2), np.full((TERMS, FACTORS), 1e-2), 1e-2
    batches = max(1, len(y) // BATCH)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // batches))):
        for rows in np.array_split(rng.permutation(len(y)), batches):
            counts = np.array([len(documents[i]) for i in rows])
            terms = np.concatenate([documents[i] for i in rows]).astype(np.int64)
            owner = np.repeat(np.arange(len(rows)), counts)
            added, sums, part, held = _parts(machine, terms, owner, len(rows))
            error = (1 / (1 + np.exp(-np.clip(machine.bias + added, -30, 30))) - y[rows]) * weight[rows] / len(rows) * 16
            machine.bias -= RATE * error.sum() / np.sqrt(grown_b := grown_b + error.sum() ** 2)
            if not len(terms):
                continue
            used, place = np.unique(terms, return_inverse=True)
            pull = error[owner] * part
            grad_w = np.bincount(place, pull, len(used)) + DECAY * machine.weights[used]
            steep = pull[:, None] * (sums[owner] - held)
            grad_v = np.stack([np.bincount(place, steep[:, k], len(used)) for k in range(FACTORS)], axis=1) + DECAY * machine.factors[used]
            grown_w[used] += grad_w**2
            grown_v[used] += grad_v**2
            machine.weights[used] -= RATE * grad_w / np.sqrt(grown_w[used])
            machine.factors[used] -= RATE * grad_v / np.sqrt(grown_v[used])
    return machine


def _with_terms(docs: DataFrame, columns: list[str], schema: str, finish) -> DataFrame:
    """Maps (columns..., text) to what `finish` makes of the columns, the flat terms and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _terms()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [document_terms(x or "", known) for x in batch.column(len(columns)).to_pylist()]
            return finish(batch, np.array([t for x in found for t in x], dtype=np.int64), np.array([len(x) for x in found], dtype=np.int64))

        yield from by_slices(work)(batches)

    return docs.select(*columns, "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Machine:
    """The machine fitted on at most TRAIN_ROWS labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(TRAIN_ROWS)  # a bounded table, hence broadcast below
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _terms()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            terms = pa.array([document_terms(x, known) for x in texts], pa.list_(pa.int32()))
            words = pa.array([[known[w][0] for w in WORD.findall(x.lower())] for x in texts], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms, words], ["doc_id", "y", "terms", "words"])

        yield from by_slices(work)(batches)

    rows = durable(labelled.select("doc_id", "y", "text").mapInArrow(termed, "doc_id bigint, y int, terms array<int>, words array<int>"))
    counts = durable(rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("marked")))
    told = flagged(associated_terms(rows, counts).unionByName(paired_terms(rows, counts)).distinct())
    shared = docs.sparkSession.sparkContext.broadcast(told)

    def only_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [[t for t in terms if shared.value[t]] for terms in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.list_(pa.int32()))], ["doc_id", "y", "terms"])

    held = rows.select("doc_id", "y", "terms").mapInArrow(only_told, "doc_id bigint, y int, terms array<int>").toPandas().sort_values(["doc_id", "y"], kind="stable")
    return fit(list(held["terms"]), held["y"].to_numpy())


def flagged(terms: DataFrame) -> np.ndarray:
    """A flag per term; `terms(term)` are distinct, so they are at most TERMS numbers."""
    flags = np.zeros(TERMS, dtype=bool)
    flags[terms.toPandas()["term"].to_numpy(dtype=np.int64)] = True
    return flags


def associated_terms(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The terms of labelled `rows(y, ...)` whose documents carry the label clearly more or less often than all do."""
    share = rows.agg(F.avg("y").alias("share"))
    gap = F.col("marked") - F.col("n") * F.col("share")
    strong = gap * gap >= ASSOCIATION * F.col("n") * F.col("share") * (1 - F.col("share"))
    return counts.crossJoin(F.broadcast(share)).filter((F.col("n") >= LEAST_ROWS) & strong).select("term")


def near_pairs(words: np.ndarray) -> np.ndarray:
    """The distinct pairs of unlike terms at most PAIR_REACH places apart (-1: no term), as smaller * TERMS + larger."""
    found = [np.empty(0, dtype=np.int64)]
    for gap in range(1, min(PAIR_REACH + 1, len(words))):
        low, high = np.minimum(words[:-gap], words[gap:]), np.maximum(words[:-gap], words[gap:])
        found.append((low * TERMS + high)[(low >= 0) & (low < high)])
    return np.unique(np.concatenate(found))


def paired_terms(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Both terms of every near pair of words that is tied to the label more strongly than its more telling word."""
    total, marked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    some = counts.filter((F.col("n") >= LEAST_ROWS) & (F.col("n") <= max(LEAST_ROWS, COMMON * total))).select("term", "n", "marked")
    shared = rows.sparkSession.sparkContext.broadcast(flagged(some.select("term")))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OF_PAIRS):
                part = batch.slice(at, ROWS_OF_PAIRS)
                y, words = part.column(0).to_pylist(), [np.asarray(x, dtype=np.int64) for x in part.column(1).to_pylist()]
                found = [near_pairs(np.where(shared.value[w], w, -1)) for w in words]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(y, [len(x) for x in found]), pa.int32()), pa.array(np.concatenate(found))], ["y", "pair"])

    near = rows.repartition(PAIR_TASKS, "doc_id").select("y", "words").mapInArrow(pairs, "y int, pair bigint").groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("marked"))
    often = near.filter(F.col("n") >= LEAST_ROWS).select(F.floor(F.col("pair") / TERMS).cast("int").alias("a"), (F.col("pair") % TERMS).cast("int").alias("b"), "n", "marked")
    rate = some.select("term", (F.col("marked") / F.col("n")).alias("rate"))  # at most TERMS rows, hence broadcast
    rated = often.join(F.broadcast(rate.select(F.col("term").alias("a"), F.col("rate").alias("rate_a"))), "a").join(F.broadcast(rate.select(F.col("term").alias("b"), F.col("rate").alias("rate_b"))), "b")
    best = F.greatest("rate_a", "rate_b", F.lit(marked / max(total, 1)))
    gap = F.col("marked") - F.col("n") * best
    strong = (gap > 0) & (gap * gap >= PAIR_ASSOCIATION * F.col("n") * best * (1 - best))
    return rated.filter(strong).select(F.explode(F.array("a", "b")).alias("term")).distinct()


def score_toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.5, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label))

    def finish(batch: pa.RecordBatch, terms: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        score = machine.value.scores(terms, counts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = _with_terms(docs, ["doc_id"], "doc_id bigint, score double, predicted int", finish)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
