"""The factorization machine: its sums, its pairs, and what is lost without its factors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from embertrail.llm import toxicity_fm


def _random_machine(rng):
    machine = toxicity_fm.Machine(-0.3, rng.normal(size=toxicity_fm.TERMS), rng.normal(size=(toxicity_fm.TERMS, toxicity_fm.FACTORS)), rng.random(toxicity_fm.TERMS) < 0.5)
    return machine


def test_logits_equal_the_sum_over_all_pairs():
    rng = np.random.default_rng(0)
    machine = _random_machine(rng)
    documents = [rng.choice(toxicity_fm.TERMS, n, replace=False) for n in (0, 1, 2, 7, 30, 400)] + [np.flatnonzero(~machine.learned)[:5]]
    got = machine.logits(np.concatenate(documents).astype(np.int64), np.array([len(d) for d in documents]))
    for document, logit in zip(documents, got):
        held = [t for t in document if machine.learned[t]]
        size = 1 / math.sqrt(max(len(held), 1))
        want = machine.bias + sum(machine.weights[t] * size for t in held)
        want += sum(machine.factors[a] @ machine.factors[b] * size * size for i, a in enumerate(held) for b in held[i + 1 :])
        assert logit == pytest.approx(want)
    assert got[0] == got[-1] == machine.bias


def test_near_pairs_equal_a_loop():
    rng = random.Random(2)
    for n in (0, 1, 2, 9, 60):
        words = [rng.randrange(-1, 12) for _ in range(n)]
        want = {min(a, b) * toxicity_fm.TERMS + max(a, b) for i, a in enumerate(words) for b in words[i + 1 : i + 1 + toxicity_fm.PAIR_REACH] if a != b and min(a, b) >= 0}
        assert toxicity_fm.near_pairs(np.array(words, dtype=np.int64)).tolist() == sorted(want)


@pytest.fixture(scope="module")
def paired(spark):
    """A quarter of the texts hold one of two words beside one of two others: each is harmless, two of the four pairs are not."""
    rng, rows = random.Random(1), []
    for i in range(1600):
        filling, k = [f"w{rng.randrange(40)}" for _ in range(10)], rng.randrange(6)
        if i % 4 == 0:
            first, second = rng.choice(["red", "blue"]), rng.choice(["fruit", "stone"])
            y, words = int((first == "red") == (second == "fruit")), [*filling[:k], first, *filling[k : k + 2], second, *filling[k + 2 :]]
        else:
            y = rng.randrange(2)
            words = [*filling[:k], "awful" if y else "plain", *filling[k:]]
        rows.append((i, " ".join(words), y))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def _right(paired, machine, monkeypatch):
    monkeypatch.setattr(toxicity_fm, "train", lambda *_: machine)
    scored = toxicity_fm.score_toxicity(paired.select("doc_id", "text"), paired.select("doc_id", "toxic"))
    held = scored.filter("held_out").join(paired, "doc_id").filter(F.col("text").rlike("red|blue"))
    return held.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.count(F.lit(1))).first()


def test_pairs_of_harmless_words_are_learned_from_the_table(paired, monkeypatch):
    machine = toxicity_fm.train(paired.select("doc_id", "text"), paired.select("doc_id", "toxic"))
    right, n = _right(paired, machine, monkeypatch)
    assert n > 60 and right >= 0.95
    machine.factors[:] = 0
    assert _right(paired, machine, monkeypatch)[0] <= 0.7


def test_held_out_recall_falls_without_the_factors(spark, monkeypatch):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    machine = toxicity_fm.train(labelled, labels)

    def found():
        with monkeypatch.context() as patched:
            patched.setattr(toxicity_fm, "train", lambda *_: machine)
            held = toxicity_fm.score_toxicity(labelled, labels).filter("held_out").join(labels, "doc_id")
            counts = {(r["toxic"], r["predicted"]): r["n"] for r in held.groupBy("toxic", "predicted").agg(F.count(F.lit(1)).alias("n")).collect()}
        return counts.get((1, 1), 0) / (counts.get((1, 1), 0) + counts.get((1, 0), 0)), counts.get((0, 1), 0)

    recall, wrong = found()
    assert recall >= 0.85 and wrong <= 10
    machine.factors[:] = 0
    assert found()[0] <= recall - 0.2


def test_long_texts_ties_and_texts_without_words(spark):
    rows = [(i, "good day", 0) for i in range(40)] + [(100 + i, "vile day", 1) for i in range(40)]
    rows += [(900, "filler " * 200_000 + "vile", None), (901, "filler " * 200_000 + "vile", None), (902, "", None), (903, None, None), (904, "!!! ...", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    score = {r["doc_id"]: r["score"] for r in toxicity_fm.score_toxicity(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).collect()}
    assert score[900] == score[901] > 0.5 and score[902] == score[903] == score[904] and score[5] < 0.5 < score[105]
