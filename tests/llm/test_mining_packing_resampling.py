import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from embertrail.llm import hard_negatives, importance_resampling as resampling, oracles, packing
from embertrail.llm.queries import QUERIES
from tests.llm.conftest import DOCUMENTS, SF

VECTORS = "vec_id bigint, embedding array<float>, label int, rank string, score string, slot string, width string"


# ---- hard negatives ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls, broken and unequal vectors, ties, repeated rows, many copies of one vector, negative scores, and clashing names."""
    rng = random.Random(5)
    rows = [(100 * i, [rng.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(6)]
    rows += [(i, [rng.uniform(0, 1) for _ in range(4)], rng.randrange(3)) for i in range(1001, 1301)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5], 1) for i in range(2001, 2061)] + [(i, [0.25, 0.25, 0.25, 0.25], 2) for i in range(2101, 2161)]
    rows += [(3000, [0.5, 0.5, 0.5, 0.5], 1), (3100, None, 1), (3200, [0.1, None, 0.1, 0.1], 1), (3300, [float("nan"), 0.0, 0.0, 0.0], 1)]
    rows += [(3400, [float("inf"), 0.0, 0.0, 0.0], 1), (3500, [0.5, 0.5], 1), (3501, [0.4, 0.5], 1), (3502, [0.2, 0.3], 2), (3600, [], 1), (3601, [], 1)]
    rows += [(3700, [1.0, 1.0, 1.0, 1.0], None), (None, [0.5, 0.5, 0.5, 0.5], 1), (3800, [0.0, 0.0, 0.0, 0.0], 2), (3900, [-1.0, 0.2, 0.0, 0.0], 77), (1301, [0.3, 0.3, 0.3, 0.3], 2), (1302, [0.3, 0.3, 0.3, 0.3], 2)]
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS)


def _mined(vectors, **how):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0, **how)


def test_hard_negatives_equal_the_sql(spark, same_rows):
    same_rows(QUERIES["op11_hard_negatives"](spark, SF), oracles.OP11, SF)


@pytest.mark.parametrize("how", [{}, {"block_rows": 7, "block_anchors": 2}])
def test_hard_negatives_of_odd_vectors(odd_vectors, same_rows, monkeypatch, how):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 5)
    same_rows(_mined(odd_vectors, **how), oracles.OP11, embeddings=odd_vectors.select("vec_id", "embedding", "label"))


def test_no_vectors_and_no_anchors(spark, odd_vectors):
    empty = spark.createDataFrame([], VECTORS)
    assert _mined(empty).count() == 0
    assert hard_negatives.mine_hard_negatives(odd_vectors, F.lit(False)).count() == 0


def test_repeated_rows_are_returned_as_often_and_anchors_once(spark):
    rows = [(100, [1.0, 0.0], 0), (100, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.0], 1), (2, [0.5, 0.0], 1)]
    found = hard_negatives.mine_hard_negatives(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), F.col("vec_id") == 100)
    assert sorted((r["positive_id"], r["rank"], r["negative_id"]) for r in found.collect()) == [(1, 1, 2), (1, 2, 2)]


def test_slots_keep_the_best_however_rows_are_cut():
    """The slots against a plain selection, with ties, cut after every few candidates."""
    rng = np.random.default_rng(2)
    scores = rng.integers(-5, 40, (400, 3)).astype(float)
    upper = np.array([[30, 20, 20, -np.inf], [25, -np.inf, -np.inf, -np.inf], [39, 38, 5, 1]])
    lower, marks, own = np.array([3.0, 0.0, -2.0]), rng.integers(0, 4, 400), np.array([0, 1, 9])
    before, hard_negatives.GATHERED = hard_negatives.GATHERED, 10
    try:
        best = hard_negatives.Best(upper, lower, 6)
        for start in range(0, 400, 9):
            part = slice(start, start + 9)
            best.offer(scores[part], np.arange(400)[part], marks[part], own)
        best.cut()
    finally:
        hard_negatives.GATHERED = before
    got = sorted(zip(*(x.tolist() for x in best.kept)))
    want = []
    for a in range(3):
        for slot in range(4):
            below = upper[a, slot + 1] if slot < 3 else -np.inf
            fit = [(-s, i) for i, s in enumerate(scores[:, a]) if max(below, lower[a] - 0.5) < s <= upper[a, slot] and marks[i] != own[a]]
            want += [(a * 4 + slot, -s, i) for s, i in sorted(fit)[:6]]
    assert got == sorted(want)


def test_long_vectors_are_scored_in_doubles(spark):
    rows = [(100, [4e4, 3.0], 0), (1, [4e4, 5.0], 0), (2, [2e4, 7.0], 1), (3, [2e4, 8.0], 1)]
    found = hard_negatives.mine_hard_negatives(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), F.col("vec_id") == 100)
    got = [(r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found.orderBy("rank").collect()]
    whole = lambda x, y: 256 * 256 * int(x[0] * y[0] + x[1] * y[1])
    assert got == [(1, 3, whole(rows[0][1], rows[1][1]), whole(rows[0][1], rows[3][1])), (2, 2, whole(rows[0][1], rows[1][1]), whole(rows[0][1], rows[2][1]))]


# ---- packing ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def _is_packed(pieces, wanted, window):
    """Pieces make up the documents (a list of id lists) and whole sequences; returns the padding."""
    ids_of, places, sequences = {}, {}, {}
    for doc, start, length, crc, tokens, sequence, offset in pieces:
        places.setdefault(doc, []).append((start, length, crc, tokens))
        sequences.setdefault(sequence, []).append((offset, length))
    assert set(places) == set(wanted)
    for doc, ids in wanted.items():
        at = 0
        for start, length, crc, tokens in sorted(places[doc]):
            assert (start, tokens) == (at, len(ids)) and length > 0
            assert crc == zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def _rows(pieces):
    return [tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")) for r in pieces.collect()]


def test_packing_of_a_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library = Tokenizer.from_str(tokenizer)
    wanted = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    assert _is_packed(_rows(QUERIES["op12_packing"](spark, SF)), wanted, 4096) == 0
    small = packing.pack_documents(docs.repartition(3), tokenizer, window=64)
    assert _is_packed(_rows(small), wanted, 64) == 0
    joined = {i: [] for i in wanted}
    for r in small.orderBy("doc_id", "start").collect():
        joined[r["doc_id"]] += r["ids"]
    assert joined == wanted


def test_packing_of_odd_documents(spark, odd_documents, tokenizer):
    library = Tokenizer.from_str(tokenizer)
    long = spark.createDataFrame([(90, "Straße " * 400_000, "en", "a", 1), (91, "ab" * 50_000, "en", "a", 1), (92, "   x́ 'S　don't İ", "en", "a", 1)], DOCUMENTS)
    docs = odd_documents.select("doc_id", "text", "n_words").unionByName(long.select("doc_id", "text", F.lit("x").alias("n_words")))
    wanted = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    assert _is_packed(_rows(packing.pack_documents(docs, tokenizer, ids=False)), wanted, 4096) == 0
    assert packing.pack_documents(docs.limit(0), tokenizer).count() == 0
    alike = packing.pack_documents(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id bigint, text string"), tokenizer, ids=False)
    assert {(r["doc_id"], r["doc_tokens"]) for r in alike.collect()} == {(None, 3)} and alike.agg(F.sum("length")).first()[0] == 6


def test_words_forgotten_are_looked_up_again(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 5)
    codec, library = packing.WordIds(tokenizer), Tokenizer.from_str(tokenizer)
    for text in ("one two three", "three four five one", "six seven eight nine one two", "one one six"):
        assert np.frombuffer(codec.ids([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_the_level_with_the_smallest_sum_of_squares_is_taken():
    rng = random.Random(3)
    packer, window = packing.Packer(20, 10**9), 20
    for number in range(2000):
        size = rng.randint(1, 19)
        counts = packer.levels.copy()

        def after(level):
            moved = counts.copy()
            if level:
                moved[level] -= 1
            if level + size < window:
                moved[level + size] += 1
            return int((moved**2).sum())

        fits = [h for h in range(1, window - size + 1) if counts[h]]
        least = min([after(0), *map(after, fits)])
        assert packer.level_for(size) == max([h for h in fits if after(h) == least], default=0)
        list(packer.add(number, bytes(4 * size)))
        assert packer.n_open == packer.levels.sum() == sum(map(len, packer.open.values()))


def test_open_windows_stay_bounded():
    """Pieces of which no two fit together are poured into full windows."""
    packer = packing.Packer(16, 5)
    done = []
    for number in range(100):
        done += packer.add(number, bytes(4 * 9))
        assert packer.n_open <= 5
    done += packer.finish()
    lengths = [sum(len(ids) // 4 for *_, ids in sequence) for sequence in done]
    assert sum(lengths) == 900 and lengths.count(16) == 56 and lengths[-1] == 4


def test_sequences_are_padded_unless_a_power_of_two(spark):
    pieces = spark.createDataFrame([(7, 3, 2, [4, 5]), (7, 0, 3, [1, 2, 3]), (8, 0, 4, [9, 9, 9, 9])], "sequence_id long, offset long, length long, ids array<int>")
    found = {r["sequence_id"]: (r["n_tokens"], r["ids"]) for r in packing.packed_sequences(pieces, window=8).collect()}
    assert found == {7: (5, [1, 2, 3, 4, 5, 0, 0, 0]), 8: (4, [9, 9, 9, 9])}


# ---- importance resampling --------------------------------------------------------------------------------------


def _plain_features(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[0-9a-z\x80-\xff]+", low)
    return words + [a + b" " + b for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("piece", [1 << 17, 500, 40])
def test_codes_of_all_features_are_their_crc(monkeypatch, piece):
    """Spans around the table's length and its multiples, words across pieces, texts without words, non-ASCII words."""
    monkeypatch.setattr(resampling, "PIECE_BYTES", piece)
    rng = random.Random(1)
    lengths = [1, 2, 3, 7, 40, 63, 64, 65, 126, 127, 128, 129, 130, 200, 256, 257, 1000]
    words = lambda: ["".join(rng.choice("abcXYZ019éß漢") for _ in range(rng.choice(lengths))) for _ in range(rng.randint(1, 25))]
    texts = ["", "a", "  ", "a b", "A-b c", "x" * 5000, *(rng.choice(["", " ", "\n"]) + " ".join(words()) + rng.choice(["", "!"]) for _ in range(150))]
    got = [[] for _ in texts]
    for row, _, found in resampling.text_features(pa.array(texts)):
        for owner, code in zip(found.owners, found.codes):
            got[row + int(owner)].append(int(code))
    assert [sorted(x) for x in got] == [sorted(map(zlib.crc32, _plain_features(t))) for t in texts]


def test_slices_of_a_column_are_read_from_their_own_place():
    column = pa.array(["skip me", "one two", None, "three"]).slice(1)
    counts = [0, 0, 0]
    for row, _, found in resampling.text_features(column.fill_null("")):
        for owner in found.owners:
            counts[row + int(owner)] += 1
    assert counts == [3, 0, 1]


def test_resampling_equals_the_sql(spark, same_rows):
    same_rows(QUERIES["op13_importance_resampling"](spark, SF), oracles.OP13, SF)


def test_resampling_of_odd_documents(spark, odd_documents, same_rows):
    more = spark.createDataFrame([(None, "a " * 30, "en", "a", 1), (95, "Word-" * 20_000, "en", "a", 1), (95, "Word-" * 20_000, "en", "a", 1), (96, "z" * 900 + " " + "yß" * 90, "en", "a", 1)], DOCUMENTS)
    docs = odd_documents.select(*DOCUMENTS.names, "score", "n_words").unionByName(more.select("*", F.lit("x").alias("score"), F.lit("x").alias("n_words")))
    target = spark.createDataFrame([(1, "word w1 w2 v3 v4 ß"), (2, None), (3, "")], "item_id bigint, text string")
    plain = docs.select("doc_id", "text")
    same_rows(resampling.resample(docs, target), oracles.OP13, documents=plain, benchmark=target)
    same_rows(resampling.resample(docs, target.limit(0)), oracles.OP13, documents=plain, benchmark=target.limit(0))
    assert resampling.resample(docs.limit(0), target).count() == 0


def test_documents_like_the_target_are_drawn(spark):
    rng = random.Random(4)
    like, unlike = [f"near{i}" for i in range(30)], [f"far{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(like if i % 4 == 0 else unlike, k=40)), i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rank long")
    drawn = resampling.resampled_documents(docs, spark.createDataFrame([(" ".join(rng.choices(like, k=500)),)], "text string"))
    ids = [r["doc_id"] for r in drawn.collect()]
    assert drawn.columns == docs.columns and len(ids) == 50 and sum(i % 4 == 0 for i in ids) >= 30  # 12 by chance
