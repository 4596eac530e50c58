"""Line dedup, BPE and token counts against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from embertrail.llm import byte_bpe, line_dedup, queries, token_counts
from embertrail.llm.oracles import SQL

SF = "/root/testdata/sf0.001"


def deduped(docs, index):
    rows = line_dedup.drop_repeated_lines(docs, index, text=False)
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows.collect()}


def brute_lines(rows, min_docs=3, min_chars=20):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
        return k if len(k) >= min_chars else None

    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                holders.setdefault(key(line), set()).add(doc_id)
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (key(x) and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != doc_id)]
        out[doc_id] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


def test_lines_match_brute_force_and_sql(spark, odd_documents, same_rows):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    found = deduped(odd_documents, line_dedup.add_documents(line_dedup.empty_index(spark, shards=4), odd_documents))
    assert found == brute_lines(rows)
    assert found[1][1] == 1 and found[3][1] == 0  # the passage stays in the largest id only, there in all its places
    same_rows(queries.QUERIES["op10_line_dedup"](spark, SF), SQL["op10_line_dedup"], SF)


def test_lines_keep_other_columns(spark, odd_documents):
    index = line_dedup.add_documents(line_dedup.empty_index(spark, shards=4), odd_documents)
    kept = line_dedup.drop_repeated_lines(odd_documents, index)
    row = kept.filter("doc_id = 1").first()
    assert row["text"] == "first own line that is long enough\nshort" and row["key"] == "clash" and row["n_lines"] == 3


def test_lines_are_reversible(spark, odd_documents):
    docs = odd_documents.select("doc_id", "text")
    index = line_dedup.add_documents(line_dedup.empty_index(spark, shards=4), docs.filter("doc_id < 20"))
    before = deduped(docs.filter("doc_id < 20"), index)
    copies = spark.createDataFrame([(100 + i, f"first own line that is long enough\ncopy {i}") for i in range(3)], "doc_id long, text string")
    grown = line_dedup.add_documents(index, copies)
    assert deduped(docs.filter("doc_id = 1"), grown)[1][1] == 2
    again = line_dedup.add_documents(grown, copies)  # known documents change nothing
    assert {tuple(r) for r in again.refs.collect()} == {tuple(r) for r in grown.refs.collect()}
    back = line_dedup.remove_documents(again, copies)
    assert deduped(docs.filter("doc_id < 20"), back) == before
    assert {tuple(r) for r in back.refs.collect()} == {tuple(r) for r in index.refs.collect()}
    held = {r["shard"]: int((line_dedup.CuckooFilter.load(r["filter"]).table != 0).sum()) for r in back.filters.collect()}
    marked = {r["shard"]: r["count"] for r in back.refs.filter("n_docs >= 3").groupBy("shard").count().collect()}
    assert {s: n for s, n in held.items() if n} == marked
    only = line_dedup.remove_documents(back, spark.createDataFrame([(2,)], "doc_id long"))
    assert deduped(docs.filter("doc_id = 1"), only)[1][1] == 0


def test_lines_null_ids_repeated_rows_and_empty_table(spark):
    line = "a line that is surely long enough"
    rows = [(None, line), (5, line), (5, line), (7, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = line_dedup.add_documents(line_dedup.empty_index(spark, shards=2), docs)
    found = sorted(((r["doc_id"] or 0), r["n_dropped"]) for r in line_dedup.drop_repeated_lines(docs, index, text=False).collect())
    assert found == [(0, 1), (5, 1), (5, 1), (7, 0)]
    none = docs.limit(0)
    assert line_dedup.drop_repeated_lines(none, line_dedup.add_documents(line_dedup.empty_index(spark), none)).count() == 0


def test_cuckoo_filter_holds_and_forgets():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(5000)]
    held = line_dedup.CuckooFilter.load(line_dedup.CuckooFilter.of(keys).dump())
    array = np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, 16)
    assert held.contains(array).all()
    assert all(held.delete(k) for k in keys[:2500])
    assert held.contains(array[2500:]).all() and held.contains(array[:2500]).mean() < 0.01


@pytest.fixture(scope="module")
def tokenizer():
    return queries.bpe_tokenizer()


@pytest.fixture(scope="module")
def tiktoken_ids():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_bpe_looks_words_up_once_whatever_stands_around_them(tokenizer, tiktoken_ids, monkeypatch):
    texts = ["one two\nthree, four", "two one. four\none", "three\n\ntwo  one\t", " one", "one\x1c two\u00a0", "\n", "", "l'été d'one 'two'"]
    codec, seen = byte_bpe.Codec(tokenizer), []
    encoded = codec._encoded
    monkeypatch.setattr(codec, "_encoded", lambda matches: seen.extend(matches) or encoded(matches))
    for _ in range(2):
        for text in texts:
            packed = codec.packed([text])[0]
            assert np.frombuffer(packed, "<u4").tolist() == tiktoken_ids(text) and codec.decoded(packed).decode() == text
            assert codec.listed(packed) == ",".join(map(str, tiktoken_ids(text)))
    assert len(seen) == len(set(seen)) and " one" in seen
    monkeypatch.setattr(byte_bpe, "PIECES", 3)
    monkeypatch.setattr(byte_bpe, "PIECE_CHARS", 3)
    assert codec.ids(texts) == codec.ids(texts) == [tiktoken_ids(text) for text in texts]
    assert np.concatenate([np.frombuffer(x, "<u4") for x in codec.packed(texts)]).tolist() == [i for text in texts for i in tiktoken_ids(text)]


def test_bpe_gives_the_ids_of_a_merge_by_rank(tokenizer, tiktoken_ids):
    rng = random.Random(3)
    pool = "ab e\n\t'sdlm-.é漢字😀🏽‍\u0085　ñ12٣½\x00<|endoftext|>"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += [c * n for c in "a- \n=é漢" for n in (1, 2, 3, 5, 17, 150, 5000)] + ["", "it's they'll   end  \n\n x"]
    codec = byte_bpe.Codec(tokenizer)
    found = codec.ids(texts)
    assert found == [tiktoken_ids(t) for t in texts]
    assert found == [ids for ids, _ in codec.ids_and_offsets(texts)]
    assert [codec.decode(ids) for ids in found] == [t.encode() for t in texts]


def test_bpe_columns(spark, odd_documents, tokenizer, tiktoken_ids):
    encoded = byte_bpe.encode_texts(odd_documents, tokenizer)
    rows = byte_bpe.decode_ids(encoded, tokenizer).collect()
    for r in rows:
        text = r["text"] or ""
        assert r["ids"] == tiktoken_ids(text) and bytes(r["decoded"]) == text.encode() and r["decoded_text"] == text and r["key"] == "clash"
        covered = {i for a, b in zip(r["starts"], r["ends"]) for i in range(a, b)}
        assert covered == set(range(len(text)))
    digests = {r["doc_id"]: r for r in byte_bpe.round_trip_digests(odd_documents.select("doc_id", "text"), tokenizer).collect()}
    for r in rows:
        ids = tiktoken_ids(r["text"] or "")
        assert digests[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[r["doc_id"]]["n_tokens"] == len(ids)
    split = spark.createDataFrame([(tiktoken_ids("🏽")[:1],), (None,)], "ids array<int>")
    assert "�" in byte_bpe.decode_ids(split, tokenizer).collect()[0]["decoded_text"]


def longest_match(word, starting, continuing):
    at, count, pieces = 0, 0, starting
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, count, pieces = end, count + 1, continuing
    return count


def test_automaton_counts_the_longest_matches():
    rng = random.Random(2)
    for trial in range(600):
        letters = "ab" if trial % 2 else "abc"
        some = lambda: {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(8))}
        starting, continuing = some(), some()
        automaton = token_counts.PieceAutomaton(starting, continuing)
        for _ in range(20):
            word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
            assert automaton.pieces(word) == longest_match(word, starting, continuing)


def test_long_words_are_counted_whole(spark):
    rng = random.Random(4)
    starting, continuing = {"a", "ab", "aba"}, {"a", "b", "ba", "bab", "漢", "漢字"}
    words = ["a" + "".join(rng.choice(["a", "b", "ba", "漢字"]) for _ in range(n)) for n in (9_000, 10_000, 20_000)] + ["ab" * 5_000, "ab" * 5_000 + "a", "ab" * 6_000 + "x"]
    want = [long_match(w, starting, continuing) for w in words]
    assert any(len(w) > 10_000 and n > 1 for w, n in zip(words, want)) and want[-1] == 0
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs, (sorted(starting), sorted(continuing))).collect()}
    assert [(rows[i]["n_tokens"], rows[i]["n_unknown"]) for i in range(len(words))] == [(max(n, 1), int(n == 0)) for n in want]


def long_match(word, starting, continuing):
    """As longest_match, trying ends no further than the longest piece."""
    at, count, pieces, most = 0, 0, starting, max(map(len, starting | continuing))
    while at < len(word):
        end = next((e for e in range(min(len(word), at + most), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, count, pieces = end, count + 1, continuing
    return count


def test_token_counts_match_brute_force(spark, odd_documents):
    import public_tokenizers

    pieces = token_counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    sets = [set(p) for p in pieces]
    sample = odd_documents.select("doc_id", "text", F.lit(0).alias("n_tokens")).unionByName(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(0).alias("n_tokens")).limit(30)
    )
    for r in token_counts.count_tokens(sample, pieces).collect():
        counts = [longest_match(w.decode(), *sets) for w in (r["text"] or "").encode().split()]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(counts), sum(max(c, 1) for c in counts), counts.count(0))
    assert token_counts.count_tokens(sample.limit(0), pieces).count() == 0
    nothing = token_counts.count_tokens(sample.filter("doc_id = 12").limit(1), ([], [])).first()
    assert (nothing["n_tokens"], nothing["n_unknown"]) == (1, 1)
