"""Near-duplicate operators and the pipeline against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

import corpus_pipeline
from embertrail.llm import hnsw_dedup, line_dedup, ngram_join, queries
from embertrail.llm.common import read

SF = "/root/testdata/sf0.001"


def united(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_join(rows):
    """(n_links, component) by id, from all pairs of n-gram sets."""
    grams = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        grams[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(grams)
    links = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
        if grams[a] and grams[b] and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])
    ]
    roots = united(ids, links)
    return {i: (sum(i in pair for pair in links), roots[i]) for i in ids}


def joined(df):
    return {r["doc_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def test_ngram_join_finds_every_pair(spark, odd_documents):
    given = read(spark, SF, "documents")
    assert joined(queries.QUERIES["op8_ngram_jaccard"](spark, SF)) == brute_join([(r["doc_id"], r["text"]) for r in given.collect()])
    assert joined(ngram_join.ngram_jaccard_join(odd_documents)) == brute_join([(r["doc_id"], r["text"]) for r in odd_documents.collect()])


def test_ngram_join_over_many_chunks_and_buckets(spark, monkeypatch):
    """A chain of near copies, cut into small chunks, once in whole places and once bucket by bucket."""
    texts = [(i, " ".join(f"t{j}" for j in range(i, i + 120))) for i in range(0, 400, 4)] + [(1000 + i, "copy of one text " * 9) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    want = brute_join(texts)
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", 7)
    assert joined(ngram_join.ngram_jaccard_join(docs)) == want
    monkeypatch.setattr(ngram_join, "PLACE_ROWS", 3)
    assert joined(ngram_join.ngram_jaccard_join(docs)) == want


def test_ngram_join_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A B  c d e f"), (5, None), (6, "")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["class_id"], r["n_links"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(docs).collect())
    assert rows == [(0, None, 0, None), (3, 3, 2, 3), (3, 3, 2, 3), (4, 3, 2, 3), (5, 5, 0, 5), (6, 6, 0, 6)]
    kept = sorted((r["doc_id"] or 0) for r in ngram_join.one_of_each_group(docs).collect())
    assert kept == [0, 3, 5, 6]
    assert ngram_join.ngram_jaccard_join(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.choose_bands(threshold, 0.99)
        assert bands * rows <= ngram_join.MOST_HASHES and 1 - (1 - threshold**rows) ** bands >= 0.99


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute_vectors(rows, threshold=0.98):
    sound = [(i, np.array(v, dtype=float), k) for i, v, k in rows if v and k is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for n, (i, v, k) in enumerate(sound):
        for j, w, m in sound[n + 1 :]:
            if k == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                links.append((i, j))
    roots = united([r[0] for r in rows], links)
    return {r[0]: (sum(r[0] in p for p in links), roots[r[0]], roots[r[0]] == r[0]) for r in rows}


def vector_results(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_vectors_match_brute_force(spark):
    given = [(r["vec_id"], r["embedding"], r["label"]) for r in read(spark, SF, "embeddings").collect()]
    assert vector_results(queries.QUERIES["op3_hnsw_dedup"](spark, SF)) == brute_vectors(given)


def test_vector_groups_over_several_shards(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=16) * (0.05 if i % 3 else 0.4)], i % 12 % 2) for i in range(360)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]  # one vector over and over
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, [None] * 16, 0), (2005, rows[0][1], None)]
    rows += [(2006, [float("inf")] + [1.0] * 15, 0), (2007, [1.0, 2.0], 0), (2008, [2.0, 4.0], 0)]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("weight", F.lit("clash")).withColumn("n_links", F.lit("clash"))
    assert vector_results(hnsw_dedup.near_duplicate_vectors(frame, shard_rows=64)) == brute_vectors(rows)
    assert hnsw_dedup.near_duplicate_vectors(frame.limit(0)).count() == 0
    nameless = hnsw_dedup.near_duplicate_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)], VECTORS))
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in nameless.collect()} == {(None, 0, None), (4, 0, 4)}


def test_graph_recall():
    rng = np.random.default_rng(8)
    points = hnsw_dedup.unit(rng.normal(size=(3000, 32)))
    graph = hnsw_dedup.Graph.build(points)
    ids, _ = graph.search(points[:200].astype(np.float32), 128)
    true = np.argsort(-(points[:200] @ points.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), true.tolist())]) >= 0.9


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, kept[-1], SF).write.parquet(path)
        kept.append(spark.read.parquet(path))
    first, good, lines, groups, mixed, tokens = kept
    assert all(k.columns == columns for k in (good, lines, groups, mixed))

    from embertrail.llm.quality_net import score_quality

    scored = {r["doc_id"]: r["predicted"] for r in score_quality(first, read(spark, SF, "labels")).collect()}
    assert {r[0] for r in rows_of(good, "doc_id")} == {i for i, p in scored.items() if p}

    from tests.llm.test_lines_and_tokens import brute_lines

    want = brute_lines(rows_of(good, "doc_id", "text"))
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows_of(lines, "doc_id", "text")} == {i: w[2] for i, w in want.items()}
    assert all(len(t) == n for _, t, n in rows_of(lines, "doc_id", "text", "n_chars"))

    components = brute_join(rows_of(lines, "doc_id", "text"))
    assert {r[0] for r in rows_of(groups, "doc_id")} == {i for i, (_, c) in components.items() if i == c}

    from embertrail.llm.source_mix import mix_sources

    times = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 0 for r in mix_sources(groups).collect()}
    counted = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    sized = {r["doc_id"] for r in mix_sources(groups).filter("size > 0").collect()}
    assert {i: n for i, n in counted.items() if i in sized} == {i: n for i, n in times.items() if n}

    import public_tokenizers
    import tiktoken

    from embertrail.llm.byte_bpe import read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = dict(rows_of(mixed, "doc_id", "text"))
    assert tokens.count() == mixed.count()
    assert all(ids == encode(texts[i]) and exact for i, ids, exact in rows_of(tokens, "doc_id", "ids", "exact"))
