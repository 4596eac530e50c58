import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from embertrail.operators.components import connected_components
from embertrail.operators.density import density_clusters
from embertrail.operators.matching import best_matches
from embertrail.operators.scale import latest_wins, lookup_join, number_rows, running_sums, salted_join, top_rows
from embertrail.operators.tables import merge_rows, merge_table, new_rows, pending_embeddings, read_table, write_run
from embertrail.schemas import CLUSTER_RUNS, DEPLOYS


def test_rows_are_numbered_without_gaps(spark):
    values = list(range(1000))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    rows = number_rows(df, [F.desc("v")]).collect()
    assert sorted((r["row_no"], r["v"]) for r in rows) == [(i + 1, 999 - i) for i in range(1000)]


def test_running_sums_match_a_plain_loop_with_one_hot_key(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"k{i % 11}", i, rng.randint(-5, 9)) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, at long, v long").repartition(6)
    got = {(r["k"], r["at"]): r["total"] for r in running_sums(df, ["k"], [F.col("at")], {"total": F.col("v")}).collect()}
    sums = {}
    for k, at, v in data:
        sums[k] = sums.get(k, 0) + v
        assert got[(k, at)] == sums[k]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_joins_give_the_plain_join(spark, how):
    facts = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 7}") for i in range(900)], "id long, k string")
    lookups = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("zz", 5)], "k string, v int")
    plain = sorted(map(tuple, facts.join(lookups, ["k"], how).collect()), key=str)
    salted = salted_join(facts, lookups, ["k"], ["id"], how, rows_per_task=50)
    assert sorted(map(tuple, salted.select(*facts.join(lookups, ["k"], how).columns).collect()), key=str) == plain
    assert sorted(map(tuple, lookup_join(facts, lookups, ["k"], ["id"], how).collect()), key=str) == plain


def test_top_rows_are_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(100)], "k int, v int")
    top = top_rows(df, ["k"], [F.desc("v")], 2)
    assert sorted((r["k"], r["rank"], r["v"]) for r in top.collect()) == [(0, 1, 98), (0, 2, 96), (1, 1, 99), (1, 2, 97)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert latest_wins(df, ["k"], [F.desc("v")]).count() == 2


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_connected_components(spark, shape):
    rng = random.Random(7)
    if shape == "chain":
        edges = [(i, i + 1) for i in range(1, 120)]
    elif shape == "star":
        edges = [(500, i) for i in range(100)]
    else:
        edges = [(rng.randint(1, 150), rng.randint(1, 150)) for _ in range(110)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["row_id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if any(a != b and x in (a, b) for a, b in edges)}


def sequential_labels(vectors, eps, min_samples):
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)
    close = 1 - unit @ unit.T <= eps
    np.fill_diagonal(close, True)
    core = close.sum(axis=1) >= min_samples
    labels, number = np.full(len(vectors), -1), 0
    for i in range(len(vectors)):
        if labels[i] != -1 or not core[i]:
            continue
        stack, labels[i] = [i], number
        while stack:
            j = stack.pop()
            if core[j]:
                fresh = np.flatnonzero(close[j] & (labels == -1))
                labels[fresh] = number
                stack.extend(fresh)
        number += 1
    return labels


def spark_labels(spark, vectors, eps, min_samples, tile_rows):
    rows = [(f"{i:06d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "log_id string, vector array<double>").withColumn("ts", F.lit(None).cast("timestamp"))
    return np.array([r[0] for r in density_clusters(df, eps, min_samples, tile_rows).orderBy("log_id").select("cluster_id").collect()])


@pytest.mark.parametrize("eps,min_samples,tile_rows", [(0.1, 3, 40), (0.3, 4, 2048), (0.02, 2, 64)])
def test_density_clusters_equal_the_sequential_algorithm(spark, eps, min_samples, tile_rows):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(5, 12))
    groups = [centers[i] + 0.25 * rng.normal(size=(n, 12)) for i, n in enumerate([160, 40, 30, 8, 3])]
    copies, noise = np.repeat(centers[:1], 80, axis=0), rng.normal(size=(40, 12))
    vectors = np.concatenate([*groups, copies, noise, np.zeros((2, 12))])
    rng.shuffle(vectors)
    assert (spark_labels(spark, vectors, eps, min_samples, tile_rows) == sequential_labels(vectors, eps, min_samples)).all()


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10_000), eps=st.sampled_from([0.05, 0.2, 0.6]), min_samples=st.integers(2, 5))
def test_density_clusters_on_random_planes(spark, seed, eps, min_samples):
    rng = np.random.default_rng(seed)
    vectors = np.round(rng.normal(size=(60, 3)), 2)
    assert (spark_labels(spark, vectors, eps, min_samples, 16) == sequential_labels(vectors, eps, min_samples)).all()


def brute_matches(latest, previous, threshold):
    found = {}
    for cid, key, _, services, centroid in latest:
        best = None
        for pid, pkey, size, others, vector in sorted(previous, key=lambda r: (-r[2], r[0])):
            a, b = np.array(centroid), np.array(vector)
            scale = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) and len(a) else 0
            cosine = float(a @ b) / scale if scale else 0.0
            union = set(services) | set(others)
            score = 0.6 * cosine + 0.25 * (len(set(services) & set(others)) / len(union) if union else 1.0)
            if best is None or score > best[0] + 1e-12:
                best = (score, pid, size)
        if best and best[0] >= threshold:
            found[cid] = best[1:]
    return found


@pytest.mark.parametrize("threshold", [0.1, 0.45, 0.7])
def test_best_matches_equal_brute_force(spark, threshold):
    rng = np.random.default_rng(2)

    def clusters(n, start):
        rows = []
        for i in range(n):
            vector = [] if i % 17 == 5 else [0.0] * 6 if i % 17 == 7 else [float(x) for x in rng.normal(size=4 if i % 5 == 1 else 6)]
            rows.append((start + i, f"k{start + i}", int(rng.integers(1, 9)), [f"s{j}" for j in range(4) if rng.random() < 0.4], vector))
        return rows

    layout = "cluster_id long, cluster_key string, log_count long, services array<string>, centroid array<double>"
    latest, previous = clusters(40, 0), clusters(70, 1000)
    frames = [spark.createDataFrame(rows, layout) for rows in (latest, previous)]
    got = {r["cluster_id"]: (r["matched_id"], r["matched_size"]) for r in best_matches(*frames, threshold, tile_rows=16).collect()}
    assert got == brute_matches(latest, previous, threshold)


def test_unequal_keys_never_reach_the_default_threshold(spark):
    layout = "cluster_id long, cluster_key string, log_count long, services array<string>, centroid array<double>"
    one = spark.createDataFrame([(1, "a", 1, ["s"], [1.0, 0.0])], layout)
    assert best_matches(one, one).count() == 0


def deploy_rows(spark, rows):
    full = [(i, None, s, v, None, None, None, [], None, None, None) for i, s, v in rows]
    return spark.createDataFrame(full, DEPLOYS).withColumn("n", F.monotonically_increasing_id())


def test_merging_tables_replaces_keys_and_repeats_safely(spark, tmp_path):
    root = str(tmp_path)
    assert read_table(spark, root, "deploys").count() == 0
    merge_table(spark, root, "deploys", deploy_rows(spark, [("a", "s", "1"), ("b", "s", "1"), ("a", "s", "2")]), [F.col("n")])
    second = deploy_rows(spark, [("b", "s", "3"), ("c", "s", "1")])
    for _ in range(2):
        merge_table(spark, root, "deploys", second, [F.col("n")])
    assert sorted((r["deploy_id"], r["version"]) for r in read_table(spark, root, "deploys").collect()) == [("a", "2"), ("b", "3"), ("c", "1")]


def test_runs_are_replaced_as_a_whole(spark, tmp_path):
    for noise in (5, 6):
        run = spark.createDataFrame([(1, 0.3, 3, 10, noise, None)], CLUSTER_RUNS)
        write_run(run, str(tmp_path), "cluster_runs")
    write_run(spark.createDataFrame([(2, 0.3, 3, 11, 0, None)], CLUSTER_RUNS), str(tmp_path), "cluster_runs")
    assert sorted((r["run_id"], r["noise_count"]) for r in read_table(spark, str(tmp_path), "cluster_runs").collect()) == [(1, 6), (2, 0)]


def test_small_set_operators(spark):
    logs = spark.createDataFrame([("a",), ("b",)], "log_id string")
    assert [r[0] for r in pending_embeddings(logs, spark.createDataFrame([("a",)], "log_id string")).collect()] == ["b"]
    pairs = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "i int, t string")
    assert new_rows(pairs, spark.createDataFrame([(2, "y")], "i int, t string"), ["i", "t"]).count() == 1
    current = spark.createDataFrame([("a", "old"), ("b", "old")], "k string, v string")
    incoming = spark.createDataFrame([("b", "new", 1), ("b", "newer", 2), ("c", "new", 1)], "k string, v string, n int")
    assert sorted(map(tuple, merge_rows(current, incoming, ["k"], [F.col("n")]).collect())) == [("a", "old"), ("b", "newer"), ("c", "new")]


def test_rows_reach_few_tiles_as_vectors_that_cluster_grow(spark):
    """More than one tile runs, and the copies sent per row do not grow with the table."""
    from embertrail.operators.tiles import Zoning, tile_rows_self

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    copies = []
    for count in (1250, 2500):
        vectors = centres[np.arange(count) % 40] + rng.normal(size=(count, 16)) * 0.1
        points = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(vectors)], "row_id long, weight long, vector array<double>")
        zoning = Zoning.fit(points, 0.3, 64)
        assigned = zoning.assign(points).cache()
        stats = zoning.statistics(assigned)
        routed = tile_rows_self(zoning.reach(assigned, stats), zoning.close_zones(stats, stats), zoning.blocks(stats))
        assert routed.select("zone_a", "block_a", "zone_b", "block_b").distinct().count() > 10
        copies.append(routed.count() / count)
    assert copies[1] <= copies[0] * 1.3
