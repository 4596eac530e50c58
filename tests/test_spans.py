"""Deploy windows as spans, what incidents read of their regressions, and nodes that are left whole."""

import random
from datetime import datetime, timedelta

import numpy as np

from embertrail.operators.balltree import routed_rows
from embertrail.operators.density import neighbour_counts
from embertrail.plans.incidents import _deciding
from embertrail.plans.regressions import window_counts, window_spans

START = datetime(2024, 1, 1)


def _tables(spark, n_logs, n_deploys):
    rng = random.Random(4)
    logs = [(f"l{i}", START + timedelta(minutes=rng.randrange(600)), f"s{i % 2}", rng.randrange(3)) for i in range(n_logs)]
    deploys = [(f"d{i}", START + timedelta(minutes=rng.randrange(600)), f"s{i % 2}") for i in range(n_deploys)]
    return logs, deploys, spark.createDataFrame(logs, "log_id string, ts timestamp, service string, cluster_id bigint"), spark.createDataFrame(
        deploys, "deploy_id string, deployed_at timestamp, service string"
    )


def test_window_counts_equal_a_plain_count(spark):
    logs, deploys, log_rows, deploy_rows = _tables(spark, 60, 150)
    want = {}
    for name, at, service in deploys:
        for _, ts, where, cluster in logs:
            if where == service and at - timedelta(minutes=40) <= ts <= at + timedelta(minutes=25):
                held = want.setdefault((name, cluster), [0, 0, None])
                held[ts >= at] += 1
                if ts >= at:
                    held[2] = min(held[2] or ts, ts)
    got = {(r["deploy_id"], r["cluster_id"]): [r["before_count"], r["after_count"], r["first_seen_after"]] for r in window_counts(deploy_rows, log_rows, 40, 25).collect()}
    assert got == want


def test_spans_go_by_logs_not_by_deploys(spark):
    logs, _, log_rows, deploy_rows = _tables(spark, 30, 900)
    spans, numbered = window_spans(deploy_rows, log_rows, 200, 200)
    assert spans.count() <= 4 * len(logs)
    assert window_counts(deploy_rows, log_rows, 200, 200).count() > 40 * len(logs)
    assert numbered.count() == 900


def test_incidents_read_at_most_three_findings_of_a_key(spark):
    rows = [(f"k{i % 2}", i, None if i < 10 else START) for i in range(100)]
    kept = _deciding(spark.createDataFrame(rows, "cluster_key string, seq long, first_seen timestamp"))
    assert sorted(r["seq"] for r in kept.collect()) == [0, 1, 10, 11, 98, 99]


def test_a_node_whose_children_would_all_get_its_rows_is_left_whole(spark):
    vectors = np.random.default_rng(2).normal(size=(2500, 32))
    points = spark.createDataFrame([(i, 1, v) for i, v in enumerate(vectors.tolist())], "row_id long, weight long, vector array<double>")
    rows = routed_rows(points, 1.2, 16)
    assert rows.count() == 2500 and rows.filter("home").count() == 2500
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = {r["row_id"]: r["neighbours"] for r in neighbour_counts(points, 0.72, 16).collect()}
    assert got == dict(enumerate(np.maximum(1, (1.0 - unit @ unit.T <= 0.72).sum(axis=1)).tolist()))
