import datetime as dt
import json
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from embertrail.functions.generated import parse_confidence
from embertrail.operators.representatives import newest_messages, oldest_messages
from embertrail.operators.tables import append_alerts, merge_table, of_latest_run, read_table
from embertrail.plans.anomalies import detect_anomalies, detect_anomalies_by_run
from embertrail.plans.ci import ci_patterns
from embertrail.plans.clusters import cluster_logs, cluster_snapshots, signature_clusters
from embertrail.plans.deploys import correlate_deploys
from embertrail.plans.embed import embed_logs
from embertrail.plans.evaluate import case_columns, evaluate
from embertrail.plans.incidents import apply_status_changes, explain_incidents, fold_incidents, incident_detail, list_incidents, promote_regressions
from embertrail.plans.ingest import ingest_ci, ingest_deploys, ingest_logs
from embertrail.plans.regressions import detect_regressions, list_regressions, window_counts
from embertrail.plans.reports import cluster_reports, cluster_timeline, incident_paragraph_lines, incident_report_lines, timeline_order, write_incident_reports
from embertrail.plans.sessions import fold_sessions
from embertrail.plans.summaries import dominant_levels, summarize_clusters, summarize_with
from embertrail.schemas import CLUSTER_HISTORY, EVIDENCE, INCIDENTS, RUN_SESSIONS
from embertrail.sources.cases import read_cases
from embertrail.streaming.live import LiveTriage


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def keyword_provider(texts: pd.Series) -> pd.Series:
    def one(text):
        lowered = text.lower()
        return [0.6, 0.8, 0.0] if "valve" in lowered else [0.0, 0.0, 1.0] if "glaze" in lowered else [1.0, 0.0, 0.0]

    return texts.map(one)


def at(text):
    return dt.datetime.fromisoformat(text)


def test_deploy_bound_regression_end_to_end(spark, tmp_path):
    root = str(tmp_path / "store")
    line = '{"time":"2025-07-02T%s:30Z","app":"kiln","severity":"WARN","msg":"valve 3 stuck half open"}'
    (tmp_path / "logs.jsonl").write_text("\n".join(line % t for t in ("16:41", "17:05", "17:11", "17:24")))
    (tmp_path / "deploys.jsonl").write_text(
        '{"time":"2025-07-02T17:00:00Z","app":"kiln","release":"r7","env":"floor","id":"kiln-r7","sha":"c0ffee1","ref":"trunk",'
        '"files":["kiln/valves.py"]}'
    )
    ingest_logs(spark, root, str(tmp_path / "logs.jsonl"))
    ingest_deploys(spark, root, str(tmp_path / "deploys.jsonl"))
    logs = read_table(spark, root, "logs")
    merge_table(spark, root, "embeddings", embed_logs(logs, read_table(spark, root, "embeddings"), keyword_provider), [F.col("log_id")])
    assert embed_logs(logs, read_table(spark, root, "embeddings"), keyword_provider).count() == 0
    run = cluster_logs(logs, read_table(spark, root, "embeddings"), 1, eps=0.1, min_samples=2)
    found = detect_regressions(read_table(spark, root, "deploys"), logs, run.assignments, run.snapshots, 30, 30)
    row = list_regressions(found).first()
    assert (row["regression_type"], row["before_count"], row["after_count"], row["delta"], row["percent_change"], row["severity"]) == (
        "frequency_spike_after_deploy", 1, 3, 2, 200.0, "medium")
    assert row["confidence"] == pytest.approx(0.69)
    assert row["reason"] == (
        "Error cluster frequency spiked in kiln after deploy kiln-r7 commit c0ffee1; before=1, after=3, change=200.0%. Changed files: kiln/valves.py.")
    members = logs.join(run.assignments.select("log_id", "cluster_id"), "log_id")
    done = promote_regressions(found, spark.createDataFrame([], INCIDENTS), spark.createDataFrame([], EVIDENCE), members)
    incident, evidence = incident_detail(done.incidents, done.evidence, 1)
    assert "kiln-r7" in incident.first()["summary"]
    kinds = [r["evidence_type"] for r in evidence.collect()]
    assert kinds == ["regression", "deploy_correlation", "changed_files", "representative_log"]
    explained = explain_incidents(done.incidents, done.evidence, members, read_table(spark, root, "run_sessions"))
    hypothesis = explained.first()["root_cause_hypothesis"]
    assert hypothesis.startswith("Likely deploy-introduced regression: frequency_spike_after_deploy: deploy=kiln-r7")
    paragraph = "".join(r["text"] for r in incident_paragraph_lines(explained, done.evidence).orderBy("incident_id", "section", "line_no").collect())
    assert paragraph.startswith("Incident 1 is open with medium severity. ") and "Correlated deploys: deploy=kiln-r7" in paragraph
    write_incident_reports(incident_report_lines(explained, done.evidence), str(tmp_path / "reports"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "reports" / "incident_id=1").glob("part-*")))
    assert text.startswith("# Incident Report\n\n## Incident\n\n- Incident ID: 1\n") and "## Changed Files\n\n- kiln/valves.py" in text


def test_window_edges_and_new_clusters(spark):
    logs = [("a", "2026-01-01 09:00:00", "s", 0), ("b", "2026-01-01 10:00:00", "s", 0), ("c", "2026-01-01 11:00:00", "s", 0),
            ("d", "2026-01-01 08:59:59", "s", 0), ("e", "2026-01-01 11:00:01", "s", 0), ("f", "2025-01-01 00:00:00", "other", 1),
            ("g", "2026-01-01 10:30:00", "s", 1), ("h", "2026-01-01 10:40:00", "s", 2), ("i", None, "s", 2), ("j", "2026-01-01 10:40:00", "s", -1)]
    df = spark.createDataFrame([(i, at(t) if t else None, s, c) for i, t, s, c in logs], "log_id string, ts timestamp, service string, cluster_id long")
    deploys = spark.createDataFrame([("d1", "s", at("2026-01-01 10:00:00"), None, None, [])],
                                    "deploy_id string, service string, deployed_at timestamp, commit_sha string, branch string, changed_files array<string>")
    counts = {r["cluster_id"]: (r["before_count"], r["after_count"]) for r in window_counts(deploys, df, 60, 60).collect()}
    assert counts == {0: (1, 2), 1: (0, 1), 2: (0, 1)}
    clusters = spark.createDataFrame([(0, "k0", "m"), (1, "k1", "m"), (2, "k2", "m")], "cluster_id long, cluster_key string, example_message string")
    found = {r["cluster_key"]: (r["regression_type"], r["severity"]) for r in detect_regressions(deploys, df.drop("cluster_id"), df, clusters).collect()}
    assert found == {"k1": ("reappearing_cluster", "medium"), "k2": ("new_cluster_after_deploy", "high")}


def lines(spark, numbers, text):
    rows = [("stdin", n, text, at("2026-01-01 00:00:00")) for n in numbers]
    return spark.createDataFrame(rows, "source string, line_no long, line string, arrived_at timestamp")


def test_live_iterations_open_and_reopen_an_incident(spark, tmp_path):
    root = str(tmp_path)
    seen = []
    live = LiveTriage(root=root, eps=0.1, min_samples=2, provider=keyword_provider, on_anomalies=seen.append)
    text = "[kiln] valve 3 stuck half open"
    first = live.process_lines(lines(spark, (1, 2), text), 1)
    assert (first.ingested_logs, first.embedded_logs, first.anomaly_count) == (2, 2, 0)
    assert live.process_lines(lines(spark, (1,), "   "), 9).run_id is None
    assert live.process_lines(lines(spark, (3, 4), text), 2).anomaly_count == 1
    incident = read_table(spark, root, "incidents").first()
    assert (incident["incident_id"], incident["status"], incident["title"]) == (1, "open", "growth_spike in cluster 0")
    assert incident["confidence"] == pytest.approx(0.61) and incident["current_size"] == 4
    change = spark.createDataFrame([(1, "acknowledged", 1), (1, "resolved", 2)], "incident_id long, status string, at int")
    merge_table(spark, root, "incidents", apply_status_changes(read_table(spark, root, "incidents"), change), [F.col("incident_id")])
    live.process_lines(lines(spark, (5, 6), text), 3)
    again = seen[-1].first()
    assert (again["anomaly_type"], again["previous_size"], again["current_size"], again["z_score"]) == ("rare_spike", 4, 6, 3.0)
    incident = list_incidents(read_table(spark, root, "incidents")).first()
    assert (incident["status"], incident["severity"]) == ("regressed", "high") and incident["confidence"] == pytest.approx(0.71)
    evidence = read_table(spark, root, "evidence").collect()
    assert "status_change" in {r["evidence_type"] for r in evidence}
    before = sorted(map(str, evidence))
    live.process_lines(lines(spark, (5, 6), text), 3)
    assert sorted(map(str, read_table(spark, root, "evidence").collect())) == before
    assert read_table(spark, root, "logs").count() == 6


def test_stream_of_rolled_files(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "store"
    folder.mkdir()
    results = []
    live = LiveTriage(root=str(root), eps=0.1, min_samples=2, provider=keyword_provider, alert_path=str(tmp_path / "alerts"), on_batch=results.append)
    for number in range(2):
        (folder / f"part-{number}.log").write_text("[kiln] valve 3 stuck\n\n[kiln] valve 4 stuck\n[dryer] glaze too thin\n")
        live.start(spark, str(folder), str(tmp_path / "checkpoint"), every=None).awaitTermination()
    assert [(r.run_id, r.ingested_logs, r.anomaly_count) for r in results] == [(1, 3, 0), (2, 3, 2)]
    alerts = spark.read.json(str(tmp_path / "alerts"))
    assert sorted((r["anomaly_type"], r["delta"]) for r in alerts.collect()) == [("growth_spike", 2), ("novel_cluster", 2)]
    append_alerts(alerts, str(tmp_path / "plain"))
    assert spark.read.json(str(tmp_path / "plain")).count() == 2


def history(spark, rows):
    full = [(run, cid, key, size, None, None, f"m{cid}", ["s"], vector) for run, cid, key, size, vector in rows]
    return spark.createDataFrame(full, CLUSTER_HISTORY)


def runs(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "run_id long")


def test_anomaly_rules(spark):
    one = history(spark, [(1, 0, "a", 3, [1.0])])
    assert detect_anomalies(one, runs(spark, 1)).count() == 0
    skipped = history(spark, [(1, 0, "a", 3, [1.0]), (3, 0, "a", 9, [1.0])])
    assert [r["anomaly_type"] for r in detect_anomalies(skipped, runs(spark, 1, 2, 3)).collect()] == ["novel_cluster"]
    assert [r["anomaly_type"] for r in detect_anomalies_by_run(skipped, runs(spark, 1, 2, 3)).collect()] == ["novel_cluster"]
    twice = history(spark, [(1, 0, "a", 9, [1.0]), (1, 1, "a", 2, [1.0]), (2, 0, "a", 5, [1.0]), (2, 1, "b", 4, [0.0, 1.0])])
    rows = {r["cluster_key"]: r for r in detect_anomalies(twice, runs(spark, 1, 2)).collect()}
    assert (rows["a"]["previous_size"], rows["a"]["delta"], rows["b"]["anomaly_type"]) == (2, 3, "novel_cluster")
    drift = history(spark, [(1, 0, "a", 4, [1.0, 0.0]), (2, 0, "b", 7, [1.0, 0.01])])
    assert [r["anomaly_type"] for r in detect_anomalies(drift, runs(spark, 1, 2)).collect()] == ["novel_cluster"]
    row = detect_anomalies(drift, runs(spark, 1, 2), match_threshold=0.8).first()
    assert (row["anomaly_type"], row["previous_size"], row["delta"], row["z_score"]) == ("growth_spike", 4, 3, 0.0)


def test_promotions_of_one_key_fold_in_order(spark):
    promotions = spark.createDataFrame([
        (1, "a", 0, "high", "first", "s1", None, None, 5, 0.9), (2, "a", 1, "medium", "last", "s2", at("2026-01-02 00:00:00"), None, 3, 0.6),
        (3, "b", 2, "high", "b", "s", at("2026-01-03 00:00:00"), None, 1, 0.7), (4, "c", 2, "high", "c", "s", at("2026-01-04 00:00:00"), None, 1, 0.7),
    ], "seq long, cluster_key string, cluster_id long, severity string, title string, summary string, first_seen timestamp, last_seen timestamp, current_size long, confidence double")
    current = spark.createDataFrame([(7, "b", 0, "resolved", "low", "t", "s", None, None, 1, 0.1), (8, "z", 0, "acknowledged", "low", "t", "s", None, None, 1, 0.1)], INCIDENTS)
    rows = {r["cluster_key"]: r for r in fold_incidents(current, promotions).collect()}
    assert {k: (r["incident_id"], r["status"]) for k, r in rows.items()} == {"a": (9, "open"), "b": (7, "regressed"), "c": (10, "open"), "z": (8, "acknowledged")}
    assert (rows["a"]["title"], rows["a"]["first_seen"], rows["a"]["severity"]) == ("last", at("2026-01-02 00:00:00"), "medium")


def log_rows(spark, rows):
    return spark.createDataFrame([(i, at(t) if t else None, s, lv, m, c, n) for i, t, s, lv, m, c, n in rows],
                                 "log_id string, ts timestamp, service string, level string, message string, cluster_id long, session_id long")


def test_snapshots_levels_and_representatives(spark):
    rows = log_rows(spark, [
        ("1", None, "api", "ERROR", "late 5", 0, 1), ("2", "2026-01-02 00:00:00", "", "WARN", "b 12", 0, 1), ("3", "2026-01-01 00:00:00", " Web", "ERROR", "a 1", 0, 2),
        ("4", "2026-01-03 00:00:00", "api", "WARN", "a 1", 0, None), ("5", None, None, None, "lonely", 1, None), ("6", None, "x", "INFO", "noise", -1, None),
    ])
    snaps = {r["cluster_id"]: r for r in cluster_snapshots(rows).collect()}
    assert set(snaps) == {0, 1} and snaps[0]["log_count"] == 4 and snaps[0]["example_message"] == "a 1" and snaps[0]["services"] == [" Web", "api"]
    assert (snaps[0]["first_seen"], snaps[0]["last_seen"], snaps[1]["first_seen"]) == (at("2026-01-01 00:00:00"), at("2026-01-03 00:00:00"), None)
    other = cluster_snapshots(rows.withColumn("message", F.regexp_replace("message", r"\d+", "77"))).filter("cluster_id = 0").first()
    assert other["cluster_key"] == snaps[0]["cluster_key"] and len(other["cluster_key"]) == 16
    assert {r["cluster_id"]: r["level"] for r in dominant_levels(rows).collect()}[0] == "ERROR"
    oldest = [r["message"] for r in oldest_messages(rows, 2).filter("cluster_id = 0").orderBy("rank").collect()]
    newest = [r["message"] for r in newest_messages(rows, 2).filter("cluster_id = 0").orderBy("rank").collect()]
    assert (oldest, newest) == (["a 1", "b 12"], ["a 1", "b 12"])
    keyed = signature_clusters(rows).collect()
    assert len({r["cluster_key"] for r in keyed}) == 6


def test_deploys_near_clusters_match_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    base = at("2026-01-01 00:00:00")
    deploys = [(f"d{i:03d}", "hot" if i % 3 else f"s{i % 4}", base + dt.timedelta(minutes=int(rng.integers(0, 3000)))) for i in range(200)]
    clusters = []
    for i in range(40):
        first = base + dt.timedelta(minutes=int(rng.integers(0, 3000)))
        clusters.append((i, ["hot", f"s{i % 4}"][: 1 + i % 2], first, first + dt.timedelta(minutes=int(rng.integers(0, 200)))))
    extra = [(*d, "v1", None, "", None, ["f.py"], None) for d in deploys]
    deploy_df = spark.createDataFrame(extra, "deploy_id string, service string, deployed_at timestamp, version string, environment string, commit_sha string, branch string, changed_files array<string>, repo_url string")
    cluster_df = spark.createDataFrame(clusters, "cluster_id long, services array<string>, first_seen timestamp, last_seen timestamp")
    got = {}
    for r in correlate_deploys(cluster_df, deploy_df, 90, 5).collect():
        got.setdefault(r["cluster_id"], {})[r["rank"]] = r["deploy_id"]
        assert r["details"].endswith(f"(event {r['deploy_id']} changed_files=f.py)") and " to unknown env at 2026-" in r["details"]
    window = dt.timedelta(minutes=90)
    for cid, services, first, last in clusters:
        want = sorted((t, d) for d, s, t in deploys if s in services and first - window <= t <= last + window)[:5]
        assert [got.get(cid, {}).get(i + 1) for i in range(5)] == [d for _, d in want] + [None] * (5 - len(want))


def test_ci_patterns_from_a_file(spark, tmp_path):
    record = '{"workflow":"night shift","test_name":"glaze_depth","status":"%s","message":"depth out of range","sha":"%s","created_at":"2025-07-03T02:%s:00Z"}'
    (tmp_path / "ci.jsonl").write_text("\n".join([record % ("failed", "aa10", "05"), record % ("passed", "aa11", "25"), record % ("failed", "aa12", "45")]))
    stored, patterns = ingest_ci(spark, str(tmp_path / "store"), str(tmp_path / "ci.jsonl"), F.lit("2026-04-01 00:00:00").cast("timestamp"))
    assert stored.rows.count() == 3 and read_table(spark, str(tmp_path / "store"), "logs").count() == 3
    row = patterns.first()
    assert (row["pattern"], row["failed_runs"], row["total_runs"], row["flaky"], row["commit_sha"]) == ("glaze_depth", 2, 3, True, "aa10")
    assert row["reason"] == "Test glaze_depth failed in 2/3 recent CI runs and appears flaky."
    flipped = ci_patterns(stored.rows.orderBy(F.desc("ts"))).first()
    assert flipped == row


def test_evaluation_fallbacks(spark, tmp_path):
    cases = [
        {"root_cause": "Pool", "trigger": "d1", "report": "pool exhausted after d1", "logs": ["a", "b"], "root_cause_candidates": ["x", "y", "z", "pool"], "baseline_triage_steps": 8, "assisted_triage_steps": 2},
        {"root_cause": "disk", "trigger": "d2", "predicted_root_cause": "DISK full", "predictions": ["Disk"], "predicted_trigger": "D2", "logs": ["the disk died", "b", "c"]},
        {"report": "anything"},
    ]
    (tmp_path / "cases.json").write_text(json.dumps({"cases": cases}))
    row = evaluate(case_columns(read_cases(spark, str(tmp_path / "cases.json")))).first()
    third = pytest.approx(1 / 3)
    assert (row["incident_count"], row["root_cause_top1"], row["root_cause_top3"], row["trigger_attribution"]) == (3, pytest.approx(2 / 3), third, pytest.approx(2 / 3))
    assert row["baseline_keyword_accuracy"] == third and row["triage_reduction"] == pytest.approx((12 - 4) / 12)
    (tmp_path / "none.json").write_text("[]")
    assert evaluate(case_columns(read_cases(spark, str(tmp_path / "none.json")))).first()["root_cause_top1"] == 0.0


def test_summaries_reports_and_generators(spark):
    rows = log_rows(spark, [(str(i), f"2026-01-0{i} 00:00:00", "api", "ERROR", f"boom {i}", 0, None) for i in range(1, 8)])
    clusters = cluster_snapshots(rows)
    none = spark.createDataFrame([], "deploy_id string, service string, deployed_at timestamp, version string, environment string, commit_sha string, branch string, changed_files array<string>, repo_url string")
    summary = summarize_clusters(clusters, rows, none).first()
    assert summary["description"] == "Cluster 0 groups repeated error log events with the pattern 'boom 1'." and summary["confidence"] == pytest.approx(0.95)
    assert summary["timeline"] == ["First seen: 2026-01-01 00:00:00", "Last seen: 2026-01-07 00:00:00", "Observed 7 related logs in the latest clustering run."]
    assert summary["representative_logs"] == [f"boom {i}" for i in range(1, 6)]
    report = cluster_reports(summarize_clusters(clusters, rows, none)).first()["markdown"]
    assert "- Confidence: 0.95\n" in report and report.endswith("- No correlated deploy events found in the configured time window.\n")

    def provider(prompts):
        assert all("message=boom 7" in p and "- Log Count: 7" in p for p in prompts)
        return prompts.map(lambda _: "Description: d\nTimeline:\n- one\n- two\nConfidence: 85%")

    made = summarize_with(provider, clusters, rows, none).first()
    assert (made["description"], made["timeline"], made["affected_services"], made["confidence"]) == ("d", ["one", "two"], ["api"], 0.85)
    texts = spark.createDataFrame([("85%", 0.85), ("0.4", 0.4), ("high", 0.7), ("", 0.7), ("-3", 0.0), ("300", 1.0)], "t string, want double")
    assert all(r["got"] == pytest.approx(r["want"]) for r in texts.select("want", parse_confidence(F.col("t")).alias("got")).collect())


def test_timeline_and_sessions(spark):
    rows = log_rows(spark, [("1", "2026-01-01 00:00:00", "s", "E", "m", 0, 1), ("2", "2026-01-01 00:00:00", "s", "E", "m", 0, 1), ("3", None, "s", "E", "m", 0, 1)])
    regressions = spark.createDataFrame([(4, 0, "new_cluster_after_deploy", "d", at("2025-12-31 00:00:00"), "why")], "regression_id long, cluster_id long, regression_type string, deploy_id string, deployed_at timestamp, reason string")
    incidents = spark.createDataFrame([(1, "k", 0, "open", "high", "t", "s", at("2026-01-02 00:00:00"), None, 1, 0.5)], INCIDENTS)
    events = [(r["event_type"], r["title"], r["details"]) for r in cluster_timeline(rows, regressions, incidents).orderBy(*timeline_order()).collect()]
    assert events == [
        ("regression", "new_cluster_after_deploy after d", "Regression 4: why"), ("logs", "2 log(s)", "Cluster 0 observed 2 log(s)."),
        ("incident", "Incident 1 open", "high incident for cluster 0; last_seen=-"), ("logs", "1 log(s)", "Cluster 0 observed 1 log(s)."),
    ]
    started, ended = at("2026-01-01 00:00:00"), at("2026-01-01 01:00:00")
    layout = "session_id long, kind string, at timestamp, command string, exit_code int, git_sha string, branch string, changed_files array<string>"
    folded = fold_sessions(spark.createDataFrame([
        (1, "start", started, "make", None, "abc", "main", ["f"]), (1, "end", ended, None, 2, None, None, None), (2, "start", started, "run", None, None, None, None)], layout))
    got = {r["session_id"]: (r["command"], r["exit_code"], r["ended_at"], r["changed_files"]) for r in folded.collect()}
    assert got == {1: ("make", 2, ended, ["f"]), 2: ("run", None, None, [])}
    assert [f.name for f in RUN_SESSIONS.fields] == folded.columns
    assert of_latest_run(runs(spark, 1, 2).withColumn("x", F.lit(1)), runs(spark, 1, 2)).count() == 1


def test_snapshots_of_a_run_scan_what_it_kept_not_the_logs_again(spark, tmp_path):
    from embertrail.plans.clusters import cluster_logs

    rows = [(f"l{i}", f"2024-01-01 00:00:0{i}", "api", "red" if i < 3 else "blue", [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(6)]
    given = spark.createDataFrame(rows, "log_id string, ts string, service string, message string, vector array<double>")
    given.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "logs"))
    logs = spark.read.parquet(str(tmp_path / "logs"))
    run = cluster_logs(logs, logs.select("log_id", "vector"), run_id=1, min_samples=2)
    assert not any(str(tmp_path) in file for file in run.snapshots.inputFiles())
    assert sorted((r["example_message"], r["log_count"]) for r in run.snapshots.collect()) == [("blue", 3), ("red", 3)]
