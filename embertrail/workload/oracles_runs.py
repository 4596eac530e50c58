"""SQL for the queries over whole clustering runs and ordered views."""

from __future__ import annotations

from embertrail.workload.oracles import ANOMALIES, LAST_ANOMALIES, REGRESSION_INCIDENTS, REGRESSION_TABLES, STEPS
from embertrail.workload.oracles_records import CI
from embertrail.workload.views import BASE, CLUSTERED, CLUSTERS, EVENTS, SIGNATURES, sql_instant as inst, with_tables

RUN = with_tables(BASE, """typed AS (SELECT logs.*, split_part(message, ' ', 1) AS kind FROM logs),
kinds AS (
  SELECT kind, row_number() OVER (ORDER BY min(strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || log_id)) - 1 AS cluster_id
  FROM typed WHERE kind <> 'signup' GROUP BY kind HAVING count(*) >= 2),
members AS (SELECT * FROM typed JOIN kinds USING (kind))""")

# The stream's first run sees the month's first half, the second run all of it; clusters are the kinds of message.
LIVE = with_tables(BASE, SIGNATURES, """seen AS (
  SELECT run_id, sigs.*, split_part(message, ' ', 1) AS kind FROM sigs, (SELECT unnest([1, 2]) AS run_id) WHERE run_id = 2 OR day(ts) <= 15),
placed AS (SELECT * FROM seen WHERE kind <> 'signup' QUALIFY count(*) OVER (PARTITION BY run_id, kind) >= 2),
grouped AS (
  SELECT run_id, kind, count(*) AS log_count, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(message, ts) AS example_message,
         list_sort(list(DISTINCT service)) AS names, list_sort(list(DISTINCT signature))[1:5] AS signatures FROM placed GROUP BY run_id, kind),
history AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first_seen) - 1 AS cluster_id, names[1] AS service,
         substr(sha256(array_to_string(names, ',') || '|' || array_to_string(signatures, chr(31))), 1, 16) AS cluster_key FROM grouped),
run_list AS (SELECT DISTINCT run_id FROM history)""", STEPS[STEPS.index("steps AS"):], ANOMALIES, LAST_ANOMALIES)

SQL = {
    "growing_file_logs": with_tables(BASE, """lines AS (
          SELECT service, event_type, '[' || service || '] ' || message || ' of ' || log_id AS text
          FROM logs JOIN (SELECT event_id, event_type FROM events) e ON log_id = 'log-' || lpad(CAST(e.event_id AS VARCHAR), 12, '0'))""") + """
        SELECT service, '[' || service || '] ' || event_type AS opening, count(*) AS n, count(DISTINCT text) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars
        FROM lines GROUP BY ALL""",
    "live_stream_incidents": LIVE + "SELECT cluster_key, status, severity, title, current_size FROM found_incidents",
    "message_embeddings": """
        SELECT CAST(doc_id AS VARCHAR) AS log_id, CAST(length(text) AS DOUBLE) AS v0, CASE WHEN contains(text, 'the') THEN 1.0::DOUBLE ELSE 0 END AS v1,
               CASE WHEN contains(text, ' de ') THEN 1.0::DOUBLE ELSE 0 END AS v2, CASE WHEN contains(text, '!') THEN 1.0::DOUBLE ELSE 0 END AS v3 FROM documents""",
    "clustering_run": RUN + """
        SELECT 1 AS run_id, 0.3::DOUBLE AS eps, 2 AS min_samples, (SELECT count(*) FROM logs) AS total_logs,
               (SELECT count(*) FROM logs) - (SELECT count(*) FROM members) AS noise_count""",
    "clustering_run_snapshots": RUN + f"""
        SELECT 1 AS run_id, cluster_id, count(*) AS log_count, {inst('min(ts)')} AS first_seen, {inst('max(ts)')} AS last_seen,
               arg_min(message, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || log_id) AS example_message,
               array_to_string(list_sort(list(DISTINCT service)), ',') AS services,
               CASE min(kind) WHEN 'error' THEN '1,0,0,0' WHEN 'click' THEN '0,1,0,0' WHEN 'purchase' THEN '0,0,1,0' ELSE '0,0,0,1' END AS centroid
        FROM members GROUP BY cluster_id""",
    "stored_run": RUN + """
        SELECT cluster_id, array_to_string(list_sort(list(DISTINCT service)), ',') AS affected_services, least(5, count(DISTINCT message)) AS n_logs
        FROM members GROUP BY cluster_id""",
    "cluster_list": with_tables(CLUSTERED, CLUSTERS) + "SELECT row_number() OVER (ORDER BY log_count DESC, cluster_id) AS rank, cluster_id, log_count FROM clusters",
    "incident_list": with_tables(*REGRESSION_TABLES, REGRESSION_INCIDENTS) + """
        SELECT row_number() OVER (ORDER BY last_seen DESC NULLS LAST, incident_id DESC) AS rank, incident_id, status FROM incidents""",
    "regression_list": with_tables(*REGRESSION_TABLES) + """
        SELECT row_number() OVER (ORDER BY deployed_at DESC, severity = 'high' DESC, delta DESC, deploy_id, cluster_id, regression_type) AS rank,
               deploy_id, cluster_id, regression_type FROM regressions""",
    "ci_pattern_list": with_tables(EVENTS, CI) + """
        SELECT row_number() OVER (ORDER BY failed_runs > 0 AND failed_runs < total_runs DESC, failed_runs DESC, total_runs DESC, pattern, test_name NULLS FIRST, workflow) AS rank,
               pattern, workflow, failed_runs
        FROM (SELECT lower(failure_signature) AS pattern, test_name, workflow, count(*) AS total_runs,
                     count(*) FILTER (WHERE status IN ('failed', 'failure', 'timed_out', 'cancelled')) AS failed_runs FROM ci_signed GROUP BY 1, 2, 3)""",
    "rejected_records": with_tables(EVENTS, """forms AS (
          SELECT k % 5 AS form, event_id, event_type FROM ev),
        problems AS (
          SELECT 'log' AS kind, CASE form WHEN 0 THEN 'not readable as JSON' WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'no message field' END AS problem, * FROM forms
          UNION ALL SELECT 'deploy', CASE form WHEN 0 THEN 'not readable as JSON' WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'no valid deploy time' WHEN 3 THEN 'no service field' END, * FROM forms)""") + """
        SELECT kind, problem, count(*) AS n, count(DISTINCT CASE form WHEN 0 THEN '-' WHEN 1 THEN CAST(event_id AS VARCHAR) ELSE event_type END) AS texts
        FROM problems WHERE problem IS NOT NULL GROUP BY kind, problem""",
}
