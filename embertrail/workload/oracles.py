"""The queries' meaning as SQL over the given tables, written independently of the Spark plans."""

from __future__ import annotations

from embertrail.workload.oracles_records import SQL as RECORD_SQL
from embertrail.workload.views import (
    BASE, CLUSTERED, CLUSTERS, DEPLOYS, HISTORY, SESSIONS, SIGNATURES, sql_instant as inst, with_tables,
)

WINDOW = 720
PLACE = "strftime({t}ts, '%Y-%m-%d %H:%M:%S.%f') || {t}log_id"


def text_of(column: str) -> str:
    """A timestamp with its fraction only when there is one."""
    return f"(strftime({column}, '%Y-%m-%d %H:%M:%S') || CASE WHEN strftime({column}, '%f') = '000000' THEN '' ELSE '.' || strftime({column}, '%f') END)"


COUNTS = f"""counts AS (
  SELECT d.deploy_id, m.cluster_id, count(*) FILTER (WHERE m.ts < d.deployed_at) AS before_count,
         count(*) FILTER (WHERE m.ts >= d.deployed_at) AS after_count, min(m.ts) FILTER (WHERE m.ts >= d.deployed_at) AS first_seen_after
  FROM deploys d JOIN members m ON m.service = d.service
   AND m.ts BETWEEN d.deployed_at - INTERVAL {WINDOW} MINUTE AND d.deployed_at + INTERVAL {WINDOW} MINUTE
  GROUP BY 1, 2),
seen AS (SELECT cluster_id, min(ts) AS first_seen FROM members GROUP BY 1)"""

REGRESSIONS = f"""measured AS (
  SELECT c.*, d.service, d.deployed_at, d.commit_sha, d.branch, d.changed_files, s.first_seen, k.cluster_key, k.example_message,
         after_count - before_count AS delta,
         CASE WHEN before_count > 0 THEN CAST(after_count - before_count AS DOUBLE) / before_count * 100 END AS percent_change
  FROM counts c JOIN deploys d USING (deploy_id) JOIN seen s USING (cluster_id) JOIN clusters k USING (cluster_id)
  WHERE after_count > 0),
typed AS (
  SELECT *, CASE WHEN before_count = 0 AND first_seen < deployed_at - INTERVAL {WINDOW} MINUTE THEN 'reappearing_cluster'
                 WHEN before_count = 0 THEN 'new_cluster_after_deploy'
                 WHEN delta >= 2 AND percent_change >= 200 THEN 'frequency_spike_after_deploy' END AS regression_type
  FROM measured),
graded AS (
  SELECT *, CASE WHEN regression_type = 'new_cluster_after_deploy' THEN 'high'
                 WHEN regression_type = 'frequency_spike_after_deploy' AND percent_change >= 300 THEN 'high' ELSE 'medium' END AS severity,
         coalesce(printf('%.1f%%', percent_change), 'new') AS percent_text
  FROM typed WHERE regression_type IS NOT NULL),
regressions AS (
  SELECT *, CAST(least(0.98, 0.55 + least(greatest(delta, 0), 10) * 0.03 + CASE WHEN before_count = 0 THEN 0.12 ELSE 0 END
                + CASE WHEN len(changed_files) > 0 THEN 0.08 ELSE 0 END + CASE WHEN severity = 'high' THEN 0.07 ELSE 0 END) AS DOUBLE) AS confidence,
         CASE regression_type WHEN 'new_cluster_after_deploy' THEN 'New error cluster appeared in '
              WHEN 'frequency_spike_after_deploy' THEN 'Error cluster frequency spiked in ' ELSE 'Previously seen error cluster reappeared in ' END
         || service || ' after deploy ' || deploy_id || coalesce(' commit ' || commit_sha, '') || '; before=' || before_count || ', after=' || after_count
         || CASE WHEN regression_type = 'frequency_spike_after_deploy' THEN ', change=' || percent_text ELSE '' END || '.'
         || CASE WHEN len(changed_files) > 0 THEN ' Changed files: ' || array_to_string(changed_files[1:8], ', ') || '.' ELSE '' END AS reason,
         row_number() OVER (ORDER BY severity = 'high' DESC, delta DESC, after_count DESC, deployed_at, deploy_id, cluster_id) AS seq
  FROM graded)"""
REGRESSION_TABLES = (CLUSTERED, DEPLOYS, CLUSTERS, COUNTS, REGRESSIONS)

REGRESSION_INCIDENTS = """incidents AS (
  SELECT row_number() OVER (ORDER BY min(seq)) AS incident_id, cluster_key, arg_max(cluster_id, seq) AS cluster_id, 'open' AS status,
         arg_max(severity, seq) AS severity, arg_max(regression_type || ' after deploy ' || deploy_id, seq) AS title, arg_max(reason, seq) AS summary,
         arg_min(first_seen_after, seq) AS first_seen, arg_max(first_seen_after, seq) AS last_seen, arg_max(after_count, seq) AS current_size,
         arg_max(confidence, seq) AS confidence
  FROM regressions GROUP BY cluster_key)"""


def messages(direction: str, k: int, name: str) -> str:
    ends = "min(ts)" if direction == "oldest" else "max(ts)"
    order = "end_ts" if direction == "oldest" else "end_ts DESC"
    return f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {order}, message) AS rank
                 FROM (SELECT cluster_id, message, {ends} AS end_ts FROM members GROUP BY 1, 2)) WHERE rank <= {k})"""


DEPLOY_LINE = (
    "'deploy=' || deploy_id || ' service=' || service || ' deployed_at=' || " + text_of("deployed_at")
    + " || ' commit=' || coalesce(commit_sha, 'unknown') || ' branch=' || coalesce(branch, 'unknown')"
)
REGRESSION_LINE = (
    "regression_type || ': deploy=' || deploy_id || ', service=' || service || ', before=' || before_count || ', after=' || after_count"
    " || ', delta=' || delta || ', percent_change=' || percent_text"
)
REGRESSION_EVIDENCE = f"""evidence AS (
  SELECT incident_id, evidence_type, details, min((seq * 10 + kind) * 10 + item) AS place FROM (
    SELECT r.cluster_key, seq, 'regression' AS evidence_type, 1 AS kind, 0 AS item, {REGRESSION_LINE} AS details FROM regressions r
    UNION ALL SELECT cluster_key, seq, 'deploy_correlation', 2, 0, {DEPLOY_LINE} FROM regressions
    UNION ALL SELECT cluster_key, seq, 'changed_files', 3, 0, array_to_string(changed_files[1:12], ', ') FROM regressions WHERE len(changed_files) > 0
    UNION ALL SELECT cluster_key, seq, 'representative_log', 4, rank, message
              FROM (SELECT cluster_id, cluster_key, min(seq) AS seq FROM regressions GROUP BY 1, 2) JOIN oldest USING (cluster_id)
  ) JOIN (SELECT incident_id, cluster_key FROM incidents) USING (cluster_key) GROUP BY 1, 2, 3)"""
REGRESSION_PROMOTION = (*REGRESSION_TABLES, REGRESSION_INCIDENTS, messages("oldest", 3, "oldest"), REGRESSION_EVIDENCE)

STEPS = """run_list AS (SELECT DISTINCT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS run_id FROM logs),
steps AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS previous_run_id FROM run_list),
baselines AS (
  SELECT cluster_key, run_id, count(*) OVER upto AS history_points, avg(log_count) OVER before AS baseline_mean,
         coalesce(stddev_pop(log_count) OVER before, 0) AS baseline_sigma
  FROM history
  WINDOW upto AS (PARTITION BY cluster_key ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         before AS (PARTITION BY cluster_key ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
ANOMALIES = """compared AS (
  SELECT h.*, p.log_count IS NULL AS novel, coalesce(p.log_count, 0) AS previous_size, h.log_count - coalesce(p.log_count, 0) AS delta,
         CASE WHEN p.log_count IS NULL OR baseline_sigma < 1e-12 OR history_points < 2 THEN 0 ELSE (h.log_count - baseline_mean) / baseline_sigma END AS z_score
  FROM history h JOIN steps USING (run_id) JOIN baselines USING (cluster_key, run_id)
  LEFT JOIN history p ON p.run_id = steps.previous_run_id AND p.cluster_key = h.cluster_key
  WHERE steps.previous_run_id IS NOT NULL),
anomalies AS (
  SELECT run_id, CASE WHEN novel THEN 'novel_cluster' WHEN z_score >= 2 THEN 'rare_spike' ELSE 'growth_spike' END AS anomaly_type, cluster_key,
         cluster_id, log_count AS current_size, previous_size, delta, z_score, CASE WHEN novel OR z_score >= 2 THEN 'high' ELSE 'medium' END AS severity,
         CASE WHEN novel THEN 'Cluster appears in the latest run but was absent in the previous snapshot.'
              WHEN z_score >= 2 THEN 'Cluster size is ' || printf('%.2f', z_score) || ' standard deviations above its historical baseline.'
              ELSE 'Cluster grew by ' || delta || ' logs between the last two clustering runs.' END AS reason,
         example_message, first_seen, last_seen, service
  FROM compared WHERE novel OR delta >= 2)"""
ANOMALY_TABLES = (CLUSTERED, HISTORY, STEPS, ANOMALIES)
ANOMALY_COLUMNS = (
    "run_id, anomaly_type, cluster_key, cluster_id, current_size, previous_size, delta, round(z_score, 6) AS z_score, severity, reason, example_message"
)


def near(clusters: str, name: str) -> str:
    """The five first deploys within 90 minutes of each cluster's lifetime; the cluster table has one service per row."""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT c.cluster_id, d.*, row_number() OVER (PARTITION BY c.cluster_id ORDER BY d.deployed_at, d.deploy_id) AS rank,
           d.service || ' deployed ' || coalesce(version, 'unknown version') || ' to ' || coalesce(environment, 'unknown env') || ' at '
           || {text_of('deployed_at')} || ' (event ' || deploy_id || coalesce(' commit=' || commit_sha, '') || coalesce(' branch=' || branch, '')
           || CASE WHEN len(changed_files) > 0 THEN ' changed_files=' || array_to_string(changed_files[1:5], ', ') ELSE '' END || ')' AS details
    FROM {clusters} c JOIN deploys d ON d.service = c.service
     AND d.deployed_at BETWEEN c.first_seen - INTERVAL 90 MINUTE AND c.last_seen + INTERVAL 90 MINUTE) WHERE rank <= 5)"""


LAST_ANOMALIES = """found AS (
  SELECT *, row_number() OVER (ORDER BY severity = 'high' DESC, delta DESC, current_size DESC, cluster_id) AS seq
  FROM anomalies WHERE run_id = (SELECT max(run_id) FROM run_list)),
found_incidents AS (
  SELECT seq AS incident_id, cluster_key, cluster_id, 'open' AS status, severity, anomaly_type || ' in cluster ' || cluster_id AS title,
         rtrim(reason, '.') || ' affecting ' || service || '.' AS summary, first_seen, last_seen, current_size,
         CAST(least(0.95, 0.55 + CASE WHEN severity = 'high' THEN 0.1 ELSE 0 END + least(delta, 5) * 0.03) AS DOUBLE) AS confidence
  FROM found)"""
CLUSTER_SESSIONS = """seen_sessions AS (
  SELECT * FROM (
    SELECT cluster_id, session_id, command, git_sha, exit_code, row_number() OVER (PARTITION BY cluster_id ORDER BY session_id DESC) AS rank,
           'session=' || session_id || ' command=' || command || ' git_sha=' || coalesce(git_sha, 'unknown') || ' exit_code='
           || coalesce(CAST(exit_code AS VARCHAR), 'running') AS line
    FROM (SELECT DISTINCT cluster_id, session_id FROM members) JOIN sessions USING (session_id)) WHERE rank <= 5)"""
ANOMALY_PROMOTION = (*ANOMALY_TABLES, DEPLOYS, SESSIONS, LAST_ANOMALIES, messages("oldest", 3, "oldest"), CLUSTER_SESSIONS, near("found", "near"))
INCIDENT_COLUMNS = (
    f"incident_id, cluster_key, cluster_id, status, severity, title, summary, {inst('first_seen')} AS first_seen, {inst('last_seen')} AS last_seen, "
    "current_size, round(confidence, 6) AS confidence"
)

EXPLAINED = f"""firsts AS (
  SELECT incident_id, arg_min(details, place) FILTER (WHERE evidence_type = 'regression') AS regression,
         arg_min(details, place) FILTER (WHERE evidence_type = 'deploy_correlation') AS deploy,
         arg_min(details, place) FILTER (WHERE evidence_type = 'changed_files') AS files
  FROM evidence GROUP BY 1),
newest_lists AS (SELECT cluster_id, string_agg(message, chr(10) ORDER BY rank) AS representative_logs, arg_min(message, rank) AS hint FROM newest GROUP BY 1),
session_lists AS (
  SELECT cluster_id, string_agg(line, chr(10) ORDER BY rank) AS related_sessions, string_agg(line, '; ' ORDER BY rank) FILTER (WHERE rank <= 2) AS two
  FROM seen_sessions GROUP BY 1),
explained AS (
  SELECT i.*, representative_logs, coalesce(related_sessions, '') AS related_sessions, two,
         CASE WHEN files IS NOT NULL THEN 'Likely deploy-introduced regression: ' || regression || '. The correlated deploy is ' || deploy
                   || '; changed files include ' || files || '. Representative evidence: ' || hint
              ELSE 'Likely deploy-correlated regression: ' || regression || '. The strongest deploy evidence is ' || deploy
                   || '. Representative evidence: ' || hint END AS root_cause_hypothesis
  FROM incidents i JOIN firsts USING (incident_id) JOIN newest_lists USING (cluster_id) LEFT JOIN session_lists USING (cluster_id))"""
EXPLANATION = (*REGRESSION_PROMOTION, SESSIONS, messages("newest", 5, "newest"), CLUSTER_SESSIONS, EXPLAINED)


def _section(number: int, *lines: str) -> str:
    return " UNION ALL ".join(f"SELECT incident_id, {number} AS section, {line} AS text FROM explained" for line in lines)


def _evidence_section(number: int, kind: str, missing: str, ends: bool) -> str:
    parts = [
        _section(number, f"'## {kind}'", "''"),
        f"""SELECT incident_id, {number}, '- ' || details FROM evidence WHERE evidence_type = '{kind.lower().replace(' ', '_')}'""",
        f"""SELECT incident_id, {number}, '- {missing}' FROM explained WHERE incident_id NOT IN
            (SELECT incident_id FROM evidence WHERE evidence_type = '{kind.lower().replace(' ', '_')}')""",
    ]
    return " UNION ALL ".join(parts + ([_section(number, "''")] if ends else []))


REPORT = " UNION ALL ".join([
    _section(0, "'# Incident Report'", "''"),
    _section(
        1, "'## Incident'", "''", "'- Incident ID: ' || incident_id", "'- Status: ' || status", "'- Severity: ' || severity",
        "'- Cluster ID: ' || cluster_id", "'- Cluster Key: `' || cluster_key || '`'", "'- Confidence: ' || printf('%.2f', confidence)",
        f"'- First Seen: ' || {text_of('first_seen')}", f"'- Last Seen: ' || {text_of('last_seen')}", "'- Current Size: ' || current_size", "''",
    ),
    _section(2, "'## Title'", "''", "title", "''"),
    _section(3, "'## Summary'", "''", "summary", "''"),
    _section(4, "'## Root Cause Hypothesis'", "''", "root_cause_hypothesis", "''"),
    _section(5, "'## Representative Logs'", "''", "''"),
    "SELECT incident_id, 5, '- `' || unnest(string_split(representative_logs, chr(10))) || '`' FROM explained",
    _section(6, "'## Related Sessions'", "''", "''"),
    "SELECT incident_id, 6, '- ' || unnest(string_split(CASE related_sessions WHEN '' THEN 'No related sessions captured.' ELSE related_sessions END, chr(10))) FROM explained",
    _evidence_section(7, "Deploy Correlation", "No correlated deploy events found.", True),
    _evidence_section(8, "Changed Files", "No changed files linked to this incident.", True),
    _section(9, "'## Evidence'", "''"),
    "SELECT incident_id, 9, '- [' || evidence_type || '] ' || details FROM evidence",
])

FIRST_LOGS = f"""first_logs AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts, log_id) AS rank FROM members),
levels AS (
  SELECT cluster_id, level FROM (
    SELECT cluster_id, level, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min({PLACE.format(t='')})) AS r
    FROM members GROUP BY 1, 2) WHERE r = 1)"""
SUMMARIES = f"""one_service AS (SELECT *, services[1] AS service FROM clusters),
{near('one_service', 'near')},
near_lists AS (SELECT cluster_id, string_agg(details, chr(10) ORDER BY rank) AS deploy_correlation FROM near GROUP BY 1),
first_lists AS (SELECT cluster_id, string_agg(message, chr(10) ORDER BY rank) AS representative_logs FROM first_logs WHERE rank <= 5 GROUP BY 1),
summaries AS (
  SELECT cluster_key, cluster_id, 'Cluster ' || cluster_id || ' groups repeated ' || lower(level) || ' log events with the pattern ''' || example_message || '''.' AS description,
         array_to_string(services, chr(10)) AS affected_services,
         'First seen: ' || {text_of('first_seen')} || chr(10) || 'Last seen: ' || {text_of('last_seen')} || chr(10) || 'Observed ' || log_count
         || ' related logs in the latest clustering run.' AS timeline,
         representative_logs, coalesce(deploy_correlation, '') AS deploy_correlation,
         'Likely a recurring issue in the affected service path. Inspect the representative logs and recent deploys around the first occurrence.' AS suspected_root_cause,
         CAST(least(0.95, 0.45 + 0.1 * least(log_count, 5)) AS DOUBLE) AS confidence
  FROM clusters JOIN levels USING (cluster_id) JOIN first_lists USING (cluster_id) LEFT JOIN near_lists USING (cluster_id))"""
SUMMARY_TABLES = (CLUSTERED, CLUSTERS, DEPLOYS, FIRST_LOGS, SUMMARIES)


def _bullets(column: str, none: str) -> str:
    return f"CASE WHEN {column} = '' THEN '- {none}' ELSE '- ' || replace({column}, chr(10), chr(10) || '- ') END"


SQL = {
    "regressions_after_deploy": with_tables(*REGRESSION_TABLES) + f"""
        SELECT regression_type, cluster_id, cluster_key, deploy_id, service, before_count, after_count, delta, round(percent_change, 6) AS percent_change,
               {inst('first_seen_after')} AS first_seen_after, severity, round(confidence, 6) AS confidence, reason, example_message FROM regressions""",
    "deploy_window_counts": with_tables(CLUSTERED, DEPLOYS, COUNTS) + f"""
        SELECT deploy_id, cluster_id, before_count, after_count, {inst('first_seen_after')} AS first_seen_after, {inst('first_seen')} AS first_seen
        FROM counts JOIN seen USING (cluster_id)""",
    "message_signatures": with_tables(BASE, SIGNATURES) + "SELECT log_id, signature FROM sigs",
    "signature_clusters": with_tables(CLUSTERED) + "SELECT log_id, cluster_id, cluster_key FROM members",
    "cluster_snapshots": with_tables(CLUSTERED, CLUSTERS) + f"""
        SELECT cluster_id, cluster_key, log_count, {inst('first_seen')} AS first_seen, {inst('last_seen')} AS last_seen, example_message,
               array_to_string(services, ',') AS services FROM clusters""",
    "node_cluster_keys": with_tables(BASE, SIGNATURES) + f"""
        , placed AS (SELECT *, CAST(regexp_extract(message, 'node n(\\d+)', 1) AS BIGINT) AS cluster_id FROM sigs),
        signature_sets AS (SELECT cluster_id, list_sort(list(DISTINCT signature))[1:5] AS signatures FROM placed GROUP BY 1)
        SELECT cluster_id, any_value(substr(sha256(array_to_string(names, ',') || '|' || array_to_string(signatures, chr(31))), 1, 16)) AS cluster_key,
               any_value(log_count) AS log_count, any_value(example_message) AS example_message, any_value(array_to_string(names, ',')) AS services
        FROM (SELECT cluster_id, list_sort(list(DISTINCT service)) AS names, count(*) AS log_count, arg_min(message, {PLACE.format(t='')}) AS example_message
              FROM placed GROUP BY 1) JOIN signature_sets USING (cluster_id) GROUP BY cluster_id""",
    "history_baselines": with_tables(CLUSTERED, HISTORY, STEPS) + """
        SELECT cluster_key, run_id, history_points, round(baseline_mean, 6) AS baseline_mean, round(baseline_sigma, 6) AS baseline_sigma FROM baselines""",
    "anomalies_by_run": with_tables(*ANOMALY_TABLES) + f"SELECT {ANOMALY_COLUMNS} FROM anomalies",
    "anomalies_latest_run": with_tables(*ANOMALY_TABLES) + f"SELECT {ANOMALY_COLUMNS} FROM anomalies WHERE run_id = (SELECT max(run_id) FROM run_list)",
    "label_centroids": """
        SELECT CAST(label AS BIGINT) AS label, position, round(avg(value), 6) AS value
        FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS position, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings) GROUP BY 1, 2""",
    "best_cluster_matches": """
        WITH parts AS (SELECT label, generate_subscripts(embedding, 1) AS position, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
        means AS (SELECT label, position, avg(value) AS value FROM parts GROUP BY 1, 2),
        centroid AS (SELECT label, list(value ORDER BY position) AS vector FROM means GROUP BY 1),
        scored AS (SELECT CAST(centroid.label AS BIGINT) AS cluster_id, vec_id AS matched_id, vec_id % 7 + 1 AS matched_size,
                          0.6 * list_cosine_similarity(vector, CAST(embedding AS DOUBLE[])) + CASE WHEN centroid.label % 3 = vec_id % 3 THEN 0.25 ELSE 0 END AS score
                   FROM centroid, embeddings)
        SELECT cluster_id, matched_id, matched_size, round(score, 6) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, matched_size DESC, matched_id) AS r FROM scored) WHERE r = 1 AND score >= 0.5""",
    "deploy_correlation": with_tables(CLUSTERED, DEPLOYS, HISTORY, "episodes AS (SELECT * REPLACE (cluster_id * 100000 + run_id AS cluster_id) FROM history)",
                                      near("episodes", "near")) + "SELECT cluster_id, rank, deploy_id, details FROM near",
    "representative_logs": with_tables(CLUSTERED, messages("oldest", 5, "oldest")) + f"SELECT cluster_id, rank, message, {inst('end_ts')} AS first_ts FROM oldest",
    "recent_unique_logs": with_tables(CLUSTERED, messages("newest", 5, "newest")) + f"SELECT cluster_id, rank, message, {inst('end_ts')} AS last_ts FROM newest",
    "sessions_for_cluster": with_tables(CLUSTERED, SESSIONS, CLUSTER_SESSIONS) + "SELECT cluster_id, session_id, command, git_sha, exit_code, rank FROM seen_sessions",
    "incidents_from_regressions": with_tables(*REGRESSION_TABLES, REGRESSION_INCIDENTS) + f"SELECT {INCIDENT_COLUMNS} FROM incidents",
    "evidence_from_regressions": with_tables(*REGRESSION_PROMOTION) + "SELECT incident_id, evidence_type, details FROM evidence",
    "incidents_from_anomalies": with_tables(*ANOMALY_TABLES, LAST_ANOMALIES) + f"SELECT {INCIDENT_COLUMNS} FROM found_incidents",
    "evidence_from_anomalies": with_tables(*ANOMALY_PROMOTION) + """
        SELECT seq AS incident_id, 'anomaly' AS evidence_type, anomaly_type || ': current=' || current_size || ', previous=' || previous_size || ', delta=' || delta
               || ', z_score=' || printf('%.2f', z_score) || ', reason=' || reason AS details FROM found
        UNION ALL SELECT seq, 'services', 'Affected services: ' || service FROM found
        UNION ALL SELECT seq, 'representative_log', message FROM found JOIN oldest USING (cluster_id)
        UNION ALL SELECT seq, 'session', line FROM found JOIN seen_sessions USING (cluster_id)
        UNION ALL SELECT seq, 'deploy_correlation', details FROM found JOIN near USING (cluster_id)""",
    "incidents_reopened": with_tables(*REGRESSION_TABLES, REGRESSION_INCIDENTS, HISTORY, STEPS, ANOMALIES, LAST_ANOMALIES) + f"""
        , before AS (SELECT *, CASE WHEN incident_id % 2 = 0 THEN 'resolved' ELSE 'acknowledged' END AS old_status FROM found_incidents)
        SELECT cluster_key, CASE WHEN b.cluster_key IS NULL THEN 'open' WHEN i.cluster_key IS NULL THEN old_status
                                 WHEN old_status = 'resolved' THEN 'regressed' ELSE old_status END AS status,
               coalesce(i.severity, b.severity) AS severity, coalesce(i.title, b.title) AS title, {inst('coalesce(b.first_seen, i.first_seen)')} AS first_seen
        FROM before b FULL JOIN incidents i USING (cluster_key)""",
    "incident_explanations": with_tables(*EXPLANATION) + "SELECT incident_id, representative_logs, related_sessions, root_cause_hypothesis FROM explained",
    "incident_reports": with_tables(*EXPLANATION) + f"SELECT incident_id, CAST(section AS BIGINT) AS section, text FROM ({REPORT})",
    "incident_summaries": with_tables(*EXPLANATION) + """
        , numbered AS (
          SELECT incident_id, details, row_number() OVER (PARTITION BY incident_id ORDER BY place) AS i, count(*) OVER (PARTITION BY incident_id) AS n
          FROM evidence WHERE evidence_type = 'deploy_correlation')
        SELECT incident_id, 0 AS section, 'Incident ' || incident_id || ' is ' || status || ' with ' || severity || ' severity. ' || summary AS text FROM explained
        UNION ALL SELECT incident_id, 1, CASE WHEN i = 1 THEN ' Correlated deploys: ' ELSE '; ' END || details || CASE WHEN i = n THEN '.' ELSE '' END
        FROM numbered WHERE incident_id IN (SELECT incident_id FROM explained)
        UNION ALL SELECT incident_id, 2, ' Recent sessions: ' || two || '.' FROM explained WHERE two IS NOT NULL
        UNION ALL SELECT incident_id, 3, ' Hypothesis: ' || root_cause_hypothesis FROM explained""",
    "cluster_timeline": with_tables(*REGRESSION_TABLES, REGRESSION_INCIDENTS) + f"""
        , ids AS (SELECT *, row_number() OVER (ORDER BY deployed_at, deploy_id, after_count DESC, cluster_id, regression_type) AS regression_id FROM regressions)
        SELECT cluster_id, 'logs' AS event_type, {inst('ts')} AS ts, count(*) || ' log(s)' AS title, 'Cluster ' || cluster_id || ' observed ' || count(*) || ' log(s).' AS details
        FROM members GROUP BY cluster_id, members.ts
        UNION ALL SELECT cluster_id, 'regression', {inst('deployed_at')}, regression_type || ' after ' || deploy_id, 'Regression ' || regression_id || ': ' || reason FROM ids
        UNION ALL SELECT cluster_id, 'incident', {inst('first_seen')}, 'Incident ' || incident_id || ' ' || status,
                  severity || ' incident for cluster ' || cluster_id || '; last_seen=' || {text_of('last_seen')} FROM incidents""",
    "newest_incident_detail": with_tables(*REGRESSION_PROMOTION) + """
        SELECT incident_id, status, evidence_type, details FROM evidence JOIN incidents USING (incident_id) WHERE incident_id = (SELECT max(incident_id) FROM incidents)""",
    "stored_regressions": with_tables(*REGRESSION_TABLES) + """
        SELECT regression_type, cluster_key, deploy_id, before_count, after_count,
               row_number() OVER (ORDER BY regression_type = 'reappearing_cluster' DESC, deployed_at, deploy_id, after_count DESC, cluster_id, regression_type) AS regression_id
        FROM regressions""",
    "cluster_summaries": with_tables(*SUMMARY_TABLES) + "SELECT * REPLACE (round(confidence, 6) AS confidence) FROM summaries",
    "cluster_reports": with_tables(*SUMMARY_TABLES) + f"""
        SELECT cluster_id, '# Incident Report' || chr(10) || chr(10) || '## Cluster' || chr(10) || chr(10) || '- Cluster ID: ' || cluster_id || chr(10)
          || '- Cluster Key: `' || cluster_key || '`' || chr(10) || '- Affected Services: ' || replace(affected_services, chr(10), ', ') || chr(10)
          || '- Confidence: ' || printf('%.2f', confidence) || chr(10) || chr(10) || '## Description' || chr(10) || chr(10) || description || chr(10) || chr(10)
          || '## Timeline' || chr(10) || chr(10) || {_bullets('timeline', 'unavailable')} || chr(10) || chr(10)
          || '## Representative Logs' || chr(10) || chr(10) || '- `' || replace(representative_logs, chr(10), '`' || chr(10) || '- `') || '`' || chr(10) || chr(10)
          || '## Suspected Root Cause' || chr(10) || chr(10) || suspected_root_cause || chr(10) || chr(10) || '## Deploy Correlation' || chr(10) || chr(10)
          || {_bullets('deploy_correlation', 'No correlated deploy events found in the configured time window.')} || chr(10) AS markdown
        FROM summaries""",
    "cluster_prompts": with_tables(CLUSTERED, CLUSTERS, FIRST_LOGS) + f"""
        , lines AS (SELECT cluster_id, string_agg('- [' || {text_of('ts')} || '] service=' || service || ' level=' || level || ' message=' || message, chr(10) ORDER BY rank) AS body
                    FROM first_logs WHERE rank <= 8 GROUP BY 1)
        SELECT cluster_id, concat_ws(chr(10), 'You are an SRE assistant analyzing a cluster of production logs.', 'Return exactly these fields on separate lines:',
          'Description:', 'Affected Services:', 'Timeline:', 'Suspected Root Cause:', 'Confidence:', '', 'Facts:', '- Cluster ID: ' || cluster_id,
          '- Log Count: ' || log_count, '- First Seen: ' || {text_of('first_seen')}, '- Last Seen: ' || {text_of('last_seen')},
          '- Services: ' || array_to_string(services, ', '), '', 'Representative logs:', body, '',
          'Be concise, operational, and avoid speculation beyond the logs.') AS prompt
        FROM clusters JOIN lines USING (cluster_id)""",
    "latest_log_per_session": with_tables(BASE) + """
        SELECT session_id, log_id, service, message FROM (
          SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, log_id DESC) AS r FROM logs) WHERE r = 1""",
    **RECORD_SQL,
}
SQL["timeline_events"] = f"""
    SELECT row_number() OVER (ORDER BY cluster_id, ts NULLS LAST, event_type, title, details) AS place, cluster_id, ts, event_type, title FROM ({SQL['cluster_timeline']})"""
