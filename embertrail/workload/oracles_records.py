"""SQL for the queries over records, vectors, CI runs and evaluation, stated on the tables they were built from."""

from __future__ import annotations

from embertrail.workload.views import BASE, DEPLOYS, EVENTS, sql_instant as inst, with_tables

EV = with_tables(EVENTS)

CI = """ci AS (
  SELECT event_id, ts, 'wf-' || (user_id % 4) AS workflow, CASE WHEN k % 3 <> 0 THEN 'Test_' || (k // 10) END AS test_name,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'cancelled' WHEN 'view' THEN 'action_required' WHEN 'purchase' THEN 'passed' ELSE 'failed' END AS status,
         CASE WHEN k % 2 = 0 THEN 'Request timeout while waiting' ELSE 'Assertion  failed in step ' || (k % 5) || ' of the long nightly build run today' END AS message,
         CASE WHEN event_type <> 'signup' THEN sha256(CAST(event_id AS VARCHAR)) END AS sha, k
  FROM ev),
ci_signed AS (
  SELECT *, CASE WHEN test_name IS NOT NULL THEN test_name WHEN k % 2 = 0 THEN workflow || ':timeout'
                 ELSE 'assertion failed in step ' || (k % 5) || ' of the long' END AS failure_signature FROM ci)"""

CASES = """cases AS (
  SELECT d.*, b.text AS passage, string_split(b.text, ' ') AS words, lower(d.text) AS report FROM documents d, (SELECT count(*) AS total FROM benchmark) t
  JOIN benchmark b ON b.item_id = d.doc_id % t.total),
scored AS (
  SELECT *, lower(passage) AS root, lower(source) AS trigger_text, CASE WHEN doc_id % 3 = 0 THEN 'after ' || lower(source) ELSE report END AS predicted,
         CASE WHEN doc_id % 4 = 0 THEN 9 ELSE len(words) END AS baseline_steps, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 1 END AS assisted_steps
  FROM cases)"""

VECTORS = "vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
CLOSE = """near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a, vectors b
  WHERE a.vec_id = b.vec_id OR 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) <= 0.6)"""

SQL = {
    "service_inference": EV + """
        SELECT event_id, CASE event_type WHEN 'error' THEN 'svc-' || user_id WHEN 'click' THEN 'api.' || user_id WHEN 'view' THEN 'web-' || user_id
                                         WHEN 'signup' THEN 'job' || user_id END AS service FROM ev""",
    "logs_normalized": EV + f"""
        SELECT event_id, CASE WHEN k % 3 < 2 THEN {inst('ts')} END AS ts, CASE WHEN k % 2 = 0 THEN 'app-' || user_id ELSE 'web' END AS service,
               CASE WHEN k % 5 = 0 THEN 'WARN' WHEN k % 5 > 1 THEN 'INFO' END AS level, CASE event_type WHEN 'click' THEN 'clicked' ELSE event_type END AS message,
               'c' || k AS commit_sha, 'a.py,b' || k || '.py' AS changed_files
        FROM ev WHERE event_type <> 'view'""",
    "duplicate_records": EV + "SELECT event_type AS message, 2 * count(*) AS copies FROM ev GROUP BY event_type, k",
    "changed_file_forms": EV + """
        SELECT event_id, CASE event_type WHEN 'error' THEN 'a' || k || '.py|b.py|' || k WHEN 'click' THEN 'x.py|y' || k || '.py' WHEN 'view' THEN 'm' || k || '.py|n.py'
                 WHEN 'purchase' THEN CAST(k AS VARCHAR) ELSE '' END AS files FROM ev""",
    "timestamp_forms": EV + f"""
        SELECT event_id, {inst('t')} AS ts FROM (
          SELECT event_id, CASE k % 8 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE WHEN 2 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP)
                   WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 7 THEN date_trunc('millisecond', ts) END AS t FROM ev)""",
    "live_lines": """
        SELECT sha256(message) AS message_hash, CASE WHEN role = 'user' THEN 'desk' ELSE 'desk' END AS service, '2024-02-01 00:00:00.000000' AS ts, CAST(7 AS BIGINT) AS session_id
        FROM (SELECT role, CASE WHEN role = 'user' THEN text ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS message FROM conversations) WHERE message <> ''""",
    "text_file_lines": """
        SELECT sha256(line) AS message_hash, count(*) AS n
        FROM (SELECT unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM documents)
        WHERE regexp_matches(line, '\\S') GROUP BY 1""",
    "jsonl_file_logs": f"SELECT event_id, {inst('ts')} AS ts, event_type AS message, props AS level FROM events",
    "csv_file_logs": "SELECT page_id, url AS service, sha256(html) AS message_hash FROM pages",
    "json_document_logs": EV + """
        SELECT event_id, event_type AS message FROM ev WHERE k % 3 < 2 UNION ALL SELECT event_id, 'echo ' || event_type FROM ev WHERE k % 3 = 0""",
    "deploys_normalized": with_tables(BASE, DEPLOYS) + f"""
        SELECT coalesce(commit_sha, deploy_id) AS deploy_id, {inst('deployed_at')} AS deployed_at, service, version, environment, commit_sha, branch,
               array_to_string(changed_files, '|') AS changed_files FROM deploys""",
    "deploys_enriched": f"""
        SELECT 'github-deployment-' || o_orderkey AS deploy_id, {inst('o_orderdate')} AS deployed_at, substr('sha-' || (o_custkey * 2), 1, 12) AS version,
               CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority ELSE 'none' END AS environment,
               CASE WHEN p_partkey IS NULL THEN 'sha-' || (o_custkey * 2) ELSE 'sha-' || p_partkey || '-full' END AS commit_sha,
               CASE WHEN o_orderstatus = 'F' THEN 'main' WHEN p_partkey IS NOT NULL THEN p_type END AS branch, CASE WHEN p_size > 25 THEN p_name ELSE '' END AS changed_files,
               coalesce(p_brand, 'u') AS repo_url, 'github_deployments' AS provider
        FROM orders LEFT JOIN part ON p_partkey = o_custkey * 2""",
    "ci_records": with_tables(EVENTS, CI) + f"""
        SELECT event_id, {inst('ts')} AS ts, 'ci' AS service, 'ERROR' AS level, message, failure_signature, status, CAST(19 AS BIGINT) AS id_length FROM ci_signed""",
    "ci_patterns": with_tables(EVENTS, CI) + """
        SELECT *, failed_runs > 0 AND failed_runs < total_runs AS flaky,
               'Test ' || coalesce(test_name, 'unknown') || ' failed in ' || failed_runs || '/' || total_runs || ' recent CI runs'
               || CASE WHEN failed_runs > 0 AND failed_runs < total_runs THEN ' and appears flaky' ELSE '' END || '.' AS reason
        FROM (SELECT lower(failure_signature) AS pattern, test_name, workflow, count(*) FILTER (WHERE status IN ('failed', 'failure', 'timed_out', 'cancelled')) AS failed_runs,
                     count(*) AS total_runs, arg_min(sha, ts) FILTER (WHERE sha IS NOT NULL) AS commit_sha FROM ci_signed GROUP BY 1, 2, 3)""",
    "workflow_run_failures": f"""
        WITH failed AS (SELECT *, 'wf ' || o_orderpriority AS workflow FROM orders WHERE o_orderstatus <> 'O'),
        hit AS (SELECT * FROM failed JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R')
        SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'job ' || l_linenumber AS test_name, workflow, 'failure' AS status, 'job ' || l_linenumber || ' failed in ' || workflow AS message,
               'job ' || l_linenumber AS failure_signature, {inst('l_shipdate')} AS ts FROM hit
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, workflow, CASE o_orderstatus WHEN 'F' THEN 'failure' ELSE 'timed_out' END, workflow || ' failed', workflow, {inst('o_orderdate')}
        FROM failed WHERE o_orderkey NOT IN (SELECT o_orderkey FROM hit)""",
    "evaluation_metrics": with_tables(CASES) + """
        SELECT count(*) AS incident_count, round(avg(CASE WHEN root <> '' AND contains(report, root) THEN 1.0 ELSE 0 END), 6) AS root_cause_top1,
               round(avg(CASE WHEN root <> '' AND (doc_id % 2 = 0 OR contains(report, root)) THEN 1.0 ELSE 0 END), 6) AS root_cause_top3,
               round(avg(CASE WHEN contains(predicted, trigger_text) THEN 1.0 ELSE 0 END), 6) AS trigger_attribution,
               round(avg(CASE WHEN root <> '' THEN 1.0 ELSE 0 END), 6) AS baseline_keyword_accuracy,
               round(greatest(0, (sum(baseline_steps) - sum(assisted_steps)) / sum(baseline_steps)), 6) AS triage_reduction FROM scored""",
    "generated_summaries": EV + """
        SELECT event_id AS cluster_id, CASE WHEN k % 2 = 0 THEN 'Users saw ' || event_type ELSE 'late text' END AS description,
               CASE WHEN k % 3 = 0 THEN 'api|worker-' || k ELSE 'svc' END AS affected_services, 'start ' || k || '|then failed|again' AS timeline,
               CASE WHEN k % 5 = 0 THEN 'pool: empty' ELSE 'Model-generated summary; validate against representative logs and deploy history.' END AS suspected_root_cause,
               round(CASE k % 4 WHEN 0 THEN CASE WHEN k > 1 THEN k / 100.0 ELSE k END WHEN 1 THEN CAST('0.' || k AS DOUBLE) ELSE 0.7 END, 6) AS confidence FROM ev""",
    "session_fold": f"""
        WITH turns AS (SELECT *, make_timestamp(CAST((1704067200 + conv_id * 1000 + turn) * 1000000 AS BIGINT)) AS moment, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations),
        finish AS (SELECT conv_id, moment, length(text) AS exit_code FROM turns WHERE turn = last_turn AND turn > 0 AND role = 'assistant'),
        begin_turn AS (SELECT conv_id, moment, sha256(text) AS command, role FROM turns WHERE turn = 0)
        SELECT coalesce(b.conv_id, f.conv_id) AS session_id, command, {inst('b.moment')} AS started_at, {inst('f.moment')} AS ended_at, exit_code, role AS git_sha, coalesce(role, '') AS changed_files
        FROM begin_turn b FULL JOIN finish f ON b.conv_id = f.conv_id""",
    "pending_embeddings": "SELECT doc_id AS log_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "upsert_latest_wins": """
        WITH newest AS (SELECT l_orderkey AS id, l_linestatus || '-' || l_partkey AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS r
                        FROM lineitem)
        SELECT id, value FROM newest WHERE r = 1 UNION ALL SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT id FROM newest)""",
    "vector_similarity": """
        WITH sets AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_distinct([label, label % 3, 1]) AS s FROM embeddings)
        SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine,
               round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS overlap
        FROM sets a JOIN sets b ON b.vec_id = a.vec_id + 1""",
    "close_neighbour_counts": with_tables(VECTORS, CLOSE) + "SELECT a AS vec_id, count(*) AS neighbours FROM near GROUP BY 1",
    "density_clusters": "WITH RECURSIVE " + VECTORS + ",\n" + CLOSE + """,
        core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 2),
        links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
        reach(id, other) AS (SELECT id, id FROM core UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
        roots AS (SELECT id, min(other) AS root FROM reach GROUP BY 1),
        numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM roots),
        edge_rows AS (SELECT n.a AS id, min(cluster_id) AS cluster_id FROM near n JOIN numbered c ON c.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY 1)
        SELECT v.vec_id, coalesce(c.cluster_id, e.cluster_id, -1) AS cluster_id
        FROM vectors v LEFT JOIN numbered c ON c.id = v.vec_id LEFT JOIN edge_rows e ON e.id = v.vec_id""",
}
