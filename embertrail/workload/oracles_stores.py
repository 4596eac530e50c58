"""SQL for the queries that go through files and stored tables."""

from __future__ import annotations

from embertrail.workload import oracles, oracles_records
from embertrail.workload.views import EVENTS, with_tables

SQL = {
    "ingested_deploys": with_tables(EVENTS) + """
        SELECT 'user-' || user_id AS deploy_id, arg_max(event_type, event_id) AS service, 'v' || max(event_id) AS version,
               arg_max(coalesce('full-' || n_name, 'c' || (k % 40)), event_id) AS commit_sha,
               max_by(CASE WHEN n_name IS NOT NULL THEN 'topic' ELSE '' END, event_id) AS branch, arg_max(coalesce(n_name || '.py', ''), event_id) AS changed_files
        FROM ev LEFT JOIN nation ON n_nationkey = k % 40 GROUP BY user_id""",
    "ingested_logs": "SELECT DISTINCT 'shipping' AS service, l_returnflag AS level, 'shipped ' || l_suppkey || ' as ' || l_linestatus AS message FROM lineitem",
    "case_file_metrics": oracles_records.SQL["evaluation_metrics"],
    "alert_lines": oracles.SQL["anomalies_latest_run"],
    "json_text_lists": with_tables(EVENTS) + "SELECT event_id, CASE WHEN k % 4 = 0 THEN event_type || '|' || k ELSE '' END AS items FROM ev",
    "clusters_by_batches": oracles_records.SQL["density_clusters"],
}
