"""Which of several records wins, which column a field lands in, and which run a batch gets."""

import json

import pytest
from pyspark.sql import functions as F

from embertrail.functions.payload import string_list
from embertrail.operators.tables import merge_table, read_table
from embertrail.plans.ingest import ingest_deploys
from embertrail.schemas import TABLES
from embertrail.sources.payloads import read_csv
from embertrail.streaming.live import LiveTriage


def test_the_last_record_of_a_key_wins_after_enrichment(spark, tmp_path):
    path = tmp_path / "deploys.jsonl"
    records = [{"id": f"d{i % 200}", "deployed_at": "2026-01-05T10:00:00Z", "service": "billing", "version": f"v{i}", "commit_sha": f"c{i % 7}"} for i in range(2000)]
    path.write_text("\n".join(json.dumps(r) for r in records))
    commits = spark.createDataFrame(
        [(f"c{i}", f"full{i}", None, ["a.py"], "topic") for i in range(7)], "requested_sha string, sha string, html_url string, files array<string>, pull_branch string"
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ingest_deploys(spark, str(tmp_path / "store"), str(path), commits=commits)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored = {r["deploy_id"]: r["version"] for r in read_table(spark, str(tmp_path / "store"), "deploys").collect()}
    assert stored == {f"d{i}": f"v{1800 + i}" for i in range(200)}


def test_csv_columns_follow_each_files_own_header(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("service,message\npay,ping\n")
    (folder / "b.csv").write_text('message,service\n"two\nlines",web\n')
    (folder / "c.csv").write_text("message,service,level\nlate,web,WARN\n")
    rows = {tuple(sorted(json.loads(r["record_text"]).items())) for r in read_csv(spark, str(folder)).collect()}
    assert rows == {
        (("message", "ping"), ("service", "pay")), (("message", "two\nlines"), ("service", "web")),
        (("level", "WARN"), ("message", "late"), ("service", "web")),
    }


def test_file_lists_lose_all_white_space(spark):
    texts = ['"a.py,\\tb.py"', '"\\n[\\"x\\"]"', '["\\t","c.py"]']
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(string_list(F.parse_json("t")).alias("files"))
    assert [r["files"] for r in frame.collect()] == [["a.py", "b.py"], ["x"], ["c.py"]]


def test_a_failed_read_is_no_empty_table(spark, tmp_path):
    root = str(tmp_path)
    assert read_table(spark, root, "deploys").count() == 0
    layout, _ = TABLES["live_batches"]
    merge_table(spark, root, "live_batches", spark.createDataFrame([("s", 1, 1)], layout), [F.col("run_id")])
    assert read_table(spark, root, "live_batches").count() == 1
    (tmp_path / "deploys").mkdir()
    (tmp_path / "deploys" / "part-0.parquet").write_text("not parquet at all")
    with pytest.raises(Exception):
        read_table(spark, root, "deploys").collect()


def test_runs_go_on_after_a_new_checkpoint(spark, tmp_path):
    live = LiveTriage(root=str(tmp_path), stream="first")
    assert [live.run_of_batch(spark, b) for b in (0, 1, 1)] == [1, 2, 2]
    other = LiveTriage(root=str(tmp_path), stream="second")
    assert other.run_of_batch(spark, 0) == 3 and live.run_of_batch(spark, 0) == 1
