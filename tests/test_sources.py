import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from embertrail.functions.payload import first_truthy, first_truthy_or_last, json_text_list, raw_field, string_list
from embertrail.functions.services import clean_service
from embertrail.functions.signatures import message_signature
from embertrail.functions.timestamps import parse_timestamp, timestamp_text
from embertrail.sources.cases import read_cases
from embertrail.sources.ci import failures_from_runs, normalize_ci, read_ci
from embertrail.sources.deploys import commits_from_api, deploys_from_api, read_deploys
from embertrail.sources.lines import number_lines, text_lines
from embertrail.sources.logs import normalize_live_lines, read_logs
from embertrail.sources.payloads import read_payloads

def NOW():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")



def variants(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "i int, t string").withColumn("payload", F.try_parse_json("t")).orderBy("i")


def test_falsy_values_fall_through_to_the_next_alias(spark):
    texts = ['{"a":"","b":"x"}', '{"a":0,"b":"x"}', '{"a":false,"b":"x"}', '{"a":[],"b":"x"}', '{"a":{},"b":"x"}',
             '{"a":null,"b":"x"}', '{"b":"x"}', '{"a":" ","b":"x"}', '{"a":"0","b":"x"}', '{"a":0.0,"b":"x"}', '{"a":true}',
             '{"a":7}']
    got = [r[0] for r in variants(spark, texts).select(first_truthy(F.col("payload"), "a", "b")).collect()]
    assert got == ["x"] * 7 + [" ", "0", "x", "True", "7"]


def test_the_last_alias_is_returned_as_it_is(spark):
    rows = variants(spark, ['{"level":"","severity":""}', '{"level":""}', '{"severity":"w"}', '{"severity":0}'])
    got = [r[0] for r in rows.select(first_truthy_or_last(F.col("payload"), "level", "severity")).collect()]
    assert got == ["", None, "w", "0"]


def test_timestamps_are_read_leniently_and_in_utc(spark):
    cases = {
        "2026-03-09T10:05:00Z": "2026-03-09 10:05:00", "2026-03-09T10:05:00+05:30": "2026-03-09 04:35:00",
        "2026-03-09": "2026-03-09 00:00:00", "20260309": "2026-03-09 00:00:00", "20260309T100500": "2026-03-09 10:05:00",
        "2026-03-09 10:05": "2026-03-09 10:05:00", "2026-03-09T10": "2026-03-09 10:00:00",
        "2026-03-09T10:05:00,25": "2026-03-09 10:05:00.250000", "2026-03-09T10:05:00.123456+0000": "2026-03-09 10:05:00.123456",
        "2026": None, "10:05": None, "nope": None, "1773050700": None, "": None, "2026-13-01": None, "2026-03-09T25:00:00": None,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    got = df.select("t", "want", timestamp_text(parse_timestamp(F.col("t"))).alias("got")).collect()
    assert {r["t"]: r["got"] for r in got} == cases


def test_changed_files_from_every_shape(spark):
    texts = ['{"f":["a"," ","b",3]}', '{"f":"[\\"a\\", \\"b\\"]"}', '{"f":"a, b,,c "}', '{"f":5}', '{"f":""}', '{}', '{"f":"[broken"}',
             '{"f":null}']
    got = [r[0] for r in variants(spark, texts).select(string_list(raw_field(F.col("payload"), "f"))).collect()]
    assert got == [["a", "b", "3"], ["a", "b"], ["a", "b", "c"], ["5"], [], [], ["[broken"], []]
    lists = spark.createDataFrame([('["x", 1]',), ("{}",), ("oops",), (None,)], "t string")
    assert [r[0] for r in lists.select(json_text_list(F.col("t"))).collect()] == [["x", "1"], [], [], []]


def test_service_names_are_cleaned(spark):
    rows = [(" [Api] ", "api"), ("INFO", None), ("a b", None), ("x" * 65, None), ("", None), ("(svc.one)", "svc.one")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", clean_service(F.col("t")).alias("got")).collect())


def test_signatures_mask_numbers_hex_and_ids(spark):
    rows = [
        ("  Order 42  failed at 0xDEADBEEF ", "order <num> failed at <hex>"), ("commit deadbeefcafe", "commit <id>"),
        ("v2 x10 12", "v2 x10 <num>"), ("é1234567890abc", "é1234567890abc"),
    ]
    df = spark.createDataFrame(rows, "m string, want string")
    for r in df.select("want", message_signature(F.col("m")).alias("got")).collect():
        assert r["got"] == r["want"]
    long = spark.createDataFrame([("x" * 500,)], "m string").select(F.length(message_signature(F.col("m")))).first()[0]
    assert long == 160


def test_jsonl_logs_collapse_equal_records_and_reject_bad_ones(spark, tmp_path):
    path = tmp_path / "logs.jsonl"
    path.write_text("\n".join([
        '{"timestamp":"2026-03-09T10:00:00Z","service":"api","level":"ERROR","message":"boom"}',
        '{"service":"api","message":"boom","level":"ERROR","timestamp":"2026-03-09T10:00:00Z"}',
        "", "   ", "not json", '{"level":"x"}', "[1]", '{"msg":"[dryer] glaze too thin","severity":""}',
    ]))
    logs, rejected = read_logs(spark, str(path))
    rows = logs.collect()
    assert len(rows) == 3 and len({r["log_id"] for r in rows}) == 2
    worker = next(r for r in rows if "glaze" in r["message"])
    assert (worker["service"], worker["level"], worker["ts"]) == ("dryer", "", None)
    assert sorted(r["problem"] for r in rejected.collect()) == ["no message field", "not a JSON object", "not readable as JSON"]


def test_json_documents_arrays_and_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"message": "one"}, {"message": "two"}]))
    (tmp_path / "b.json").write_text(json.dumps({"message": "three"}))
    (tmp_path / "c.json").write_text("5")
    logs, rejected = read_logs(spark, str(tmp_path), "json")
    assert sorted(r["message"] for r in logs.collect()) == ["one", "three", "two"]
    assert rejected.count() == 1


def test_csv_keeps_short_rows_and_rejects_long_ones(spark, tmp_path):
    path = tmp_path / "logs.csv"
    path.write_text('timestamp,service,message\n2026-03-09T10:00:00Z,api,"multi\nline ""quoted"""\n2026-03-09T10:00:00Z,api\nx,y,z,extra\n2026-03-09T10:01:00Z,,plain\n')
    logs, rejected = read_logs(spark, str(path))
    rows = {r["message"]: r for r in logs.collect()}
    assert set(rows) == {'multi\nline "quoted"', "plain"}
    assert rows["plain"]["service"] is None
    assert sorted(r["problem"] for r in rejected.collect()) == ["more fields than the header", "no message field"]


def test_text_lines_are_numbered_per_file_across_blocks(spark, tmp_path):
    lines = [f"line {i}" if i % 7 else "" for i in range(1, 4001)]
    (tmp_path / "big.log").write_text("\n".join(lines))
    (tmp_path / "small.log").write_text("same\nsame\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = number_lines(text_lines(spark, str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    big = {r["line_no"]: r["line"] for r in rows if r["source"].endswith("big.log")}
    assert big == {i: line for i, line in enumerate(lines, 1) if line}
    logs, _ = read_logs(spark, str(tmp_path / "small.log"))
    assert logs.select("log_id").distinct().count() == 2


def test_live_lines_fill_only_absent_keys(spark):
    lines = [
        ("s", 1, "service=dryer fan stopped twice"), ("s", 2, '{"message":"m","service":"own"}'), ("s", 3, '{"message":"m","service":""}'),
        ("s", 4, '{"message":"m","timestamp":"2025-07-02T18:30:00Z"}'), ("s", 5, '{"message":"m","timestamp":"bad"}'),
        ("s", 6, "{broken"), ("s", 7, "   "), ("s", 8, '{"message":"m","ts":"2026-03-09T10:00:00Z"}'),
    ]
    df = spark.createDataFrame(lines, "source string, line_no long, line string")
    rows = normalize_live_lines(df, NOW(), service="kiln", session_id=9).collect()
    got = {i: r for i, r in zip([1, 2, 3, 4, 5, 6, 8], sorted(rows, key=lambda r: 0))}
    by_message = [(r["message"], r["service"], r["ts"], r["session_id"]) for r in rows]
    now, given = dt.datetime(2026, 1, 1), dt.datetime(2025, 7, 2, 18, 30)
    assert by_message == [
        ("service=dryer fan stopped twice", "kiln", now, 9), ("m", "own", now, 9), ("m", None, now, 9), ("m", "kiln", given, 9),
        ("m", "kiln", None, 9), ("{broken", "kiln", now, 9), ("m", "kiln", now, 9),
    ]
    assert len({r["log_id"] for r in rows}) == len(got) == 7
    bracket = spark.createDataFrame([("s", 1, "[kiln] valve 3 stuck half open")], df.schema)
    assert normalize_live_lines(bracket, NOW()).first()["service"] == "kiln"


def test_deploy_events(spark, tmp_path):
    path = tmp_path / "deploys.jsonl"
    path.write_text("\n".join([
        '{"deployed_at":"2025-07-02T16:20:00Z","service":"kiln","version":"r6","environment":"floor","deployment_id":"d1","commit_sha":"bead42","branch":"trunk","changed_files":["kiln/valves.py","kiln/heat.py"],"provider":"belt"}',
        '{"time":"2026-03-09T09:50:00Z","app":"web","sha":"abc","files":"a.py, b.py"}',
        '{"time":"2026-03-09T09:50:00Z","app":"web"}', '{"time":"nope","app":"web"}', '{"time":"2026-03-09T09:50:00Z"}',
    ]))
    deploys, rejected = read_deploys(spark, str(path))
    rows = {r["deploy_id"]: r for r in deploys.collect()}
    assert rows["d1"]["changed_files"] == ["kiln/valves.py", "kiln/heat.py"] and rows["abc"]["changed_files"] == ["a.py", "b.py"]
    assert len(rows) == 3 and any(len(key) == 16 for key in rows)
    assert sorted(r["problem"] for r in rejected.collect()) == ["no service field", "no valid deploy time"]
    with pytest.raises(ValueError):
        read_deploys(spark, str(tmp_path / "deploys.txt"))


def test_ci_records_and_defaults(spark, tmp_path):
    (tmp_path / "ci.json").write_text(json.dumps({"runs": [
        {"workflow": "tests", "message": "Request timeout in step", "custom": {"z": 1}}, {"test_name": "t1", "error": "bad"}, {},
    ]}))
    logs, _ = read_ci(spark, str(tmp_path / "ci.json"), NOW())
    rows = {r["message"]: r for r in logs.collect()}
    assert rows["Request timeout in step"]["failure_signature"] == "tests:timeout"
    assert rows["bad"]["failure_signature"] == "t1"
    plain = rows["CI failure"]
    assert (plain["service"], plain["level"], plain["failure_signature"], plain["status"]) == ("ci", "ERROR", "ci failure", "failed")
    raw = json.loads(rows["Request timeout in step"]["raw"])
    assert raw["source_type"] == "ci" and raw["custom"] == {"z": 1} and raw["service"] == "ci"
    assert all(r["log_id"].startswith("ci-") and len(r["log_id"]) == 19 for r in rows.values())


def test_workflow_runs_become_failure_records(spark):
    runs = variants(spark, [
        '{"id":71,"name":"night shift","conclusion":"failure","head_sha":"bead42","head_branch":"trunk","jobs_url":"u1","html_url":"r1","created_at":"2025-07-03T02:00:00Z"}',
        '{"id":72,"name":"night shift","conclusion":"success","jobs_url":"u2"}', '{"id":3,"name":"lint","conclusion":"timed_out"}',
    ]).withColumnRenamed("i", "position")
    jobs = spark.createDataFrame([
        ("u1", '{"id":711,"name":"glaze_depth","conclusion":"failure","html_url":"j1","started_at":"2025-07-03T02:05:00Z"}'),
        ("u1", '{"id":12,"name":"unit","conclusion":"success"}'), ("u2", '{"id":13,"name":"x","conclusion":"failure"}'),
    ], "jobs_url string, t string").withColumn("payload", F.try_parse_json("t"))
    logs, _ = normalize_ci(failures_from_runs(runs, jobs), NOW())
    rows = {r["test_name"]: r for r in logs.collect()}
    assert set(rows) == {"glaze_depth", None}
    assert rows["glaze_depth"]["commit_sha"] == "bead42" and rows["glaze_depth"]["message"] == "glaze_depth failed in night shift"
    assert rows[None]["message"] == "lint failed" and rows[None]["status"] == "timed_out"


def test_deployments_and_commits_from_landed_responses(spark):
    items = variants(spark, ['{"id":9001,"sha":"bead42c0ffee1777","ref":"trunk","environment":"floor","updated_at":"2025-07-02T16:20:00Z","url":"u"}']).withColumnRenamed("i", "position")
    deploy = deploys_from_api(items, "kiln", NOW()).first()
    assert (deploy["deploy_id"], deploy["version"], deploy["branch"]) == ("github-deployment-9001", "bead42c0ffee", "trunk")
    commits = spark.createDataFrame([("abc", '{"sha":"abc","html_url":"h","files":[{"filename":"kiln/heat.py"},{"x":1}]}')], "requested_sha string, t string").withColumn("payload", F.try_parse_json("t"))
    pulls = spark.createDataFrame([("abc", '[{"head":{"ref":"feature"}}]')], "requested_sha string, t string").withColumn("payload", F.try_parse_json("t"))
    row = commits_from_api(commits, pulls).first()
    assert (row["sha"], row["files"], row["pull_branch"]) == ("abc", ["kiln/heat.py"], "feature")


def test_cases_from_files_and_folders(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"cases": [{"id": "1"}, 5]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "2"}]))
    (tmp_path / "c.json").write_text(json.dumps({"id": "3"}))
    (tmp_path / "d.json").write_text(json.dumps({"cases": []}))
    (tmp_path / "skip.txt").write_text("{}")
    assert read_cases(spark, str(tmp_path)).count() == 3
    assert read_cases(spark, str(tmp_path / "a.json")).count() == 1
    assert read_payloads(spark, str(tmp_path / "a.json")).count() == 1
