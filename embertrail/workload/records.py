"""Queries over record files, payload normalization, vectors, CI runs, evaluation and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from embertrail.functions.payload import raw_field, string_list
from embertrail.functions.services import service_from_message
from embertrail.functions.timestamps import parse_timestamp
from embertrail.functions.vectors import cosine_similarity, jaccard
from embertrail.operators.density import density_clusters, neighbour_counts
from embertrail.operators.tables import merge_rows, pending_embeddings
from embertrail.plans.ci import ci_patterns
from embertrail.plans.deploys import enrich_deploys
from embertrail.plans.evaluate import case_columns, evaluate
from embertrail.plans.sessions import fold_sessions
from embertrail.plans.summaries import generated_summaries
from embertrail.session import durable, scratch_root
from embertrail.sources.ci import failures_from_runs, normalize_ci
from embertrail.sources.deploys import commits_from_api, deploys_from_api, normalize_deploys
from embertrail.sources.lines import number_lines, text_lines
from embertrail.sources.logs import logs_from_lines, normalize_live_lines, normalize_logs, read_logs
from embertrail.sources.payloads import explode_documents, payloads_from_text
from embertrail.workload import views as V


def job_time() -> Column:
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/embertrail-{name}-{uuid.uuid4().hex}"


def _payloads(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    named = rows.withColumn("value", text).withColumn("source", F.lit("events"))
    return payloads_from_text(named.select(*keep, "source", "value"))


def service_inference(spark: SparkSession, folder: str) -> DataFrame:
    """Each event's message opens in one of the forms a service name may take."""
    user = F.col("user_id").cast("string")
    message = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("[Svc-"), user, F.lit("] request failed")))
        .when(F.col("event_type") == "click", F.concat(F.lit("retry exhausted, service= Api."), user, F.lit(" gone")))
        .when(F.col("event_type") == "view", F.concat(F.lit("worker_"), user, F.lit(" | app=web-"), user, F.lit(" slow")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("ERROR: order "), user, F.lit(" lost")))
        .otherwise(F.concat(F.lit("job"), user, F.lit(" - finished")))
    )
    return V.events(spark, folder).select("event_id", service_from_message(message).alias("service"))


def logs_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON records under varying aliases, with falsy first aliases and some records without a message."""
    rows = V.events(spark, folder)
    quoted = lambda value: F.concat(F.lit('"'), value, F.lit('"'))
    text = F.concat(
        F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"message":'),
        F.when(F.col("event_type") == "view", F.lit("0,\"msg\":\"\"")).when(F.col("event_type") == "click", F.lit('"","log":"clicked"'))
        .otherwise(quoted(F.col("event_type"))),
        F.lit(',"timestamp":'), F.when(F.col("k") % 3 == 0, F.concat(F.lit('"","ts":'), quoted(F.concat(_iso(F.col("ts")), F.lit("Z")))))
        .when(F.col("k") % 3 == 1, quoted(F.concat(_iso(F.col("ts")), F.lit("+00:00")))).otherwise(F.lit('"not a time"')),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit(',"service":null,"app":'), quoted(F.concat(F.lit("app-"), F.col("user_id").cast("string"))))).otherwise(F.lit(',"logger":"[Web]"')),
        F.lit(',"level":'), F.when(F.col("k") % 5 == 0, F.lit('"","severity":"WARN"')).when(F.col("k") % 5 == 1, F.lit('""')).otherwise(F.lit('"INFO"')),
        F.lit(',"changed_files":"a.py, ,b'), F.col("k").cast("string"), F.lit('.py","sha":"c'), F.col("k").cast("string"), F.lit('"}'),
    )
    logs, _ = normalize_logs(_payloads(rows, text))
    return logs.select(
        F.get_json_object("raw", "$.event_id").cast("bigint").alias("event_id"), V.instant(F.col("ts")).alias("ts"), "service", "level", "message",
        "commit_sha", F.array_join("changed_files", ",").alias("changed_files"),
    )


def duplicate_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of equal content get one id whatever their key order: events reduced to (type, k), written both ways."""
    rows = V.events(spark, folder).withColumn("flip", F.explode(F.array(F.lit(0), F.lit(1))))
    kind, k = F.concat(F.lit('"message":"'), F.col("event_type"), F.lit('"')), F.concat(F.lit('"k":'), F.col("k").cast("string"))
    text = F.concat(F.lit("{"), F.when(F.col("flip") == 0, F.concat(kind, F.lit(","), k)).otherwise(F.concat(k, F.lit(" , "), kind)), F.lit("}"))
    logs, _ = normalize_logs(_payloads(rows, text))
    return logs.groupBy("log_id", "message").agg(F.count(F.lit(1)).alias("copies")).select("message", "copies")


def changed_file_forms(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("k").cast("string")
    text = F.concat(F.lit('{"changed_files":'), (
        F.when(F.col("event_type") == "error", F.concat(F.lit('["a'), k, F.lit('.py"," ","\\t","b.py",'), k, F.lit("]")))
        .when(F.col("event_type") == "click", F.concat(F.lit('"[\\"x.py\\", \\"y'), k, F.lit('.py\\"]"')))
        .when(F.col("event_type") == "view", F.concat(F.lit('"m'), k, F.lit('.py ,\\t,\\n n.py\\t"'))).when(F.col("event_type") == "purchase", k).otherwise(F.lit("null"))
    ), F.lit("}"))
    rows = V.events(spark, folder).withColumn("payload", F.parse_json(text))
    return rows.select("event_id", F.array_join(string_list(raw_field(F.col("payload"), "changed_files")), "|").alias("files"))


def timestamp_forms(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.col("ts")
    text = (
        F.when(F.col("k") % 8 == 0, F.concat(_iso(ts), F.lit("Z"))).when(F.col("k") % 8 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("+05:30")))
        .when(F.col("k") % 8 == 2, F.date_format(ts, "yyyyMMdd")).when(F.col("k") % 8 == 3, F.date_format(ts, "yyyyMMdd'T'HHmmss"))
        .when(F.col("k") % 8 == 4, F.date_format(ts, "yyyy-MM-dd")).when(F.col("k") % 8 == 5, F.date_format(ts, "yyyy"))
        .when(F.col("k") % 8 == 6, F.unix_seconds(ts).cast("string")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss,SSS"))
    )
    return V.events(spark, folder).select("event_id", V.instant(parse_timestamp(text)).alias("ts"))


def live_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as live lines: JSON objects for the user's turns, plain text for the others."""
    turns = V.table(spark, folder, "conversations")
    record = F.to_json(F.struct(F.col("text").alias("msg"), F.col("turn").alias("turn"), F.lit("chat").alias("service_name")))
    line = F.when(F.col("role") == "user", record).otherwise(F.regexp_replace("text", r"\s+", " "))
    rows = turns.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("source"), F.col("turn").alias("line_no"), line.alias("line"))
    logs = normalize_live_lines(rows, job_time(), service="desk", session_id=7)
    return logs.select(F.sha2("message", 256).alias("message_hash"), "service", V.instant(F.col("ts")).alias("ts"), "session_id")


def text_file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All document texts as plain-text log files, read back line by line."""
    path = scratch(spark, "text")
    V.table(spark, folder, "documents").select("text").write.text(path)
    logs = logs_from_lines(number_lines(text_lines(spark, path)))
    return logs.groupBy(F.sha2("message", 256).alias("message_hash")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("raw").alias("places")).select("message_hash", "n")


def jsonl_file_logs(spark: SparkSession, folder: str) -> DataFrame:
    """All events as a JSONL file, read back as logs."""
    path = scratch(spark, "jsonl")
    V.events(spark, folder).select("event_id", _iso(F.col("ts")).alias("timestamp"), F.col("event_type").alias("message"), F.col("props").alias("level")).write.json(path)
    logs, _ = read_logs(spark, path, "jsonl")
    return logs.select(F.get_json_object("raw", "$.event_id").cast("bigint").alias("event_id"), V.instant(F.col("ts")).alias("ts"), "message", "level")


def csv_file_logs(spark: SparkSession, folder: str) -> DataFrame:
    """All page addresses and conversation-free columns as CSV with quoted markup, read back as logs."""
    path = scratch(spark, "csv")
    V.table(spark, folder, "pages").select("page_id", F.col("url").alias("service"), F.col("html").alias("message")).write.option("header", True).option("escape", '"').csv(path)
    logs, _ = read_logs(spark, path, "csv")
    return logs.select(F.get_json_object("raw", "$.page_id").cast("bigint").alias("page_id"), "service", F.sha2("message", 256).alias("message_hash"))


def json_document_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Each event as a JSON document: an array of two records, one object, or no record at all."""
    record = F.to_json(F.struct("event_id", F.col("event_type").alias("message")))
    echo = F.to_json(F.struct("event_id", F.concat(F.lit("echo "), F.col("event_type")).alias("msg")))
    text = (
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("["), record, F.lit(","), echo, F.lit("]"))).when(F.col("k") % 3 == 1, record)
        .otherwise(F.col("k").cast("string"))
    )
    documents = V.events(spark, folder).select(F.lit("events").alias("source"), text.alias("record_text")).withColumn("document", F.try_parse_json("record_text"))
    logs, _ = normalize_logs(explode_documents(documents))
    return logs.select(F.get_json_object("raw", "$.event_id").cast("bigint").alias("event_id"), "message")


def deploys_normalized(spark: SparkSession, folder: str) -> DataFrame:
    deploys = V.deploys(spark, folder).withColumn("n", F.col("version"))
    even = F.col("environment") == "prod"
    record = F.struct(
        F.when(even, _iso(F.col("deployed_at"))).alias("deployed_at"), F.when(~even, _iso(F.col("deployed_at"))).alias("time"),
        F.when(even, F.col("service")).otherwise(F.lit("")).alias("service"), F.col("service").alias("app"), F.col("version").alias("release"),
        F.col("environment").alias("env"), F.col("commit_sha").alias("sha"), F.col("branch").alias("ref"),
        F.array_join("changed_files", ", ").alias("files"), F.when(F.col("commit_sha").isNull(), F.col("deploy_id")).alias("deployment_id"),
    )
    rows, _ = normalize_deploys(_payloads(deploys, F.to_json(record)))
    return rows.select(
        "deploy_id", V.instant(F.col("deployed_at")).alias("deployed_at"), "service", "version", "environment", "commit_sha", "branch",
        F.array_join("changed_files", "|").alias("changed_files"),
    )


def deploys_enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as landed deployment responses, completed from parts as landed commits and pull requests."""
    orders = V.table(spark, folder, "orders")
    item = F.struct(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("sha-"), (F.col("o_custkey") * 2).cast("string")).alias("sha"),
        F.when(F.col("o_orderstatus") == "F", F.lit("main")).alias("ref"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("environment"),
        _iso(F.col("o_orderdate").cast("timestamp")).alias("updated_at"), F.lit("u").alias("url"),
    )
    items = orders.select(F.col("o_orderkey").alias("position"), F.try_parse_json(F.to_json(item)).alias("payload"))
    sha = F.concat(F.lit("sha-"), F.col("p_partkey").cast("string"))
    files = F.when(F.col("p_size") > 25, F.array(F.struct(F.col("p_name").alias("filename")))).otherwise(F.array().cast("array<struct<filename:string>>"))
    parts = V.table(spark, folder, "part")
    commits = parts.select(sha.alias("requested_sha"), F.try_parse_json(F.to_json(F.struct(F.concat(sha, F.lit("-full")).alias("sha"), files.alias("files"), F.col("p_brand").alias("html_url")))).alias("payload"))
    pulls = parts.select(sha.alias("requested_sha"), F.try_parse_json(F.concat(F.lit('[{"head":{"ref":"'), F.col("p_type"), F.lit('"}}]'))).alias("payload"))
    deploys = enrich_deploys(deploys_from_api(items, "shop", job_time(), environment="none"), commits_from_api(commits, pulls))
    return deploys.select(
        "deploy_id", V.instant(F.col("deployed_at")).alias("deployed_at"), "version", "environment", "commit_sha", "branch",
        F.array_join("changed_files", "|").alias("changed_files"), "repo_url", "provider",
    )


def _ci_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.events(spark, folder)
    record = F.struct(
        F.concat(F.lit("wf-"), (F.col("user_id") % 4).cast("string")).alias("workflow"),
        F.when(F.col("k") % 3 != 0, F.concat(F.lit("Test_"), F.floor(F.col("k") / 10).cast("string"))).alias("test_name"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "Cancelled").when(F.col("event_type") == "view", "action_required")
        .when(F.col("event_type") == "purchase", "passed").otherwise("").alias("status"),
        F.when(F.col("k") % 2 == 0, F.lit("Request timeout while waiting")).otherwise(F.concat(F.lit("Assertion  failed in step "), (F.col("k") % 5).cast("string"), F.lit(" of the long nightly build run today"))).alias("error"),
        F.when(F.col("event_type") != "signup", F.sha2(F.col("event_id").cast("string"), 256)).alias("sha"),
        _iso(F.col("ts")).alias("started_at"), F.col("event_id").alias("event_id"),
    )
    return normalize_ci(_payloads(rows, F.to_json(record)), job_time())[0]


def ci_record_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _ci_records(spark, folder).select(
        F.get_json_object("raw", "$.event_id").cast("bigint").alias("event_id"), V.instant(F.col("ts")).alias("ts"), "service", "level", "message",
        "failure_signature", "status", F.length("log_id").alias("id_length"),
    )


def ci_failure_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return ci_patterns(_ci_records(spark, folder), F.col("ts"))


def workflow_run_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as workflow runs and their line items as jobs."""
    conclusion = F.when(F.col("o_orderstatus") == "F", "failure").when(F.col("o_orderstatus") == "O", "success").otherwise("Timed_Out")
    run = F.struct(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("wf "), F.col("o_orderpriority")).alias("name"), conclusion.alias("conclusion"),
        F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("jobs_url"), _iso(F.col("o_orderdate").cast("timestamp")).alias("created_at"),
    )
    runs = V.table(spark, folder, "orders").select(F.col("o_orderkey").alias("position"), F.try_parse_json(F.to_json(run)).alias("payload"))
    job = F.struct(
        F.col("l_linenumber").alias("id"), F.concat(F.lit("job "), F.col("l_linenumber").cast("string")).alias("name"),
        F.when(F.col("l_returnflag") == "R", "failure").otherwise("success").alias("conclusion"), _iso(F.col("l_shipdate").cast("timestamp")).alias("started_at"),
    )
    jobs = V.table(spark, folder, "lineitem").select(F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("jobs_url"), F.try_parse_json(F.to_json(job)).alias("payload"))
    logs, _ = normalize_ci(failures_from_runs(runs, jobs), job_time())
    return logs.select(F.get_json_object("raw", "$.run_id").alias("run_id"), "test_name", "workflow", "status", "message", "failure_signature", V.instant(F.col("ts")).alias("ts"))


def evaluation_cases(spark: SparkSession, folder: str) -> DataFrame:
    """`(doc_id, case)`: documents as cases, a benchmark passage as root cause and its words as logs, against the text
    as report and the source as trigger."""
    docs = V.table(spark, folder, "documents")
    items = V.table(spark, folder, "benchmark")
    total = items.agg(F.count(F.lit(1)).alias("total"))
    keyed = docs.join(F.broadcast(total)).withColumn("item_id", F.col("doc_id") % F.col("total"))
    joined = keyed.join(items.select("item_id", F.col("text").alias("passage")), "item_id")
    words = F.split("passage", " ")
    case = F.struct(
        F.col("passage").alias("root_cause"), F.col("source").alias("trigger"), F.when(F.col("lang") == "en", F.col("text")).alias("report"),
        F.when(F.col("lang") != "en", F.col("text")).alias("predicted_root_cause"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"), F.lit("y"), F.col("passage"), F.lit("z"))).alias("root_cause_candidates"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("after "), F.col("source"))).alias("predicted_trigger"), words.alias("logs"),
        F.when(F.col("doc_id") % 4 == 0, F.lit(9)).alias("baseline_triage_steps"), F.when(F.col("doc_id") % 5 == 0, F.lit(3)).alias("assisted_triage_steps"),
    )
    return joined.select("doc_id", case.alias("case"))


def rounded_metrics(cases: DataFrame) -> DataFrame:
    metrics = evaluate(case_columns(cases))
    return metrics.select("incident_count", *[F.round(c, 6).alias(c) for c in metrics.columns if c != "incident_count"])


def evaluation_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_metrics(evaluation_cases(spark, folder).select(F.try_parse_json(F.to_json("case")).alias("payload")))


def generated_summary_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a one-log cluster whose summary text states some fields and leaves others out."""
    rows = V.events(spark, folder)
    k = F.col("k").cast("string")
    text = F.concat(
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("DESCRIPTION: Users saw "), F.col("event_type"), F.lit("\n"))).otherwise(F.lit("Description:\n  late text  \nmore\n")),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("Affected Services: api , worker-"), k, F.lit(",,\n"))).otherwise(F.lit("")),
        F.lit("Timeline: start "), k, F.lit("\n\n - then failed\n-- again\n"), F.when(F.col("k") % 5 == 0, F.lit("Suspected Root Cause: pool: empty\n")).otherwise(F.lit("")),
        F.lit("Confidence: "), F.when(F.col("k") % 4 == 0, F.concat(k, F.lit("%"))).when(F.col("k") % 4 == 1, F.concat(F.lit("0."), k)).otherwise(F.lit("high")),
    )
    members = rows.select(F.col("event_id").alias("cluster_id"), F.col("event_id").cast("string").alias("log_id"), "ts", F.col("event_type").alias("message"))
    clusters = rows.select(
        F.col("event_id").alias("cluster_id"), F.col("event_id").cast("string").alias("cluster_key"), F.lit(1).cast("bigint").alias("log_count"),
        F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.col("event_type").alias("example_message"), F.array(F.lit("svc")).alias("services"),
    )
    summaries = generated_summaries(clusters, members, rows.select(F.col("event_id").alias("cluster_id"), text.alias("generated")))
    return summaries.select(
        "cluster_id", "description", F.array_join("affected_services", "|").alias("affected_services"), F.array_join("timeline", "|").alias("timeline"),
        "suspected_root_cause", F.round("confidence", 6).alias("confidence"),
    )


def session_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as run sessions: the first turn starts one, an assistant's last turn ends it."""
    turns = V.table(spark, folder, "conversations")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 1000 + F.col("turn"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    start = turns.filter(F.col("turn") == 0).select(
        F.col("conv_id").alias("session_id"), F.lit("start").alias("kind"), at.alias("at"), F.sha2("text", 256).alias("command"), F.lit(None).cast("int").alias("exit_code"),
        F.col("role").alias("git_sha"), F.lit("main").alias("branch"), F.array(F.col("role")).alias("changed_files"),
    )
    end = turns.join(last, "conv_id").filter((F.col("turn") == F.col("last_turn")) & (F.col("turn") > 0) & (F.col("role") == "assistant")).select(
        F.col("conv_id").alias("session_id"), F.lit("end").alias("kind"), at.alias("at"), F.lit(None).cast("string").alias("command"), F.length("text").alias("exit_code"),
        F.lit(None).cast("string").alias("git_sha"), F.lit(None).cast("string").alias("branch"), F.lit(None).cast("array<string>").alias("changed_files"),
    )
    sessions = fold_sessions(start.unionByName(end))
    return sessions.select("session_id", "command", V.instant(F.col("started_at")).alias("started_at"), V.instant(F.col("ended_at")).alias("ended_at"), "exit_code", "git_sha",
                           F.array_join("changed_files", "|").alias("changed_files"))


def pending_embedding_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that no label row covers, as logs without a vector."""
    docs = V.table(spark, folder, "documents").select(F.col("doc_id").alias("log_id"), "lang")
    return pending_embeddings(docs, V.table(spark, folder, "labels").select(F.col("doc_id").alias("log_id")))


def upsert_latest_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Line items upserted over the orders' rows by order key, the highest line number winning."""
    current = V.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("value"))
    incoming = V.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("value"), "l_linenumber", "l_partkey")
    return merge_rows(current, incoming.withColumn("value", F.concat("value", F.lit("-"), F.col("l_partkey").cast("string"))), ["id"], [F.col("l_linenumber"), F.col("l_partkey")])


def vector_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector against the next one, with the overlap of two small service sets."""
    vectors = V.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("other"), F.col("label").alias("other_label"))
    services = lambda label: F.array_distinct(F.array(F.col(label), F.col(label) % 3, F.lit(1)))
    return vectors.join(following, "vec_id").select(
        "vec_id", F.round(cosine_similarity(F.col("vector"), F.col("other")), 6).alias("cosine"), F.round(jaccard(services("label"), services("other_label")), 6).alias("overlap")
    )


def vector_rows(spark: SparkSession, folder: str) -> DataFrame:
    return V.table(spark, folder, "embeddings").select(
        F.format_string("%012d", "vec_id").alias("log_id"), F.lit(None).cast("timestamp").alias("ts"), F.col("embedding").cast("array<double>").alias("vector"), "vec_id"
    )


def close_neighbour_counts(spark: SparkSession, folder: str) -> DataFrame:
    points = vector_rows(spark, folder).select(F.col("vec_id").alias("row_id"), F.lit(1).cast("bigint").alias("weight"), "vector")
    return neighbour_counts(points, 0.6, V.CHECKED_TILE_ROWS).select(F.col("row_id").alias("vec_id"), "neighbours")


def density_cluster_rows(spark: SparkSession, folder: str) -> DataFrame:
    labels = density_clusters(vector_rows(spark, folder).drop("vec_id"), 0.6, 2, V.CHECKED_TILE_ROWS)
    return labels.select(F.col("log_id").cast("bigint").alias("vec_id"), "cluster_id")


QUERIES = {
    "service_inference": service_inference,
    "logs_normalized": logs_normalized,
    "duplicate_records": duplicate_records,
    "changed_file_forms": changed_file_forms,
    "timestamp_forms": timestamp_forms,
    "live_lines": live_lines,
    "text_file_lines": text_file_lines,
    "jsonl_file_logs": jsonl_file_logs,
    "csv_file_logs": csv_file_logs,
    "json_document_logs": json_document_logs,
    "deploys_normalized": deploys_normalized,
    "deploys_enriched": deploys_enriched,
    "ci_records": ci_record_rows,
    "ci_patterns": ci_failure_patterns,
    "workflow_run_failures": workflow_run_failures,
    "evaluation_metrics": evaluation_metrics,
    "generated_summaries": generated_summary_rows,
    "session_fold": session_fold,
    "pending_embeddings": pending_embedding_rows,
    "upsert_latest_wins": upsert_latest_wins,
    "vector_similarity": vector_similarity,
    "close_neighbour_counts": close_neighbour_counts,
    "density_clusters": density_cluster_rows,
}
