"""Fields taken out of a payload in one pass read as those looked up by path."""

from pyspark.sql import functions as F

from embertrail.functions import payload as P
from embertrail.operators.scale import evaluate_once
from embertrail.sources.ci import normalize_ci
from embertrail.sources.payloads import payloads_from_text

KEYS = ("a", "@time", "b.c")
VALUES = (
    '""', '" "', "null", "true", "false", "0", "-0", "0.0", "0e5", "1", "-1", "1e2", "1.50", "-0.5", '"0"', '"true"', '"false"', '"null"', '"f"', '"t"', '"[]"',
    "[]", "{}", "[0]", '{"a":0}', '"longer than eight"', '[1,"x"]', "123456789", '"é"',
)


def test_fields_read_as_paths(spark):
    texts = [f'{{"{key}":{value}}}' for key in KEYS for value in VALUES] + ["{}", "[1]", "1", '"x"', "null", '{"other":1}']
    rows = spark.createDataFrame([(t,) for t in texts], "value string").select("value", F.try_parse_json("value").alias("payload"))
    rows = evaluate_once(rows, fields=P.taken_out(F.col("payload"), *KEYS, KEYS[0]))
    sides = []
    for source in (P.Fields("fields"), F.col("payload")):
        sides.append(F.to_json(F.array(*[
            F.struct(
                P.text_field(source, k).alias("text"), P.truthy_field(source, k).alias("truthy"), P.has_key(source, k).alias("has"),
                F.to_json(P.truthy_value(source, k)).alias("value"), P.string_list(P.raw_field(source, k)).alias("list"),
            ) for k in KEYS
        ])))
    for row in rows.select("value", sides[0].alias("one"), sides[1].alias("other")).collect():
        assert row["one"] == row["other"], row["value"]


def test_short_values_are_judged_as_before(spark):
    payload = F.try_parse_json("value")
    rows = spark.createDataFrame([(f'{{"a":{v}}}',) for v in VALUES], "value string").select(
        P.truthy_field(payload, "a").alias("truthy"), P.text_field(payload, "a").alias("text")
    ).collect()
    absent = {'""', "null", "false", "0", "-0", "0.0", "0e5", "[]", "{}"}
    assert [v for v, r in zip(VALUES, rows) if r["truthy"] is None] == [v for v in VALUES if v in absent]
    named = dict(zip(VALUES, (r["text"] for r in rows)))
    assert (named["true"], named["false"], named['"true"'], named["null"]) == ("True", "False", "true", None)


def test_ci_defaults_with_and_without_a_clash(spark):
    texts = ['{}', '{"z":1.50,"level":null}', '{"source_type":"x","b":[1,{"a":2}]}', '{"message":"m","source_type":null}', '{"test_name":"\\"q\\"}"}']
    rows = spark.createDataFrame([(t, "f") for t in texts], "value string, source string")
    logs, _ = normalize_ci(payloads_from_text(rows), F.lit("2024-01-01").cast("timestamp"))
    assert {r["raw"] for r in logs.collect()} == {
        '{"failure_signature":"ci failure","level":"ERROR","message":"CI failure","service":"ci","source_type":"ci"}',
        '{"failure_signature":"ci failure","level":null,"message":"CI failure","service":"ci","source_type":"ci","z":1.5}',
        '{"b":[1,{"a":2}],"failure_signature":"ci failure","level":"ERROR","message":"CI failure","service":"ci","source_type":"ci"}',
        '{"failure_signature":"m","level":"ERROR","message":"m","service":"ci","source_type":"ci"}',
        '{"failure_signature":"\\"q\\"}","level":"ERROR","message":"CI failure","service":"ci","source_type":"ci","test_name":"\\"q\\"}"}',
    }
