"""Records with keys of their own: parsing, reports, merged schemas and a round trip."""

import json

from pyspark.sql import functions as F

from runlens.session import scratch_path
from runlens.sources import variants as VAR

LINES = [
    '{"id": 1, "success": true, "tests": ["a", "b"], "coverage": {"LINE": 50.5}}',
    '{"id": 2, "success": false, "error": "no_jar"}',
    '{"id": 3, "success": false, "error": "timeout", "extra": {"deep": [1, {"x": null}]}, "note": "ünï"}',
    '{"id": "four", "success": true, "tests": 7, "error": null}',
    "not json",
    "  ",
    "[1, 2]",
    "{}",
]


def _read(spark, lines):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value STRING").coalesce(1).write.text(path)
    return VAR.read_records(spark, path)


def test_keys_by_outcome(spark):
    records = _read(spark, LINES)
    assert records.count() == 7 and records.where("malformed").count() == 1
    outcome = F.coalesce(F.try_variant_get("record", "$.error", "string"), F.lit("success"))
    got = {tuple(r) for r in VAR.key_report(records, outcome).collect()}
    assert got == {
        ("success", "id", "integer", 1), ("success", "id", "string", 1), ("success", "success", "boolean", 2), ("success", "tests", "array", 1), ("success", "tests", "integer", 1),
        ("success", "coverage", "object", 1), ("success", "error", "null", 1), ("no_jar", "id", "integer", 1), ("no_jar", "success", "boolean", 1), ("no_jar", "error", "string", 1),
        ("timeout", "id", "integer", 1), ("timeout", "success", "boolean", 1), ("timeout", "error", "string", 1), ("timeout", "extra", "object", 1), ("timeout", "note", "string", 1),
    }
    merged = {r["outcome"]: r["schema"] for r in VAR.merged_schemas(records.where("NOT malformed"), outcome).collect()}
    assert "error: STRING" in merged["no_jar"] and "extra: OBJECT<deep: ARRAY<" in merged["timeout"]


def test_every_key_survives_a_round_trip(spark):
    records, path = _read(spark, LINES), scratch_path(spark, "again")
    VAR.write_records(records, path)
    back = [json.loads(r[0]) for r in VAR.read_records(spark, path).select(F.to_json("record")).collect()]
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(key, back)) == sorted(key(json.loads(x)) for x in LINES if x.strip() and x != "not json")


def test_fields_that_do_not_fit_are_null(spark):
    wanted = {"id": ("$.id", "bigint"), "first": ("$.tests[0]", "string"), "line": ("$.coverage.LINE", "double")}
    got = {tuple(r) for r in _read(spark, LINES).select(*VAR.fields("record", wanted)).collect()}
    assert got == {(1, "a", 50.5), (2, None, None), (3, None, None), (None, None, None)}


def test_no_records(spark):
    empty = _read(spark, [])
    assert empty.count() == 0 and VAR.key_report(empty, F.lit("x")).count() == 0
