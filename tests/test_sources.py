import json

import pytest

from sylvaframe.sources.drift import changes, consistent_table, name_fields, path_values
from sylvaframe.sources.records import POINT_RECORD, parse_records, read_points, rejected, row_pattern

GOOD = "1.5,2,3,7,1,2,3,note"


def reasons(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id bigint, raw_line string")
    return {r.raw_id: (r.reason, r.broken_field) for r in parse_records(df).collect()}


CASES = [
    (GOOD, None),
    ('"1.5"," 2 ",3, -1 ,,,,"a ""b"", c\nd"', None),
    ("+1.,.5,-1e-3,,1,2,3,", None),
    ("10000000,1,1,9223372036854775807,,,,", None),
    ("10000000.0000000000001,1,1,1,,,,", "value"),
    ("1e400,1,1,1,,,,", "value"),
    ("1e9999999999,1,1,1,,,,", "value"),
    ("1,1,1,9223372036854775808,,,,", "value"),
    ("1,1,1,-2,,,,", "value"),
    ("1,1,1,1.0,,,,", "value"),
    ("١,1,1,1,,,,", "value"),
    ("1\t,1,1,1,,,,", "value"),
    (",1,1,1,,,,", "value"),
    ("1,1,1,1,,,", "columns"),
    ("1,1,1,1,,,,,", "columns"),
    ("", "columns"),
    (None, "columns"),
    ('1,1,1,1,,,,"open', "quoting"),
    ('1,1,1,1,,,,a"b', "quoting"),
    ('1,1,1,1,,,, "b"', "quoting"),
    ('""x,1', "quoting"),
    ('1,1,1,1,,,,""', None),
    ('1,1,1,1,,,,"""x"', None),
    ("1,1,1,1,,,," + "x" * 200_000, None),
    ('1,1,1,1,,,,"' + '""' * 100_000 + '"', None),
    ("," * 200_000, "columns"),
    ("0" * 100_000 + "1,1,1," + "0" * 100_000 + "1,,,,", None),
]


def test_reasons(spark):
    got = reasons(spark, [c for c, _ in CASES])
    assert {i: r for i, (_, r) in enumerate(CASES)} == {i: r for i, (r, _) in got.items()}


def test_broken_field(spark):
    got = reasons(spark, ["1,x,3,4,,,,", "1,2,3,-9,,,,", '1,2,3,4,,,a"b,', GOOD + ",more"])
    assert [got[i][1] for i in range(4)] == ["y", "instance_id", "intensity", None]
    got = reasons(spark, ["", None, "1,2", '1,2,3,4,,,,"x" ', "1, ,3", '1,2,3,"4",,,"', "1,2,x,4,,,,,", GOOD + ',"'])
    assert [got[i] for i in range(8)] == [("columns", "x"), ("columns", "x"), ("columns", "z"), ("quoting", "note"), ("columns", "y"), ("quoting", "intensity"), ("columns", "z"), ("quoting", None)]


def test_patterns_are_tried_once(spark):
    df = spark.createDataFrame([(1, GOOD)], "raw_id bigint, raw_line string")
    plan = rejected(df).select("raw_id", "reason")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2 and plan.count(row_pattern(POINT_RECORD)[:60]) == 1


def test_typed_values_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, '"1.5",2,3,,"a ""b""",,," n "', "old", 9.0)], "raw_id bigint, raw_line string, reason string, x double")
    row = read_points(df).first()
    assert (row.x, row.y, row.z, row.instance_id, row.semclassid, row.note) == (1.5, 2.0, 3.0, None, 'a "b"', " n ")
    assert rejected(df).count() == 0
    assert parse_records(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        parse_records(df.drop("raw_line"))


ALIAS = [("easting", "x"), ("x", "x"), ("klasse", "classification"), ("classification", "classification"), (None, "y"), ("z", None)]


def drift(spark, files):
    rows = [(i, c, n, p if p is None or isinstance(p, str) else json.dumps(p)) for i, (c, n, p) in enumerate(files)]
    df = spark.createDataFrame(rows, "record_id bigint, cloud_id string, file_no bigint, payload string")
    return df, spark.createDataFrame(ALIAS, "alias_key string, field_name string")


def test_changes(spark):
    df, alias = drift(
        spark,
        [("a", 1, {"X": 1, "classification": 2, "k": None}), ("a", 3, {"easting": 1.5, "Classification": 2, "k": None}), ("a", 4, {"easting": 2, "Class_i_fication": "7"}), ("b", 1, {"x": 1}), ("a", 9, "broken {")],
    )
    got = {tuple(r) for r in changes(name_fields(path_values(df), alias)).collect()}
    assert got == {
        ("a", 3, "x", "renamed"), ("a", 3, "x", "retyped"), ("a", 4, "k", "removed"), ("a", 3, "classification", "renamed"), ("a", 4, "x", "retyped"), ("a", 4, "classification", "renamed"), ("a", 4, "classification", "retyped"),
        ("a", 9, "x", "removed"), ("a", 9, "classification", "removed"),
    }


def test_raw_keys_decide_renames(spark):
    df, alias = drift(spark, [("a", 1, {"SemClassID": 1, "z": 1}), ("a", 2, {"sem_class_id": 1, "z": 1}), ("a", 3, {"sem_class_id": 2, "z": 2})])
    got = {tuple(r) for r in changes(name_fields(path_values(df), alias)).collect()}
    assert got == {("a", 2, "semclassid", "renamed")}


def test_nested_paths(spark):
    df, _ = drift(spark, [("a", 1, {"p": {"q": 1, "r": {"s": "t"}}, "l": [1.5, {"m": None}]})])
    got = {(r.path, r.raw_type) for r in path_values(df, depth=3).collect()}
    assert got == {("p", "nested"), ("l", "nested"), ("p.q", "integer"), ("p.r", "nested"), ("p.r.s", "text"), ("l[]", "float"), ("l[]", "nested"), ("l[].m", "null")}
    assert {r.path for r in path_values(df).collect()} == {"p", "l"}


def test_raw_types(spark):
    df, _ = drift(spark, [("a", 1, '{"a": 5.0, "b": 5, "c": "5", "d": null, "e": true, "f": [1], "g": 12345678901234567890, "h": 1.0e5, "i": -0.5, "j": 98765432109876543210987.25}'), ("a", 1, None), ("a", 1, "[1]")])
    got = {r.path: r.raw_type for r in path_values(df).collect()}
    assert got == {"a": "float", "b": "integer", "c": "text", "d": "null", "e": "boolean", "f": "nested", "g": "integer", "h": "float", "i": "float", "j": "float", None: "broken"}


def test_consistent_table(spark):
    df, alias = drift(spark, [("a", 1, {"X": 1, "klasse": "3", "odd": "v"}), ("a", 2, {"easting": "bad", "classification": 2.5}), ("a", 2, None)])
    rows = {r.record_id: r for r in consistent_table(df, alias).collect()}
    assert (rows[0].x, rows[0].classification, rows[0].extra, rows[0].failed_casts) == (1.0, 3, {"odd": "v"}, [])
    assert (rows[1].x, rows[1].classification, sorted(rows[1].failed_casts)) == (None, None, ["classification", "x"])
    assert rows[2].is_broken and len(rows) == 3
    assert consistent_table(df.where("false"), alias).count() == 0
