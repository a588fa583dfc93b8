"""The pN_ queries of the core operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaframe.operators.hotkeys import hot_keys, keyed_statistics
from sylvaframe.operators.near import containing_region, neighbour_counts, pairs_within
from sylvaframe.schema import load, valid_points
from sylvaframe.sources.drift import changes, consistent_table, name_fields, path_values
from sylvaframe.sources.records import read_points, rejected

NEAR = 0.0255
HOT_SHARE = 0.03


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(load(spark, sf_dir, "raw_points")).select("raw_id", "reason")


def p2_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read_points(load(spark, sf_dir, "raw_points"))
    return good.select("raw_id", "file_id", "line_no", "x", "y", "z", "instance_id", "semclassid", "specificclassid", F.col("intensity").alias("intensity_text"), "note")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = load(spark, sf_dir, "file_records").select("record_id", "cloud_id", "file_no", "payload")
    named = name_fields(path_values(records), load(spark, sf_dir, "field_alias"))
    return changes(named).select("cloud_id", "file_no", "field_name", "change_kind")


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = consistent_table(load(spark, sf_dir, "file_records"), load(spark, sf_dir, "field_alias"))
    return table.select(*[c for c in table.columns if c not in ("extra", "failed_casts", "received_ts")], F.array_join("failed_casts", ",").alias("failed"), F.size("extra").alias("n_extra"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys(load(spark, sf_dir, "point_cloud"), "instance_id", HOT_SHARE).select("instance_id")


def p5_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = valid_points(load(spark, sf_dir, "point_cloud"), "instance_id")
    # whole millimetres: their sums are exact in any order
    mm = points.select("instance_id", *[F.round(F.col(c) * 1000).alias(c) for c in "xyz"])
    s = keyed_statistics(mm, "instance_id", ["x", "y", "z"])
    return s.select(
        "instance_id", F.col("n_rows").alias("n_points"), *[(F.col(f"{k}_{c}") / 1000).alias(f"{k}_{c}") for k in ("min", "max") for c in "xyz"], *[(F.col(f"sum_{c}") / F.col("n_rows") / 1000).alias(f"mean_{c}") for c in "xyz"]
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = valid_points(load(spark, sf_dir, "point_cloud"), "cloud_id", distinct=False)
    return pairs_within(points, NEAR)


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = valid_points(load(spark, sf_dir, "point_cloud"), "cloud_id", distinct=False)
    return neighbour_counts(points, NEAR)


def p6_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points the square of 4 m around each tree contains."""
    points = valid_points(load(spark, sf_dir, "point_cloud"), "cloud_id", distinct=False)
    t = load(spark, sf_dir, "tree_positions").where("x IS NOT NULL AND y IS NOT NULL").select("cloud_id", F.col("tree_id").alias("region_id"), "x", "y").distinct()
    boxes = t.select("cloud_id", "region_id", *[(F.col(c) + d).alias(f"{c}_{k}") for c in "xy" for k, d in (("min", -2.0), ("max", 2.0))])
    return containing_region(points, boxes).groupBy("region_id").agg(F.count(F.lit(1)).alias("n_points"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_points": p2_points,
    "p4_found": p4_found,
    "p4_table": p4_table,
    "p5_found": p5_found,
    "p5_stats": p5_stats,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
    "p6_regions": p6_regions,
}

VALID = "x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND isfinite(x) AND isfinite(y) AND isfinite(z) AND abs(z) <= 1000"

_FIELD = r'("[^"]*("""[^"]*)*"|[^",]*)'.replace('"""', '""')
_NUM = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
_V = lambda v: rf'(" *{v} *"| *{v} *)'
_SPLIT = f"string_split(regexp_replace(raw_line, '{_FIELD}(,|$)', '\\1' || chr(1), 'g'), chr(1))"

_PARSED = rf"""
WITH r AS (SELECT *, regexp_full_match(raw_line, '{_FIELD}(,{_FIELD})*') AS sound,
                  regexp_full_match(raw_line, '{_FIELD}(,{_FIELD}){{7}}') AS eight,
                  regexp_full_match(raw_line, '{_V(_NUM)},{_V(_NUM)},{_V(_NUM)},{_V("([+-]?[0-9]+)?")}(,{_FIELD}){{4}}') AS formed FROM raw_points),
t AS (SELECT *, CASE WHEN formed THEN list_transform(string_split(raw_line, ',')[1:4], lambda v: trim(trim(v, ' "'), ' ')) END AS v FROM r),
u AS (SELECT *, CASE WHEN raw_line IS NULL THEN 'columns' WHEN NOT sound THEN 'quoting' WHEN NOT eight THEN 'columns'
                     WHEN NOT formed OR abs(CAST(v[1] AS DOUBLE)) > 10000000 OR abs(CAST(v[2] AS DOUBLE)) > 10000000 OR abs(CAST(v[3] AS DOUBLE)) > 10000000
                       OR (v[4] <> '' AND coalesce(TRY_CAST(v[4] AS BIGINT), -2) < -1) THEN 'value' END AS reason FROM t)
"""

ORACLE: dict[str, str] = {
    "p2_found": _PARSED + "SELECT raw_id, reason FROM u WHERE reason IS NOT NULL",
    "p5_found": "SELECT instance_id FROM point_cloud WHERE instance_id IS NOT NULL GROUP BY instance_id HAVING count(*) > 0.03 * (SELECT count(*) FROM point_cloud)",
    "p5_stats": f"""
WITH v AS (SELECT point_id, any_value(instance_id) AS instance_id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM point_cloud WHERE {VALID} AND point_id IS NOT NULL GROUP BY point_id)
SELECT instance_id, count(*) AS n_points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z,
       {", ".join(f"CAST(sum(CAST(round({c} * 1000) AS BIGINT)) AS DOUBLE) / count(*) / 1000.0 AS mean_{c}" for c in "xyz")} FROM v WHERE instance_id IS NOT NULL GROUP BY instance_id""",
}

_RAW = lambda i: f"CASE WHEN starts_with(f[{i}], chr(34)) THEN replace(substr(f[{i}], 2, length(f[{i}]) - 2), repeat(chr(34), 2), chr(34)) ELSE f[{i}] END"
ORACLE["p2_points"] = _PARSED + rf""", g AS (SELECT *, regexp_extract_all(raw_line, '(?:^|,){_FIELD.replace('("[^', '((?:"[^', 1).replace('""[^"]*)*"|[^",]*)', '""[^"]*)*"|[^",]*))', 1)}', 1) AS f FROM u WHERE reason IS NULL)
SELECT raw_id, file_id, line_no, CAST(v[1] AS DOUBLE) AS x, CAST(v[2] AS DOUBLE) AS y, CAST(v[3] AS DOUBLE) AS z, TRY_CAST(v[4] AS BIGINT) AS instance_id, {_RAW(5)} AS semclassid, {_RAW(6)} AS specificclassid, {_RAW(7)} AS intensity_text, {_RAW(8)} AS note FROM g"""

_NEAR_SQL = f"""
WITH v AS (SELECT DISTINCT cloud_id, point_id, x, y, z FROM point_cloud WHERE {VALID} AND point_id IS NOT NULL AND cloud_id IS NOT NULL),
c AS (SELECT *, CAST(floor(x / 0.03) AS BIGINT) AS cx, CAST(floor(y / 0.03) AS BIGINT) AS cy FROM v),
e AS (SELECT c.*, cx + dx AS nx, cy + dy AS ny FROM c, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy)),
p AS (SELECT c.point_id AS point_id_a, e.point_id AS point_id_b FROM c JOIN e ON c.cloud_id = e.cloud_id AND c.cx = e.nx AND c.cy = e.ny AND c.point_id < e.point_id
      WHERE (c.x - e.x) * (c.x - e.x) + (c.y - e.y) * (c.y - e.y) + (c.z - e.z) * (c.z - e.z) <= 0.0255 * 0.0255)
"""
ORACLE["p6_found"] = _NEAR_SQL + "SELECT point_id_a, point_id_b FROM p"
ORACLE["p6_counts"] = _NEAR_SQL + "SELECT point_id, count(*) AS n_near FROM (SELECT point_id_a AS point_id FROM p UNION ALL SELECT point_id_b FROM p) AS q GROUP BY point_id"

ORACLE["p6_regions"] = f"""
WITH v AS (SELECT DISTINCT cloud_id, point_id, x, y FROM point_cloud WHERE {VALID} AND point_id IS NOT NULL),
t AS (SELECT DISTINCT cloud_id, tree_id, x, y FROM tree_positions WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT t.tree_id AS region_id, count(*) AS n_points FROM t JOIN v ON t.cloud_id = v.cloud_id AND v.x BETWEEN t.x - 2.0 AND t.x + 2.0 AND v.y BETWEEN t.y - 2.0 AND t.y + 2.0 GROUP BY t.tree_id"""

_KIND_SQL = """
WITH raw AS (SELECT record_id, cloud_id, file_no, payload, unnest(json_keys(payload)) AS path FROM file_records),
v AS (SELECT *, json_extract(payload, '$."' || path || '"') AS j FROM raw),
s AS (SELECT *, lower(regexp_replace(path, '[^A-Za-z0-9]', '', 'g')) AS spelling FROM v),
n AS (SELECT s.*, coalesce(a.field_name, s.spelling) AS field_name FROM s LEFT JOIN (SELECT DISTINCT alias_key, field_name FROM field_alias) AS a ON a.alias_key = s.spelling),
k AS (SELECT cloud_id, file_no, field_name, string_agg(DISTINCT path, chr(1) ORDER BY path) AS sp,
             CASE WHEN bool_or(json_type(j) = 'VARCHAR') THEN 'text' WHEN bool_or(json_type(j) = 'DOUBLE') THEN 'float' WHEN bool_or(json_type(j) IN ('UBIGINT', 'BIGINT')) THEN 'integer' END AS kind
      FROM n GROUP BY cloud_id, file_no, field_name),
f AS (SELECT cloud_id, file_no, lag(file_no) OVER (PARTITION BY cloud_id ORDER BY file_no) AS prev FROM (SELECT DISTINCT cloud_id, file_no FROM file_records) AS d),
b AS (SELECT k.cloud_id, k.file_no, k.field_name, k.sp, k.kind, f.prev FROM k JOIN f ON k.cloud_id = f.cloud_id AND k.file_no = f.file_no WHERE f.prev IS NOT NULL),
o AS (SELECT k.cloud_id, f.file_no, k.field_name, k.sp, k.kind FROM k JOIN f ON k.cloud_id = f.cloud_id AND k.file_no = f.prev),
m AS (SELECT coalesce(b.cloud_id, o.cloud_id) AS cloud_id, coalesce(b.file_no, o.file_no) AS file_no, coalesce(b.field_name, o.field_name) AS field_name, b.sp AS now, o.sp AS was, b.kind AS kn, o.kind AS kw
      FROM b FULL OUTER JOIN o ON b.cloud_id = o.cloud_id AND b.file_no = o.file_no AND b.field_name = o.field_name)
"""
_TARGETS = {"x": "double", "y": "double", "z": "double", "instance_id": "bigint", "classification": "bigint", "semclassid": "bigint", "specificclassid": "bigint", "semclassidpredicted": "bigint", "specificclassidpredicted": "bigint", "intensity": "double"}


def _cast_sql(field: str, kind: str) -> str:
    c = f"r_{field}"
    if kind == "double":
        return f"TRY_CAST({c} AS DOUBLE)"
    return f"CASE WHEN TRY_CAST({c} AS DECIMAL(38, 10)) = floor(TRY_CAST({c} AS DECIMAL(38, 10))) THEN TRY_CAST({c} AS BIGINT) END"


ORACLE["p4_table"] = _KIND_SQL.split("k AS (SELECT cloud_id, file_no, field_name, string_agg")[0] + f"""
w AS (SELECT record_id, {", ".join(f"min_by(json_extract_string(payload, '$.' || chr(34) || path || chr(34)), path) FILTER (field_name = '{f}' AND json_type(j) <> 'NULL') AS r_{f}" for f in _TARGETS)}, count(DISTINCT path) FILTER (field_name NOT IN ({", ".join(f"'{f}'" for f in _TARGETS)})) AS n_extra FROM n GROUP BY record_id)
SELECT r.record_id, r.cloud_id, r.file_no, {", ".join(f"{_cast_sql(f, k)} AS {f}" for f, k in _TARGETS.items())}, false AS is_broken, array_to_string(list_filter([{", ".join(f"CASE WHEN r_{f} IS NOT NULL AND {_cast_sql(f, k)} IS NULL THEN '{f}' END" for f, k in _TARGETS.items())}], lambda v: v IS NOT NULL), ',') AS failed, CAST(n_extra AS INTEGER) AS n_extra
FROM (SELECT DISTINCT record_id, cloud_id, file_no FROM file_records) AS r JOIN w ON r.record_id = w.record_id"""
ORACLE["p4_found"] = _KIND_SQL + " UNION ALL ".join(
    f"SELECT cloud_id, file_no, field_name, '{k}' AS change_kind FROM m WHERE {w}" for k, w in (("added", "was IS NULL"), ("removed", "now IS NULL"), ("renamed", "now <> was"), ("retyped", "kn <> kw"))
)
