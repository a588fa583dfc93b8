"""The pN_ queries of the operators for training data, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaframe.llm.clusters import coarse_model, describe, fine_clusters, tight_groups, trunk_points, vectors
from sylvaframe.llm.encoding import encode_corpus, token_counts
from sylvaframe.llm.packing import container_table, pack
from sylvaframe.llm.quantiles import medians_above, merge_sketches, percentiles, sketches
from sylvaframe.llm.reading import calibration, demanding, reading_levels
from sylvaframe.llm.splitting import found_strips, piece_table, split_oversized
from sylvaframe.schema import load, valid_points
from sylvaframe.session import cut


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_strips(load(spark, sf_dir, "point_cloud"), limit=1000, min_gap=3.0)


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_table(split_oversized(load(spark, sf_dir, "point_cloud"), limit=1000, margin=1.0))


def p1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: its points (each in one core only), whether it was split, and pieces above the limit (none)."""
    members = split_oversized(load(spark, sf_dir, "point_cloud"), limit=1000, margin=0.0)
    sized = members.groupBy("file_id", "piece_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("point_id").alias("d"))
    return sized.groupBy("file_id").agg(F.sum("n").alias("n_rows"), F.sum("d").alias("n_points"), (F.count(F.lit(1)) > 1).alias("is_split"), F.count_if(F.col("n") > 1000).alias("n_over"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tight_groups(load(spark, sf_dir, "point_cloud"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, divided = fine_clusters(trunk_points(load(spark, sf_dir, "point_cloud")))
    d = describe(cut(labelled)).join(divided, "cluster")
    return d.select("parent", "cloud_id", "cluster", "size", *[F.round(f"centre_{c}", 3).alias(f"centre_{c}") for c in "xyz"], F.to_json("typical").alias("typical"), F.to_json("labels").alias("labels"))


def p3_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cloud: the points in all its clusters, and how many of them are listed by label."""
    labelled, _ = fine_clusters(trunk_points(load(spark, sf_dir, "point_cloud")))
    d = describe(cut(labelled)).withColumn("labelled", F.aggregate("labels", F.lit(0).cast("bigint"), lambda t, v: t + v["n"]))
    return d.groupBy("cloud_id").agg(F.sum("size").alias("n_points"), F.sum("labelled").alias("n_labelled"))


def p3_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of the coarse clusters after the seeding (step 0) and after each step."""
    model = coarse_model(cut(vectors(trunk_points(load(spark, sf_dir, "point_cloud")))))
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(model.costs if model else [])], "step int, cost double")


def _instance_z(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    points = valid_points(load(spark, sf_dir, "point_cloud"), "instance_id", *more)
    return points.where(F.col("instance_id") >= 0).select("instance_id", "z", *more)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medians_above(_instance_z(spark, sf_dir), "instance_id", "z", 12.0, 10, k=32)


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by file, merged by instance."""
    by_file = sketches(_instance_z(spark, sf_dir, "file_id"), ["instance_id", "file_id"], "z")
    return percentiles(merge_sketches(by_file, ["instance_id"]), ["instance_id"], (0.5, 0.9, 0.99))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(load(spark, sf_dir, "documents"))


CAPACITY = 4096


def p9_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(load(spark, sf_dir, "documents")), CAPACITY)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_table(p9_assignment(spark, sf_dir))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents placed, none cut that would have fitted, no container above its capacity, few of them more than needed."""
    packed = p9_assignment(spark, sf_dir)
    docs = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("parts"))
    placed = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if((F.col("parts") > 1) & (F.col("size") <= CAPACITY)).alias("n_cut"))
    c = container_table(packed).agg(F.count_if(F.col("fill") > CAPACITY).alias("n_over"), (F.count(F.lit(1)) <= 1.02 * F.ceil(F.sum("fill") / CAPACITY) + 1).alias("is_tight"))
    return placed.crossJoin(c)  # one row each


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(load(spark, sf_dir, "documents"), load(spark, sf_dir, "reading_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demanding(load(spark, sf_dir, "documents"), load(spark, sf_dir, "reading_labels"))


def p10_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration(load(spark, sf_dir, "documents"), load(spark, sf_dir, "reading_labels"))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "n_sentences", "n_words", "n_letters", "level", F.round("demand", 3).alias("demand"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_files": p1_files,
    "p3_found": p3_found,
    "p3_clusters": p3_clusters,
    "p3_sizes": p3_sizes,
    "p3_costs": p3_costs,
    "p7_found": p7_found,
    "p7_percentiles": p7_percentiles,
    "p8_ids": p8_ids,
    "p9_assignment": p9_assignment,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
    "p10_calibration": p10_calibration,
}

VALID = "x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND isfinite(x) AND isfinite(y) AND isfinite(z) AND abs(z) <= 1000 AND point_id IS NOT NULL"

ORACLE: dict[str, str] = {
    "p1_found": f"""
WITH v AS (SELECT DISTINCT file_id, point_id, x, y FROM point_cloud WHERE {VALID} AND file_id IS NOT NULL),
o AS (SELECT v.* FROM v JOIN (SELECT file_id FROM v GROUP BY file_id HAVING count(*) > 1000) AS f ON v.file_id = f.file_id),
a AS (SELECT file_id, 'x' AS axis_name, x AS c, point_id FROM o UNION ALL SELECT file_id, 'y', y, point_id FROM o),
d AS (SELECT file_id, axis_name, c, min(point_id) AS id FROM a GROUP BY file_id, axis_name, c),
g AS (SELECT *, lag(c) OVER w AS pc, lag(id) OVER w AS pid FROM d WINDOW w AS (PARTITION BY file_id, axis_name ORDER BY c))
SELECT file_id, axis_name, least(id, pid) AS point_id_a, greatest(id, pid) AS point_id_b FROM g WHERE c - pc > 3.0""",
    "p3_found": f"""
WITH v AS (SELECT DISTINCT cloud_id, point_id, x, y, z FROM point_cloud WHERE {VALID} AND cls = 1 AND cloud_id IS NOT NULL),
c AS (SELECT *, CAST(floor(x / 2.5) AS BIGINT) AS cx, CAST(floor(y / 2.5) AS BIGINT) AS cy FROM v),
e AS (SELECT c.*, cx + dx AS nx, cy + dy AS ny FROM c, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy)),
p AS (SELECT c.point_id AS a, e.point_id AS b, (c.x - e.x) * (c.x - e.x) + (c.y - e.y) * (c.y - e.y) + (c.z - e.z) * (c.z - e.z) AS d2
      FROM c JOIN e ON c.cloud_id = e.cloud_id AND c.cx = e.nx AND c.cy = e.ny),
n AS (SELECT a, list_sort(list(b)) AS around, max(d2) AS far FROM p WHERE d2 <= 6.25 GROUP BY a),
t AS (SELECT around FROM n GROUP BY around HAVING count(*) = len(around) AND count(*) >= 5 AND max(far) <= 2.25)
SELECT around[1] AS group_id, a AS point_id FROM n WHERE around IN (SELECT around FROM t)""",
    "p7_found": f"""
WITH v AS (SELECT DISTINCT instance_id, point_id, z FROM (SELECT instance_id, point_id, x, y, z FROM point_cloud WHERE {VALID}) AS p WHERE instance_id >= 0)
SELECT instance_id FROM v GROUP BY instance_id HAVING count(*) >= 10 AND quantile_cont(z, 0.5) > 12.0""",
    "p1_files": f"""
SELECT file_id, count(*) AS n_rows, count(*) AS n_points, count(*) > 1000 AS is_split, CAST(0 AS BIGINT) AS n_over
FROM (SELECT DISTINCT file_id, point_id FROM point_cloud WHERE {VALID} AND file_id IS NOT NULL) AS v GROUP BY file_id""",
    "p3_sizes": f"SELECT cloud_id, count(DISTINCT point_id) AS n_points, count(DISTINCT point_id) AS n_labelled FROM point_cloud WHERE {VALID} AND cls = 1 AND cloud_id IS NOT NULL GROUP BY cloud_id",
    "p9_fill": "SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS n_cut, CAST(0 AS BIGINT) AS n_over, true AS is_tight FROM documents",
}
