"""Queries of the operators, one or more per operator, and their SQL.

Every query reads its whole tables. Distinct valid points are what the operators work on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaframe.functions import columns as C
from sylvaframe.functions.colors import BACKGROUND, color_classes, color_errors, color_instances, palette
from sylvaframe.operators import cluster as CL
from sylvaframe.operators import fit as FIT
from sylvaframe.operators import groups as G
from sylvaframe.operators import metrics as M
from sylvaframe.operators import morph as MO
from sylvaframe.operators import nearest as N
from sylvaframe.operators import raster as R
from sylvaframe.operators import stems as ST
from sylvaframe.plans.evaluation import evaluate
from sylvaframe.plans.pipelines import PRESETS, CanopyParameters, CanopyPipeline, StemPipeline
from sylvaframe.schema import load, valid_points
from sylvaframe.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
Spark, Dir = SparkSession, str

VALID = "x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND isfinite(x) AND isfinite(y) AND isfinite(z) AND abs(z) <= 1000 AND point_id IS NOT NULL"
COLS = ("cloud_id", "intensity", "cls", "target", "prediction", "instance_id", "classification", "semclassid", "specificclassid", "semclassidpredicted")
PTS = f"WITH v AS (SELECT point_id, {', '.join(f'any_value({c}) AS {c}' for c in ('x', 'y', 'z', *COLS))} FROM point_cloud WHERE {VALID} GROUP BY point_id)"


def query(sql: str | None = None, *, name: str | None = None):
    """Registers a query by its function's name."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return add


def pts(spark: Spark, d: Dir) -> DataFrame:
    return valid_points(load(spark, d, "point_cloud"), *COLS)


def r6(c, name: str):
    """Rounded half away from zero on the double itself, as SQL does it."""
    return F.round(c, 6).alias(name)


# ---- projections and predicates ----------------------------------------------------------------


@query(f"{PTS} SELECT cloud_id, point_id FROM v WHERE cls IN (1, 2, 3)")
def b1_tree_points(spark: Spark, d: Dir) -> DataFrame:
    return pts(spark, d).where(C.is_tree_point()).select("cloud_id", "point_id")


@query(f"{PTS} SELECT cloud_id, point_id, z >= 4.0 AS is_candidate FROM v WHERE z >= 1.0 AND z < 2.5 OR z >= 4.0")
def b2_b3_band_and_candidates(spark: Spark, d: Dir) -> DataFrame:
    p = pts(spark, d).where(C.in_band("z", 1.0, 2.5) | C.is_candidate("z", 4.0))
    return p.select("cloud_id", "point_id", C.is_candidate("z", 4.0).alias("is_candidate"))


REMAP = {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 3, (0, 0): 0, (2, 0): 4, (3, 0): 4, (4, 0): 4}
_REMAP_SQL = " ".join(f"WHEN semclassid = {a} AND specificclassid = {b} THEN {v}" for (a, b), v in REMAP.items())


@query(f"{PTS}, m AS (SELECT *, CASE {_REMAP_SQL} END AS class_id FROM v) SELECT class_id, count(*) AS n, sum(CASE WHEN class_id IN (1, 2, 3) THEN instance_id ELSE -1 END) AS sum_instance FROM m GROUP BY class_id")
def b4_remap_classes(spark: Spark, d: Dir) -> DataFrame:
    p = pts(spark, d).withColumn("class_id", C.remap_class(REMAP, "semclassid", "specificclassid"))
    inst = F.when(F.col("class_id").isin(1, 2, 3), F.col("instance_id")).otherwise(-1)
    return p.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.sum(inst).alias("sum_instance"))


_RELABEL = "d AS (SELECT cloud_id, instance_id, row_number() OVER (PARTITION BY cloud_id ORDER BY instance_id) - 1 AS r FROM (SELECT DISTINCT cloud_id, instance_id FROM {src} WHERE instance_id >= 0) AS q)"


@query(f"{PTS}, {_RELABEL.format(src='v')} SELECT v.cloud_id, v.point_id, coalesce(d.r, -1) AS instance_id FROM v LEFT JOIN d ON v.cloud_id = d.cloud_id AND v.instance_id = d.instance_id")
def b5_relabel(spark: Spark, d: Dir) -> DataFrame:
    return G.relabel(pts(spark, d)).select("cloud_id", "point_id", "instance_id")


@query(f"{PTS} SELECT point_id, CASE WHEN instance_id < 0 THEN 0 ELSE instance_id + 1 END AS instance_id FROM v WHERE instance_id IS NOT NULL")
def b6_remap_invalid(spark: Spark, d: Dir) -> DataFrame:
    return pts(spark, d).where("instance_id IS NOT NULL").select("point_id", C.remap_invalid("instance_id", 0).cast("bigint").alias("instance_id"))


RES = 16.0
_DTM = """
n AS (SELECT cloud_id, ix, iy, min(h) AS h FROM dtm WHERE h IS NOT NULL AND isfinite(h) AND abs(h) <= 1000 GROUP BY cloud_id, ix, iy),
e AS (SELECT cloud_id, min(ix) AS lx, max(ix) AS hx, min(iy) AS ly, max(iy) AS hy FROM dtm GROUP BY cloud_id),
p AS (SELECT v.*, least(greatest(x / 16.0, lx), hx) AS px, least(greatest(y / 16.0, ly), hy) AS py, lx, hx, ly, hy FROM v JOIN e ON v.cloud_id = e.cloud_id),
q AS (SELECT *, greatest(least(CAST(floor(px) AS BIGINT), hx - 1), lx) AS cx, greatest(least(CAST(floor(py) AS BIGINT), hy - 1), ly) AS cy FROM p),
w AS (SELECT q.point_id, n.h, (CASE WHEN n.ix = q.cx THEN 1 - (px - cx) ELSE px - cx END) * (CASE WHEN n.iy = q.cy THEN 1 - (py - cy) ELSE py - cy END) AS w
      FROM q JOIN n ON q.cloud_id = n.cloud_id AND n.ix IN (q.cx, q.cx + 1) AND n.iy IN (q.cy, q.cy + 1)),
g AS (SELECT point_id, sum(w * h) / nullif(sum(w), 0) AS ground FROM w GROUP BY point_id)
"""


@query(f"{PTS}, {_DTM} SELECT q.cloud_id, q.point_id, round(q.z - g.ground, 6) AS height FROM q LEFT JOIN g ON q.point_id = g.point_id")
def b7_height_above_terrain(spark: Spark, d: Dir) -> DataFrame:
    p = pts(spark, d).select("cloud_id", "point_id", "x", "y", "z")
    dtm = load(spark, d, "dtm")
    known = p.join(dtm.select("cloud_id").distinct(), "cloud_id", "left_semi")
    return R.height_above_terrain(known, dtm, RES).select("cloud_id", "point_id", r6(F.col("height"), "height"))


_LAYERS = "l AS (SELECT DISTINCT cloud_id, stem_id, layer, mid_height, circle.cx AS cx, circle.cy AS cy, circle.r AS r, ellipse.cx AS ex, ellipse.cy AS ey, ellipse.a AS a, ellipse.b AS b, ellipse.theta AS theta FROM stem_layers)"


def layers(spark: Spark, d: Dir) -> DataFrame:
    """One row per stem and layer; shapes filled with -1 count as missing."""
    rows = load(spark, d, "stem_layers").select("cloud_id", "stem_id", "layer", "mid_height", *[F.col(f"circle.{c}").alias(c) for c in ("cx", "cy", "r")], F.col("ellipse.cx").alias("ex"), F.col("ellipse.cy").alias("ey"), *[F.col(f"ellipse.{c}").alias(c) for c in ("a", "b", "theta")])
    return rows.distinct()


@query(f"{PTS}, {_LAYERS}, s AS (SELECT * FROM l WHERE a > 0 AND b > 0), j AS (SELECT s.cloud_id, s.stem_id, s.layer, v.x - ex AS dx, v.y - ey AS dy, s.* EXCLUDE (cloud_id, stem_id, layer) FROM s JOIN v ON s.cloud_id = v.cloud_id AND v.cls = 1 AND v.instance_id = s.stem_id) SELECT cloud_id, stem_id, layer, count(*) AS n, sum(CASE WHEN pow((dx * cos(theta) + dy * sin(theta)) / a, 2) + pow((dy * cos(theta) - dx * sin(theta)) / b, 2) <= 1 THEN 1 ELSE 0 END) AS n_inside FROM j GROUP BY cloud_id, stem_id, layer")
def b8_points_in_ellipse(spark: Spark, d: Dir) -> DataFrame:
    e = layers(spark, d).where("a > 0 AND b > 0").withColumnRenamed("cloud_id", "g")
    p = pts(spark, d).where("cls = 1").select("cloud_id", "x", "y", "instance_id")
    j = p.join(e, (F.col("cloud_id") == F.col("g")) & (F.col("instance_id") == F.col("stem_id")))
    inside = C.in_ellipse("x", "y", "ex", "ey", "a", "b", "theta")
    return j.groupBy("cloud_id", "stem_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_inside"))


@query("WITH s AS (SELECT DISTINCT cloud_id, tree_id, x, y FROM tree_positions WHERE y IS NOT NULL), o AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first(x) OVER w AS fx, first(y) OVER w AS fy FROM s WINDOW w AS (PARTITION BY cloud_id ORDER BY tree_id)) SELECT cloud_id, round(abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2, 2) AS area FROM o GROUP BY cloud_id")
def b9_g7_polygon_area(spark: Spark, d: Dir) -> DataFrame:
    t = load(spark, d, "tree_positions").where("y IS NOT NULL").select("cloud_id", "tree_id", "x", "y").distinct()
    ring = t.groupBy("cloud_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tree_id", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return ring.select("cloud_id", F.round(C.polygon_area("ring"), 2).alias("area"))


@query(f"{PTS}, s AS (SELECT DISTINCT cloud_id, stem_id, x AS cx, y AS cy FROM stems) SELECT v.point_id, s.stem_id, s.cx, s.cy, round(sqrt(pow(v.x - cx, 2) + pow(v.y - cy, 2)), 6) AS r, round(atan2(v.y - cy, v.x - cx), 6) AS theta FROM v JOIN s ON v.cloud_id = s.cloud_id AND v.instance_id = s.stem_id WHERE v.cls = 1")
def b10_polar(spark: Spark, d: Dir) -> DataFrame:
    s = load(spark, d, "stems").select(F.col("cloud_id").alias("g"), "stem_id", F.col("x").alias("cx"), F.col("y").alias("cy")).distinct()
    p = pts(spark, d).where("cls = 1").join(s, (F.col("cloud_id") == F.col("g")) & (F.col("instance_id") == F.col("stem_id")))
    p = p.withColumn("q", C.polar("x", "y", "cx", "cy"))
    return p.select("point_id", "stem_id", "cx", "cy", r6(F.col("q.r"), "r"), r6(F.col("q.theta"), "theta"))


@query(f"{PTS} SELECT cloud_id, CAST(floor(x / 0.5) AS BIGINT) AS ix, CAST(floor(y / 0.5) AS BIGINT) AS iy, CAST(trunc(z / 0.5) AS BIGINT) AS tz, count(*) AS n FROM v GROUP BY 1, 2, 3, 4")
def b11_b12_grid_index(spark: Spark, d: Dir) -> DataFrame:
    p = pts(spark, d)
    return p.groupBy("cloud_id", C.cell_index("x", 0.5).alias("ix"), C.cell_index("y", 0.5).alias("iy"), C.truncated_index("z", 0.5).alias("tz")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{PTS} SELECT cloud_id, instance_id, count(*) AS n, round(quantile_cont(z, 0.95), 6) AS q95 FROM v WHERE instance_id >= 0 GROUP BY cloud_id, instance_id")
def b14_quantile(spark: Spark, d: Dir) -> DataFrame:
    p = pts(spark, d).where("instance_id >= 0")
    return p.groupBy("cloud_id", "instance_id").agg(F.count(F.lit(1)).alias("n"), r6(F.percentile("z", 0.95), "q95"))


@query(f"{PTS}, u AS (SELECT cloud_id, instance_id, x AS v FROM v WHERE instance_id >= 0 UNION ALL SELECT cloud_id, instance_id, y FROM v WHERE instance_id >= 0) SELECT cloud_id, instance_id, round(stddev_pop(v), 3) AS scale FROM u GROUP BY cloud_id, instance_id")
def b15_isotropic_scale(spark: Spark, d: Dir) -> DataFrame:
    return G.isotropic_scale(pts(spark, d)).select("cloud_id", "instance_id", F.round("scale", 3).alias("scale"))


# ---- joins -------------------------------------------------------------------------------------


_GROUND = "sv AS (SELECT stem_id AS point_id, cloud_id, min(x) AS x, min(y) AS y, 0.0 AS z FROM stems WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY stem_id, cloud_id), " + _DTM.strip().replace("SELECT v.*, least", "SELECT sv.*, least").replace("FROM v JOIN e ON v.cloud_id", "FROM sv JOIN e ON sv.cloud_id") + ", gr AS (SELECT point_id AS stem_id, ground AS terrain FROM g)"


def stem_ground(spark: Spark, d: Dir) -> DataFrame:
    """stem_id and the terrain's height at the stem."""
    s = load(spark, d, "stems").where("x IS NOT NULL AND y IS NOT NULL").groupBy("cloud_id", "stem_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).withColumn("z", F.lit(0.0))
    return R.height_above_terrain(s, load(spark, d, "dtm"), RES).select("stem_id", (-F.col("height")).alias("terrain")).where("terrain IS NOT NULL")


@query(f"{PTS}, {_GROUND}, {_LAYERS}, a AS (SELECT l.*, gr.terrain, CASE WHEN 2 * r <= 0.3 THEN 0.06 ELSE 0.09 END AS w FROM l JOIN gr ON l.stem_id = gr.stem_id WHERE r > 0) SELECT a.cloud_id, a.stem_id, a.layer, v.point_id FROM a JOIN v ON a.cloud_id = v.cloud_id AND v.x BETWEEN cx - r - w AND cx + r + w AND v.y BETWEEN cy - r - w AND cy + r + w WHERE v.z - terrain BETWEEN mid_height - 0.3 AND mid_height + 0.3 AND (v.x - cx) * (v.x - cx) + (v.y - cy) * (v.y - cy) BETWEEN greatest(r - w, 0) * greatest(r - w, 0) AND (r + w) * (r + w)")
def c5_points_in_annulus(spark: Spark, d: Dir) -> DataFrame:
    """Points of any class in the ring around each fitted circle, within its layer (0.6 m high)."""
    return ST.points_near_circles(pts(spark, d), layers(spark, d), stem_ground(spark, d), height=0.6)


_POS = "t AS (SELECT DISTINCT cloud_id, stem_id AS id, x, y FROM stems WHERE x IS NOT NULL AND y IS NOT NULL), c AS (SELECT DISTINCT cloud_id, tree_id AS id, x, y FROM tree_positions WHERE y IS NOT NULL)"


@query(f"WITH {_POS}, j AS (SELECT t.id AS a, c.id AS b, pow(t.x - c.x, 2) + pow(t.y - c.y, 2) AS d2 FROM t JOIN c ON t.cloud_id = c.cloud_id), f AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d2, a) AS rb FROM j) SELECT a AS a_id, b AS b_id FROM f WHERE ra = 1 AND rb = 1 AND d2 <= 25.0")
def c3_mutual_nearest(spark: Spark, d: Dir) -> DataFrame:
    return N.mutual_nearest(*_positions(spark, d), 5.0)


@query(f"WITH {_POS}, j AS (SELECT t.id AS a, c.id AS b, c.x AS bx, c.y AS byy, pow(t.x - c.x, 2) + pow(t.y - c.y, 2) AS d2 FROM t JOIN c ON t.cloud_id = c.cloud_id), f AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d2, a) AS rb FROM j), m AS (SELECT * FROM f WHERE ra = 1 AND rb = 1 AND d2 <= 25.0) SELECT t.cloud_id, t.id, 'trunk' AS kind, coalesce(m.bx, t.x) AS x, coalesce(m.byy, t.y) AS y FROM t LEFT JOIN m ON t.id = m.a UNION ALL SELECT c.cloud_id, c.id, 'crown', c.x, c.y FROM c WHERE c.id NOT IN (SELECT b FROM m)")
def c12_h1_tree_positions(spark: Spark, d: Dir) -> DataFrame:
    return N.tree_positions(*_positions(spark, d), 5.0)


def _positions(spark: Spark, d: Dir) -> tuple[DataFrame, DataFrame]:
    t = load(spark, d, "stems").where("x IS NOT NULL AND y IS NOT NULL").select("cloud_id", F.col("stem_id").alias("id"), "x", "y").distinct()
    c = load(spark, d, "tree_positions").where("y IS NOT NULL").select("cloud_id", F.col("tree_id").alias("id"), "x", "y").distinct()
    return t, c


_KNN = "j AS (SELECT a.cloud_id, a.point_id AS p, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM v AS a JOIN v AS b ON a.cloud_id = b.cloud_id AND a.point_id <> b.point_id)"


@query(f"{PTS}, {_KNN} SELECT p AS query_id, round(list_sum([sqrt(q) for q in min(d2, 26)]), 6) AS total FROM j GROUP BY p")
def c4_c9_self_knn(spark: Spark, d: Dir) -> DataFrame:
    """All points and k = 27, the point itself included."""
    p = pts(spark, d).select("cloud_id", "point_id", "x", "y", "z")
    near = N.nearest_lists(p, None, 26, dims=("x", "y", "z"), query_id="point_id", exclude_self=True, reduce=N.distance_sum)
    return near.where("n > 0").select("query_id", r6(F.col("total"), "total"))


@query(f"{PTS}, {_KNN}, m AS (SELECT p, any_value(cloud_id) AS cloud_id, list_avg([sqrt(q) for q in min(d2, 4)]) AS md FROM j GROUP BY p), l AS (SELECT cloud_id, avg(md) + 1.5 * stddev_pop(md) AS lim FROM m GROUP BY cloud_id), n AS (SELECT cloud_id, count(*) AS n FROM v GROUP BY cloud_id) SELECT v.cloud_id, v.point_id FROM v JOIN n ON v.cloud_id = n.cloud_id LEFT JOIN m ON v.point_id = m.p LEFT JOIN l ON v.cloud_id = l.cloud_id WHERE m.md IS NULL OR n.n <= 2 OR m.md <= l.lim")
def d9_remove_outliers(spark: Spark, d: Dir) -> DataFrame:
    p = pts(spark, d).select("cloud_id", "point_id", "x", "y", "z")
    return N.remove_outliers(p, 4, 1.5).select("cloud_id", "point_id")


NODES = "n AS (SELECT DISTINCT cloud_id, ix, iy FROM dtm)"


@query(f"{PTS}, g AS (SELECT * FROM v WHERE cls = 0), n AS (SELECT cloud_id, ix, iy, row_number() OVER (ORDER BY cloud_id, ix, iy) AS nid FROM (SELECT DISTINCT cloud_id, ix, iy FROM dtm) AS q), j AS (SELECT n.cloud_id, n.ix, n.iy, g.z, g.point_id, pow(n.ix * 16.0 - g.x, 2) + pow(n.iy * 16.0 - g.y, 2) AS d2 FROM n JOIN g ON n.cloud_id = g.cloud_id), k AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, ix, iy ORDER BY d2, point_id) AS r FROM j) SELECT cloud_id, ix, iy, round(coalesce(avg(CASE WHEN d2 = 0 THEN z END), sum(CASE WHEN d2 > 0 THEN z / sqrt(d2) END) / sum(CASE WHEN d2 > 0 THEN 1 / sqrt(d2) END)), 6) AS h FROM k WHERE r <= 8 GROUP BY cloud_id, ix, iy")
def c1_d8_terrain_model(spark: Spark, d: Dir) -> DataFrame:
    """Heights of the raster's nodes from the 8 nearest ground points."""
    n = load(spark, d, "dtm").select("cloud_id", "ix", "iy").distinct()
    n = n.select("*", (F.col("ix") * RES).alias("x"), (F.col("iy") * RES).alias("y"), F.xxhash64("cloud_id", "ix", "iy").alias("query_id"))
    ground = pts(spark, d).where("cls = 0").select("cloud_id", "point_id", "x", "y", "z")
    h = R_interpolate(n, ground)
    return n.join(h, "query_id").select("cloud_id", "ix", "iy", r6(F.col("h"), "h"))


def R_interpolate(nodes: DataFrame, ground: DataFrame) -> DataFrame:
    return N.interpolate_terrain(nodes, ground, 8, 1.0)


# ---- aggregations ------------------------------------------------------------------------------


@query(f"{PTS}, k AS (SELECT *, CAST(floor(x / 0.5) AS BIGINT) AS vx, CAST(floor(y / 0.5) AS BIGINT) AS vy, CAST(floor(z / 0.5) AS BIGINT) AS vz FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, vx, vy, vz ORDER BY (x - (floor(x / 0.5) + 0.5) * 0.5) * (x - (floor(x / 0.5) + 0.5) * 0.5) + (y - (floor(y / 0.5) + 0.5) * 0.5) * (y - (floor(y / 0.5) + 0.5) * 0.5) + (z - (floor(z / 0.5) + 0.5) * 0.5) * (z - (floor(z / 0.5) + 0.5) * 0.5), point_id) AS i FROM k) SELECT cloud_id, vx, vy, vz, point_id FROM r WHERE i = 1")
def d1_voxel_downsample(spark: Spark, d: Dir) -> DataFrame:
    return G.voxel_downsample(pts(spark, d).select("cloud_id", "point_id", "x", "y", "z"), 0.5).select("cloud_id", "vx", "vy", "vz", "point_id")


@query(f"{PTS}, k AS (SELECT cloud_id, CAST(floor(x / 0.5) AS BIGINT) AS vx, CAST(floor(y / 0.5) AS BIGINT) AS vy, CAST(floor(z / 0.5) AS BIGINT) AS vz, point_id, instance_id, x, y, z FROM v), r AS (SELECT *, first(instance_id) OVER (PARTITION BY cloud_id, vx, vy, vz ORDER BY (x - (floor(x / 0.5) + 0.5) * 0.5) * (x - (floor(x / 0.5) + 0.5) * 0.5) + (y - (floor(y / 0.5) + 0.5) * 0.5) * (y - (floor(y / 0.5) + 0.5) * 0.5) + (z - (floor(z / 0.5) + 0.5) * 0.5) * (z - (floor(z / 0.5) + 0.5) * 0.5), point_id) AS own FROM k) SELECT point_id, own AS instance_id FROM r")
def c13_upsample(spark: Spark, d: Dir) -> DataFrame:
    p = pts(spark, d).select("cloud_id", "point_id", "x", "y", "z", "instance_id")
    return G.upsample(p, G.voxel_downsample(p, 0.5), 0.5, "instance_id").select("point_id", "instance_id")


def _filtered(having: str) -> str:
    return f"{PTS}, s AS (SELECT cloud_id, instance_id FROM v WHERE instance_id >= 0 GROUP BY cloud_id, instance_id HAVING {having}), {_RELABEL.format(src='s')} SELECT v.point_id, coalesce(d.r, -1) AS instance_id FROM v LEFT JOIN d ON v.cloud_id = d.cloud_id AND v.instance_id = d.instance_id"


@query(_filtered("count(*) >= 30"))
def d2_filter_min_points(spark: Spark, d: Dir) -> DataFrame:
    return G.filter_min_points(pts(spark, d), 30).select("point_id", "instance_id")


@query(_filtered("max(z) - min(z) >= 10.0"))
def d3_filter_extent(spark: Spark, d: Dir) -> DataFrame:
    return G.filter_extent(pts(spark, d), 10.0).select("point_id", "instance_id")


@query(_filtered("quantile_cont(CASE WHEN isfinite(intensity) THEN intensity END, 0.8) > 5000.0"))
def d5_filter_intensity(spark: Spark, d: Dir) -> DataFrame:
    p = pts(spark, d).withColumn("intensity", F.when(F.abs("intensity") < float("inf"), F.col("intensity")))
    return G.filter_intensity(p, 5000.0).select("point_id", "instance_id")


@query(f"{PTS}, m AS (SELECT cloud_id, instance_id, count(*) AS n, covar_pop(x, x) + covar_pop(y, y) + covar_pop(z, z) AS spread FROM v WHERE instance_id >= 0 GROUP BY cloud_id, instance_id) SELECT cloud_id, instance_id, n, spread > 0 AS has_axis FROM m")
def d4_principal_axes(spark: Spark, d: Dir) -> DataFrame:
    return G.principal_axes(pts(spark, d)).select("cloud_id", "instance_id", "n", F.col("inclination").isNotNull().alias("has_axis"))


def _pca_sql() -> str:
    """Eigenvalues of the covariance in closed form; the axis from (A - l2)(A - l3)."""
    a = [["xx", "xy", "xz"], ["xy", "yy", "yz"], ["xz", "yz", "zz"]]
    less = lambda i, j, v: f"({a[i][j]}{f' - {v}' if i == j else ''})"
    product = ", ".join(f"{' + '.join(f'{less(i, k, chr(108) + chr(50))} * {less(k, j, chr(108) + chr(51))}' for k in range(3))} AS b{i}{j}" for i in range(3) for j in range(3))
    norm = lambda j: f"sqrt(b0{j} * b0{j} + b1{j} * b1{j} + b2{j} * b2{j})"
    axis = " ".join(f"WHEN {norm(j)} >= greatest({norm(0)}, {norm(1)}, {norm(2)}) THEN abs(b2{j}) / nullif({norm(j)}, 0)" for j in range(3))
    good = f"""m AS (SELECT cloud_id, instance_id, {', '.join(f'covar_pop({u}, {v}) AS {u}{v}' for u, v in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM v WHERE instance_id >= 0 GROUP BY 1, 2),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM m), p AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q),
r AS (SELECT *, CASE WHEN p > 0 THEN greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p))) ELSE 1 END AS r FROM p),
l AS (SELECT *, q + 2 * p * cos(acos(r) / 3) AS l1, q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3) AS l3 FROM r), k AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM l), b AS (SELECT *, {product} FROM k),
c AS (SELECT cloud_id, instance_id, q, l1 / nullif(3 * q, 0) AS share, degrees(acos(least(1, CASE {axis} END))) AS inclination FROM b),
s AS (SELECT cloud_id, instance_id FROM c WHERE q <= 0 OR (coalesce(inclination <= 45.0, true) AND coalesce(share >= 0.5, true)))"""
    return f"{PTS}, {good}, {_RELABEL.format(src='s')} SELECT v.point_id, coalesce(d.r, -1) AS instance_id FROM v LEFT JOIN d ON v.cloud_id = d.cloud_id AND v.instance_id = d.instance_id"


@query(_pca_sql())
def d4_filter_pca(spark: Spark, d: Dir) -> DataFrame:
    return G.filter_pca(pts(spark, d), 45.0, 0.5).select("point_id", "instance_id")


@query(f"{PTS} SELECT cloud_id, instance_id, round(avg(x), 3) AS x, round(avg(y), 3) AS y FROM (SELECT cloud_id, instance_id, x - 412000 AS x, y - 115000 AS y FROM v WHERE cls = 1 AND instance_id >= 0) AS t GROUP BY cloud_id, instance_id")
def d6_trunk_centroids(spark: Spark, d: Dir) -> DataFrame:
    p = pts(spark, d).where("cls = 1").withColumns({"x": F.col("x") - 412000, "y": F.col("y") - 115000})
    return G.centroids(p).select("cloud_id", "instance_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"{PTS}, o AS (SELECT cloud_id, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM v WHERE cls IN (1, 2, 3) GROUP BY cloud_id) SELECT v.cloud_id, CAST(floor((x - x0) / 0.5) AS BIGINT) AS ix, CAST(floor((y - y0) / 0.5) AS BIGINT) AS iy, round(max(z - z0), 6) AS h, count(*) AS n FROM v JOIN o ON v.cloud_id = o.cloud_id WHERE cls IN (1, 2, 3) GROUP BY 1, 2, 3")
def d7_height_map(spark: Spark, d: Dir) -> DataFrame:
    return R.height_map(pts(spark, d).where(C.is_tree_point()), 0.5).select("cloud_id", "ix", "iy", r6(F.col("h"), "h"), "n")


@query(f"{_LAYERS.replace('l AS', 'WITH l AS')}, c AS (SELECT * FROM l WHERE r > 0) SELECT cloud_id, stem_id, count(*) AS n, round(CASE WHEN var_pop(mid_height) > 0 THEN avg(2 * r) + covar_pop(mid_height, 2 * r) / var_pop(mid_height) * (1.3 - avg(mid_height)) ELSE avg(2 * r) END, 6) AS diameter FROM c GROUP BY cloud_id, stem_id")
def d10_diameter_by_line(spark: Spark, d: Dir) -> DataFrame:
    rows = layers(spark, d).where("r > 0").withColumn("d", 2 * F.col("r"))
    return G.fit_line(rows, ["cloud_id", "stem_id"], "mid_height", "d", 1.3).select("cloud_id", "stem_id", "n", r6(F.col("predicted"), "diameter"))


@query(f"{PTS} SELECT cloud_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM v GROUP BY cloud_id")
def d19_bounding_boxes(spark: Spark, d: Dir) -> DataFrame:
    return G.bounding_boxes(pts(spark, d))


# ---- evaluation --------------------------------------------------------------------------------

_OVER = "o AS (SELECT cloud_id, coalesce(greatest(target, -1), -1) AS target_id, coalesce(greatest(prediction, -1), -1) AS prediction_id, count(*) AS n FROM v GROUP BY 1, 2, 3)"
_PAIRS = _OVER + ", nt AS (SELECT cloud_id, target_id, sum(n) AS nt FROM o WHERE target_id >= 0 GROUP BY 1, 2), np AS (SELECT cloud_id, prediction_id, sum(n) AS np FROM o WHERE prediction_id >= 0 GROUP BY 1, 2), pr AS (SELECT o.cloud_id, o.target_id, o.prediction_id, o.n AS tp, np.np - o.n AS fp, nt.nt - o.n AS fn, CAST(o.n AS DOUBLE) / (nt.nt + np.np - o.n) AS iou FROM o JOIN nt ON o.cloud_id = nt.cloud_id AND o.target_id = nt.target_id JOIN np ON o.cloud_id = np.cloud_id AND o.prediction_id = np.prediction_id)"


@query(f"{PTS}, {_OVER} SELECT * FROM o")
def c11_overlaps(spark: Spark, d: Dir) -> DataFrame:
    return M.overlaps(pts(spark, d))


@query(f"{PTS}, {_PAIRS} SELECT cloud_id, target_id, prediction_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(iou, 6) AS iou FROM pr")
def c11_pair_table(spark: Spark, d: Dir) -> DataFrame:
    return M.pair_table(M.overlaps(pts(spark, d))).withColumn("iou", F.round("iou", 6))


def _matched(rule_cte: str) -> str:
    return f"{PTS}, {_PAIRS}, {rule_cte} SELECT nt.cloud_id, nt.target_id, coalesce(f.prediction_id, -1) AS prediction_id, CAST(coalesce(f.tp, 0) AS BIGINT) AS tp, CAST(coalesce(f.fp, 0) AS BIGINT) AS fp, CAST(coalesce(f.fn, nt.nt) AS BIGINT) AS fn FROM nt LEFT JOIN f ON nt.cloud_id = f.cloud_id AND nt.target_id = f.target_id"


_PANOPTIC = "f AS (SELECT * FROM pr WHERE iou > 0.5)"
_COVERAGE = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, target_id ORDER BY iou DESC, prediction_id) AS i FROM pr) AS q WHERE i = 1)"
_FOR_AI = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, target_id ORDER BY iou DESC, prediction_id) AS i, row_number() OVER (PARTITION BY cloud_id, prediction_id ORDER BY iou DESC, target_id) AS k FROM pr WHERE iou >= 0.5) AS q WHERE i = 1 AND k = 1)"


def _match_query(rule: str, sql: str | None):
    query(sql, name=f"e4_match_{rule}")(lambda spark, d: M.match_instances(pts(spark, d), rule))


_match_query("panoptic_segmentation", _matched(_PANOPTIC))
_match_query("for_ai_net", _matched(_FOR_AI))
_match_query("for_ai_net_coverage", _matched(_COVERAGE))
_GREEDY = """h AS (SELECT cloud_id, target AS target_id, max(z) - min(z) AS height FROM v WHERE target >= 0 GROUP BY 1, 2),
o2 AS (SELECT pr.cloud_id, pr.target_id, list({{'p': prediction_id, 'u': iou}} ORDER BY iou DESC, prediction_id) AS c, any_value(height) AS height FROM pr JOIN h ON pr.cloud_id = h.cloud_id AND pr.target_id = h.target_id GROUP BY 1, 2),
n2 AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY height DESC, target_id) AS k FROM o2),
w AS (SELECT cloud_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS target_id, CAST(NULL AS BIGINT) AS got FROM n2 GROUP BY cloud_id
      UNION ALL SELECT cloud_id, k, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END, target_id, got FROM (
        SELECT w.cloud_id, n2.k, w.used, n2.target_id, (SELECT CASE WHEN x.u >= {least} THEN x.p END FROM (SELECT list_filter(n2.c, lambda y: NOT list_contains(w.used, y.p))[1] AS x) AS z) AS got FROM w JOIN n2 ON w.cloud_id = n2.cloud_id AND n2.k = w.k + 1) AS q),
f AS (SELECT pr.* FROM w JOIN pr ON w.cloud_id = pr.cloud_id AND w.target_id = pr.target_id AND w.got = pr.prediction_id)"""
_match_query("point2tree", "WITH RECURSIVE " + _matched(_GREEDY.format(least=0)).removeprefix("WITH "))
_match_query("for_instance", "WITH RECURSIVE " + _matched(_GREEDY.format(least=0.5)).removeprefix("WITH "))
# the best assignment keeps every pair above a half: two of them can't share an instance
_match_query("tree_learn", _matched(_PANOPTIC))

_MATCHES = "m AS (SELECT DISTINCT cloud_id, target_id, prediction_id, tp, fp, fn FROM instance_matches)"


def stored_matches(spark: Spark, d: Dir) -> DataFrame:
    return load(spark, d, "instance_matches").select("cloud_id", "target_id", "prediction_id", "tp", "fp", "fn").distinct()


_RATIO = "round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS \"Precision\", round(1 - CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS \"CommissionError\", round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS \"Recall\", round(1 - CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS \"OmissionError\", round(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 6) AS \"F1Score\""
_DETECT = f"{PTS}, {_PAIRS}, {_PANOPTIC}, k AS (SELECT nt.cloud_id, CASE WHEN f.prediction_id IS NULL THEN 'fn' ELSE 'tp' END AS k FROM nt LEFT JOIN f ON nt.cloud_id = f.cloud_id AND nt.target_id = f.target_id UNION ALL SELECT np.cloud_id, CASE WHEN f.prediction_id IS NULL THEN 'fp' END FROM np LEFT JOIN f ON np.cloud_id = f.cloud_id AND np.prediction_id = f.prediction_id), c AS (SELECT cloud_id, count(*) FILTER (k = 'tp') AS tp, count(*) FILTER (k = 'fp') AS fp, count(*) FILTER (k = 'fn') AS fn FROM k GROUP BY cloud_id)"


@query(f'{_DETECT} SELECT cloud_id, tp AS "TP", fp AS "FP", fn AS "FN", {_RATIO} FROM c')
def e1_detection_metrics(spark: Spark, d: Dir) -> DataFrame:
    p = cut(pts(spark, d).select("cloud_id", "target", "prediction", "z"))
    m = M.match_instances(p)
    out = M.detection_metrics(m, M.matched_predictions(p, m))
    return out.select("cloud_id", "TP", "FP", "FN", *[r6(F.col(c), c) for c in ("Precision", "CommissionError", "Recall", "OmissionError", "F1Score")])


_INST = "i AS (SELECT cloud_id, target_id, prediction_id, CASE WHEN prediction_id >= 0 THEN CAST(tp AS DOUBLE) / nullif(tp + fp + fn, 0) ELSE 0 END AS iou, CASE WHEN prediction_id >= 0 THEN CAST(tp AS DOUBLE) / nullif(tp + fp, 0) END AS pre, CASE WHEN prediction_id >= 0 THEN CAST(tp AS DOUBLE) / nullif(tp + fn, 0) ELSE 0 END AS rec FROM m)"


@query(f'WITH {_MATCHES}, {_INST} SELECT cloud_id, target_id AS "TargetID", prediction_id AS "PredictionID", round(iou, 6) AS "IoU", round(pre, 6) AS "Precision", round(rec, 6) AS "Recall" FROM i')
def e2_instance_metrics(spark: Spark, d: Dir) -> DataFrame:
    return M.instance_metrics(stored_matches(spark, d)).select("cloud_id", "TargetID", "PredictionID", *[r6(F.col(c), c) for c in ("IoU", "Precision", "Recall")])


@query(f'WITH {_MATCHES}, {_INST} SELECT cloud_id, round(avg(iou), 6) AS "MeanIoU", round(avg(pre), 6) AS "MeanPrecision", round(avg(rec), 6) AS "MeanRecall" FROM i GROUP BY cloud_id')
def e2_segmentation_metrics(spark: Spark, d: Dir) -> DataFrame:
    return M.segmentation_metrics(stored_matches(spark, d)).select("cloud_id", *[r6(F.col(c), c) for c in ("MeanIoU", "MeanPrecision", "MeanRecall")])


def _partition_sql(axis: str) -> str:
    dist = "sqrt(pow(x - x0, 2) + pow(y - y0, 2))" if axis == "xy" else "(z - z0)"
    return f"""{PTS}, {_PAIRS}, {_PANOPTIC},
lo AS (SELECT cloud_id, target, min(z) AS z0 FROM v WHERE target >= 0 GROUP BY 1, 2),
ft AS (SELECT v.cloud_id, v.target, any_value(z0) AS z0, avg(x) AS x0, avg(y) AS y0 FROM v JOIN lo ON v.cloud_id = lo.cloud_id AND v.target = lo.target WHERE z <= z0 + 0.30 GROUP BY 1, 2),
sc AS (SELECT v.cloud_id, v.target, any_value(z0) AS z0, any_value(x0) AS x0, any_value(y0) AS y0, quantile_cont({dist}, 0.95) AS scale FROM v JOIN ft ON v.cloud_id = ft.cloud_id AND v.target = ft.target GROUP BY 1, 2),
rf AS (SELECT sc.*, f.prediction_id AS p FROM sc JOIN f ON sc.cloud_id = f.cloud_id AND sc.target = f.target_id),
bn AS (SELECT rf.cloud_id, rf.target AS t, rf.p, CAST(floor({dist} / nullif(scale, 0) * 10) AS BIGINT) AS bin, coalesce(v.target, -1) = rf.target AS it, coalesce(v.prediction, -1) = rf.p AS ip
       FROM v JOIN rf ON v.cloud_id = rf.cloud_id AND (v.target = rf.target OR v.prediction = rf.p)),
ct AS (SELECT cloud_id, t, p, bin, count(*) FILTER (it AND ip) AS tp, count(*) FILTER (NOT it AND ip) AS fp, count(*) FILTER (it AND NOT ip) AS fn FROM bn WHERE bin >= 0 AND bin < 10 GROUP BY 1, 2, 3, 4)
SELECT cloud_id, t AS "TargetID", p AS "PredictionID", bin AS "Partition", round(CAST(tp AS DOUBLE) / nullif(tp + fp + fn, 0), 6) AS "IoU", round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS "Precision", round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS "Recall" FROM ct"""


def _partition_query(axis: str) -> None:
    def run(spark: Spark, d: Dir) -> DataFrame:
        p = cut(pts(spark, d).select("cloud_id", "target", "prediction", "x", "y", "z"))
        out = M.partition_metrics(p, M.match_instances(p), axis)
        return out.select("cloud_id", "TargetID", "PredictionID", "Partition", *[r6(F.col(c), c) for c in ("IoU", "Precision", "Recall")])

    query(_partition_sql(axis), name=f"e3_partition_{axis}")(run)


_partition_query("xy")
_partition_query("z")

CLASSES, UNIONS = [0, 1, 2, 3, 4], {"tree": [1, 2, 3], "low": [0, 4]}
_SETS = ", ".join([f"('{c}', false, [{c}])" for c in CLASSES] + [f"('{k}', true, {v})" for k, v in UNIONS.items()])


@query(f'{PTS}, x AS (SELECT cloud_id, semclassid AS t, semclassidpredicted AS p, count(*) AS n FROM v GROUP BY 1, 2, 3), s(name, is_aggregate, m) AS (VALUES {_SETS}), c AS (SELECT cloud_id, name, is_aggregate, CAST(sum(CASE WHEN coalesce(list_contains(m, t), false) AND coalesce(list_contains(m, p), false) THEN n ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN NOT coalesce(list_contains(m, t), false) AND coalesce(list_contains(m, p), false) THEN n ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN coalesce(list_contains(m, t), false) AND NOT coalesce(list_contains(m, p), false) THEN n ELSE 0 END) AS BIGINT) AS fn FROM x, s GROUP BY 1, 2, 3) SELECT *, round(CAST(tp AS DOUBLE) / nullif(tp + fp + fn, 0), 6) AS "IoU", round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS "Precision", round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS "Recall" FROM c')
def e5_semantic_metrics(spark: Spark, d: Dir) -> DataFrame:
    out = M.semantic_metrics(pts(spark, d), "semclassid", "semclassidpredicted", CLASSES, UNIONS)
    return out.withColumns({c: F.round(c, 6) for c in ("IoU", "Precision", "Recall")})


@query(f"{PTS}, t AS (SELECT cloud_id, instance_id, count(*) AS n, coalesce(bool_or(cls = 1), false) AS tr, coalesce(bool_or(cls = 2), false) AS cr FROM v GROUP BY 1, 2) SELECT cloud_id, CAST(sum(n) AS BIGINT) AS n_points, CAST(sum(CASE WHEN instance_id >= 0 THEN n ELSE 0 END) AS BIGINT) AS n_tree_points, count(*) FILTER (instance_id >= 0) AS n_trees, count(*) FILTER (instance_id >= 0 AND tr AND cr) AS n_complete FROM t GROUP BY cloud_id")
def e7_inventory(spark: Spark, d: Dir) -> DataFrame:
    return M.inventory(pts(spark, d))


@query(f"""{PTS}, {_MATCHES},
x AS (SELECT DISTINCT cloud_id, prediction FROM v WHERE prediction >= 0 EXCEPT SELECT cloud_id, prediction_id FROM m),
r AS (SELECT cloud_id, CASE WHEN prediction_id >= 0 THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN prediction_id >= 0 THEN 0 ELSE 1 END AS fn, CASE WHEN prediction_id >= 0 THEN CAST(tp AS DOUBLE) / (tp + fp + fn) END AS iou FROM m
      UNION ALL SELECT cloud_id, 0, 1, 0, NULL FROM x),
g AS (SELECT dataset, cloud_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(iou) AS mi FROM (SELECT split_part(cloud_id, '_', 1) AS dataset, * FROM r) AS q GROUP BY ROLLUP (dataset, cloud_id))
SELECT dataset, cloud_id, tp AS "TP", fp AS "FP", fn AS "FN", round(2.0 * tp / (2 * tp + fp + fn), 6) AS "F1Score", round(mi, 6) AS "MeanIoU", round(CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) * mi, 6) AS "PanopticQuality" FROM g""")
def e8_totals(spark: Spark, d: Dir) -> DataFrame:
    m = stored_matches(spark, d)
    extra = M.matched_predictions(pts(spark, d), m).where("target_id = -1")
    out = M.pooled_totals(m, extra, F.split_part("cloud_id", F.lit("_"), F.lit(1)))
    return out.select("dataset", "cloud_id", "TP", "FP", "FN", *[r6(F.col(c), c) for c in ("F1Score", "MeanIoU", "PanopticQuality")])


_VARIANTS = {"panoptic_segmentation": _PANOPTIC, "for_ai_net": _FOR_AI, "for_ai_net_coverage": _COVERAGE}


def _quality_sql(i: int, rule: str) -> str:
    """F1 times the mean IoU of the matched targets, per cloud, for one rule."""
    return f"""f{i} AS (SELECT * FROM ({_VARIANTS[rule].removeprefix('f AS (').removesuffix(')')}) AS q),
y{i} AS (SELECT nt.cloud_id, count(f.tp) AS tp, count(*) - count(f.tp) AS fn, avg(f.iou) AS mi FROM nt LEFT JOIN f{i} AS f ON nt.cloud_id = f.cloud_id AND nt.target_id = f.target_id GROUP BY nt.cloud_id),
z{i} AS (SELECT np.cloud_id, count(*) AS fp FROM np LEFT JOIN f{i} AS f ON np.cloud_id = f.cloud_id AND np.prediction_id = f.prediction_id WHERE f.tp IS NULL GROUP BY np.cloud_id)"""


@query(f"{PTS}, {_PAIRS}, {', '.join(_quality_sql(i, r) for i, r in enumerate(_VARIANTS))}, c AS (SELECT DISTINCT cloud_id FROM nt) SELECT c.cloud_id, {', '.join(f'round(CAST(2 * y{i}.tp AS DOUBLE) / (2 * y{i}.tp + coalesce(z{i}.fp, 0) + y{i}.fn) * y{i}.mi, 6) AS {r}' for i, r in enumerate(_VARIANTS))} FROM c {' '.join(f'LEFT JOIN y{i} ON y{i}.cloud_id = c.cloud_id LEFT JOIN z{i} ON z{i}.cloud_id = c.cloud_id' for i in range(len(_VARIANTS)))}")
def e9_pivot(spark: Spark, d: Dir) -> DataFrame:
    """Panoptic quality per cloud, one column per matching rule."""
    p = cut(pts(spark, d))
    parts = []
    for rule in _VARIANTS:
        m = cut(M.match_instances(p, rule))
        total = M.pooled_totals(m, M.matched_predictions(p, m).where("target_id = -1"), F.lit("all")).where("cloud_id IS NOT NULL")
        parts.append(total.select("cloud_id", F.lit(rule).alias("variant"), "PanopticQuality"))
    return M.ablation(parts[0].unionByName(parts[1]).unionByName(parts[2]), list(_VARIANTS)).select("cloud_id", *[r6(F.col(v), v) for v in _VARIANTS])


@query(f"{PTS}, n AS (SELECT cloud_id, point_id, z / 2 AS z FROM v) SELECT cloud_id, round(min(z), 6) AS low, round(max(z), 6) AS high, count(*) AS n FROM n GROUP BY cloud_id")
def b17_scale_z(spark: Spark, d: Dir) -> DataFrame:
    p = C.scale_z(pts(spark, d), 2.0)
    return p.groupBy("cloud_id").agg(r6(F.min("z"), "low"), r6(F.max("z"), "high"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 256) / 255.0 END AS r, CASE WHEN doc_id % 2 = 0 THEN 16 / 255.0 END AS g, CASE WHEN doc_id % 2 = 0 THEN 1.0 END AS b FROM documents")
def b16_hex_to_rgba(spark: Spark, d: Dir) -> DataFrame:
    """Colour codes made of ids; odd ones are no code."""
    code = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("#"), F.lpad(F.hex(F.col("doc_id") % 256), 2, "0"), F.lit("10FF"))).otherwise("none")
    return load(spark, d, "documents").select("doc_id", C.hex_to_rgba(code).alias("c")).select("doc_id", "c.r", "c.g", "c.b")


@query(f"WITH {_MATCHES}, s AS (SELECT cloud_id, prediction_id, count(*) AS n FROM m WHERE prediction_id >= 0 GROUP BY 1, 2) SELECT cloud_id, prediction_id, n, row_number() OVER (PARTITION BY cloud_id ORDER BY n DESC, prediction_id) AS place FROM s")
def g8_ranked_predictions(spark: Spark, d: Dir) -> DataFrame:
    s = stored_matches(spark, d).where("prediction_id >= 0").groupBy("cloud_id", "prediction_id").agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("place", F.row_number().over(W.partitionBy("cloud_id").orderBy(F.desc("n"), "prediction_id")))


@query("SELECT DISTINCT cloud_id, stem_id FROM stems WHERE stem_id NOT IN (SELECT stem_id FROM stem_layers)")
def h2_stems_without_layers(spark: Spark, d: Dir) -> DataFrame:
    s = load(spark, d, "stems").select("cloud_id", "stem_id").distinct()
    return s.join(load(spark, d, "stem_layers").select("stem_id"), "stem_id", "left_anti").select("cloud_id", "stem_id")


@query("SELECT DISTINCT cloud_id, stem_id FROM stems WHERE stem_id IN (SELECT stem_id FROM stem_layers WHERE circle.r > 0)")
def h3_stems_with_circle(spark: Spark, d: Dir) -> DataFrame:
    s = load(spark, d, "stems").select("cloud_id", "stem_id").distinct()
    return s.join(load(spark, d, "stem_layers").where("circle.r > 0").select("stem_id"), "stem_id", "left_semi").select("cloud_id", "stem_id")


# ---- fits, clusters and growth -----------------------------------------------------------------


@query()
def d11_fit_ellipse(spark: Spark, d: Dir) -> DataFrame:
    """Trunk points of each instance in 0.5 m layers."""
    p = pts(spark, d).where("cls = 1 AND instance_id >= 0").withColumn("layer", F.floor(F.col("z") / 0.5).cast("int"))
    return FIT.fit_ellipses(p.select("cloud_id", "instance_id", "layer", "x", "y"), ["cloud_id", "instance_id", "layer"])


@query()
def d12_d13_fit_layers(spark: Spark, d: Dir) -> DataFrame:
    p = pts(spark, d).where("cls = 1 AND instance_id >= 0").select("cloud_id", F.col("instance_id").alias("stem_id"), F.floor(F.col("z") / 2).cast("int").alias("layer"), (F.floor(F.col("z") / 2) * 2 + 1.0).alias("mid_height"), "x", "y")
    out = FIT.fit_layers(p, min_points=5)
    return out.select("cloud_id", "stem_id", "layer", "mid_height", "n", "circle.*", F.col("ellipse.a").alias("a"), F.col("ellipse.b").alias("b"))


_TRIPLES = """
s AS (SELECT cloud_id, stem_id, layer, mid_height, true AS is_circle, cx AS x, cy AS y, 2 * r AS d FROM l WHERE r > 0 UNION ALL SELECT cloud_id, stem_id, layer, mid_height, false, ex, ey, a + b FROM l WHERE a > 0 AND b > 0),
t AS (SELECT p.cloud_id, p.stem_id, p.is_circle, p.layer AS i, q.layer AS j, r.layer AS k, sqrt((pow(p.d - (p.d + q.d + r.d) / 3, 2) + pow(q.d - (p.d + q.d + r.d) / 3, 2) + pow(r.d - (p.d + q.d + r.d) / 3, 2)) / 3) AS dev
      FROM s AS p JOIN s AS q ON p.stem_id = q.stem_id AND p.is_circle = q.is_circle AND p.layer < q.layer JOIN s AS r ON p.stem_id = r.stem_id AND p.is_circle = r.is_circle AND q.layer < r.layer),
b AS (SELECT *, row_number() OVER (PARTITION BY stem_id ORDER BY is_circle DESC, dev, i, j, k) AS n FROM t WHERE dev <= 0.04),
st AS (SELECT s.cloud_id, s.stem_id, s.layer, s.mid_height, s.x, s.y, s.d AS diameter, s.is_circle FROM s JOIN b ON s.stem_id = b.stem_id AND s.is_circle = b.is_circle AND b.n = 1 AND s.layer IN (b.i, b.j, b.k))"""
_AT = lambda c: f"CASE WHEN var_pop(mid_height) > 0 THEN avg({c}) + covar_pop(mid_height, {c}) / var_pop(mid_height) * (1.3 - avg(mid_height)) ELSE avg({c}) END"


@query(f"WITH {_LAYERS}, {_TRIPLES} SELECT * FROM st")
def d15_stable_layers(spark: Spark, d: Dir) -> DataFrame:
    return FIT.stable_layers(layers(spark, d), k=3, max_std=0.04)


@query(f"WITH {_LAYERS}, {_TRIPLES} SELECT cloud_id, stem_id, round({_AT('x')}, 3) AS x, round({_AT('y')}, 3) AS y, round({_AT('diameter')}, 6) AS diameter FROM st GROUP BY cloud_id, stem_id")
def d16_d17_stem_positions(spark: Spark, d: Dir) -> DataFrame:
    out = FIT.stem_positions(FIT.stable_layers(layers(spark, d), k=3, max_std=0.04))
    return out.select("cloud_id", "stem_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), r6(F.col("diameter"), "diameter"))


@query()
def d14_refined_layers(spark: Spark, d: Dir) -> DataFrame:
    """Shapes fitted anew to all points around the stored ones."""
    p, l, g = pts(spark, d), layers(spark, d), stem_ground(spark, d)
    near = ST.points_near_circles(p, l, g, height=0.6).unionByName(ST.points_near_ellipses(p, l, g, height=0.6))
    rows = near.join(p.select("point_id", "x", "y"), "point_id").join(l.select("cloud_id", "stem_id", "layer", "mid_height"), ["cloud_id", "stem_id", "layer"])
    out = FIT.fit_layers(rows, min_points=5)
    return out.select("cloud_id", "stem_id", "layer", "mid_height", "n", "circle.*", F.col("ellipse.a").alias("a"), F.col("ellipse.b").alias("b"))


@query()
def d17_d18_outline_diameters(spark: Spark, d: Dir) -> DataFrame:
    """Positions and diameters with the outlines of the points around each stable layer's shape."""
    p, l, g = pts(spark, d), layers(spark, d), stem_ground(spark, d)
    near = ST.points_near_circles(p, l, g, height=0.6).unionByName(ST.points_near_ellipses(p, l, g, height=0.6))
    near = near.join(p.select("point_id", "x", "y"), "point_id").select("cloud_id", "stem_id", "layer", "x", "y")
    return FIT.stem_positions(FIT.outline_diameters(near, cut(FIT.stable_layers(l, k=3, max_std=0.04))))


@query(f"WITH RECURSIVE {PTS.removeprefix('WITH ')}, t AS (SELECT * FROM v WHERE cls = 1), e AS (SELECT a.point_id AS p, b.point_id AS q FROM t AS a JOIN t AS b ON a.cloud_id = b.cloud_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 6.25), r AS (SELECT p AS id, p AS root FROM e UNION SELECT e.q, r.root FROM r JOIN e ON r.id = e.p WHERE e.q > r.root) SELECT id AS point_id, min(root) AS cluster FROM r GROUP BY id")
def f3_trunk_clusters(spark: Spark, d: Dir) -> DataFrame:
    return CL.cluster_trunks(pts(spark, d).select("cloud_id", "point_id", "x", "y", "z", "cls"), 2.5)


@query(f"""WITH RECURSIVE {PTS.removeprefix('WITH ')}, t AS (SELECT * FROM v WHERE cls = 1 AND z >= 0.5 AND z < 5),
e AS (SELECT a.point_id AS p, b.point_id AS q FROM t AS a JOIN t AS b ON a.cloud_id = b.cloud_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.0),
c AS (SELECT p AS id FROM e GROUP BY p HAVING count(*) >= 3), ce AS (SELECT e.* FROM e JOIN c ON e.p = c.id JOIN c AS c2 ON e.q = c2.id),
r AS (SELECT p AS id, p AS root FROM ce UNION SELECT ce.q, r.root FROM r JOIN ce ON r.id = ce.p WHERE ce.q > r.root), g AS (SELECT id, min(root) AS cluster FROM r GROUP BY id)
SELECT t.point_id, coalesce(g.cluster, (SELECT min(g2.cluster) FROM e JOIN g AS g2 ON e.q = g2.id WHERE e.p = t.point_id)) AS cluster FROM t LEFT JOIN g ON t.point_id = g.id""")
def f1_stem_clusters(spark: Spark, d: Dir) -> DataFrame:
    """Plan-view density clusters of the trunk points in the stem layer."""
    p = pts(spark, d).where("cls = 1 AND z >= 0.5 AND z < 5").select("cloud_id", "point_id", "x", "y", "z")
    return CL.dbscan(p, 1.0, 3, dims=("x", "y"))


@query(f"""{PTS}, s AS (SELECT cloud_id, stem_id, min(x) AS x, min(y) AS y, min(diameter) AS diameter FROM stems WHERE diameter > 0 AND diameter < 3 GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN cls = 1 AND instance_id >= 0 THEN instance_id END AS own FROM v)
SELECT point_id, own AS instance_id FROM w JOIN s ON w.own = s.stem_id
UNION ALL SELECT w.point_id, min(s.stem_id) FROM w JOIN s ON w.cloud_id = s.cloud_id WHERE own IS NULL AND w.z BETWEEN 1.0 AND 1.6 AND sqrt((w.x - s.x) * (w.x - s.x) + (w.y - s.y) * (w.y - s.y)) <= greatest(s.diameter / 2 * 1.05, 0.025) GROUP BY w.point_id""")
def f5_stem_seeds(spark: Spark, d: Dir) -> DataFrame:
    return CL.stem_seeds(*_stem_inputs(spark, d))


def _stem_inputs(spark: Spark, d: Dir) -> tuple[DataFrame, DataFrame]:
    s = load(spark, d, "stems").where("diameter > 0 AND diameter < 3").groupBy("cloud_id", "stem_id").agg(*[F.min(c).alias(c) for c in ("x", "y", "diameter")])
    own = F.when((F.col("cls") == 1) & (F.col("instance_id") >= 0), F.col("instance_id"))
    p = pts(spark, d).select("cloud_id", "point_id", "x", "y", "z", F.col("z").alias("h"), own.alias("stem_id"), F.coalesce(C.is_tree_point(), F.lit(False)).alias("is_tree"))
    return p, s


@query()
def f6_f7_grow_regions(spark: Spark, d: Dir) -> DataFrame:
    p, s = _stem_inputs(spark, d)
    return CL.grow_regions(p, CL.stem_seeds(p, s), voxel=0.5, max_radius=1.5)


# ---- rasters of the canopy, terrain classes, colours -------------------------------------------


def _canopy(spark: Spark, d: Dir, cell: float = 1.0) -> DataFrame:
    return R.height_map(pts(spark, d).where(C.is_tree_point()), cell)


@query()
def f8_crown_tops(spark: Spark, d: Dir) -> DataFrame:
    return MO.find_crown_tops(_canopy(spark, d), 1.0, min_distance=3.0)


@query()
def f9_f10_watershed(spark: Spark, d: Dir) -> DataFrame:
    chm = cut(_canopy(spark, d))
    tops = MO.find_crown_tops(chm, 1.0, min_distance=3.0).withColumnRenamed("top_no", "tree_no")
    return MO.segment_canopy(chm, tops)


@query()
def f12_signed_distances(spark: Spark, d: Dir) -> DataFrame:
    return MO.signed_distances(f9_f10_watershed(spark, d))


@query()
def f14_terrain_classes(spark: Spark, d: Dir) -> DataFrame:
    return MO.classify_terrain(pts(spark, d).select("cloud_id", "point_id", "x", "y", "z"), 1.0).select("point_id", "terrain")


@query(f"{PTS}, {_RELABEL.format(src='v')} SELECT v.point_id, CASE WHEN d.r IS NULL THEN -1 ELSE d.r % 27 END AS color_no FROM v LEFT JOIN d ON v.cloud_id = d.cloud_id AND v.instance_id = d.instance_id")
def m1_color_numbers(spark: Spark, d: Dir) -> DataFrame:
    p = G.relabel(pts(spark, d))
    return p.select("point_id", F.when(F.col("instance_id") < 0, -1).otherwise(F.col("instance_id") % 27).cast("bigint").alias("color_no"))


_COLORS = f"pal(k, r, g, b, a) AS (VALUES {', '.join(f'({i}, {r}, {g}, {b}, {a})' for i, (r, g, b, a) in enumerate([*palette(), BACKGROUND]))})"


@query(f"{PTS}, {_RELABEL.format(src='v')}, {_COLORS} SELECT v.point_id, pal.r, pal.g, pal.b, pal.a FROM v LEFT JOIN d ON v.cloud_id = d.cloud_id AND v.instance_id = d.instance_id JOIN pal ON pal.k = coalesce(d.r % 27, 27)")
def m1_color_instances(spark: Spark, d: Dir) -> DataFrame:
    return color_instances(pts(spark, d)).select("point_id", "rgba.*")


@query(f"{PTS}, {_PAIRS}, {_PANOPTIC} SELECT v.point_id, CASE WHEN v.prediction >= 0 AND f.target_id IS NULL THEN 'fp' WHEN v.target >= 0 AND g.target_id IS NULL THEN 'fn' ELSE 'none' END AS kind FROM v LEFT JOIN f ON v.cloud_id = f.cloud_id AND v.prediction = f.prediction_id LEFT JOIN f AS g ON v.cloud_id = g.cloud_id AND v.target = g.target_id")
def m1_color_errors(spark: Spark, d: Dir) -> DataFrame:
    p = pts(spark, d)
    m = cut(M.match_instances(p))
    rows = color_errors(p, M.matched_predictions(p, m).where("target_id = -1"), m.where("prediction_id = -1"))
    kind = F.when((F.col("rgba.r") == 255) & (F.col("rgba.b") == 0), "fp").when((F.col("rgba.b") == 255) & (F.col("rgba.r") == 0), "fn").otherwise("none")
    return rows.select("point_id", kind.alias("kind"))


@query(f"{PTS}, c(cls, r, g, b, a) AS (VALUES (1, 139, 69, 19, 255), (2, 34, 139, 34, 255)) SELECT point_id, coalesce(r, 220) AS r, coalesce(g, 219) AS g, coalesce(b, 209) AS b, coalesce(a, 127) AS a FROM v LEFT JOIN c ON v.cls = c.cls")
def m2_color_classes(spark: Spark, d: Dir) -> DataFrame:
    return pts(spark, d).select("point_id", color_classes("cls", {1: "#8B4513", 2: "#228B22"}).alias("c")).select("point_id", "c.*")


@query(f"{PTS}, {_LAYERS}, s AS (SELECT cloud_id, instance_id AS stem_id, point_id, z FROM v WHERE cls = 1 AND instance_id >= 0), g AS (SELECT stem_id, min(z) AS terrain FROM s GROUP BY stem_id), b(layer, lo, hi) AS (SELECT i, 1.0 + i * 1.5, 1.0 + i * 1.5 + 2.0 FROM range(0, 4) AS r(i)), r AS (SELECT s.cloud_id, s.stem_id, CAST(b.layer AS INTEGER) AS layer, s.point_id FROM s JOIN g ON s.stem_id = g.stem_id JOIN b ON z - terrain BETWEEN lo AND hi), f AS (SELECT stem_id, layer FROM r GROUP BY stem_id, layer HAVING count(*) >= 3) SELECT r.* FROM r JOIN f ON r.stem_id = f.stem_id AND r.layer = f.layer")
def c15_b13_points_in_layers(spark: Spark, d: Dir) -> DataFrame:
    s = pts(spark, d).where("cls = 1 AND instance_id >= 0").select("cloud_id", F.col("instance_id").alias("stem_id"), "point_id", "z")
    ground = s.groupBy("stem_id").agg(F.min("z").alias("terrain"))
    rows = ST.points_in_layers(s, ground, n_layers=4, start=1.0, height=2.0, overlap=0.5, least=3)
    return rows.select("cloud_id", "stem_id", "layer", "point_id")


@query(f"{PTS}, {_GROUND}, {_LAYERS}, s AS (SELECT l.*, gr.terrain, CASE WHEN a + b <= 0.3 THEN 0.06 ELSE 0.09 END AS w FROM l JOIN gr ON l.stem_id = gr.stem_id WHERE a > 0 AND b > 0 AND NOT coalesce(r > 0, false)), j AS (SELECT s.cloud_id, s.stem_id, s.layer, v.point_id, (v.x - ex) * cos(theta) + (v.y - ey) * sin(theta) AS p, (v.y - ey) * cos(theta) - (v.x - ex) * sin(theta) AS q, a, b, w FROM s JOIN v ON s.cloud_id = v.cloud_id AND v.x BETWEEN ex - a - w AND ex + a + w AND v.y BETWEEN ey - a - w AND ey + a + w WHERE v.z - terrain BETWEEN mid_height - 0.3 AND mid_height + 0.3) SELECT cloud_id, stem_id, layer, point_id FROM j WHERE p * p / ((a + w) * (a + w)) + q * q / ((b + w) * (b + w)) <= 1 AND NOT (b > w AND p * p / ((a - w) * (a - w)) + q * q / ((b - w) * (b - w)) <= 1)")
def c6_points_near_ellipses(spark: Spark, d: Dir) -> DataFrame:
    return ST.points_near_ellipses(pts(spark, d), layers(spark, d), stem_ground(spark, d), height=0.6)


@query(f"{PTS}, s AS (SELECT * FROM v WHERE cls = 1 AND instance_id >= 0), u AS (SELECT * FROM v WHERE NOT coalesce(cls = 1 AND instance_id >= 0, false)), k AS (SELECT u.point_id, s.instance_id, row_number() OVER (PARTITION BY u.point_id ORDER BY (u.x - s.x) * (u.x - s.x) + (u.y - s.y) * (u.y - s.y) + (u.z - s.z) * (u.z - s.z), s.point_id) AS r FROM u JOIN s ON u.cloud_id = s.cloud_id WHERE (u.x - s.x) * (u.x - s.x) + (u.y - s.y) * (u.y - s.y) + (u.z - s.z) * (u.z - s.z) <= 4.0) SELECT point_id, instance_id FROM k WHERE r = 1")
def c8_nearest_seed(spark: Spark, d: Dir) -> DataFrame:
    p = pts(spark, d).select("cloud_id", "point_id", "x", "y", "z", "cls", "instance_id")
    is_seed = F.coalesce(F.expr("cls = 1 AND instance_id >= 0"), F.lit(False))
    return ST.nearest_seed(p.where(~is_seed).drop("instance_id"), p.where(is_seed), 2.0)


_SEGMENT = f"cv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, target_id ORDER BY iou DESC, prediction_id) AS i FROM pr) AS q WHERE i = 1), ins AS (SELECT nt.cloud_id, nt.target_id, coalesce(cv.prediction_id, -1) AS prediction_id, coalesce(cv.iou, 0) AS iou, CAST(cv.tp AS DOUBLE) / (cv.tp + cv.fp) AS pre, coalesce(CAST(cv.tp AS DOUBLE) / (cv.tp + cv.fn), 0) AS rec FROM nt LEFT JOIN cv ON nt.cloud_id = cv.cloud_id AND nt.target_id = cv.target_id)"


@query(f'{_DETECT}, {_SEGMENT}, sg AS (SELECT cloud_id, round(avg(iou), 6) AS i, round(avg(pre), 6) AS p, round(avg(rec), 6) AS r FROM ins GROUP BY cloud_id), dt AS (SELECT cloud_id, tp AS "TP", fp AS "FP", fn AS "FN", {_RATIO} FROM c) SELECT dt.cloud_id, "TP" AS "DetectionTP", "FP" AS "DetectionFP", "FN" AS "DetectionFN", {", ".join(f'"{c}" AS "Detection{c}"' for c in ("Precision", "CommissionError", "Recall", "OmissionError", "F1Score"))}, sg.i AS "SegmentationMeanIoU", sg.p AS "SegmentationMeanPrecision", sg.r AS "SegmentationMeanRecall" FROM dt LEFT JOIN sg ON dt.cloud_id = sg.cloud_id')
def e6_evaluation(spark: Spark, d: Dir) -> DataFrame:
    m = evaluate(pts(spark, d)).metrics
    return m.select(*[r6(F.col(c), c) if t == "double" else F.col(c) for c, t in m.dtypes])


@query(f'{PTS}, {_PAIRS}, {_SEGMENT} SELECT cloud_id, target_id AS "TargetID", prediction_id AS "PredictionID", round(iou, 6) AS "IoU", round(pre, 6) AS "Precision", round(rec, 6) AS "Recall" FROM ins')
def e6_instances(spark: Spark, d: Dir) -> DataFrame:
    return evaluate(pts(spark, d)).instances.select("cloud_id", "TargetID", "PredictionID", *[r6(F.col(c), c) for c in ("IoU", "Precision", "Recall")])


def _e6_frames(name: str) -> None:
    """The frames per partition of the whole evaluation."""

    def run(spark: Spark, d: Dir) -> DataFrame:
        e = getattr(evaluate(pts(spark, d), partitions=10), name)
        return e.select(*[r6(F.col(c), c) if t == "double" else F.col(c) for c, t in e.dtypes])

    query(name=f"e6_{name}")(run)


for _name in ("partition_xy", "instances_xy", "partition_z", "instances_z"):
    _e6_frames(_name)


@query(f"{PTS}, {_PAIRS}, {_PANOPTIC}, {_DTM}, hh AS (SELECT q.point_id, q.z - g.ground AS height FROM q LEFT JOIN g ON q.point_id = g.point_id), s AS (SELECT v.cloud_id, v.prediction AS prediction_id, avg(CASE WHEN v.target >= 0 THEN 1.0 ELSE 0.0 END) AS share, greatest(coalesce(max(hh.height), 0), 0) AS top FROM v LEFT JOIN hh ON v.point_id = hh.point_id WHERE v.prediction >= 0 GROUP BY 1, 2), mt AS (SELECT cloud_id, prediction_id, min(target_id) AS t FROM f GROUP BY 1, 2) SELECT s.cloud_id, s.prediction_id, coalesce(mt.t, CASE WHEN share < 0.5 OR top < 5.0 THEN -2 ELSE -1 END) AS target_id FROM s LEFT JOIN mt ON s.cloud_id = mt.cloud_id AND s.prediction_id = mt.prediction_id")
def e4_uncertain_predictions(spark: Spark, d: Dir) -> DataFrame:
    p = R.height_above_terrain(pts(spark, d), load(spark, d, "dtm"), RES)
    return M.matched_predictions(p, M.match_instances(p), min_precision=0.5, height="height", min_height=5.0)


#: the test clouds have few points a tree: cells, trunks and spacings of that size
SPARSE_CANOPY = CanopyParameters(cell=1.0, min_distance=3.0, min_cell_points=1, min_trunk_points=5, branches=True, max_spacing=1.5, grow_radius=3.0)


@query()
def f15_coarse_crowns(spark: Spark, d: Dir) -> DataFrame:
    return CanopyPipeline(replace(SPARSE_CANOPY, variant="watershed_matched_tree_positions")).transform(pts(spark, d))


@query()
def f15_crown_tops_only(spark: Spark, d: Dir) -> DataFrame:
    return CanopyPipeline(replace(SPARSE_CANOPY, variant="watershed_crown_top_positions")).transform(pts(spark, d))


@query()
def f15_f16_canopy_pipeline(spark: Spark, d: Dir) -> DataFrame:
    return CanopyPipeline(SPARSE_CANOPY).transform(pts(spark, d))


@query()
def f16_default_canopy(spark: Spark, d: Dir) -> DataFrame:
    """The default parameters as they are."""
    return CanopyPipeline().transform(pts(spark, d))


def _coarse(spark: Spark, d: Dir) -> tuple[DataFrame, DataFrame]:
    """Tree points with the delivered instance and their cell, and the canopy's labels from the trees' tops."""
    p = pts(spark, d).where(C.is_tree_point())
    chm = cut(R.height_map(p, 1.0))
    tops = MO.find_crown_tops(chm, 1.0, min_distance=3.0).withColumnRenamed("top_no", "tree_no")
    labels = cut(MO.segment_canopy(chm, cut(tops)))
    corner = p.groupBy("cloud_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    p = p.join(corner, "cloud_id").select("cloud_id", "point_id", "x", "y", "z", "cls", F.floor(F.col("x") - F.col("x0")).alias("ix"), F.floor(F.col("y") - F.col("y0")).alias("iy"))
    own = labels.where("label > 0").select("cloud_id", "ix", "iy", (F.col("label") - 1).alias("instance_id"))
    return cut(p.join(own, ["cloud_id", "ix", "iy"], "left").withColumn("instance_id", F.coalesce("instance_id", F.lit(-1)))), labels


@query()
def f11_overlapping_crowns(spark: Spark, d: Dir) -> DataFrame:
    return MO.overlapping_crowns(*_coarse(spark, d), 1.5).select("point_id", "instance_id", "is_seed")


@query()
def f13_grow_crowns(spark: Spark, d: Dir) -> DataFrame:
    p, labels = _coarse(spark, d)
    marked = cut(MO.overlapping_crowns(p, labels, 1.5))
    at = labels.where("label > 0").groupBy("cloud_id", (F.col("label") - 1).alias("tree_no")).agg(F.min(F.struct("ix", "iy")).alias("c")).select("cloud_id", "tree_no", "c.*")
    return MO.grow_crowns(marked, labels, at, radius=3.0)


@query()
def f4_f17_stem_pipeline(spark: Spark, d: Dir) -> DataFrame:
    """The default preset as it is."""
    p = pts(spark, d).select("cloud_id", "point_id", "x", "y", "z", F.when(F.abs("intensity") < float("inf"), F.col("intensity")).alias("intensity"))
    return StemPipeline(PRESETS["default"]).transform(p)
