"""Points in layers of stems and around fitted shapes, and the seeds' neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaframe.functions.columns import in_ellipse, layer_bounds
from sylvaframe.operators.nearest import nearest


def points_in_layers(points: DataFrame, ground: DataFrame, *, n_layers: int, start: float, height: float, overlap: float, least: int) -> DataFrame:
    """cloud_id, stem_id, layer, mid_height, point_id: stem points by height above the stem's ground.

    points: cloud_id, stem_id, point_id, z. ground: stem_id, terrain. Both ends of a layer count;
    layers with fewer than ``least`` points are left out. A point can lie in several layers.
    """
    at = points.join(ground.select("stem_id", "terrain"), "stem_id").withColumn("l", F.explode(layer_bounds(n_layers, start, height, overlap)))
    rows = at.where((F.col("z") - F.col("terrain")).between(F.col("l.low"), F.col("l.high"))).select("cloud_id", "stem_id", F.col("l.layer").alias("layer"), F.col("l.mid").alias("mid_height"), "point_id")
    full = rows.groupBy("stem_id", "layer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("stem_id", "layer")
    return rows.join(full, ["stem_id", "layer"], "left_semi")


def buffer_width(size, limit: float, small: float, large: float):
    return F.when(size <= limit, F.lit(small)).otherwise(F.lit(large))


def _around_shapes(points: DataFrame, shapes: DataFrame, reach: Column, centre: tuple[str, str], ground: DataFrame | None, height: float, cell: float) -> DataFrame:
    """Points that share a cell with a shape's box, in the layer's band above the stem's ground."""
    line = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / cell), F.floor((F.col(c) + reach) / cell)))
    s = shapes
    if ground is not None:
        s = s.join(ground.select(F.col("stem_id").alias("__s"), F.col("terrain").alias("__terrain")), F.col("stem_id") == F.col("__s")).drop("__s")
    s = s.withColumnRenamed("cloud_id", "__g").withColumn("__jx", line(centre[0])).withColumn("__jy", line(centre[1]))
    cols = ["cloud_id", "point_id", "x", "y"] + (["z"] if ground is not None else [])
    p = points.select(*cols, F.floor(F.col("x") / cell).alias("__ix"), F.floor(F.col("y") / cell).alias("__iy"))
    j = p.join(s, (F.col("cloud_id") == F.col("__g")) & (F.col("__ix") == F.col("__jx")) & (F.col("__iy") == F.col("__jy")))
    if ground is not None:
        j = j.where((F.col("z") - F.col("__terrain")).between(F.col("mid_height") - height / 2, F.col("mid_height") + height / 2))
    return j


def points_near_circles(points: DataFrame, shapes: DataFrame, ground: DataFrame | None, *, height: float = 0.225, limit: float = 0.3, small: float = 0.06, large: float = 0.09, cell: float = 2.0) -> DataFrame:
    """cloud_id, stem_id, layer, point_id in the ring around each circle and the layer's height band.

    points: cloud_id, point_id, x, y, z; all of them are candidates. shapes: cloud_id, stem_id,
    layer, mid_height, cx, cy, r. ground: stem_id, terrain (None: heights aren't tested). Both
    ends of ring and band count; a ring wider than its circle is a disk. A stem without terrain,
    a layer without a circle (r null or <= 0) have no points.
    """
    c = shapes.where("r > 0").select("cloud_id", "stem_id", "layer", "mid_height", "cx", "cy", "r").withColumn("w", buffer_width(2 * F.col("r"), limit, small, large))
    j = _around_shapes(points, c, F.col("r") + F.col("w"), ("cx", "cy"), ground, height, cell)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    d2, low, high = dx * dx + dy * dy, F.greatest(F.col("r") - F.col("w"), F.lit(0.0)), F.col("r") + F.col("w")
    return j.where((d2 >= low * low) & (d2 <= high * high)).select("cloud_id", "stem_id", "layer", "point_id")


def points_near_ellipses(points: DataFrame, shapes: DataFrame, ground: DataFrame | None, *, height: float = 0.225, limit: float = 0.3, small: float = 0.06, large: float = 0.09, cell: float = 2.0) -> DataFrame:
    """cloud_id, stem_id, layer, point_id between the ellipses shrunk and widened by the buffer.

    shapes: cloud_id, stem_id, layer, mid_height, r, ex, ey, a, b, theta. An ellipse counts only
    where its layer has no circle. Otherwise as for circles; an ellipse thinner than the buffer
    has no hole.
    """
    e = shapes.where("a > 0 AND b > 0 AND NOT coalesce(r > 0, false)").select("cloud_id", "stem_id", "layer", "mid_height", "ex", "ey", "a", "b", "theta")
    e = e.withColumn("w", buffer_width(F.col("a") + F.col("b"), limit, small, large))
    j = _around_shapes(points, e, F.col("a") + F.col("w"), ("ex", "ey"), ground, height, cell)
    outer = in_ellipse("x", "y", "ex", "ey", F.col("a") + F.col("w"), F.col("b") + F.col("w"), "theta")
    thin = F.col("b") <= F.col("w")
    inner = ~thin & in_ellipse("x", "y", "ex", "ey", F.col("a") - F.col("w"), F.when(thin, 1.0).otherwise(F.col("b") - F.col("w")), "theta")
    return j.where(outer & ~inner).select("cloud_id", "stem_id", "layer", "point_id")


def nearest_seed(points: DataFrame, seeds: DataFrame, radius: float, group: str = "cloud_id") -> DataFrame:
    """point_id, instance_id: of the nearest seed (3-D, ties by seed id) within ``radius``.

    seeds: group, point_id, instance_id, x, y, z.
    """
    near = nearest(points.withColumnRenamed("point_id", "query_id"), seeds, 1, dims=("x", "y", "z"), group=group, radius=radius)
    return near.join(seeds.select("point_id", "instance_id"), "point_id").select(F.col("query_id").alias("point_id"), "instance_id")
