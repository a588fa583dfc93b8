"""Density clusters, connected components and region growing as joins in a driver loop.

The loops move no rows to the driver; lineage is cut by checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.operators.near import neighbour_counts, pairs_within
from sylvaframe.operators.nearest import nearest
from sylvaframe.session import cut


#: fronts of a growth that are read as a union before they are written together
COMPACT = 8


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, component: the smallest id that each vertex is connected to.

    vertices: id; edges: a, b (either direction). Labels spread along edges and by pointer
    jumping, so the number of rounds grows with the logarithm of the longest path.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(vertices.select("id").distinct().withColumn("component", F.col("id")))
    for _ in range(max_rounds):
        around = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("least"))
        spread = labels.join(around, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "least").alias("component"))
        jump = spread.select(F.col("id").alias("component"), F.col("component").alias("next"))
        moved = cut(spread.join(jump, "component").select("id", "was", F.col("next").alias("component")))
        labels = moved.select("id", "component")
        if moved.where("was <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def dbscan(points: DataFrame, eps: float, min_points: int, *, dims: tuple[str, ...] = ("x", "y", "z"), group: str = "cloud_id") -> DataFrame:
    """point_id, cluster: the smallest core point_id of the cluster, null for noise.

    ``min_points`` counts the point itself. A border point in reach of several clusters goes to
    the one with the smallest id. Points repeating an id count once. Neighbours are counted where
    they meet, core points are linked by cells, and only pairs of a border and a core point are
    ever written: fewer than ``min_points`` for each border point.
    """
    p = cut(points.select(group, "point_id", *dims).dropDuplicates(["point_id"]))
    n = neighbour_counts(p, eps, group=group, dims=dims)
    p = cut(p.join(n, "point_id", "left").select(group, "point_id", *dims, (F.coalesce("n_near", F.lit(0)) + 1 >= min_points).alias("is_core")))
    label = cut(single_linkage(p.where("is_core"), eps, group=group, dims=dims))
    pairs = pairs_within(p, eps, group=group, dims=dims, flag="is_core")
    both = pairs.select(F.col("point_id_a").alias("point_id"), F.col("point_id_b").alias("core")).unionByName(pairs.select(F.col("point_id_b").alias("point_id"), F.col("point_id_a").alias("core")))
    border = both.join(label.withColumnRenamed("point_id", "core"), "core").groupBy("point_id").agg(F.min("cluster").alias("cluster"))
    return p.select("point_id").join(label.unionByName(border), "point_id", "left").select("point_id", "cluster")


def single_linkage(points: DataFrame, eps: float, *, group: str = "cloud_id", dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """point_id, cluster: what is connected by steps of at most ``eps``, named by its smallest id.

    All points of a cell with diagonal eps belong together, so cells are the vertices and one
    pair is enough to link two of them: edges follow the occupied volume, not the density.
    """
    cell = eps / len(dims) ** 0.5 * 0.999999
    p = cut(points.select(group, "point_id", *dims).dropDuplicates(["point_id"]))
    at = [f"c{i}" for i in range(len(dims))]
    named = p.select(group, "point_id", *[F.floor(F.col(c) / cell).alias(a) for a, c in zip(at, dims, strict=True)])
    cells = named.groupBy(group, *at).agg(F.min("point_id").alias("rep"))
    own = cut(named.join(cells, [group, *at]).select("point_id", "rep"))
    pairs = pairs_within(p, eps, group=group, link_cell=cell, dims=dims)
    ends = pairs.join(own.select(F.col("point_id").alias("point_id_a"), F.col("rep").alias("a")), "point_id_a").join(own.select(F.col("point_id").alias("point_id_b"), F.col("rep").alias("b")), "point_id_b")
    label = connected_components(own.select(F.col("rep").alias("id")), ends.select("a", "b"))
    return own.join(label.select(F.col("id").alias("rep"), "component"), "rep").select("point_id", F.col("component").alias("cluster"))


def cluster_trunks(points: DataFrame, eps: float = 2.5, branches: bool = False) -> DataFrame:
    """Trunk (and branch) points by single linkage at ``eps``."""
    kinds = [1, 3] if branches else [1]
    return single_linkage(points.where(F.col("cls").isin(*kinds)), eps)


def stem_seeds(points: DataFrame, stems: DataFrame, *, band: float = 0.6, factor: float = 1.05, least_diameter: float = 0.05, cell: float = 1.0) -> DataFrame:
    """point_id, instance_id: seeds of the stems; points: cloud_id, point_id, x, y, h, stem_id (or null).

    All points of a stem's own cluster, and unclustered points in a cylinder around the stem at
    breast height. A point in reach of several stems goes to the smallest id.
    """
    own = points.where(F.col("stem_id").isNotNull()).join(stems.select("stem_id"), "stem_id", "left_semi").select("point_id", F.col("stem_id").alias("instance_id"))
    reach = F.greatest(F.col("diameter") / 2 * factor, F.lit(least_diameter / 2))
    s = stems.select(F.col("cloud_id").alias("g"), F.col("stem_id").alias("s"), F.col("x").alias("sx"), F.col("y").alias("sy"), reach.alias("reach"))
    line = lambda c: F.explode(F.sequence(F.floor((F.col(f"s{c}") - F.col("reach")) / cell), F.floor((F.col(f"s{c}") + F.col("reach")) / cell)))
    s = s.withColumn("jx", line("x")).withColumn("jy", line("y"))
    free = points.where(F.col("stem_id").isNull() & F.col("h").between(1.3 - band / 2, 1.3 + band / 2))
    free = free.select("cloud_id", "point_id", "x", "y", F.floor(F.col("x") / cell).alias("ix"), F.floor(F.col("y") / cell).alias("iy"))
    hit = free.join(s, (F.col("cloud_id") == F.col("g")) & (F.col("ix") == F.col("jx")) & (F.col("iy") == F.col("jy")))
    hit = hit.where(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) <= F.col("reach"))
    return own.unionByName(hit.groupBy("point_id").agg(F.min("s").alias("instance_id")))


def grow_regions(
    points: DataFrame,
    seeds: DataFrame,
    *,
    voxel: float,
    z_scale: float = 2.0,
    max_radius: float = 0.5,
    max_iterations: int = 500,
    decrease_after: int = 10,
    least_total: float = 0.002,
    least_trees: float = 0.3,
    terrain_distance: float = 0.8,
    group: str = "cloud_id",
) -> DataFrame:
    """point_id, instance_id of all points that the seeds reach; breadth-first in widening steps.

    points: group, point_id, x, y, z, is_tree. seeds: point_id, instance_id. In each step every
    free point takes the label of its nearest seed within the radius (ties: smallest point_id).
    Newly labelled points are the next seeds; when too little grows, the radius widens by a
    voxel and all labelled points are seeds again. Beyond ``terrain_distance`` of summed radii
    only tree points join. RuntimeError when ``max_iterations`` steps don't end the growth.
    """
    pts = cut(points.select(group, "point_id", "x", "y", (F.col("z") / z_scale).alias("z"), "is_tree"))
    front = cut(seeds.select("point_id", "instance_id").groupBy("point_id").agg(F.min("instance_id").alias("instance_id")))
    n_trees = front.select("instance_id").distinct().count()
    labels, n_fronts = front, 1  # a union of the fronts, written anew every ``COMPACT`` steps
    free = cut(pts.join(labels, "point_id", "left_anti"))
    n_free, radius, still, total, only_trees = free.count(), voxel, 0, 0.0, False
    for step in range(max_iterations + 1):
        if radius > max_radius or not n_free or front.isEmpty():
            break
        if step == max_iterations:
            raise RuntimeError(f"growth did not end within {max_iterations} steps")
        if total > terrain_distance and not only_trees:
            only_trees = True
            free = cut(free.where("is_tree"))
            n_free = free.count()
            if not n_free:
                break
        near = nearest(free.withColumnRenamed("point_id", "query_id"), pts.join(front, "point_id", "left_semi"), 1, dims=("x", "y", "z"), group=group, radius=radius)
        new = cut(near.select("query_id", "point_id").join(front, "point_id").select(F.col("query_id").alias("point_id"), "instance_id"))
        got = new.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("instance_id").alias("t")).first()
        if got["n"]:
            labels, n_fronts = labels.unionByName(new), n_fronts + 1
            if n_fronts == COMPACT:
                labels, n_fronts = cut(labels), 1
            free = free.join(new, "point_id", "left_anti")
            if n_fronts == 1:
                free = cut(free)
        if got["n"] / n_free < least_total or got["t"] / max(1, n_trees) < least_trees:
            radius, front, still = radius + voxel, labels, 0
        else:
            front, still = new, still + 1
        n_free -= got["n"]
        if radius > voxel and still == decrease_after:
            radius, still = radius - voxel, 0
        total += radius
    return labels
