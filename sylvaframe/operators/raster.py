"""Rasters as rows: height maps, terrain heights between raster nodes, raster labels of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.functions.columns import cell_index
from sylvaframe.schema import finite


def height_map(points: DataFrame, cell: float, group: str = "cloud_id") -> DataFrame:
    """ix, iy, h (highest z above the group's lowest), n; cells count from the group's corner.

    Two aggregations with map-side combination; the corner is one row per group.
    """
    corner = points.groupBy(group).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.min("z").alias("z0"))
    rows = points.select(group, "x", "y", "z").join(corner, group)
    rows = rows.groupBy(group, cell_index("x", cell, "x0").alias("ix"), cell_index("y", cell, "y0").alias("iy"))
    return rows.agg(F.max(F.col("z") - F.col("z0")).alias("h"), F.count(F.lit(1)).alias("n"))


def usable_nodes(dtm: DataFrame, group: str = "cloud_id") -> DataFrame:
    """One row per node with a height; null, NaN and no-data marks (|h| > 1000) are none."""
    good = dtm.where(finite("h") & (F.abs(F.col("h")) <= 1000))
    return good.groupBy(group, "ix", "iy").agg(F.min("h").alias("h"))


def terrain_patches(dtm: DataFrame, group: str = "cloud_id") -> DataFrame:
    """Each raster cell with the heights of its four corner nodes (null where there is none).

    The raster is turned into one row per cell, so that points need a single equi-join.
    """
    nodes = usable_nodes(dtm, group)
    role = lambda dx, dy: F.struct((F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"), F.lit(2 * dx + dy).alias("role"))
    rows = nodes.select(group, F.explode(F.array(*[role(i, j) for i in (0, 1) for j in (0, 1)])).alias("r"), "h").select(group, "r.*", "h")
    at = lambda k: F.max(F.when(F.col("role") == k, F.col("h"))).alias(f"h{k}")
    return rows.groupBy(group, "ix", "iy").agg(*[at(k) for k in range(4)])


def height_above_terrain(points: DataFrame, dtm: DataFrame, res: float, x0: float = 0.0, y0: float = 0.0, group: str = "cloud_id", allow_outside: bool = True) -> DataFrame:
    """points with ``height``: z less the terrain, interpolated between a cell's four nodes.

    Outside of the group's raster the position is moved to its edge first, or height is null if
    not ``allow_outside``. Nodes without a height leave the others to share the weight; null
    where no node of the cell has one, or the group has no raster.
    """
    extent = dtm.groupBy(F.col(group).alias("__g")).agg(*[f(f"i{c}").alias(f"__{k}{c}") for c in "xy" for k, f in (("lo", F.min), ("hi", F.max))])
    out = points.join(extent, F.col(group) == F.col("__g"), "left")
    pos = {c: (F.col(c) - o) / res for c, o in (("x", x0), ("y", y0))}
    outside = F.lit(False)
    for c in "xy":
        outside = outside | (pos[c] < F.col(f"__lo{c}")) | (pos[c] > F.col(f"__hi{c}"))
        moved = F.least(F.greatest(pos[c], F.col(f"__lo{c}")), F.col(f"__hi{c}"))
        out = out.withColumn(f"__p{c}", moved)
    out = out.withColumn("__out", outside)
    # the last line of nodes belongs to the cell before it
    cell = lambda c: F.greatest(F.least(F.floor(f"__p{c}"), F.col(f"__hi{c}") - 1), F.col(f"__lo{c}"))
    out = out.withColumn("__ix", cell("x")).withColumn("__iy", cell("y"))
    patch = terrain_patches(dtm, group).select(F.col(group).alias("__pg"), F.col("ix").alias("__jx"), F.col("iy").alias("__jy"), "h0", "h1", "h2", "h3")
    out = out.join(patch, (F.col(group) == F.col("__pg")) & (F.col("__ix") == F.col("__jx")) & (F.col("__iy") == F.col("__jy")), "left")
    u, v = F.col("__px") - F.col("__ix"), F.col("__py") - F.col("__iy")
    weight = [(1 - u) * (1 - v), (1 - u) * v, u * (1 - v), u * v]
    known = [F.when(F.col(f"h{k}").isNotNull(), w).otherwise(0.0) for k, w in enumerate(weight)]
    total = known[0] + known[1] + known[2] + known[3]
    level = sum((F.coalesce(f"h{k}", F.lit(0.0)) * w for k, w in enumerate(known)), F.lit(0.0))
    height = F.col("z") - F.try_divide(level, total)
    if not allow_outside:
        height = F.when(~F.col("__out"), height)
    extra = [c for c in out.columns if c.startswith("__")]
    return out.withColumn("height", height).drop(*extra, "h0", "h1", "h2", "h3")


def raster_labels(points: DataFrame, labels: DataFrame, cell: float, label: str = "instance_id", group: str = "cloud_id", x0=0.0, y0=0.0) -> DataFrame:
    """Points without an instance take that of their raster cell (0 there means none)."""
    keyed = points.withColumn("__ix", cell_index("x", cell, x0)).withColumn("__iy", cell_index("y", cell, y0))
    cells = labels.where(F.col("label") > 0).select(F.col(group).alias("__g"), F.col("ix").alias("__jx"), F.col("iy").alias("__jy"), (F.col("label") - 1).alias("__new"))
    out = keyed.join(cells, (F.col(group) == F.col("__g")) & (F.col("__ix") == F.col("__jx")) & (F.col("__iy") == F.col("__jy")), "left")
    new = F.when(F.coalesce(F.col(label), F.lit(-1)) >= 0, F.col(label)).otherwise(F.coalesce("__new", F.lit(-1)))
    return out.withColumn(label, new).drop("__ix", "__iy", "__g", "__jx", "__jy", "__new")
