"""Per-instance filters and aggregates, voxels and labels. Labels below 0 are no instance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaframe.schema import INVALID, require


def relabel(points: DataFrame, label: str = "instance_id", group: str = "cloud_id") -> DataFrame:
    """Valid labels become 0..K-1 per group in their order; others become -1.

    The rank is computed on the distinct labels, so no window ever holds points.
    """
    require(points, label, group)
    ids = points.where(F.col(label) >= 0).select(group, label).distinct()
    ids = ids.select(F.col(group).alias("__g"), F.col(label).alias("__l"), (F.row_number().over(W.partitionBy(group).orderBy(label)) - 1).cast("bigint").alias("__new"))
    out = points.join(ids, (F.col(group) == F.col("__g")) & (F.col(label) == F.col("__l")), "left")
    return out.withColumn(label, F.coalesce("__new", F.lit(INVALID))).drop("__g", "__l", "__new")


def _keep_where(points: DataFrame, label: str, group: str, keep: DataFrame) -> DataFrame:
    """Points whose (group, label) isn't in ``keep`` get -1. keep: one row per kept label."""
    kept = keep.select(F.col(group).alias("__g"), F.col(label).alias("__l"), F.lit(True).alias("__ok"))
    out = points.join(kept, (F.col(group) == F.col("__g")) & (F.col(label) == F.col("__l")), "left")
    return out.withColumn(label, F.when(F.col("__ok"), F.col(label)).otherwise(F.lit(INVALID).cast("bigint"))).drop("__g", "__l", "__ok")


def _by_label(points: DataFrame, label: str, group: str, *aggs: Column) -> DataFrame:
    return points.where(F.col(label) >= 0).groupBy(group, label).agg(*aggs)


def filter_min_points(points: DataFrame, least: int | None, label: str = "instance_id", group: str = "cloud_id") -> DataFrame:
    """Drops labels of fewer than ``least`` points, then relabels; None changes nothing."""
    if least is None:
        return points
    keep = _by_label(points, label, group, F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return relabel(_keep_where(points, label, group, keep), label, group)


def filter_extent(points: DataFrame, least: float, label: str = "instance_id", group: str = "cloud_id") -> DataFrame:
    """Drops labels whose vertical extent is below ``least``; an equal one stays."""
    keep = _by_label(points, label, group, (F.max("z") - F.min("z")).alias("e")).where(F.col("e") >= least)
    return relabel(_keep_where(points, label, group, keep), label, group)


def filter_intensity(points: DataFrame, least: float, q: float = 0.8, label: str = "instance_id", group: str = "cloud_id") -> DataFrame:
    """Drops labels whose q-quantile of intensity (interpolated) is ``least`` or lower."""
    keep = _by_label(points, label, group, F.percentile("intensity", q).alias("q")).where(F.col("q") > least)
    return relabel(_keep_where(points, label, group, keep), label, group)


def principal_axes(points: DataFrame, label: str = "instance_id", group: str = "cloud_id") -> DataFrame:
    """Per label: n, ``inclination`` of the first principal axis to +z in degrees, its share of variance.

    Ten sums per label reach Python, never points. Labels of one point or without spread have nulls.
    """
    names = ("x", "y", "z")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    cov = _by_label(points, label, group, F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])
    kind = points.schema[label].dataType.simpleString()

    def eigen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            c = np.empty((t.num_rows, 3, 3))
            for a, b in pairs:
                i, j = names.index(a), names.index(b)
                c[:, i, j] = c[:, j, i] = np.nan_to_num(t.column(f"c{a}{b}").to_numpy(zero_copy_only=False).astype(float))
            value, vector = np.linalg.eigh(c)
            total = value.sum(1)
            flat = total <= 0
            angle = np.degrees(np.arccos(np.clip(np.abs(vector[:, 2, 2]), 0, 1)))
            share = value[:, 2] / np.where(flat, 1, total)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column("n"), pa.array(angle, mask=flat), pa.array(share, mask=flat)], names=[group, label, "n", "inclination", "share"])

    return cov.mapInArrow(eigen, f"{group} string, {label} {kind}, n bigint, inclination double, share double")


def filter_pca(points: DataFrame, max_inclination: float | None, min_share: float | None, label: str = "instance_id", group: str = "cloud_id") -> DataFrame:
    """Drops labels leaning more than ``max_inclination`` degrees or spread in more than one direction."""
    keep = principal_axes(points, label, group)
    if max_inclination is not None:
        keep = keep.where(F.coalesce(F.col("inclination") <= max_inclination, F.lit(True)))
    if min_share is not None:
        keep = keep.where(F.coalesce(F.col("share") >= min_share, F.lit(True)))
    return relabel(_keep_where(points, label, group, keep), label, group)


def centroids(points: DataFrame, label: str = "instance_id", group: str = "cloud_id") -> DataFrame:
    return _by_label(points, label, group, F.avg("x").alias("x"), F.avg("y").alias("y"))


def bounding_boxes(points: DataFrame, group: str = "cloud_id") -> DataFrame:
    return points.groupBy(group).agg(*[f(c).alias(f"{k}_{c}") for c in "xy" for k, f in (("min", F.min), ("max", F.max))])


def isotropic_scale(points: DataFrame, label: str = "instance_id", group: str = "cloud_id") -> DataFrame:
    """Population deviation over all x and y of a label taken together."""
    rows = points.where(F.col(label) >= 0).select(group, label, F.explode(F.array("x", "y")).alias("v"))
    return rows.groupBy(group, label).agg(F.stddev_pop("v").alias("scale"))


def voxel_keys(size: float, axes: str = "xyz") -> list[Column]:
    return [F.floor(F.col(c) / size).alias(f"v{c}") for c in axes]


def voxel_downsample(points: DataFrame, size: float, group: str = "cloud_id") -> DataFrame:
    """The point of each occupied voxel nearest to its centre, ties by point_id, with vx, vy, vz."""
    d2 = sum((F.col(c) - (F.floor(F.col(c) / size) + 0.5) * size) * (F.col(c) - (F.floor(F.col(c) / size) + 0.5) * size) for c in "xyz")
    cols = [c for c in points.columns if c != group]
    best = points.groupBy(group, *voxel_keys(size)).agg(F.min_by(F.struct(*cols), F.struct(d2, "point_id")).alias("p"))
    return best.select(group, "p.*", "vx", "vy", "vz")


def upsample(points: DataFrame, reduced: DataFrame, size: float, label: str, group: str = "cloud_id") -> DataFrame:
    """Labels of a voxel's representative for all its points."""
    keyed = points.drop(label).withColumns({f"v{c}": F.floor(F.col(c) / size) for c in "xyz"})
    return keyed.join(reduced.select(group, "vx", "vy", "vz", label), [group, "vx", "vy", "vz"], "left").drop("vx", "vy", "vz")


def fit_line(rows: DataFrame, keys: list[str], x: str, y: str, at: float) -> DataFrame:
    """Least-squares line per key and its value at ``at``; without spread in x the mean of y."""
    line = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("__mx"), F.avg(y).alias("__my"), F.try_divide(F.covar_pop(x, y), F.var_pop(x)).alias("slope")
    )
    slope = F.coalesce("slope", F.lit(0.0))
    return line.select(*keys, "n", slope.alias("slope"), (F.col("__my") - slope * F.col("__mx")).alias("intercept"), (F.col("__my") + slope * (at - F.col("__mx"))).alias("predicted"))
