"""Segmentation pipelines: stems first, then crowns; and canopy first, then refinement."""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaframe.functions.columns import in_band, is_tree_point, remap_invalid, truncated_index
from sylvaframe.operators import cluster, fit, groups, morph, nearest, raster, terrain
from sylvaframe.operators.stems import points_in_layers, points_near_circles, points_near_ellipses
from sylvaframe.plans.tracker import Tracker
from sylvaframe.session import cut, packed_cut, sweep


class SegmentationPipeline(ABC):
    """points in, (cloud_id, point_id, instance_id) out; -1 means no instance."""

    def __init__(self) -> None:
        self.tracker = Tracker()
        self.logger = logging.getLogger(f"{__name__}.{type(self).__name__}")

    def performance_metrics(self, spark: SparkSession) -> DataFrame:
        """description, wall_s, cpu_s, rss_gb, rss_delta_gb of the steps so far, in their order."""
        names = ("wall_s", "cpu_s", "rss_gb", "rss_delta_gb")
        rows = [(k, *[float(v.get(n, 0.0)) for n in names]) for k, v in self.tracker.rows.items()]
        return spark.createDataFrame(rows, "description string, " + ", ".join(f"{n} double" for n in names))

    @abstractmethod
    def transform(self, points: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class StemParameters:
    """The reference's defaults."""

    csf_resolution: float = 0.5
    csf_threshold: float = 0.5
    csf_iterations: int = 500
    terrain_resolution: float = 0.25
    terrain_neighbours: int = 400
    terrain_voxel: float = 0.05
    min_z: float = 1.0
    max_z: float = 4.0
    voxel: float = 0.015
    eps_2d: float = 0.025
    eps_3d: float = 0.1
    min_points_2d: int = 90
    min_points_3d: int = 15
    min_cluster_points: int = 300
    min_extent: float = 1.5
    min_intensity: float | None = 6000.0
    max_inclination: float | None = None
    n_layers: int = 15
    layer_start: float = 1.0
    layer_height: float = 0.225
    layer_overlap: float = 0.025
    layer_points: int = 15
    bandwidth: float = 0.01
    ellipses: bool = False
    refine: bool = False
    buffer_switch: float = 0.3
    buffer_small: float = 0.06
    buffer_large: float = 0.09
    outline_buffer: float = 0.03
    outline_difference: float | None = 0.3
    combination: int = 6
    max_std_diameter: float = 0.04
    max_std_position: float | None = None
    grow_voxel: float = 0.05
    grow_max_radius: float = 0.5
    grow_max_iterations: int = 500
    grow_least_total: float = 0.002
    grow_least_trees: float = 0.3
    grow_terrain_distance: float = 0.8
    seed_height: float = 0.6
    seed_factor: float = 1.05
    seed_min_diameter: float = 0.05
    min_diameter: float = 0.02
    max_diameter: float = 1.0
    invalid_id: int = -1

    def __post_init__(self) -> None:
        checks = {
            "invalid_id must not be above 0": self.invalid_id <= 0,
            "min_z must not be below csf_threshold": self.min_z >= self.csf_threshold,
            "layer_start must not be below min_z": self.layer_start >= self.min_z,
            "min_diameter must be below max_diameter": self.min_diameter < self.max_diameter,
        }
        for message, fine in checks.items():
            if not fine:
                raise ValueError(message)

    def with_values(self, **values) -> StemParameters:
        return replace(self, **values)


class StemPipeline(SegmentationPipeline):
    """Terrain, heights, stem clusters, shapes per layer, stable stems, region growing."""

    def __init__(self, parameters: StemParameters = StemParameters()) -> None:  # noqa: B008
        super().__init__()
        self.p = parameters
        #: a terrain model of the caller's for the stems' centres; else that of ``heights``
        self.dtm: DataFrame | None = None
        self.ground: DataFrame | None = None

    def heights(self, points: DataFrame) -> DataFrame:
        """points with ``terrain`` (0 ground) and ``h`` above it; keeps the ground points of the terrain model.

        The model has only the nodes around cells with points, made where the points are: a far-off point adds four.
        """
        p = self.p
        cloth = morph.cloth_heights(points, p.csf_resolution, p.csf_threshold, 2, p.csf_iterations)
        sweep(points.sparkSession)
        high, self.ground = terrain.terrain_heights(points, cloth, resolution=p.csf_resolution, threshold=p.csf_threshold, voxel=p.terrain_voxel, node=p.terrain_resolution, k=p.terrain_neighbours)
        del cloth
        sweep(points.sparkSession)
        return high

    def model_at(self, places: DataFrame) -> DataFrame:
        """The terrain model's nodes (cloud_id, ix, iy, h) of the cells that hold places (cloud_id, x, y)."""
        p = self.p
        used = places.select("cloud_id", *[F.floor(F.col(c) / p.terrain_resolution).alias(f"i{c}") for c in "xy"]).distinct()
        line = lambda c: F.explode(F.array(F.col(f"i{c}"), F.col(f"i{c}") + 1))
        nodes = used.withColumn("ix", line("x")).withColumn("iy", line("y")).distinct()
        nodes = nodes.select("cloud_id", "ix", "iy", *[(F.col(f"i{c}") * p.terrain_resolution).alias(c) for c in "xy"], F.xxhash64("cloud_id", "ix", "iy").alias("query_id"))
        level = nearest.interpolate_terrain(nodes, self.ground, p.terrain_neighbours, 1.0)
        return cut(nodes.join(level, "query_id").select("cloud_id", "ix", "iy", "h"))

    def stems(self, points: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(stems: cloud_id, stem_id, x, y, diameter; their points: point_id, stem_id)."""
        p = self.p
        band = points.where(in_band("h", p.min_z, p.max_z))
        thin = packed_cut(groups.voxel_downsample(band.select("cloud_id", "point_id", "x", "y", "z", "h", *[c for c in ("intensity",) if c in band.columns]), p.voxel))

        sweep(points.sparkSession)

        def clustered(df: DataFrame, eps: float, least: int, dims: tuple[str, ...], group: str) -> DataFrame:
            own = cluster.dbscan(df, eps, least, dims=dims, group=group)
            df = df.drop("instance_id").join(own.select("point_id", F.col("cluster").alias("instance_id")), "point_id")
            df = df.where(F.col("instance_id").isNotNull())
            sized = df.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"), (F.max("z") - F.min("z")).alias("e"))
            kept = sized.where((F.col("n") >= p.min_cluster_points) & (F.col("e") >= p.min_extent)).select("instance_id")
            return cut(df.join(kept, "instance_id", "left_semi"))

        flat = clustered(thin, p.eps_2d, p.min_points_2d, ("x", "y"), "cloud_id")
        flat = flat.withColumn("flat_id", F.col("instance_id").cast("string"))
        solid = clustered(flat, p.eps_3d, p.min_points_3d, ("x", "y", "z"), "flat_id").drop("flat_id")
        if p.min_intensity is not None and "intensity" in solid.columns:
            q = solid.groupBy("instance_id").agg(F.percentile("intensity", 0.8).alias("q")).where(F.col("q") > p.min_intensity).select("instance_id")
            solid = solid.join(q, "instance_id", "left_semi")
        if p.max_inclination is not None:
            ok = groups.principal_axes(solid).where(F.coalesce(F.col("inclination") <= p.max_inclination, F.lit(True))).select("instance_id")
            solid = solid.join(ok, "instance_id", "left_semi")
        solid = cut(solid.withColumnRenamed("instance_id", "stem_id"))
        if self.dtm is None and (self.ground is None or solid.isEmpty()):
            level = solid.groupBy("stem_id").agg(F.avg(F.col("z") - F.col("h")).alias("terrain"))
        else:
            middle = cut(solid.groupBy("cloud_id", "stem_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("z", F.lit(0.0)))
            dtm = self.model_at(middle) if self.dtm is None else self.dtm
            level = raster.height_above_terrain(middle, dtm, p.terrain_resolution).select("stem_id", (-F.col("height")).alias("terrain"))
        level = cut(level)
        rows = points_in_layers(solid, level, n_layers=p.n_layers, start=p.layer_start, height=p.layer_height, overlap=p.layer_overlap, least=p.layer_points)
        shapes = self.shapes(rows.join(solid.select("point_id", "x", "y"), "point_id"))
        near = None
        if p.refine:
            near = cut(self.around(band, shapes, level, p.buffer_small, p.buffer_large))
            shapes = self.shapes(near.join(shapes.select("cloud_id", "stem_id", "layer", "mid_height"), ["cloud_id", "stem_id", "layer"]))
        stable = cut(fit.stable_layers(shapes, p.combination, p.max_std_diameter, p.max_std_position))
        if near is None:
            near = self.around(thin, shapes, level, p.outline_buffer, p.outline_buffer)
        stable = cut(fit.outline_diameters(near, stable, p.outline_difference))
        found = cut(fit.stem_positions(stable))
        return found, solid.join(found.select("stem_id"), "stem_id", "left_semi").select("point_id", "stem_id")

    def shapes(self, rows: DataFrame) -> DataFrame:
        """Circle and ellipse of each layer as flat columns."""
        p = self.p
        s = fit.fit_layers(rows, min_diameter=p.min_diameter, max_diameter=p.max_diameter, min_points=p.layer_points, ellipses=p.ellipses, bandwidth=p.bandwidth)
        return cut(s.select("cloud_id", "stem_id", "layer", "mid_height", "circle.*", F.col("ellipse.cx").alias("ex"), F.col("ellipse.cy").alias("ey"), *[F.col(f"ellipse.{c}").alias(c) for c in ("a", "b", "theta")]))

    def around(self, points: DataFrame, shapes: DataFrame, level: DataFrame, small: float, large: float) -> DataFrame:
        """cloud_id, stem_id, layer, x, y of all points around the layers' shapes."""
        p = self.p
        more = {"height": p.layer_height, "limit": p.buffer_switch, "small": small, "large": large}
        near = points_near_circles(points, shapes, level, **more).unionByName(points_near_ellipses(points, shapes, level, **more))
        return near.join(points.select("point_id", "x", "y"), "point_id").select("cloud_id", "stem_id", "layer", "x", "y")

    def transform(self, points: DataFrame) -> DataFrame:
        p = self.p
        with self.tracker.measure("heights"):
            high = self.heights(points)
        with self.tracker.measure("stems"):
            stems, own = self.stems(high)
        n_stems = stems.count()
        self.logger.info("%d stems", n_stems)
        if not n_stems:
            return points.select("cloud_id", "point_id", F.lit(p.invalid_id).cast("bigint").alias("instance_id"))
        with self.tracker.measure("crowns"):
            labelled = high.join(own, "point_id", "left").withColumn("is_tree", F.col("h") >= p.csf_threshold)
            thin = packed_cut(groups.voxel_downsample(labelled.select("cloud_id", "point_id", "x", "y", "z", "h", "stem_id", "is_tree"), p.grow_voxel))
            seeds = cluster.stem_seeds(thin, stems, band=p.seed_height, factor=p.seed_factor, least_diameter=p.seed_min_diameter)
            grown = cluster.grow_regions(thin, seeds, voxel=p.grow_voxel, max_radius=p.grow_max_radius, max_iterations=p.grow_max_iterations, least_total=p.grow_least_total, least_trees=p.grow_least_trees, terrain_distance=p.grow_terrain_distance)
            reduced = thin.join(grown, "point_id", "left").select("cloud_id", "vx", "vy", "vz", F.coalesce("instance_id", F.lit(-1)).alias("instance_id"))
            out = groups.upsample(points.select("cloud_id", "point_id", "x", "y", "z"), reduced, p.grow_voxel, "instance_id")
            return groups.relabel(out).select("cloud_id", "point_id", remap_invalid("instance_id", p.invalid_id).cast("bigint").alias("instance_id"))


VARIANTS = ("full", "watershed_crown_top_positions", "watershed_matched_tree_positions")


@dataclass(frozen=True)
class CanopyParameters:
    """The reference's defaults."""

    variant: str = "full"
    voxel: float | None = None
    branches: bool = False
    trunk_eps: float = 2.5
    min_trunk_points: int = 100
    cell: float = 0.5
    min_distance: float = 7.0
    min_cell_points: int = 100
    min_height: float = 2.5
    smooth_sigma: float | None = 1.0
    match_distance: float = 5.0
    correct: bool = True
    max_spacing: float = 0.08
    grow_radius: float = 1.0
    outside_factor: float = 2.0
    grow_neighbours: int = 27
    z_scale: float = 0.5


class CanopyPipeline(SegmentationPipeline):
    """Crown tops and trunks become tree positions, a watershed of the canopy gives the labels, overlapping crowns are grown anew.

    The variants stop earlier: after the watershed from the crown tops of all tree points, or
    after the watershed from the matched positions.
    """

    def __init__(self, parameters: CanopyParameters = CanopyParameters()) -> None:  # noqa: B008
        super().__init__()
        if parameters.variant not in VARIANTS:
            raise ValueError(f"variant must be one of {', '.join(VARIANTS)}")
        self.p = parameters

    def transform(self, points: DataFrame) -> DataFrame:
        """points: cloud_id, point_id, x, y, z, cls (1 trunk, 2 crown, 3 branch)."""
        p = self.p
        trees = cut(points.where(is_tree_point("cls", p.branches)).select("cloud_id", "point_id", "x", "y", "z", "cls"))
        with self.tracker.measure("downsampling"):
            thin = trees if p.voxel is None else cut(groups.voxel_downsample(trees, p.voxel).drop("vx", "vy", "vz"))
        labels = self.segment(thin)
        if p.voxel is not None:
            with self.tracker.measure("upsampling"):
                keyed = thin.join(labels, "point_id").select("cloud_id", *groups.voxel_keys(p.voxel), "instance_id")
                labels = groups.upsample(trees.select("cloud_id", "point_id", "x", "y", "z"), keyed, p.voxel, "instance_id").select("point_id", "instance_id")
        rest = points.select("cloud_id", "point_id").join(labels, "point_id", "left")
        return groups.relabel(rest.select("cloud_id", "point_id", F.coalesce("instance_id", F.lit(-1)).cast("bigint").alias("instance_id")))

    def segment(self, trees: DataFrame) -> DataFrame:
        """point_id, instance_id (a tree's number in its cloud, -1: none) of tree points."""
        p = self.p
        corner = trees.groupBy("cloud_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
        cell = lambda c: F.floor((F.col(c) - F.col(f"{c}0")) / p.cell)
        placed = cut(trees.join(corner, "cloud_id").select(*trees.columns, cell("x").alias("ix"), cell("y").alias("iy")))
        with self.tracker.measure("crown tops"):
            # the full variant looks for tops among crown points, in the raster of all tree points' box
            seen = placed if p.variant == "watershed_crown_top_positions" else placed.where("cls = 2")
            low = seen.groupBy(F.col("cloud_id").alias("g")).agg(F.min("z").alias("z0"))
            chm = seen.join(low, F.col("cloud_id") == F.col("g")).groupBy("cloud_id", "ix", "iy").agg(F.max(F.col("z") - F.col("z0")).alias("h"), F.count(F.lit(1)).alias("n"))
            chm = cut(chm)
            tops = morph.find_crown_tops(chm, p.cell, min_distance=p.min_distance, min_height=p.min_height, min_points=p.min_cell_points, sigma=p.smooth_sigma)
        if p.variant == "watershed_crown_top_positions":
            at, own = cut(tops.select("cloud_id", F.col("top_no").alias("tree_no"), "ix", "iy")), None
        else:
            at, own = self.positions(trees, tops, corner)
        with self.tracker.measure("watershed"):
            labels = cut(morph.segment_canopy(chm, at, correct=p.correct))
        start = placed.withColumn("instance_id", F.lit(-1).cast("bigint")) if own is None else placed.join(own, "point_id", "left")
        region = labels.where("label > 0").select("cloud_id", "ix", "iy", (F.col("label") - 1).alias("region"))
        coarse = start.join(region, ["cloud_id", "ix", "iy"], "left").withColumn("instance_id", F.coalesce("instance_id", "region", F.lit(-1).cast("bigint"))).drop("region")
        if own is None:
            coarse = start.drop("instance_id").join(region.withColumnRenamed("region", "instance_id"), ["cloud_id", "ix", "iy"], "left").withColumn("instance_id", F.coalesce("instance_id", F.lit(-1).cast("bigint")))
        if p.variant != "full":
            return coarse.select("point_id", "instance_id")
        with self.tracker.measure("overlaps"):
            marked = cut(morph.overlapping_crowns(cut(coarse), labels, p.max_spacing, trunks=(1, 3) if p.branches else (1,)))
        with self.tracker.measure("growth"):
            grown = morph.grow_crowns(marked, labels, at, k=p.grow_neighbours, radius=p.grow_radius, factor=p.outside_factor, z_scale=p.z_scale)
        grown = grown.select("point_id", F.col("instance_id").alias("grown"))
        return marked.join(grown, "point_id", "left").select("point_id", F.coalesce("grown", "instance_id").alias("instance_id"))

    def positions(self, trees: DataFrame, tops: DataFrame, corner: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(cloud_id, tree_no, ix, iy: trunks first, then unmatched tops; point_id, instance_id of trunk points)."""
        p = self.p
        with self.tracker.measure("trunks"):
            tops = tops.join(corner, "cloud_id").select("cloud_id", F.xxhash64("cloud_id", "ix", "iy").alias("id"), *[(F.col(f"i{c}") * p.cell + F.col(f"{c}0")).alias(c) for c in "xy"])
            own = cut(cluster.cluster_trunks(trees, p.trunk_eps, p.branches).where("cluster IS NOT NULL"))
            big = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.min_trunk_points).select("cluster")
            own = cut(own.join(big, "cluster", "left_semi"))
            trunks = trees.join(own, "point_id").groupBy("cloud_id", F.col("cluster").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        with self.tracker.measure("matching"):
            at = nearest.tree_positions(cut(trunks), cut(tops), p.match_distance)
            number = F.row_number().over(_order()) - 1
            index = lambda c: truncated_index(c, p.cell, F.col(f"{c}0")).alias(f"i{c}")
            at = cut(at.join(corner, "cloud_id").select("cloud_id", "id", "kind", number.cast("bigint").alias("tree_no"), index("x"), index("y")))
        first = own.join(at.where("kind = 'trunk'").select(F.col("id").alias("cluster"), F.col("tree_no").alias("instance_id")), "cluster").select("point_id", "instance_id")
        return at, first


def _order():
    from pyspark.sql import Window as W

    return W.partitionBy("cloud_id").orderBy(F.desc("kind"), "id")


#: The reference's presets by what they change. Scans from the ground (tls) are the defaults.
PRESETS = {
    "default": StemParameters(),
    "tls": StemParameters(),
    "original": StemParameters(max_z=3.0, min_extent=1.3, refine=True, ellipses=True, n_layers=14, layer_height=0.125, layer_points=50, max_std_diameter=0.0185, outline_difference=None),
    "uls": StemParameters(max_z=5.0, eps_2d=0.07, min_points_2d=15, eps_3d=0.3, min_points_3d=1, min_cluster_points=20, n_layers=4, layer_height=1.4, layer_overlap=0.4, bandwidth=0.03, max_std_diameter=0.1, combination=2),
}
