"""Heights above the terrain model, made where the points are."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from sylvaframe.operators import groups, morph, nearest, raster, terrain
from sylvaframe.plans.pipelines import StemPipeline
from sylvaframe.session import cut, shared_dir


def test_heights_make_no_rows_of_nodes(spark):
    """Heights equal those over a model of joined nodes, also across leaves and for far-off points; however few ground points there are."""
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.uniform(0, 40, (1500, 2)), rng.uniform(0, 3, (500, 2)), rng.uniform(900, 902, (20, 2)), [[-700.0, 300.0]]])
    rows = [("c" if i % 4 else "d", i, float(x), float(y), float(0.02 * x + (0 if i % 3 else 4)) + float(rng.uniform(0, 0.1))) for i, (x, y) in enumerate(xy)]
    rows += [("few", 5000 + i, 0.4 * i, 0.1, 0.1 * i) for i in range(5)]  # fewer ground points than neighbours
    points = spark.createDataFrame(rows, "cloud_id string, point_id bigint, x double, y double, z double").repartition(3).cache()
    cloth = cut(morph.cloth_heights(points, 0.5, 0.5))
    high, ground = terrain.terrain_heights(points, cloth, resolution=0.5, threshold=0.5, voxel=0.3, node=0.25, k=40, target=150)
    classed = morph.classify_terrain(points, 0.5, 0.5)
    low = groups.voxel_downsample(classed.where("terrain = 0").select("cloud_id", "point_id", "x", "y", "z"), 0.3).cache()
    assert {tuple(r) for r in ground.collect()} == {tuple(r) for r in low.select(*ground.columns).collect()}
    used = points.select("cloud_id", *[F.floor(F.col(c) / 0.25).alias(f"i{c}") for c in "xy"]).distinct()
    line = lambda c: F.explode(F.array(F.col(f"i{c}"), F.col(f"i{c}") + 1))
    nodes = used.withColumn("ix", line("x")).withColumn("iy", line("y")).distinct()
    nodes = nodes.select("*", (F.col("ix") * 0.25).alias("x"), (F.col("iy") * 0.25).alias("y"), F.xxhash64("cloud_id", "ix", "iy").alias("query_id"))
    dtm = nodes.join(nearest.interpolate_terrain(nodes, low, 40, 1.0), "query_id").select("cloud_id", "ix", "iy", "h")
    want = {r.point_id: (r.terrain, r.height) for r in raster.height_above_terrain(classed, dtm, 0.25).collect()}
    got = {r.point_id: (r.terrain, r.h) for r in high.collect()}
    assert len(got) == len(rows) and got.keys() == want.keys()
    assert all(got[i][0] == t and abs(got[i][1] - h) < 1e-9 for i, (t, h) in want.items())


def test_ties_of_ground_points_by_id():
    ground = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0], [3.0, 3.0]])
    z = np.array([1.0, 2.0, 3.0, 4.0, 9.0])
    got = terrain.idw_levels(np.array([[0.0, 0.0], [3.0, 3.0]]), ground, z, np.array([5, 4, 3, 2, 1]), 2, 1.0)
    assert got.tolist() == [3.5, 9.0]
    assert np.isnan(terrain.idw_levels(np.zeros((1, 2)), ground[:0], z[:0], np.empty(0, int), 2, 1.0)).all()


def test_cloth_on_slices_equals_cloth_on_cells():
    rng = np.random.default_rng(5)
    for shape in ((1, 1), (1, 7), (8, 1), (9, 12), (30, 31)):
        surface = np.where(rng.random(shape) < 0.7, rng.uniform(0, 9, shape), np.nan)
        known = ~np.isnan(surface)
        known[0, 0] = True
        ground = -np.nan_to_num(surface)
        for rigidness in (1, 3):
            assert np.array_equal(morph._fallen_cells(ground, known, rigidness, 200, 0.65), morph._fallen_grid(ground, known, rigidness, 200, 0.65))


def test_heights_ship_less_than_their_nodes_would(spark):
    """All that ``heights`` ever writes to the shared folder is a few packed copies of the points."""
    n = 3000
    rng = np.random.default_rng(4)
    rows = [("c", i, float(x), float(y), 0.0) for i, (x, y) in enumerate(rng.uniform(0, 200, (n, 2)))]
    points = spark.createDataFrame(rows, "cloud_id string, point_id bigint, x double, y double, z double")
    shared_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))  # this session's own
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    high = StemPipeline().heights(points)
    assert high.count() == n
    assert size() - before < 150 * n
