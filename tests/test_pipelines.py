import struct
import zlib

import numpy as np
import pytest

from sylvaframe.functions.colors import BACKGROUND, palette
from sylvaframe.operators.metrics import run_times
from sylvaframe.plans.evaluation import evaluate
from sylvaframe.plans.pipelines import PRESETS, CanopyParameters, CanopyPipeline, StemParameters, StemPipeline
from sylvaframe.plans.tracker import Tracker
from sylvaframe.sources import rasters
from sylvaframe.sources.pointfiles import read_csv_points, register, write_clouds, write_las, write_table


def two_trees():
    """Flat ground, two stems of stacked circles and two cubic crowns."""
    rng = np.random.default_rng(0)
    grid = lambda n, s: np.stack(np.meshgrid(*[np.arange(k) * s for k in n], indexing="ij"), -1).reshape(-1, len(n))
    ground = np.c_[grid((100, 100), 0.1), np.zeros(10_000)]

    def stem(x, y, r, layers):
        t = np.linspace(0, 2 * np.pi, 200)
        return np.concatenate([np.c_[x + (r + rng.normal(0, 0.003, 200)) * np.cos(t), y + r * np.sin(t), np.full(200, k * 0.1 + 0.1)] for k in range(layers)])

    parts = [ground, grid((20,) * 3, 0.1) + [1.05, 1.05, 3.1], stem(2.05, 2.05, 0.15, 30), grid((30,) * 3, 0.1) + [4.15, 4.15, 3.6], stem(5.65, 5.65, 0.25, 35)]
    return np.concatenate(parts), np.repeat([0, 1, 1, 2, 2], [len(p) for p in parts])


@pytest.fixture(scope="module")
def trees(spark):
    p, label = two_trees()
    df = spark.createDataFrame([("c", i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(p, label, strict=True))], "cloud_id string, point_id bigint, x double, y double, z double, target bigint")
    return df.repartition(4)


def test_stems_are_found_where_they_are(spark, trees):
    pipe = StemPipeline(StemParameters(csf_resolution=0.5, csf_threshold=0.05, csf_iterations=200, terrain_resolution=0.5, terrain_neighbours=8, voxel=0.03, eps_2d=0.06, eps_3d=0.15, min_points_2d=4, min_points_3d=4, min_cluster_points=100, min_extent=1.0, n_layers=6, layer_height=0.3, layer_overlap=0.1, layer_points=10, combination=3))
    stems, _ = pipe.stems(pipe.heights(trees))
    got = sorted((round(r.x, 2), round(r.y, 2), round(r.diameter, 2)) for r in stems.collect())
    assert len(got) == 2
    assert np.allclose(got, [(2.05, 2.05, 0.3), (5.65, 5.65, 0.5)], atol=0.011)


def test_unmodified_preset_finds_a_stem(spark):
    t, h = np.meshgrid(np.arange(16) * np.pi / 8, np.arange(0.5, 5, 0.09))
    rows = [("c", i, 3 + 0.05 * float(np.cos(a)), 3 + 0.05 * float(np.sin(a)), 10 + float(z), float(z), 9000.0) for i, (a, z) in enumerate(zip(t.ravel(), h.ravel(), strict=True))]
    points = spark.createDataFrame(rows, "cloud_id string, point_id bigint, x double, y double, z double, h double, intensity double")
    stems, own = StemPipeline(PRESETS["default"]).stems(points.repartition(4))
    got = stems.collect()
    assert len(got) == 1 and np.allclose([got[0].x, got[0].y, got[0].diameter], [3, 3, 0.1], atol=0.001)
    assert max(rows[r.point_id][5] for r in own.collect()) > 3.5


def test_canopy_pipeline_and_evaluation(spark, trees):
    from pyspark.sql import functions as F

    cls = F.when(F.col("target") == 0, 0).when(F.col("z") < 3.1, 1).otherwise(2)
    pts = trees.withColumn("cls", cls).where((F.col("cls") != 1) | (F.col("point_id") % 5 == 0))
    out = CanopyPipeline(CanopyParameters(min_cell_points=1)).transform(pts).withColumnRenamed("instance_id", "prediction")
    both = pts.withColumn("target", F.col("target") - 1).join(out.select("point_id", "prediction"), "point_id")
    e = evaluate(both, partitions=5)
    m = e.metrics.first()
    assert (m.DetectionTP, m.DetectionFP, m.DetectionFN) == (2, 0, 0) and m.SegmentationMeanIoU > 0.95
    assert e.partition_xy.count() and e.partition_z.count()


@pytest.mark.parametrize(("variant", "branches", "voxel"), [("full", True, 0.05), ("full", False, None), ("watershed_crown_top_positions", True, None), ("watershed_matched_tree_positions", False, 0.05)])
def test_canopy_variants_label_every_point(spark, variant, branches, voxel):
    rng = np.random.default_rng(0)
    rows = [("c", i, *map(float, v), int(i % 4)) for i, v in enumerate(rng.normal(0, 2, (30, 3)))]
    points = spark.createDataFrame(rows, "cloud_id string, point_id bigint, x double, y double, z double, cls bigint")
    p = CanopyParameters(variant=variant, branches=branches, voxel=voxel, min_trunk_points=1, min_cell_points=1, min_height=0.1, min_distance=1.0, max_spacing=5.0)
    got = CanopyPipeline(p).transform(points).collect()
    assert sorted(r.point_id for r in got) == list(range(30))
    assert all(r.instance_id == -1 for r in got if r.point_id % 4 == 0 or (r.point_id % 4 == 3 and not branches))
    with pytest.raises(ValueError):
        CanopyPipeline(CanopyParameters(variant="none"))


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    p = np.round(rng.uniform([412000, 115000, -5], [412100, 115100, 30], (1000, 3)), 3)
    write_las(*p.T, str(tmp_path / "a.las"), intensity=np.arange(1000), classification=np.arange(1000) % 5)
    register(spark)
    got = spark.read.format("las").load(str(tmp_path / "a.las")).orderBy("intensity").toPandas()
    assert np.allclose(got[["x", "y", "z"]], p, atol=1e-6) and got.classification.tolist() == [i % 5 for i in range(1000)]


def test_las_sink_keeps_attributes(spark, tmp_path):
    rows = [(float(i), i * 0.5, -1.0 * i, 7.0, i % 5, i - 1, None if i % 3 else 0.25 * i, "text") for i in range(500)] + [(None, 1.0, 1.0, 1.0, 1, 1, 1.0, "t")]
    df = spark.createDataFrame(rows, "x double, y double, z double, intensity double, classification bigint, instance_id bigint, score double, note string")
    register(spark)
    df.repartition(3).write.format("las").mode("append").save(str(tmp_path / "out"))
    got = spark.read.format("las").load(str(tmp_path / "out")).orderBy("x").toPandas()
    assert list(got.columns) == ["x", "y", "z", "intensity", "classification", "instance_id", "score"] and len(got) == 500
    assert got.instance_id.tolist() == [i - 1 for i in range(500)] and got.classification.tolist() == [i % 5 for i in range(500)]
    assert [s for s in got.score if s == s] == [0.25 * i for i in range(0, 500, 3)]


def test_raster_files(spark, tmp_path):
    dtm = spark.createDataFrame([("c", 0, 0, 1.5), ("c", 3, 1, 2.5), ("c", 3, 1, 2.0), ("c", 5, 0, 9.0), ("c", 1, 1, None), ("d", -1, -1, 4.0)], "cloud_id string, ix int, iy int, h double")
    got = {(r.cloud_id, r.tx, r.ty): r.file for r in rasters.write_heights(dtm, str(tmp_path / "tif"), 0.5, x0=100.0, tile=4).collect()}
    assert set(got) == {("c", 0, 0), ("c", 1, 0), ("d", -1, -1)}
    raw = open(got["c", 0, 0], "rb").read()
    tags = {t: (k, n, v) for t, k, n, v in (struct.unpack_from("<HHII", raw, 10 + 12 * i) for i in range(struct.unpack_from("<H", raw, 8)[0]))}
    image = np.frombuffer(raw, "<f4", 16, tags[273][2]).reshape(4, 4)
    assert tags[256][2] == tags[257][2] == 4 and image[3, 0] == 1.5 and image[2, 3] == 2.0 and (image == rasters.NO_DATA).sum() == 14
    assert struct.unpack_from("<6d", raw, tags[33922][2]) == (0, 0, 0, 100.0, 2.0, 0)
    labels = spark.createDataFrame([("c", 0, 0, 1), ("c", 1, 0, 0), ("c", 3, 3, 2)], "cloud_id string, ix int, iy int, label bigint")
    (row,) = rasters.write_tree_maps(labels, str(tmp_path / "png"), labels.where("label = 2"), tile=4).collect()
    raw = open(row.file, "rb").read()
    size = struct.unpack_from(">I", raw, 33)[0]
    pixels = np.frombuffer(zlib.decompress(raw[41 : 41 + size]), np.uint8).reshape(4, 17)[:, 1:].reshape(4, 4, 4)
    assert tuple(pixels[3, 0]) == palette()[0] and tuple(pixels[0, 3]) == (0, 0, 0, 255) and tuple(pixels[3, 1]) == BACKGROUND


def test_run_times(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("a", "z", 4.0), ("a", "q", None)], "cloud_id string, description string, wall_s double")
    got = [(r.step, r.place, r.wall_s) for r in run_times(rows, {"second": ["z"], "first": ["x", "y"]}, by=("cloud_id",)).orderBy("place").collect()]
    assert got == [("second", 1, 4.0), ("first", 2, 3.0), ("Other", 3, 0.0)]


def test_ply(spark, tmp_path):
    head = "ply\nformat {} 1.0\ncomment c\nelement vertex 2\nproperty double x\nproperty float y\nproperty uchar z\nelement face 0\nend_header\n"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.ply").write_bytes(head.format("binary_little_endian").encode() + struct.pack("<dfB", 1.5, 2.5, 3) + struct.pack("<dfB", -1, 0, 255))
    (tmp_path / "t" / "b.ply").write_text(head.format("ascii") + "7 8 9\n1 2 3\n")
    register(spark)
    assert sorted(tuple(r) for r in spark.read.format("ply").load(str(tmp_path / "t")).collect()) == [(-1.0, 0.0, 255.0), (1.0, 2.0, 3.0), (1.5, 2.5, 3.0), (7.0, 8.0, 9.0)]


def test_csv_and_sinks(spark, tmp_path):
    (tmp_path / "p.txt").write_text("//X,Y,Z,Intensity\n1,2,3,4\n5,bad,7,\n")
    df = read_csv_points(spark, str(tmp_path / "p.txt"), ["x", "y", "intensity"])
    assert [tuple(r) for r in df.orderBy("x").collect()] == [(1.0, 2.0, 4.0), (5.0, None, None)]
    p = spark.createDataFrame([("a", 1), ("b", 2)], "cloud_id string, v int")
    write_clouds(p, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("cloud_id = 'b'").first().v == 2
    write_table(p, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_tracker():
    t = Tracker()
    for v in (1, 2):
        t.save("a", wall_s=v, rss_gb=0.5)
    assert t.rows == {"a": {"wall_s": 3.0, "rss_gb": 1.0}}
    with t.measure("b"):
        pass
    assert set(t.rows["b"]) == {"wall_s", "cpu_s", "rss_gb", "rss_delta_gb"}
    t.reset()
    assert t.rows == {}
