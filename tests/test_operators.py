import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.functions import columns as C
from sylvaframe.operators import fit, metrics, morph
from sylvaframe.operators.cluster import connected_components, dbscan, grow_regions
from sylvaframe.operators.groups import filter_extent, filter_intensity, filter_min_points, fit_line, principal_axes, voxel_downsample
from sylvaframe.operators.hotkeys import Dense, hot_keys, keyed_statistics
from sylvaframe.operators.near import containing_region, pairs_within
from sylvaframe.operators.nearest import distance_sum, interpolate_terrain, nearest, nearest_lists, remove_outliers
from sylvaframe.operators.raster import height_above_terrain


def cloud(spark, p, group=None, **more):
    cols = {"cloud_id": group or ["a"] * len(p), "point_id": list(range(len(p))), "x": p[:, 0].tolist(), "y": p[:, 1].tolist(), "z": p[:, 2].tolist(), **more}
    kinds = {"cloud_id": "string", "x": "double", "y": "double", "z": "double", "intensity": "double"}
    return spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in cols))


def brute(p, g, r):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    return {(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if g[i] == g[j] and d[i, j] <= r}


@pytest.mark.parametrize("target", [50, 20_000])
def test_pairs_within(spark, target):
    rng = np.random.default_rng(1)
    p = np.r_[rng.uniform(0, 10, (600, 3)), rng.normal(3, 0.05, (200, 3)), np.full((5, 3), 7.0)]
    g = [("a", "b")[i % 2] for i in range(len(p))]
    df = cloud(spark, p, g)
    df = df.unionByName(df.limit(300)).withColumn("leaf", F.lit("clash"))
    got = {tuple(r) for r in pairs_within(df, 0.4, target=target, sample_rows=400).collect()}
    assert got == brute(p, g, 0.4)


def test_pairs_within_dirt(spark):
    rows = [("a", 1, 0.0, 0.0, None), ("a", 2, 0.0, 0.0, float("nan")), (None, 3, 0.0, 0.0, 0.0), ("a", None, 0.0, 0.0, 0.0), ("a", 4, 0.0, 0.0, 0.0), ("a", 5, 0.0, 0.0, 0.0), ("a", 6, float("inf"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "cloud_id string, point_id bigint, x double, y double, z double")
    assert [tuple(r) for r in pairs_within(df, 0.0).collect()] == [(4, 5)]
    assert pairs_within(df.where("false"), 1.0).count() == 0


def test_containing_region(spark):
    p = cloud(spark, np.array([[0.5, 0.5, 0], [5, 5, 0], [9, 1, 0]]))
    r = spark.createDataFrame([("a", 1, 0.0, 5.0, 0.0, 5.0), ("a", 2, 5.0, 1.0, 0.0, 9.0), ("a", 3, None, 1.0, 0.0, 9.0)], "cloud_id string, region_id int, x_min double, x_max double, y_min double, y_max double")
    assert sorted((x.point_id, x.region_id) for x in containing_region(p, r).collect()) == [(0, 1), (1, 1)]


def test_keyed_statistics(spark):
    rows = [(1, 2.0)] * 700 + [(2, None), (2, float("nan")), (3, -1.0), (None, 5.0), (-9, 4.0), (-9, 6.0)]
    df = spark.createDataFrame(rows, "k bigint, v double").withColumn("keys", F.lit(0)).repartition(7)
    got = {r.k: r for r in keyed_statistics(df, "k", ["v"], fan_in=2).collect()}
    assert (got[1].n_rows, got[1].sum_v, got[1].min_v, got[1].max_v) == (700, 1400.0, 2.0, 2.0)
    assert (got[2].n_rows, got[2].n_v, got[2].sum_v, got[2].min_v) == (2, 0, None, None)
    assert (got[-9].sum_v, got[-9].min_v, got[-9].max_v) == (10.0, 4.0, 6.0)
    assert set(got) == {1, 2, 3, -9}
    assert [r.k for r in hot_keys(df, "k", 0.5).collect()] == [1]
    assert keyed_statistics(df.where("false"), "k", ["v"]).count() == 0
    # more levels than two: 40 splits, two at a time
    many = spark.createDataFrame([(i % 17, float(i)) for i in range(4000)], "k bigint, v double").repartition(40)
    got = {r.k: (r.n_rows, r.sum_v, r.min_v, r.max_v) for r in keyed_statistics(many, "k", ["v"], fan_in=2).collect()}
    assert got == {k: (len(v), sum(v), min(v), max(v)) for k in range(17) for v in [[float(i) for i in range(k, 4000, 17)]]}
    # rows with a null key count in the whole: 5 of 9 are no more than 56 %
    few = spark.createDataFrame([(1,)] * 5 + [(None,)] * 4, "k bigint")
    assert [r.k for r in hot_keys(few, "k", 0.5).collect()] == [1] and hot_keys(few, "k", 0.56).count() == 0
    assert hot_keys(few.where("false"), "k", 0.5).count() == 0


def test_dense_slots_grow_as_needed():
    rng = np.random.default_rng(2)
    keys, v = rng.integers(0, 200_000, 400_000), rng.normal(0, 1, 400_000)
    acc = Dense(1)
    for k, w in zip(np.array_split(keys, 40), np.array_split(v, 40), strict=True):
        acc.add(k, [w])
    acc.settle()
    assert (acc.keys == np.unique(keys)).all() and acc.n.sum() == 400_000
    want = np.full(200_000, np.inf)
    np.minimum.at(want, keys, v)
    assert np.array_equal(acc.stats[:, 0, 2], want[acc.keys]) and np.allclose(acc.stats[:, 0, 1], np.bincount(keys, v, 200_000)[acc.keys])


@pytest.mark.parametrize(("k", "dims", "radius"), [(3, "xyz", None), (26, "xyz", None), (2, "xy", 1.5), (400, "xy", None)])
def test_nearest_equals_brute_force(spark, k, dims, radius):
    """Many small leaves, a far-off query and point, repeated places, a group without points."""
    rng = np.random.default_rng(5)
    p = np.round(np.r_[rng.uniform(0, 30, (500, 3)), rng.normal(5, 0.05, (300, 3)), np.repeat(rng.uniform(0, 9, (5, 3)), 20, 0), [[9e5, -9e5, 3]]], 2)
    q = np.r_[rng.uniform(-5, 35, (150, 3)), [[-8e5, 8e5, 0]], p[:50]]
    own = lambda n: [("a", "b")[i % 7 == 0] for i in range(n)]
    points = [(g, i, *map(float, v)) for i, (g, v) in enumerate(zip(own(len(p)), p, strict=True))]
    asked = [(g, i, *map(float, v)) for i, (g, v) in enumerate(zip(own(len(q)), q, strict=True))] + [("none", 10_000, 1.0, 1.0, 1.0), ("a", 10_001, None, 1.0, 1.0)]
    cols = "cloud_id string, {} bigint, x double, y double, z double"
    lists = nearest_lists(spark.createDataFrame(asked, cols.format("query_id")), spark.createDataFrame(points, cols.format("point_id")), k, dims=tuple(dims), radius=radius, target=60)
    got = {r.query_id: (r.ids, r.d2s) for r in lists.collect()}
    assert len(got) == len(asked) - 1 and got[10_000] == ([], [])
    for g, i, *v in asked[:-2]:
        d = sorted((sum((a - b) ** 2 for a, b in zip(v[: len(dims)], w, strict=False)), j) for h, j, *w in points if h == g)
        d = [x for x in d if radius is None or x[0] <= radius * radius][:k]
        assert got[i][0] == [j for _, j in d] and np.allclose(got[i][1], [x for x, _ in d])
    mean = nearest_lists(spark.createDataFrame(points, cols.format("point_id")), None, 5, dims=tuple(dims), query_id="point_id", exclude_self=True, reduce=distance_sum, target=60)
    got = {r.query_id: (r.n, r.total) for r in mean.collect()}
    for g, i, *v in points[::9]:
        d = sorted(sum((a - b) ** 2 for a, b in zip(v[: len(dims)], w, strict=False)) ** 0.5 for h, j, *w in points if h == g and j != i)[:5]
        assert got[i][0] == 5 and abs(got[i][1] - sum(d)) < 1e-6 * max(1, sum(d))


def test_near_operators_without_rows(spark):
    p = spark.createDataFrame([("c", 1, 0.0, 0.0, 0.0), ("c", 2, None, 1.0, 1.0), (None, 3, 1.0, 1.0, 1.0), ("c", None, 1.0, 1.0, 1.0), ("c", 4, float("nan"), 0.0, 0.0)], "cloud_id string, point_id bigint, x double, y double, z double")
    p = p.withColumns({"leaf": F.lit(0), "role": F.lit("clash"), "g": F.lit(1), "region_id": F.lit(9)})
    boxes = spark.createDataFrame([("c", 1, -1.0, 1.0, -1.0, 1.0), ("c", 2, 1.0, -1.0, 0.0, 0.0), ("c", 3, None, 1.0, 0.0, 1.0)], "cloud_id string, region_id bigint, x_min double, x_max double, y_min double, y_max double")
    assert [(r.point_id, r.region_id) for r in containing_region(p, boxes).collect()] == [(1, 1)]
    none, empty = p.where("false"), boxes.where("false")
    assert containing_region(none, boxes).count() == 0 and containing_region(p, empty).count() == 0
    assert pairs_within(none, 1.0).count() == 0 and pairs_within(p, 1.0).count() == 0
    asked = p.withColumnRenamed("point_id", "query_id")
    assert [(r.query_id, r.ids) for r in nearest_lists(asked, none, 2).collect()] == [(1, [])]
    assert nearest_lists(asked.where("false"), p, 2).count() == 0 and nearest(asked, p, 2).count() == 1


def test_containing_polygon(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    regions = spark.createDataFrame([("c", 1, [{"x": x, "y": y} for x, y in ring]), ("c", 1, [{"x": x, "y": y} for x, y in ring]), ("c", 2, [{"x": 0.0, "y": 0.0}]), (None, 3, [{"x": x, "y": y} for x, y in ring])], "cloud_id string, region_id bigint, ring array<struct<x:double,y:double>>")
    at = [(0.5, 0.5), (2.0, 3.0), (2.0, 1.0), (4.0, 4.0), (3.9, 3.0), (5.0, 0.0), (0.0, 2.0)]
    p = spark.createDataFrame([("c", i, *v) for i, v in enumerate(at)] + [("c", 90, None, 1.0), ("d", 91, 0.5, 0.5)], "cloud_id string, point_id bigint, x double, y double")
    got = sorted((r.point_id, r.region_id) for r in containing_region(p.unionByName(p), regions, target=2).collect())
    assert got == [(0, 1), (2, 1), (3, 1), (4, 1), (6, 1)]


def test_nearest_widens_until_exact(spark):
    rng = np.random.default_rng(2)
    p = np.r_[rng.uniform(0, 5, (80, 3)), [[200.0, 200.0, 0.0]]]
    df = cloud(spark, p)
    got = {(r.query_id, r.rank): r.point_id for r in nearest(df.withColumnRenamed("point_id", "query_id"), df, 3, exclude_self=True).collect()}
    d = ((p[:, None, :2] - p[None, :, :2]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert all(got[i, k + 1] == want[i, k] for i in range(len(p)) for k in range(3))
    assert nearest(df.withColumnRenamed("point_id", "query_id"), df.where("false"), 1).count() == 0


def test_terrain_model_fixture(spark):
    p = cloud(spark, np.array([[0, 0, 1], [0, 0, 1], [0, 1, 2], [1, 0, 0], [1, 1, 3.0]]))
    nodes = spark.createDataFrame([("a", i * 2 + j, float(i), float(j)) for i in (0, 1) for j in (0, 1)], "cloud_id string, query_id bigint, x double, y double")
    got = {r.query_id: r.h for r in interpolate_terrain(nodes, p, 2, 1.0).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 0.0, 3: 3.0}


def test_height_above_terrain_fixture(spark):
    grid = [[0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 1, 1], [0, 1, 2, 2], [0, 0, 2, 4]]
    dtm = spark.createDataFrame([("a", x, y, float(h)) for y, row in enumerate(grid) for x, h in enumerate(row)], "cloud_id string, ix int, iy int, h double")
    p = cloud(spark, np.array([[0, 0, 2], [1, 1, 4], [3, 4, 5.0]]))
    assert [r.height for r in height_above_terrain(p, dtm, 2.0, -2.0, -4.0).orderBy("point_id").collect()] == [2.0, 3.0, 2.0]
    far = cloud(spark, np.array([[50.0, 60.0, 5.0]]))
    assert height_above_terrain(far, dtm, 2.0, -2.0, -4.0).first().height == 1.0
    assert height_above_terrain(far, dtm, 2.0, -2.0, -4.0, allow_outside=False).first().height is None


def labels(df):
    return [r.instance_id for r in df.orderBy("point_id").collect()]


def test_group_filters(spark):
    z = np.zeros((20, 3))
    assert labels(filter_min_points(cloud(spark, z, instance_id=[0] * 3 + [-1] * 7 + [1] * 10), 5)) == [-1] * 10 + [0] * 10
    p = np.array([[0, 0, v] for v in (0, 1, 0, 1, 10.0)])
    assert labels(filter_extent(cloud(spark, p, instance_id=[0, 0, -1, 1, 1]), 3.0)) == [-1, -1, -1, 0, 0]
    i = cloud(spark, np.zeros((6, 3)), instance_id=[0, 0, 0, -1, 1, 1], intensity=[6000.0, 4000.0, 7000.0, 4000.0, 3000.0, 6000.0])
    assert labels(filter_intensity(i, 5000.0, 0.6)) == [0, 0, 0, -1, -1, -1]
    up = np.array([[0, 0, 0], [0, 0, 1], [0, 0, 2.0], [0, 0, 0], [1, 0, 0.1], [2, 0, 0.2]])
    got = {r.instance_id: r.inclination for r in principal_axes(cloud(spark, up, instance_id=[0, 0, 0, 1, 1, 1])).collect()}
    assert got[0] == pytest.approx(0, abs=1e-6) and got[1] > 80


def test_columns(spark):
    r = spark.range(1).select(
        C.polygon_area(F.expr("array(named_struct('x',-1d,'y',-1d),named_struct('x',-1d,'y',1d),named_struct('x',1d,'y',1d))")).alias("area"),
        C.in_ellipse(F.lit(0.9 + 4 / 2**0.5), F.lit(0.9 + 4 / 2**0.5), 1, 1, 4, 2, np.pi / 4).alias("inside"),
        C.in_ellipse(F.lit(2.1), F.lit(-1.1), 1, 1, 4, 2, np.pi / 4).alias("outside"),
        C.hex_to_rgba(F.lit("#ff8000")).alias("c"),
        C.hex_to_rgba(F.lit("nope")).alias("none"),
        C.layer_bounds(3, 1.0, 0.6, 0.1).alias("layers"),
    ).first()
    assert (r.area, r.inside, r.outside, r.none) == (2.0, True, False, None)
    assert (r.c.r, round(r.c.g, 3), r.c.b) == (1.0, 0.502, 0.0)
    assert [round(x.mid, 6) for x in r.layers] == [1.3, 1.8, 2.3]


def test_line(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 3.0, 4.0), (2, 1.0, 5.0), (2, 1.0, 7.0)], "k int, x double, y double")
    assert {r.k: round(r.predicted, 9) for r in fit_line(df, ["k"], "x", "y", 4.0).collect()} == {1: 5.0, 2: 6.0}


def test_voxels_and_outliers(spark):
    p = np.array([[0.1, 0.1, 0.1], [0.5, 0.5, 0.5], [0.5, 0.5, 0.5], [1.5, 0.5, 0.5]])
    assert sorted(r.point_id for r in voxel_downsample(cloud(spark, p), 1.0).collect()) == [1, 3]
    rng = np.random.default_rng(0)
    q = np.r_[rng.uniform(-0.01, 0.01, (8, 3)), rng.uniform(-0.01, 0.01, (2, 3)) + 4]
    assert sorted(r.point_id for r in remove_outliers(cloud(spark, q), 5, 1.5).collect()) == list(range(8))
    assert remove_outliers(cloud(spark, q[:2]), 5, 1.5).count() == 2


@pytest.mark.parametrize("i", range(3))
def test_ellipse(i):
    t = np.linspace(0, 2 * np.pi, 120, endpoint=False)
    a, b, theta = 2.0 * (i + 1), 1.0, np.pi * i / 3
    x = a * np.cos(t) * np.cos(theta) - b * np.sin(t) * np.sin(theta)
    y = i + a * np.cos(t) * np.sin(theta) + b * np.sin(t) * np.cos(theta)
    got = fit.ellipse(x, y)
    assert np.allclose(got[:4], (0, i, a, b), atol=1e-9) and abs(np.sin(got[4] - theta)) < 1e-9
    assert fit.ellipse(np.zeros(9), np.zeros(9)) is None


def test_circle_and_outline():
    t = np.linspace(-np.pi, np.pi, 50)
    x, y = 412000 + np.cos(t), 115000 + np.sin(t)
    assert np.allclose(fit.robust_circle(np.r_[x, 412000.3], np.r_[y, 115000.1], 0.5, 2.0), (412000, 115000, 1), atol=1e-3)
    assert fit.outline_diameter(x, y, 412000, 115000, 0.3) == pytest.approx(2.0, abs=1e-2)
    assert fit.best_combination(np.array([0.5, 0.1, 0.52, 0.51]), np.zeros(4), np.zeros(4), 3, 0.1, None) == (0, 2, 3)
    assert fit.best_combination(np.array([0.5, 0.1]), np.zeros(2), np.zeros(2), 3, 0.1, None) is None


def test_signed_distance():
    r = np.zeros((5, 5), bool)
    r[1:4, 1:4] = True
    d = morph.signed_distance(r)
    assert (d[2, 2], d[1, 1], d[0, 2], d[0, 0]) == (-2.0, -1.0, 1.0, pytest.approx(2**0.5))


def test_growth_runs_until_it_ends(spark):
    """A chain of 16 steps: no label is missing at the end, and a limit below that is an error."""
    p = cloud(spark, np.c_[np.arange(17) * 0.9, np.zeros((17, 2))]).withColumn("is_tree", F.lit(True))
    seeds = spark.createDataFrame([(0, 7)], "point_id bigint, instance_id bigint")
    assert {r.point_id for r in grow_regions(p, seeds, voxel=1.0, max_radius=1.0).collect()} == set(range(17))
    with pytest.raises(RuntimeError):
        grow_regions(p, seeds, voxel=1.0, max_radius=1.0, max_iterations=4)


def test_totals_count_unmatched_predictions(spark):
    from oracle import DATA, connect
    from sylvaframe.plans.queries import VALID, e8_totals

    sql = f"SELECT count(*) FROM (SELECT DISTINCT cloud_id, prediction FROM point_cloud WHERE {VALID} AND prediction >= 0) AS p ANTI JOIN instance_matches AS m ON p.cloud_id = m.cloud_id AND p.prediction = m.prediction_id"
    want = connect("sf0.001").execute(sql).fetchone()[0]
    r = e8_totals(spark, str(DATA / "sf0.001")).where("dataset IS NULL").first()
    assert want > 0 and r.FP == want
    assert abs(r.F1Score - 2 * r.TP / (2 * r.TP + r.FP + r.FN)) < 1e-6 and abs(r.PanopticQuality - r.F1Score * r.MeanIoU) < 2e-6


def test_single_cells_share_the_ground_of_all_neighbours():
    """Tree 3 has one cell between trees 1 and 2 at the canopy's edge; tree 4 stays apart by its line."""
    filled = np.array([[1, 1, 1, 3, 2, 2, 2, 4, 4, 0]] + [[1, 1, 1, 1, 2, 2, 2, 4, 4, 0]] * 3)
    label = np.where(np.isin(np.arange(10), [6]), 0, filled)
    markers = np.zeros(filled.shape, int)
    for k, at in {1: (2, 0), 2: (2, 5), 3: (0, 3), 4: (2, 8)}.items():
        markers[at] = k
    mask = filled > 0
    new_label, new_filled = morph.correct_watershed(label, filled, markers, mask)
    assert (new_filled == 3).sum() > 1 and set(np.unique(new_filled[mask])) == {1, 2, 3, 4}
    assert (new_filled[:, 7:9] == 4).all() and (new_label[:, 7:9] == 4).all()
    assert (new_label[:, 6] == 0).all()


def test_neighbour_queries_take_all_points(spark, tmp_path):
    from sylvaframe.plans import queries as Q

    rng = np.random.default_rng(4)
    n, p = 150, np.r_[rng.uniform(0, 6, (145, 3)), rng.uniform(20, 30, (5, 3))]
    cls, own = [None if i % 10 == 9 else i % 5 for i in range(n)], [i % 3 - 1 for i in range(n)]
    more = {c: [None] * n for c in Q.COLS if c not in ("cloud_id", "cls", "instance_id")}
    cloud(spark, p, cls=cls, instance_id=own, **more).write.parquet(str(tmp_path / "point_cloud.parquet"))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    near = np.sort(d, 1)[:, 1:]
    got = {r.query_id: r.total for r in Q.c4_c9_self_knn(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(n)) and np.allclose([got[i] for i in range(n)], near[:, :26].sum(1), atol=1e-5)
    mean = near[:, :4].mean(1)
    kept = sorted(r.point_id for r in Q.d9_remove_outliers(spark, str(tmp_path)).collect())
    assert kept == np.flatnonzero(mean <= mean.mean() + 1.5 * mean.std()).tolist() and len(kept) < n
    seeds = [i for i in range(n) if cls[i] == 1 and own[i] >= 0]
    first = {i: seeds[int(np.argmin(d[i, seeds]))] for i in range(n) if i not in seeds}
    want = {i: own[s] for i, s in first.items() if d[i, s] <= 2}
    assert {r.point_id: r.instance_id for r in Q.c8_nearest_seed(spark, str(tmp_path)).collect()} == want


def test_watershed_parts_a_ridge():
    h = np.array([[3.0, 2, 1, 2, 3]] * 3)
    m = np.zeros(h.shape, int)
    m[1, 0], m[1, 4] = 1, 2
    label, filled = morph.watershed(-h, m, h > 0)
    assert set(np.unique(label)) == {0, 1, 2} and (filled > 0).all()
    assert (filled[:, 0] == 1).all() and (filled[:, 4] == 2).all()


def test_priority_growth_takes_cheap_edges():
    first, near = np.array([0, 1, 3, 5, 6]), np.array([1, 0, 2, 1, 3, 2])
    d2 = np.array([1.0, 1, 4, 4, 1, 1])
    seed, label = np.array([True, False, False, True]), np.array([0, -1, -1, 1])
    grow = lambda crown: morph.priority_grow(first, near, d2, label, seed, 3.0, np.array(crown), {}, 2.0).tolist()
    assert grow([0, 0, 1, 1]) == [0, 0, 1, 1]
    assert grow([0, 0, 0, 1]) == [0, 0, 0, 1] or grow([0, 0, 0, 1]) == [0, 0, 1, 1]


def test_cloth(spark):
    g = np.stack(np.meshgrid(np.arange(20.0), np.arange(20.0)), -1).reshape(-1, 2)
    p = np.c_[g, np.zeros(len(g))]
    p = np.r_[p, [[10.2, 10.2, 6.0]]]
    got = morph.classify_terrain(cloud(spark, p), 2.0, 0.5, 1).orderBy("point_id").collect()
    assert [r.terrain for r in got] == [0] * len(g) + [1]
    with pytest.raises(ValueError):
        morph.classify_terrain(cloud(spark, p), rigidness=4)


def test_components_and_dbscan(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41)], "a bigint, b bigint")
    ids = spark.range(42).select("id")
    got = {r.id: r.component for r in connected_components(ids, edges).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[41] == 40 and got[35] == 35
    p = np.array([[0, 0, 0], [0.5, 0, 0], [1, 0, 0], [1.9, 0, 0], [9, 0, 0]], float)
    got = {r.point_id: r.cluster for r in dbscan(cloud(spark, p), 1.0, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: None}


def matched(spark, target, prediction, z, rule):
    p = np.c_[np.zeros((len(z), 2)), z]
    df = cloud(spark, p, target=target, prediction=prediction)
    return {r.target_id: r.prediction_id for r in metrics.match_instances(df, rule).collect()}


def test_match_instances(spark):
    target = [1, 1, 1, 2, 2, 2, 2, 0, 0, 0, 1, 3, 3, 3, 3, -1]
    prediction = [2, 2, 2, 2, -1, 3, 1, 0, 0, 1, 2, -1, -1, -1, -1, -1]
    z = [0, 1, 10, 0, 1, 2, 5, 1, 2, 3, 4, 0, 0, 0, 15, 0]
    for rule in ("panoptic_segmentation", "for_ai_net", "for_instance", "tree_learn"):
        assert matched(spark, target, prediction, z, rule) == {0: 0, 1: 2, 2: -1, 3: -1}, rule
    assert matched(spark, target, prediction, z, "point2tree") == {0: 0, 1: 2, 2: 3, 3: -1}
    with pytest.raises(ValueError):
        matched(spark, target, prediction, z, "guess")


def test_hungarian():
    c = np.array([[4.0, 1, 3], [2, 0, 5], [3, 2, 2]])
    i, j = metrics.hungarian(c)
    assert c[i, j].sum() == 5.0
    i, j = metrics.hungarian(c[:, :2])
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1), (1, 0)]


def test_metrics(spark):
    m = spark.createDataFrame([("a", 0, 2, 3, 2, 0), ("a", 1, 0, 3, 0, 1), ("a", 2, -1, 0, 0, 1)], "cloud_id string, target_id bigint, prediction_id bigint, tp bigint, fp bigint, fn bigint")
    r = metrics.segmentation_metrics(m).first()
    assert r.MeanIoU == pytest.approx((3 / 5 + 3 / 4) / 3) and r.MeanPrecision == pytest.approx((3 / 5 + 1) / 2)
    p = spark.createDataFrame([("a", 2, 0), ("a", 0, 1), ("a", 7, -1), ("a", 8, -2)], "cloud_id string, prediction_id bigint, target_id bigint")
    d = metrics.detection_metrics(m, p).first()
    assert (d.TP, d.FP, d.FN) == (2, 1, 1)
    s = spark.createDataFrame([("a", t, q) for t, q in zip([1, 1, 1, 0, 0, 2, 1, 1, 3, 2], [1, 1, 0, 2, 0, 2, 2, 1, 3, 3], strict=True)], "cloud_id string, t bigint, p bigint")
    got = {x["name"]: x.IoU for x in metrics.semantic_metrics(s, "t", "p", [0, 1, 2, 3], {"Vegetation": [1, 2], "Other": [0, 3]}).collect()}
    assert got == {"0": pytest.approx(1 / 3), "1": pytest.approx(3 / 5), "2": pytest.approx(1 / 4), "3": pytest.approx(1 / 2), "Vegetation": pytest.approx(5 / 8), "Other": pytest.approx(2 / 5)}
