"""Stem operators and the stem pipeline. Inputs and expected values are fixed values: results must equal the reference's."""

import numpy as np
import pytest

from sylvaframe.operators import cluster, fit, stems
from sylvaframe.plans.pipelines import StemParameters, StemPipeline

PI4 = np.pi / 4
AROUND = [[0, 0.62, 1], [0.6, 0, 1.1], [-0.59, 0, 1.2], [0, 0, 1.1], [0, 0.61, 1.3], [0, 0.52, 1.3], [4 + 0.42 / 2**0.5, 4 + 0.42 / 2**0.5, 2.0], [4 + 0.4 / 2**0.5, 4 + 0.4 / 2**0.5, 2.0], [4 + 0.4 / 2**0.5, 4 + 0.41 / 2**0.5, 2.0], [0, 0.51, 3.2], [0, 0.52, 3.3], [0, 0.66, 1]]
LAYER = "cloud_id string, stem_id bigint, layer int, mid_height double, cx double, cy double, r double, ex double, ey double, a double, b double, theta double"
NONE = (-1.0,) * 3, (-1.0,) * 5


def layer_rows(spark, shapes, mids):
    """shapes: per stem and layer a circle and an ellipse (-1: none)."""
    rows = [("c", s, k, mids[k], *map(float, circle), *map(float, ell)) for s, own in enumerate(shapes) for k, (circle, ell) in enumerate(own)]
    return spark.createDataFrame(rows, LAYER)


def test_points_around_shapes(spark):
    shapes = [[((0, 0, 0.6), NONE[1]), NONE, (NONE[0], (4, 4, 0.4, 0.2, PI4))], [NONE, NONE, ((0, 0.3, 0.22), NONE[1])]]
    rows = layer_rows(spark, shapes, [1.3, 1.8, 2.3])
    p = spark.createDataFrame([("c", i, *map(float, v)) for i, v in enumerate(AROUND)], "cloud_id string, point_id bigint, x double, y double, z double")
    ground = spark.createDataFrame([(0, 0.0), (1, 1.0)], "stem_id bigint, terrain double")
    more = {"height": 0.6, "limit": 0.7, "small": 0.015, "large": 0.05}
    got = stems.points_near_circles(p, rows, ground, **more).unionByName(stems.points_near_ellipses(p, rows, ground, **more)).collect()
    found = {(s, k): sorted(r.point_id for r in got if (r.stem_id, r.layer) == (s, k)) for s in range(2) for k in range(3)}
    assert found == {(0, 0): [0, 1, 2, 4], (0, 1): [], (0, 2): [7, 8], (1, 0): [], (1, 1): [], (1, 2): [9, 10]}
    # where a layer has a circle its ellipse doesn't count
    both = layer_rows(spark, [[((50, 50, 0.1), (4, 4, 0.4, 0.2, PI4))]], [2.0])
    assert stems.points_near_ellipses(p, both, None, **more).count() == 0


CIRCLES = [[(-1, -1, -1)] * 4, [(0, 0, 2), (0, 0, 0.95), (0, 0, 1.4), (0, 0.1, 0.1)], [(-1, -1, -1), (0, 0, 1), (-1, -1, -1), (-1, -1, -1)], [(0, 0, 1), (0, 0, 0.95), (0, 0, 1.2), (0, 0.1, 0.9)], [(0, 0.1, 1), (0, 0.3, 1), (0, 0.5, 1), (0, 0.7, 1.1)]]
ELLIPSES = [[(-1,) * 5] * 4, [(-1,) * 5] * 4, [(0, 0, 1, 0.9, 0), (0, 0, 0.95, 0.9, 0), (0, 0, 0.9, 0.85, 0), (0, 0, 1.2, 0.85, 0)], [(0, 0, 1, 0.9, 0), (0, 0, 1, 0.9, 0), (0, 0, 1.2, 1.1, 0), (0, 0.1, 0.9, 0.8, 0)], [(0, 0.1, 1, 1, 0), (0, 0.3, 1, 1, 0), (0, 0.5, 1, 1, 0), (0, 0.7, 1.1, 1.1, 0)]]


@pytest.mark.parametrize("max_position", [None, 0.1])
def test_best_combinations(spark, max_position):
    rows = layer_rows(spark, [list(zip(c, e, strict=True)) for c, e in zip(CIRCLES, ELLIPSES, strict=True)], [1.0, 2.0, 3.0, 4.0])
    got = fit.stable_layers(rows, 3, 0.1, max_position).collect()
    found = {s: (sorted(r.layer for r in got if r.stem_id == s), any(r.is_circle for r in got if r.stem_id == s)) for s in {r.stem_id for r in got}}
    assert found == {2: ([0, 1, 2], False), 3: ([0, 1, 3], True)} | ({4: ([0, 1, 2], True)} if max_position is None else {})


def around(a, b, n=50):
    """n points on an ellipse about (1, 1), evenly along its length."""
    t = np.linspace(0, 2 * np.pi, 10_000)
    x, y = 1 + a * np.cos(t), 1 + b * np.sin(t)
    length = np.r_[0, np.cumsum(np.hypot(np.diff(x), np.diff(y)))]
    at = np.searchsorted(length, np.linspace(0, length[-1], n))
    return x[np.minimum(at, len(t) - 1)], y[np.minimum(at, len(t) - 1)]


def test_outline_of_circle_and_ellipse():
    x, y = around(1, 1)
    assert fit.outline_diameter(x, y, 1, 1, 0.3) == pytest.approx(2.0, abs=1e-3)
    assert fit.outline_diameter(x[:30], y[:30], 1, 1, 0.3) == pytest.approx(2.0, abs=1e-3)
    x, y = around(1.2, 0.9)
    assert fit.outline_diameter(x, y, 1, 1, 0.4) == pytest.approx(2.1, abs=0.025)
    assert fit.outline_diameter(x, y, 1, 1, 0.1) is None and fit.outline_diameter(x, y, 1, 1, None) is not None


@pytest.mark.parametrize("empty", [False, True])
def test_diameters_over_layers(spark, empty):
    """Radii 1 - 0.1 per layer at heights 1, 2, ..: at 1.3 both stems have 2 * 0.97; the ellipses' outlines are too uneven to count."""
    best = [(0, k, float(k + 1), 1 - 0.1 * k, 1 - 0.1 * k, True) for k in (0, 1, 2)] + [(1, k, float(k + 1), 1.1 - 0.1 * k, 0.9 - 0.1 * k, False) for k in (1, 2, 3)]
    stable = spark.createDataFrame([("c", s, k, h, 0.0, 0.0, float(a + b), c) for s, k, h, a, b, c in best], "cloud_id string, stem_id bigint, layer int, mid_height double, x double, y double, diameter double, is_circle boolean")
    rows = []
    for s, k, _, a, b, _ in best if not empty else ():
        x, y = around(a, b)
        rows += [("c", s, k, float(u - 1), float(v - 1)) for u, v in zip(x, y, strict=True)]
    points = spark.createDataFrame(rows, "cloud_id string, stem_id bigint, layer int, x double, y double")
    got = fit.stem_positions(fit.outline_diameters(points, stable, 0.05)).collect()
    assert len(got) == 2 and all(r.diameter == pytest.approx(1.94, abs=1e-4) for r in got)


def grid(n, s=0.1):
    return np.stack(np.meshgrid(*[np.arange(k) * s for k in n], indexing="ij"), -1).reshape(-1, len(n))


def test_growth_takes_the_trees_and_eight_ground_points(spark):
    ground = np.c_[grid((100, 100)), np.zeros(10_000)]
    stem = lambda at, n: np.c_[np.full((n, 2), at), np.arange(n) * 0.1]
    parts = [ground, grid((20,) * 3) + [1.05, 1.05, 3.1], stem(2.05, 30), grid((30,) * 3) + [3.15, 3.15, 3.6], stem(4.65, 35)]
    p, tree = np.concatenate(parts), np.repeat([-1, 0, 0, 1, 1], [len(v) for v in parts])
    own = np.full(len(p), -1)
    first = {0: 10_000 + 8000 + 10, 1: 10_000 + 8030 + 27_000 + 10}
    for s, at in first.items():
        own[at : at + 10] = s
    rows = [("c", i, *map(float, v), float(v[2]), None if s < 0 else int(s), bool(t >= 0)) for i, (v, s, t) in enumerate(zip(p, own, tree, strict=True))]
    points = spark.createDataFrame(rows, "cloud_id string, point_id bigint, x double, y double, z double, h double, stem_id bigint, is_tree boolean").repartition(4).cache()
    found = spark.createDataFrame([("c", 0, 2.05, 2.05, 0.01), ("c", 1, 4.65, 4.65, 0.01)], "cloud_id string, stem_id bigint, x double, y double, diameter double")
    got = {r.point_id: r.instance_id for r in cluster.grow_regions(points, cluster.stem_seeds(points, found), voxel=0.025, terrain_distance=(1.3 - 0.3) / 2 + 0.2).collect()}
    assert all(got.get(i, -1) == t for i, t in enumerate(tree) if i >= 10_000)
    assert sum(i < 10_000 for i in got) == 8


@pytest.mark.parametrize("wrong", [{"invalid_id": 1}, {"min_z": 0.4}, {"layer_start": 0.9}, {"min_diameter": 1.0}])
def test_parameters_are_checked(wrong):
    with pytest.raises(ValueError):
        StemParameters(**wrong)


def two_trees():
    def trunk(x, y, r, layers):
        out = []
        for k in range(layers):
            rng = np.random.default_rng(k)
            t = np.linspace(0, 2 * np.pi, 200)
            d = r + rng.normal(0, 0.01, 200)
            out.append(np.c_[x + d * np.cos(t), y + d * np.sin(t), np.full(200, k * 0.1)])
        return np.concatenate(out)

    parts = [np.c_[grid((100, 100)), np.zeros(10_000)], grid((20,) * 3) + [1.05, 1.05, 3.1], trunk(2.05, 2.05, 0.15, 30), grid((30,) * 3) + [4.15, 4.15, 3.6], trunk(5.65, 5.65, 0.25, 35)]
    return np.concatenate(parts), np.repeat([0.0, 4999, 4999, 5001, 5001], [len(v) for v in parts])


@pytest.mark.parametrize(("refine", "intensities"), [(False, False), (True, True)])
def test_positions_diameters_and_filters(spark, refine, intensities):
    p, strength = two_trees()
    rows = [("c", i, *map(float, v), float(s)) for i, (v, s) in enumerate(zip(p, strength, strict=True))]
    points = spark.createDataFrame(rows, "cloud_id string, point_id bigint, x double, y double, z double, intensity double").repartition(4)
    points = points if intensities else points.drop("intensity")
    pipe = StemPipeline(StemParameters(eps_2d=0.05, eps_3d=0.25, min_points_3d=5, min_intensity=5000.0, refine=refine))
    high = pipe.heights(points)
    got = sorted((r.x, r.y, r.diameter) for r in pipe.stems(high)[0].collect())
    want = [(2.05, 2.05, 0.3), (5.65, 5.65, 0.5)][intensities:]
    assert len(got) == len(want) and np.abs(np.array(got) - want).max() < 0.015
    assert {"heights"} >= {r.description for r in pipe.performance_metrics(spark).collect()}
    if intensities:
        none = StemPipeline(StemParameters(eps_2d=0.05, eps_3d=0.25, min_points_3d=5, min_cluster_points=10_000))
        none.dtm = pipe.dtm
        assert none.stems(high)[0].isEmpty()
