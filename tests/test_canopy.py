"""Canopy rasters and crowns. Inputs and expected values are fixed values: results must equal the reference's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import morph, raster
from sylvaframe.operators.tiles import agreed


def as_rows(spark, columns):
    """Arrays of one shape as rows (cloud_id, ix, iy, name..) of cloud c."""
    names = list(columns)
    first = columns[names[0]]
    rows = [("c", i, j, *[columns[n][i, j].item() for n in names]) for i in range(first.shape[0]) for j in range(first.shape[1])]
    kinds = {"i": "bigint", "f": "double"}
    return spark.createDataFrame(rows, "cloud_id string, ix bigint, iy bigint, " + ", ".join(f"{n} {kinds[columns[n].dtype.kind]}" for n in names))


def grid(df, column, shape):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r.ix, r.iy] = r[column]
    return out


def at(spark, cells):
    return spark.createDataFrame([("c", k, i, j) for k, (i, j) in enumerate(cells)], "cloud_id string, tree_no bigint, ix bigint, iy bigint")


CROWNS = [[0, 1, 1], [0, 1, 0], [1, 0, 1], [1, 1, 2], [1, 2, 1], [1, 3, 1], [1, 4, 1], [1, 5, 1], [2, 0, 1], [2, 1, 1], [3, 1, 3], [3, 1, 1], [3, 1, 1], [4, 4, 1], [4, 5, 1], [5, 4, 4], [5, 5, 1]]


@pytest.mark.parametrize(
    ("distance", "least", "height", "tops"),
    [(1.0, 1, 1.0, {(1, 1), (3, 1), (5, 4)}), (3.0, 1, 1.0, {(3, 1), (5, 4)}), (10.0, 1, 1.0, {(5, 4)}), (1.0, 3, 1.0, {(3, 1)}), (1.0, 1, 3.0, {(5, 4)}), (1.0, 3, 3.0, set()), (3.0, 1, 10.0, set())],
)
def test_crown_tops(spark, distance, least, height, tops):
    p = spark.createDataFrame([("c", i, *map(float, v)) for i, v in enumerate(CROWNS)], "cloud_id string, point_id bigint, x double, y double, z double")
    got = morph.find_crown_tops(raster.height_map(p, 1.0), 1.0, min_distance=distance, min_height=height, min_points=least, sigma=None).collect()
    assert {(r.ix, r.iy) for r in got} == tops
    assert sorted(r.top_no for r in got) == list(range(len(tops)))


SMOOTHED = [[0, 0, 0], [1, 1, 1], [1, 2, 1], [1, 3, 1], [2, 1, 1], [2, 2, 2], [2, 3, 1], [3, 1, 1], [3, 2, 1], [3, 3, 1], [3, 4, 1], [3, 5, 1], [3, 6, 1], [4, 1, 1], [4, 2, 1], [4, 3, 1], [4, 4, 6], [4, 5, 1], [5, 5, 1], [5, 5, 1]]


def test_smoothed_crown_top(spark):
    p = spark.createDataFrame([("c", i, *map(float, v)) for i, v in enumerate(SMOOTHED)], "cloud_id string, point_id bigint, x double, y double, z double")
    got = morph.find_crown_tops(raster.height_map(p, 1.0), 1.0, min_distance=2.0, min_height=1.0, min_points=1).collect()
    assert [(r.ix, r.iy) for r in got] == [(4, 4)]


def test_tops_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(3)
    h = rng.uniform(3, 9, (60, 70)) * (rng.uniform(0, 1, (60, 70)) < 0.9)
    chm = as_rows(spark, {"h": h, "n": np.ones(h.shape, int)}).where("h > 0")
    one, many = (sorted((r.ix, r.iy) for r in morph.find_crown_tops(chm, 1.0, min_distance=4.0, tile=t).collect()) for t in (256, 16))
    assert one == many and len(one) > 20


HEIGHTS = np.array([[1, 2, 2, 0, 0, 0], [2, 3, 2, 0, 0, 0], [0, 2, 1, 3, 1, 0], [0, 0, 2, 5, 1, 1], [0, 0, 3, 4, 2, 0], [0, 0, 0, 0, 0, 0]], float)
BORDER = np.array([[1, 1, 1, 0, 0, 0], [1, 1, 1, 0, 0, 0], [0, 1, 0, 2, 2, 0], [0, 0, 2, 2, 2, 2], [0, 0, 2, 2, 2, 0], [0, 0, 0, 0, 0, 0]])
FILLED = np.array([[1, 1, 1, 0, 0, 0], [1, 1, 1, 0, 0, 0], [0, 1, 2, 2, 2, 0], [0, 0, 2, 2, 2, 2], [0, 0, 2, 2, 2, 0], [0, 0, 0, 0, 0, 0]])


def test_watershed(spark):
    got = morph.segment_canopy(as_rows(spark, {"h": HEIGHTS}), at(spark, [(1, 1), (4, 3)]), correct=False)
    assert (grid(got, "label_border", HEIGHTS.shape) == BORDER).all() and (grid(got, "label", HEIGHTS.shape) == FILLED).all()


def test_enclosed_region_is_corrected():
    border = np.array([[0, 1, 1, 1, 1, 1], [0, 1, 1, 0, 1, 1], [0, 1, 0, 3, 0, 1], [0, 1, 1, 0, 1, 1], [0, 1, 1, 1, 1, 1], [0] * 6, [0] * 6, [0] * 6, [0, 0, 0, 2, 2, 2]])
    filled = np.array([[0, 1, 1, 1, 1, 1], [0, 1, 1, 1, 1, 1], [0, 1, 1, 3, 1, 1], [0, 1, 1, 1, 1, 1], [0, 1, 1, 1, 1, 1], [0] * 6, [0] * 6, [0] * 6, [0, 0, 0, 2, 2, 2]])
    markers = np.zeros(border.shape, int)
    for k, place in enumerate([(3, 3), (8, 4), (2, 3)], 1):
        markers[place] = k
    got_border, got = morph.correct_watershed(border, filled, markers, filled > 0)
    top = [[0, 3, 3, 3, 3, 3]] * 3
    rest = [[0] * 6] * 3 + [[0, 0, 0, 2, 2, 2]]
    # the line between the two may lie in either way
    borders = [top + [[0, 3, 0, 1, 0, 3], [0, 0, 1, 1, 1, 0]] + rest, top + [[0, 0, 0, 1, 0, 0], [0, 1, 1, 1, 1, 1]] + rest]
    wholes = [top + [[0, 3, 3, 1, 3, 3], [0, 3, 1, 1, 1, 3]] + rest, top + [[0, 3, 3, 1, 3, 3], [0, 1, 1, 1, 1, 1]] + rest]
    assert any(np.array_equal(got_border, b) for b in borders) and any(np.array_equal(got, w) for w in wholes)


def test_labels_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(1)
    x, y = np.indices((80, 90))
    tops = rng.uniform(0, 80, (60, 2))
    h = np.max([12 * np.exp(-((x - a) ** 2 + (y - b) ** 2) / 40) for a, b in tops], 0) + rng.uniform(0, 0.01, (80, 90))
    h = np.where(h > 2, h, 0.0)
    chm = as_rows(spark, {"h": h, "n": np.ones(h.shape, int)}).where("h > 0")
    trees = morph.find_crown_tops(chm, 1.0, min_distance=4.0).withColumnRenamed("top_no", "tree_no").cache()
    one, many = (sorted(tuple(r) for r in morph.segment_canopy(chm, trees, halo=8, tile=t).select("ix", "iy", "label", "label_border").collect()) for t in (256, 20))
    assert one == many and len({r[2] for r in one}) > 20


def test_halo_widens_until_tiles_agree(spark):
    """Each cell takes its row's largest value: only the whole row in the window gives it."""
    v = np.zeros((3, 64))
    v[:, 5] = [1, 2, 3]
    kernel = lambda pdf: pdf.assign(m=pdf.groupby("ix")["v"].transform("max"))[["ix", "iy", "m"]]
    got = agreed(as_rows(spark, {"v": v}), kernel, {"m": "double"}, halo=2, tile=8).collect()
    assert len(got) == 192 and all(r.m == r.ix + 1 for r in got)


LABELS = np.array([[2, 2, 2, 0], [2, 2, 2, 0], [2, 2, 3, 0], [0, 3, 3, 3], [0, 3, 3, 3], [0, 0, 0, 0], [0, 1, 0, 0]])
LINES = np.array([[2, 2, 2, 0], [2, 2, 2, 0], [2, 2, 0, 0], [0, 0, 3, 3], [0, 3, 3, 3], [0, 0, 0, 0], [0, 1, 0, 0]])


def test_overlapping_crowns(spark):
    xyz = [[0, 0, 1], [0, 1, 1], [0, 2, 1], [1, 0, 1], [1, 1, 2], [1, 2, 1], [2, 0, 1], [2, 1, 1], [2, 2, 1], [2, 3, 1], [3, 1, 1], [3, 2, 2], [3, 3, 1], [4, 1, 1], [4, 2, 1], [4, 3, 1], [6, 1, 1], [1, 1, 1], [1, 1, 0.5], [3, 2, 0.5]]
    cls = [2] * 17 + [3] + [1] * 2
    own = [1] * 8 + [2] * 8 + [0] + [1] * 2 + [2]
    p = spark.createDataFrame([("c", i, *map(float, v), c, o) for i, (v, c, o) in enumerate(zip(xyz, cls, own, strict=True))], "cloud_id string, point_id bigint, x double, y double, z double, cls bigint, instance_id bigint")
    labels = as_rows(spark, {"label": LABELS, "label_border": LINES}).where("label > 0")
    got = morph.overlapping_crowns(p, labels, 2.0).orderBy("point_id").collect()
    assert [r.instance_id for r in got] == [-1] * 16 + [0] + [1] * 2 + [2]
    assert [r.is_seed for r in got] == [False] * 17 + [True] * 3
    alone = morph.overlapping_crowns(p, labels, 0.1).collect()
    assert not any(r.is_seed for r in alone) and sorted(r.instance_id for r in alone) == sorted(own)


def test_signed_distances_stay_around_the_tree(spark):
    r = np.zeros((40, 40), int)
    r[1:4, 1:4], r[30:32, 30] = 1, 2
    got = morph.signed_distances(as_rows(spark, {"label": r}), margin=1).collect()
    one = {(x.ix, x.iy): x.sd for x in got if x.tree_no == 0}
    assert len(one) == 25 and (one[2, 2], one[1, 1], one[0, 2]) == (-2.0, -1.0, 1.0) and one[0, 0] == pytest.approx(2**0.5)
    assert len(got) == 25 + 12 and morph.signed_distances(as_rows(spark, {"label": r}).where("ix < 0")).count() == 0


def test_crowns_grow_from_their_trunks(spark):
    stem = lambda x: [[x, 2, z] for z in (0, 0.1, 0.2, 0.3, 1, 2)]
    crown = lambda x: [[x + i, 2 + j, 3] for i in (-1, 0, 1) for j in (-1, 0, 1)]
    xyz = [*stem(2), *crown(2), *stem(7), *crown(7)]
    own = [0] + [-1] * 14 + [1] + [-1] * 14
    rows = [("c", i, *map(float, v), o, o >= 0, int(v[0]), int(v[1])) for i, (v, o) in enumerate(zip(xyz, own, strict=True))]
    p = spark.createDataFrame(rows, "cloud_id string, point_id bigint, x double, y double, z double, instance_id bigint, is_seed boolean, ix bigint, iy bigint")
    r = np.zeros((9, 5), int)
    r[1:4, 1:4], r[6:9, 1:4] = 1, 2
    labels, places = as_rows(spark, {"label": r}).where("label > 0"), at(spark, [(2, 2), (7, 2)])
    got = morph.grow_crowns(p, labels, places).orderBy("point_id").collect()
    assert [x.instance_id for x in got] == [0] * 15 + [1] * 15
    none = morph.grow_crowns(p.withColumn("is_seed", F.lit(False)).withColumn("instance_id", F.lit(-1).cast("bigint")), labels, places).collect()
    assert len(none) == 30 and {x.instance_id for x in none} == {-1}
