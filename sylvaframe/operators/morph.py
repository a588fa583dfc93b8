"""Raster and growth kernels on a window of a canopy raster or one tree neighbourhood, in plain numpy.

Rasters come from an aggregation and kernels see tiles with a halo, so a task is bounded by a
window's area, however many points or cells a cloud has.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaframe.operators.cluster import single_linkage
from sylvaframe.operators.nearest import mean_neighbour_distance, nearest_lists
from sylvaframe.operators.tiles import agreed, by_tiles, own_cells
from sylvaframe.session import cut, default_parallelism

def gaussian_smooth(h: np.ndarray, sigma: float) -> np.ndarray:
    """Normalised smoothing of the occupied cells (h > 0); the others stay 0."""
    reach = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()

    def blur(a: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            p = np.pad(a, [(reach, reach) if i == axis else (0, 0) for i in (0, 1)])
            a = sum(w * np.take(p, np.arange(j, j + a.shape[axis]), axis) for j, w in enumerate(k))
        return a

    mask = (h > 0).astype(float)
    weight = blur(mask)
    return np.where(mask > 0, blur(h * mask) / np.where(weight > 0, weight, 1), 0.0)


def disk(radius: int) -> np.ndarray:
    g = np.arange(-radius, radius + 1)
    return g[:, None] ** 2 + g[None, :] ** 2 <= radius * radius


def _shifts(a: np.ndarray, footprint: np.ndarray, fill: float):
    r = footprint.shape[0] // 2
    p = np.pad(a, r, constant_values=fill)
    for i, j in np.argwhere(footprint):
        yield p[i : i + a.shape[0], j : j + a.shape[1]]


def dilate(a: np.ndarray, footprint: np.ndarray) -> np.ndarray:
    out = a.copy()
    for s in _shifts(a, footprint, a.min() if a.size else 0):
        out = np.maximum(out, s)
    return out


def erode(mask: np.ndarray, footprint: np.ndarray) -> np.ndarray:
    out = mask.copy()
    for s in _shifts(mask, footprint, False):
        out = out & s
    return out


def crown_tops(h: np.ndarray, n: np.ndarray, cell: float, min_distance: float, min_height: float, min_points: int, sigma: float | None = 1.0) -> np.ndarray:
    """Cells (ix, iy) of local maxima above ``min_height``, highest first.

    A maximum is the highest of a disk of half the distance; of two less than ``min_distance``
    apart (in whole cells, along the wider axis) the higher one stays.
    """
    if sigma:
        h = gaussian_smooth(h, sigma)
    h = np.where(n < min_points, 0.0, h)
    apart = int(min_distance / cell)
    top = (h == dilate(h, disk(int(min_distance / cell * 0.5)))) & (h > min_height) & (h > 0)
    at = np.argwhere(top)
    at = at[np.lexsort((at[:, 1], at[:, 0], -h[at[:, 0], at[:, 1]]))]
    kept: list[np.ndarray] = []
    for p in at:
        if not kept or np.abs(np.array(kept) - p).max(1).min() >= apart:
            kept.append(p)
    return np.array(kept, int).reshape(-1, 2)


NEXT = ((-1, 0), (0, -1), (0, 1), (1, 0))


def watershed(value: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels with border lines of 0, labels with lines filled) by priority flooding from low values.

    Cells are decided in order of (value, time of arrival); one whose labelled neighbours differ
    becomes border. Border cells inside the mask then take the largest label around them.
    """
    label = np.where(mask, markers, 0).astype(np.int64)
    w, hgt = label.shape
    decided = label > 0
    heap: list[tuple[float, int, int, int]] = []
    count = 0

    def push(i: int, j: int) -> None:
        nonlocal count
        for di, dj in NEXT:
            a, b = i + di, j + dj
            if 0 <= a < w and 0 <= b < hgt and mask[a, b] and not decided[a, b]:
                heapq.heappush(heap, (float(value[a, b]), count, a, b))
                count += 1

    for i, j in np.argwhere(decided):
        push(i, j)
    while heap:
        _, _, i, j = heapq.heappop(heap)
        if decided[i, j]:
            continue
        around = {int(label[i + di, j + dj]) for di, dj in NEXT if 0 <= i + di < w and 0 <= j + dj < hgt} - {0}
        decided[i, j] = True
        if len(around) == 1:
            label[i, j] = around.pop()
            push(i, j)
    filled = np.where(mask & (label == 0), dilate(label, np.ones((3, 3), bool)), label)
    return label, filled


def correct_watershed(label: np.ndarray, filled: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regions of one cell or enclosed by a single neighbour share their neighbours' ground anew, on flat terrain.

    Cells at the edge to trees outside that ground keep what they had in ``label``, lines included.
    """
    label, filled = label.copy(), filled.copy()
    boxes = {}
    _find_boxes(filled, (0, 0), boxes)
    square, cross = np.ones((3, 3), bool), disk(1)
    for k in np.unique(filled[filled > 0]).tolist():
        at = _around([boxes[k]], filled.shape)
        f = filled[at]
        region = f == k
        if not region.any():
            continue
        ring = set(np.unique(f[dilate(region, square) & ~region]).tolist())
        if region.sum() != 1 and (0 in ring or len(ring) != 1):
            continue
        ring -= {0}
        at = _around([boxes[j] for j in (k, *ring)], filled.shape)
        f, m = filled[at], markers[at]
        area = np.isin(f, [k, *ring])
        sub = np.where(area & np.isin(m, [k, *ring]), m, 0)
        new_label, new_filled = watershed(np.zeros(f.shape), sub, area & mask[at])
        f = np.where(area, new_filled, f)
        outer = area & (dilate(np.where(area, 0, f), cross) > 0)
        filled[at] = f
        label[at] = np.where(area & ~outer, new_label, label[at])
        _find_boxes(np.where(area, f, 0), (at[0].start, at[1].start), boxes)
    return label, filled


def _find_boxes(labels: np.ndarray, corner: tuple[int, int], boxes: dict[int, tuple[int, int, int, int]]) -> None:
    """Sets the box (first and last row and column) of each label above 0."""
    i, j = np.nonzero(labels)
    if not len(i):
        return
    k = labels[i, j]
    order = np.argsort(k, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(k[order]) != 0])
    ends = [f.reduceat(v[order], first) + c for v, c in ((i, corner[0]), (j, corner[1])) for f in (np.minimum, np.maximum)]
    boxes.update(zip(k[order][first].tolist(), zip(*[e.tolist() for e in ends], strict=True), strict=True))


def _around(boxes: list[tuple[int, int, int, int]], shape: tuple[int, int]) -> tuple[slice, slice]:
    """What all the boxes span, and one cell around."""
    b = np.array(boxes)
    return slice(max(0, b[:, 0].min() - 1), min(shape[0], b[:, 1].max() + 2)), slice(max(0, b[:, 2].min() - 1), min(shape[1], b[:, 3].max() + 2))


def signed_distance(region: np.ndarray) -> np.ndarray:
    """Distance in cells to the other side of the region's edge; negative inside."""
    inside, outside = np.argwhere(region), np.argwhere(~region)
    out = np.zeros(region.shape)
    if not len(inside) or not len(outside):
        return np.full(region.shape, np.inf if not len(inside) else -np.inf)
    edge_in = inside[dilate(~region, np.ones((3, 3), bool))[inside[:, 0], inside[:, 1]]]
    edge_out = outside[dilate(region, np.ones((3, 3), bool))[outside[:, 0], outside[:, 1]]]
    for cells, edge, sign in ((inside, edge_out, -1.0), (outside, edge_in, 1.0)):
        for i in range(0, len(cells), 1024):
            part = cells[i : i + 1024]
            d = np.sqrt(((part[:, None] - edge[None]) ** 2).sum(2)).min(1)
            out[part[:, 0], part[:, 1]] = sign * d
    return out


def priority_grow(first: np.ndarray, near: np.ndarray, d2: np.ndarray, labels: np.ndarray, seed: np.ndarray, radius: float, crown: np.ndarray, crown_of: dict[int, int], factor: float) -> np.ndarray:
    """Labels spread along the cheapest single edge first (not the shortest path).

    near, d2: neighbours of point i at first[i]:first[i + 1]. crown: whose crown each point lies
    in; an edge into a cell outside of the tree's own crown (``crown_of[label]``) costs factor^2
    times its squared length. Edges above radius^2 count not.
    """
    labels = labels.copy()
    done = labels >= 0
    heap: list[tuple[float, int, int, int]] = []
    count = 0

    def push(i: int) -> None:
        nonlocal count
        own = int(labels[i])
        inside = crown_of.get(own, own)
        for j, d in zip(near[first[i] : first[i + 1]].tolist(), d2[first[i] : first[i + 1]].tolist(), strict=True):
            if j >= 0 and not done[j] and d <= radius * radius:
                heapq.heappush(heap, (d if crown[j] == inside else d * factor * factor, count, j, own))
                count += 1

    for i in np.flatnonzero(seed):
        push(i)
    while heap:
        _, _, j, own = heapq.heappop(heap)
        if not done[j]:
            labels[j], done[j] = own, True
            push(j)
    return labels


def dense(pdf: pd.DataFrame, column: str, fill: float = 0.0, corner: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Rows (ix, iy, column) of one window as an array from ``corner`` on."""
    ix, iy = pdf["ix"].to_numpy(int) - corner[0], pdf["iy"].to_numpy(int) - corner[1]
    out = np.full((ix.max() + 1, iy.max() + 1), fill)
    out[ix, iy] = pdf[column]
    return out


def _corner(pdf: pd.DataFrame) -> tuple[int, int]:
    return int(pdf["ix"].min()), int(pdf["iy"].min())


def find_crown_tops(chm: DataFrame, cell: float, *, min_distance: float = 2.0, min_height: float = 2.5, min_points: int = 1, sigma: float | None = 1.0, tile: int = 256) -> DataFrame:
    """cloud_id, top_no, ix, iy, h of the canopy rasters (cloud_id, ix, iy, h, n).

    Tiles see a halo of four times the distance besides the smoothing's reach, so whether a
    lower top gives way is decided by the same neighbours on both sides of a tile's edge.
    """
    halo = int(4 * min_distance / cell) + int(4 * (sigma or 0) + 0.5) + 1
    schema = "cloud_id string, ix bigint, iy bigint, h double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = _corner(pdf)
        h = dense(pdf, "h", corner=at)
        top = crown_tops(h, dense(pdf, "n", corner=at), cell, min_distance, min_height, min_points, sigma)
        out = pd.DataFrame({"cloud_id": pdf["cloud_id"].iloc[0], "ix": top[:, 0] + at[0], "iy": top[:, 1] + at[1], "h": h[top[:, 0], top[:, 1]], "tx": pdf["tx"].iloc[0], "ty": pdf["ty"].iloc[0]})
        return out[own_cells(out, tile)].drop(columns=["tx", "ty"])

    found = by_tiles(chm.select("cloud_id", "ix", "iy", "h", "n"), run, schema, halo=halo, tile=tile)
    number = F.row_number().over(W.partitionBy("cloud_id").orderBy(F.desc("h"), "ix", "iy")) - 1
    return found.select("cloud_id", number.cast("bigint").alias("top_no"), "ix", "iy", "h")


def segment_canopy(chm: DataFrame, positions: DataFrame, *, correct: bool = True, halo: int = 64, tile: int = 256) -> DataFrame:
    """cloud_id, ix, iy, label_border, label: watersheds of the canopy from tree positions.

    positions: cloud_id, tree_no (0, 1, ..), ix, iy; of two in one cell the larger number holds.
    Label = tree_no + 1; 0 is background. Tiles are flooded with a halo that widens until the
    labels on both sides of each tile's edge agree.
    """
    trees = positions.groupBy("cloud_id", "ix", "iy").agg(F.max(F.col("tree_no").cast("bigint")).alias("tree_no"))
    rows = chm.where("h > 0").select("cloud_id", "ix", "iy", "h").join(trees, ["cloud_id", "ix", "iy"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ix", "iy"])
        at = _corner(pdf)
        h = dense(pdf, "h", corner=at)
        markers = dense(pdf.assign(m=pdf["tree_no"].fillna(-1) + 1), "m", corner=at).astype(np.int64)
        mask = h > 0
        label, filled = watershed(-h, markers, mask)
        if correct:
            label, filled = correct_watershed(label, filled, markers, mask)
        cells = np.argwhere(mask)
        return pd.DataFrame({"ix": cells[:, 0] + at[0], "iy": cells[:, 1] + at[1], "label_border": label[mask], "label": filled[mask]})

    return agreed(rows, run, {"label_border": "bigint", "label": "bigint"}, halo=halo, tile=tile)


def signed_distances(labels: DataFrame, margin: int = 2) -> DataFrame:
    """cloud_id, tree_no, ix, iy, sd (in cells) of each labelled region's box and ``margin`` cells around.

    Negative inside of the region. Beyond the box nothing of the tree can be reached by a growth
    of ``margin`` cells, so no tree meets the whole cloud's cells. Many trees share a task.
    """
    n = 4 * default_parallelism(labels.sparkSession)
    rows = labels.where("label > 0").select("cloud_id", "label", "ix", "iy")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for (cloud, label), own in pdf.groupby(["cloud_id", "label"]):
            x0, y0 = own["ix"].min() - margin - 1, own["iy"].min() - margin - 1
            region = np.zeros((own["ix"].max() - x0 + margin + 2, own["iy"].max() - y0 + margin + 2), bool)
            region[own["ix"] - x0, own["iy"] - y0] = True
            sd = signed_distance(region)[1:-1, 1:-1]
            i, j = np.indices(sd.shape)
            parts.append(pd.DataFrame({"cloud_id": cloud, "tree_no": label - 1, "ix": i.ravel() + x0 + 1, "iy": j.ravel() + y0 + 1, "sd": sd.ravel()}))
        return pd.concat(parts)

    return rows.groupBy(F.pmod(F.xxhash64("cloud_id", "label"), F.lit(n))).applyInPandas(run, "cloud_id string, tree_no bigint, ix bigint, iy bigint, sd double")


# ---- refinement of overlapping crowns --------------------------------------------------------------

AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def _neighbours(cells: DataFrame, steps: list[tuple[int, int]], *values: str) -> DataFrame:
    """Each cell's values at the places of its neighbours: cloud_id, ix, iy, values."""
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("s")
    return cells.select("cloud_id", "ix", "iy", *values, step).select("cloud_id", (F.col("ix") + F.col("s.i")).alias("ix"), (F.col("iy") + F.col("s.j")).alias("iy"), *values)


def eroding_trees(labels: DataFrame) -> DataFrame:
    """cloud_id, tree_no of the regions that lose cells to their neighbours by an erosion with disk(1).

    Border lines count below the background and that below trees, as ranked labels; a cell next to
    the background doesn't erode. labels: cloud_id, ix, iy, label_border, one row per canopy cell.
    """
    rank = F.when(F.col("label_border") == 0, 0).otherwise(F.col("label_border") + 1)
    cells = labels.select("cloud_id", "ix", "iy", rank.alias("rank"))
    size = cells.groupBy(F.col("cloud_id").alias("g")).agg(F.max("ix").alias("mx"), F.max("iy").alias("my"))
    near = _neighbours(cells, [(-1, 0), (1, 0), (0, -1), (0, 1)], "rank").groupBy("cloud_id", "ix", "iy").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("n"))
    rows = cells.where("rank > 0").join(near, ["cloud_id", "ix", "iy"]).join(size, F.col("cloud_id") == F.col("g"))
    edges = [(F.col(c) > 0).cast("int") + (F.col(c) < F.col(f"m{c[1]}")).cast("int") for c in ("ix", "iy")]
    least = F.when(F.col("n") < edges[0] + edges[1], F.least("least", F.lit(1))).otherwise(F.col("least"))
    return rows.where((least < F.col("rank")) & (least != 1)).select("cloud_id", (F.col("rank") - 2).alias("tree_no")).distinct()


def adjacent_trees(labels: DataFrame) -> DataFrame:
    """cloud_id, a, b: tree numbers of regions that touch (8 directions), both ways round."""
    cells = labels.where("label > 0").select("cloud_id", "ix", "iy", F.col("label").alias("b"))
    met = _neighbours(cells, AROUND, "b").join(cells.withColumnRenamed("b", "a"), ["cloud_id", "ix", "iy"]).where("a <> b")
    return met.select("cloud_id", (F.col("a") - 1).alias("a"), (F.col("b") - 1).alias("b")).distinct()


def overlapping_crowns(points: DataFrame, labels: DataFrame, max_spacing: float = 0.08, *, crown: int = 2, trunks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """points with ``is_seed``; crown points of the trees to refine have lost their instance_id (-1).

    points: cloud_id, point_id, x, y, z, cls, instance_id (the tree's number). A tree is refined if
    an erosion takes cells of it, it has trunk points, its points' mean distance to their nearest
    others is at most ``max_spacing``, and a tree that touches it is such a tree, too.
    """
    spacing = mean_neighbour_distance(points.select("cloud_id", "point_id", "x", "y", "z"), 1)
    is_trunk = F.coalesce(F.col("cls").isin(*trunks), F.lit(False))
    trees = points.where("instance_id >= 0").join(spacing, "point_id", "left").groupBy("cloud_id", F.col("instance_id").alias("tree_no"))
    trees = trees.agg(F.avg("mean_distance").alias("spacing"), F.count_if(is_trunk).alias("n")).where((F.col("n") > 0) & (F.col("spacing") <= max_spacing))
    good = cut(trees.select("cloud_id", "tree_no").join(eroding_trees(labels), ["cloud_id", "tree_no"], "left_semi"))
    pairs = adjacent_trees(labels).join(good.withColumnRenamed("tree_no", "b"), ["cloud_id", "b"], "left_semi")
    refined = good.join(pairs.select("cloud_id", F.col("a").alias("tree_no")).distinct(), ["cloud_id", "tree_no"], "left_semi").select(F.col("cloud_id").alias("__g"), F.col("tree_no").alias("__t"), F.lit(True).alias("__refine"))
    rows = points.drop("is_seed").join(refined, (F.col("cloud_id") == F.col("__g")) & (F.col("instance_id") == F.col("__t")), "left")
    refine = F.coalesce("__refine", F.lit(False))
    is_crown = F.coalesce(F.col("cls") == crown, F.lit(False))
    rows = rows.withColumn("is_seed", refine & is_trunk).withColumn("instance_id", F.when(refine & is_crown, F.lit(-1).cast("bigint")).otherwise(F.col("instance_id")))
    return rows.drop("__g", "__t", "__refine")


def grow_crowns(points: DataFrame, labels: DataFrame, positions: DataFrame, *, k: int = 27, radius: float = 1.0, factor: float = 2.0, z_scale: float = 0.5) -> DataFrame:
    """cloud_id, point_id, instance_id of the seeds and of the points without an instance, grown from the seeds.

    points: cloud_id, point_id, x, y, z, instance_id, is_seed and the raster cell ix, iy. labels:
    cloud_id, ix, iy, label. positions: cloud_id, tree_no, ix, iy; a tree's crown is the region of
    its position. The growth is sequential, but no further than points are linked by steps of
    ``radius``, so each linked set is grown by itself; what no seed reaches stays -1.
    """
    n = 4 * default_parallelism(points.sparkSession)
    crown = labels.where("label > 0").select("cloud_id", "ix", "iy", (F.col("label") - 1).alias("crown"))
    rows = points.where(F.col("is_seed") | (F.coalesce("instance_id", F.lit(-1)) < 0)).join(crown, ["cloud_id", "ix", "iy"], "left")
    rows = cut(rows.select("cloud_id", "point_id", "x", "y", (F.col("z") * z_scale).alias("z"), F.when(F.col("is_seed"), F.col("instance_id")).otherwise(-1).cast("bigint").alias("instance_id"), F.coalesce("crown", F.lit(-1)).cast("bigint").alias("crown")))
    own = positions.join(crown, ["cloud_id", "ix", "iy"]).select(F.col("cloud_id").alias("g"), F.col("tree_no").cast("bigint").alias("t"), F.col("crown").alias("own_crown"))
    linked = single_linkage(rows, radius)
    near = nearest_lists(rows, None, max(1, k - 1), dims=("x", "y", "z"), query_id="point_id", exclude_self=True, radius=radius)
    rows = rows.join(own, (F.col("cloud_id") == F.col("g")) & (F.col("instance_id") == F.col("t")), "left").drop("g", "t")
    rows = rows.join(linked, "point_id").join(near.withColumnRenamed("query_id", "point_id"), "point_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, own in pdf.groupby("cluster"):
            own = own.sort_values("point_id")
            ids, label = own["point_id"].to_numpy(), own["instance_id"].to_numpy()
            seed = label >= 0
            if seed.any() and not seed.all():
                first = np.r_[0, np.cumsum([len(v) for v in own["ids"]])]
                hits, d2 = np.concatenate(own["ids"].to_list()), np.concatenate(own["d2s"].to_list())
                at = np.minimum(np.searchsorted(ids, hits), len(ids) - 1)
                at = np.where(ids[at] == hits, at, -1) if len(at) else at.astype(int)
                crowns = {int(t): int(c) for t, c in zip(label[seed], own["own_crown"].to_numpy()[seed], strict=True) if c == c}
                label = priority_grow(first, at, d2, label, seed, radius, own["crown"].to_numpy(), crowns, factor)
            parts.append(pd.DataFrame({"cloud_id": own["cloud_id"].to_numpy(), "point_id": ids, "instance_id": label}))
        return pd.concat(parts)

    rows = rows.select("cloud_id", "point_id", "instance_id", "crown", F.col("own_crown").cast("double").alias("own_crown"), "cluster", "ids", "d2s")
    return rows.groupBy(F.pmod(F.xxhash64("cluster"), F.lit(n))).applyInPandas(run, "cloud_id string, point_id bigint, instance_id bigint")


# ---- cloth simulation ------------------------------------------------------------------------------


#: cells without points that the cloth spans from the nearest ones with points; no cloth beyond
SPAN = 16


def cloth(surface: np.ndarray, rigidness: int = 2, iterations: int = 500, time_step: float = 0.65) -> np.ndarray:
    """Heights of a cloth that falls onto the turned-over surface (NaN where it has no points and there is no cloth)."""
    ground = -surface
    known = ~np.isnan(ground)
    if not known.any():
        return np.full(surface.shape, np.nan)
    # cells without points take the mean of known heights around, ring by ring
    for _ in range(SPAN):
        if known.all():
            break
        p, k = np.pad(np.where(known, ground, 0), 1), np.pad(known.astype(float), 1)
        w, h = ground.shape
        near = [(p[i : i + w, j : j + h], k[i : i + w, j : j + h]) for i in (0, 1, 2) for j in (0, 1, 2)]
        total, n = sum(a for a, _ in near), sum(b for _, b in near)
        fill = ~known & (n > 0)
        ground = np.where(fill, total / np.where(n > 0, n, 1), ground)
        known = known | fill
    if known.mean() < DENSE:
        now = _fallen_cells(ground, known, rigidness, iterations, time_step)
    else:
        now = _fallen_grid(ground, known, rigidness, iterations, time_step)
    out = np.full(surface.shape, np.nan)
    out[known] = -now
    return out


#: share of a window's cells with cloth from which whole slices are faster than lists of cells
DENSE = 0.15


def _fallen_cells(ground: np.ndarray, known: np.ndarray, rigidness: int, iterations: int, time_step: float) -> np.ndarray:
    """Heights of the known cells; only they are kept: neighbours along an axis as pairs of their numbers."""
    place = np.cumsum(known.ravel()).reshape(known.shape) - 1
    pairs = []
    for axis in (0, 1):
        one, two = [slice(None)] * 2, [slice(None)] * 2
        one[axis], two[axis] = slice(None, -1), slice(1, None)
        both = known[tuple(one)] & known[tuple(two)]
        even = np.indices(both.shape)[axis][both] % 2 == 0
        a, b = place[tuple(one)][both], place[tuple(two)][both]
        pairs += [(a[even], b[even]), (a[~even], b[~even])]  # no cell twice in a set
    level = ground[known]
    now = np.full(len(level), level.max() + 0.05)
    last = now
    free = np.ones(len(level), bool)
    fall = -0.2 * time_step * time_step
    for _ in range(iterations):
        step = np.where(free, now + (now - last) * 0.99 + fall, now)
        last, now = now, step
        for _ in range(rigidness):
            for a, b in pairs:
                d, fa, fb = now[b] - now[a], free[a], free[b]
                share = np.where(fa & fb, 0.25, 0.5) * d
                now[a] += share * fa
                now[b] -= share * fb
        low = now < level
        now = np.where(low, level, now)
        free &= ~low
        if not free.any() or np.abs(now - last)[free].max() < 0.005:
            break
    return now


def _fallen_grid(ground: np.ndarray, known: np.ndarray, rigidness: int, iterations: int, time_step: float) -> np.ndarray:
    """As ``_fallen_cells``, number for number, on slices of the whole window."""
    ends = []
    for axis in (0, 1):
        for first in (0, 1):
            n = (known.shape[axis] - first) // 2 * 2
            one, two = [slice(None)] * 2, [slice(None)] * 2
            one[axis], two[axis] = slice(first, first + n, 2), slice(first + 1, first + n, 2)
            if n:
                one, two = tuple(one), tuple(two)
                ends.append((one, two, known[one] & known[two], np.empty(known[one].shape), np.empty(known[one].shape)))
    level = np.where(known, ground, -np.inf)
    now = np.where(known, level.max() + 0.05, 0.0)
    last = now
    free = known.copy()
    fall = -0.2 * time_step * time_step
    weights: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        if not weights:  # they change where cells come to rest
            for one, two, both, _, _ in ends:
                fa, fb = free[one], free[two]
                share = np.where(fa & fb, 0.25, 0.5) * both
                weights.append((share * fa, share * fb))
        step = now - last
        step *= 0.99
        step += now
        step += fall
        step = np.where(free, step, now)
        last, now = now, step
        for _ in range(rigidness):
            for (one, two, _, d, part), (wa, wb) in zip(ends, weights, strict=True):
                np.subtract(now[two], now[one], out=d)
                now[one] += np.multiply(wa, d, out=part)
                now[two] -= np.multiply(wb, d, out=part)
        low = now < level
        if low.any():
            now = np.where(low, level, now)
            if (free & low).any():
                free &= ~low
                weights = []
        if not free.any() or np.abs(now - last)[free].max() < 0.005:
            break
    return now[known]


def cloth_heights(points: DataFrame, resolution: float = 0.5, threshold: float = 0.5, rigidness: int = 2, iterations: int = 500, group: str = "cloud_id", halo: int = 32, tile: int = 256) -> DataFrame:
    """group, ix, iy, ground: the cloth's height in each raster cell that has points.

    Only the lowest height of each raster cell goes into the simulation, which runs tile by tile
    with a halo that widens, up to 128 cells, until the cloth's heights on both sides of each edge
    agree to a fifth of the threshold.
    """
    if rigidness not in (1, 2, 3):
        raise ValueError("rigidness must be 1, 2 or 3")
    cell = [F.floor(F.col(c) / resolution).alias(f"i{c}") for c in "xy"]
    low = points.groupBy(F.col(group).alias("__g"), *cell).agg(F.min("z").alias("h"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        corner = _corner(pdf)
        surface = cloth(dense(pdf, "h", np.nan, corner), rigidness, iterations)
        ix, iy = pdf["ix"].to_numpy(int), pdf["iy"].to_numpy(int)
        return pd.DataFrame({"ix": ix, "iy": iy, "ground": surface[ix - corner[0], iy - corner[1]]})

    ground = agreed(low, run, {"ground": "double"}, halo=halo, tolerance=0.2 * threshold, most=128, group="__g", tile=tile, packed=True)
    return ground.withColumnRenamed("__g", group)


def classify_terrain(points: DataFrame, resolution: float = 0.5, threshold: float = 0.5, rigidness: int = 2, iterations: int = 500, group: str = "cloud_id", halo: int = 32, tile: int = 256) -> DataFrame:
    """points with ``terrain``: 0 within ``threshold`` of the cloth, else 1; points meet their cell's height in one join."""
    ground = cloth_heights(points, resolution, threshold, rigidness, iterations, group, halo, tile)
    rows = points.select("*", *[F.floor(F.col(c) / resolution).alias(f"__i{c}") for c in "xy"])
    ground = ground.select(F.col(group).alias("__g"), F.col("ix").alias("__jx"), F.col("iy").alias("__jy"), F.col("ground").alias("__ground"))
    out = rows.join(ground, (F.col(group) == F.col("__g")) & (F.col("__ix") == F.col("__jx")) & (F.col("__iy") == F.col("__jy")))
    flag = F.when(F.abs(F.col("z") - F.col("__ground")) <= threshold, 0).otherwise(1)
    return out.withColumn("terrain", flag).drop("__g", "__ix", "__iy", "__jx", "__jy", "__ground")
