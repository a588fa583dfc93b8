"""Points near other points, or the region that contains them.

A bounded sample of (group, x, y) shapes a quadtree: one root square per group, split where the
sample is dense. Every point goes to the leaf that owns it and, as a copy, to each leaf its
search radius reaches. A leaf is bulk-loaded into an R-tree (sort-tile-recursive), joined with
itself by descending pairs of nodes whose boxes are near enough, and the exact distance decides.
A pair that several leaves could report is reported by the one that holds its reference point.

The sample only shapes the tree; every row is indexed and no candidate is capped. Leaves that
the whole table would overfill are split further without a sample, evenly, so that their
expected load stays near ``target``; the tree holds one number for such a leaf, so what the
driver makes and broadcasts has the sample's size, whatever the table's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.schema import require

DEEPEST = 26


@dataclass
class QuadTree:
    """Leaves of all groups as ranges of (root, Morton code), ascending; bounded by the sample.

    A range that the whole table would overfill is split evenly: ``bits`` holds how many low
    bits of the code one leaf of the range covers, so the tree has the sample's size whatever
    the number of leaves. A leaf is named by its first code.
    """

    x0: float
    y0: float
    size: float  # edge of a root square
    depth: int  # levels of the Morton code below a root
    starts: np.ndarray  # uint64, root << 2*depth | code of the range's first cell
    bits: np.ndarray  # uint64, per range

    @property
    def cell(self) -> float:
        return self.size / (1 << self.depth)

    def codes(self, x: np.ndarray, y: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Morton codes; what lies outside of the square counts to its edge cells."""
        top = (1 << self.depth) - 1
        ix = np.clip(np.floor((x - self.x0) / self.cell), 0, top).astype(np.uint64)
        iy = np.clip(np.floor((y - self.y0) / self.cell), 0, top).astype(np.uint64)
        return (root.astype(np.uint64) << np.uint64(2 * self.depth)) | _spread(ix) | (_spread(iy) << np.uint64(1))

    def _leaf_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first code, bits) of the leaf that holds each code."""
        low = self.bits[np.searchsorted(self.starts, codes, side="right") - 1]
        return (codes >> low) << low, low

    def leaf(self, x: np.ndarray, y: np.ndarray, root: np.ndarray) -> np.ndarray:
        return self._leaf_of(self.codes(x, y, root))[0].astype(np.int64)

    def squares(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(x_lo, x_hi, y_lo, y_hi) of leaves; those at the edge of the root reach to infinity."""
        first, low = self._leaf_of(leaf.astype(np.uint64))
        within = first & np.uint64((1 << (2 * self.depth)) - 1)
        width = 1 << (low.astype(np.int64) // 2)
        out = []
        for start, shift in ((self.x0, 0), (self.y0, 1)):
            i = _compact(within >> np.uint64(shift)).astype(np.int64)
            lo, hi = start + i * self.cell, start + (i + width) * self.cell
            out += [np.where(i == 0, -np.inf, lo), np.where(i + width >= 1 << self.depth, np.inf, hi)]
        return out[0], out[1], out[2], out[3]

    def touched(self, x_lo: np.ndarray, x_hi: np.ndarray, y_lo: np.ndarray, y_hi: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each box meets, by descending from the root."""
        top = (1 << self.depth) - 1
        index = lambda v, start: np.clip(np.floor((v - start) / self.cell), 0, top).astype(np.int64)
        box = np.stack([index(x_lo, self.x0), index(x_hi, self.x0), index(y_lo, self.y0), index(y_hi, self.y0)], 1)
        row, at, level = np.arange(len(x_lo)), root.astype(np.uint64) << np.uint64(2 * self.depth), self.depth
        rows, leaves = [], []
        inner = np.uint64((1 << (2 * self.depth)) - 1)
        while len(row):
            first, low = self._leaf_of(at)
            whole = low.astype(np.int64) >= 2 * level
            rows.append(row[whole])
            leaves.append(first[whole].astype(np.int64))
            row, at = row[~whole], at[~whole]
            if not len(row):
                break
            level -= 1
            at = (at[:, None] | (np.arange(4, dtype=np.uint64) << np.uint64(2 * level))[None]).ravel()
            row = row.repeat(4)
            i, j = _compact(at & inner).astype(np.int64), _compact((at & inner) >> np.uint64(1)).astype(np.int64)
            last = (1 << level) - 1
            b = box[row]
            ok = (i <= b[:, 1]) & (i + last >= b[:, 0]) & (j <= b[:, 3]) & (j + last >= b[:, 2])
            row, at = row[ok], at[ok]
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return cat(rows), cat(leaves)


def _spread(v: np.ndarray) -> np.ndarray:
    """Bits of v at the even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def _compact(v: np.ndarray) -> np.ndarray:
    """The bits at the even places of v, put together."""
    v = v & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | (v >> np.uint64(shift))) & np.uint64(mask)
    return v


N_ROOTS = 64


def root_of(g: np.ndarray) -> np.ndarray:
    """Root square of each hashed group."""
    return (g.astype(np.uint64) >> np.uint64(7)) % np.uint64(N_ROOTS)


def build_quadtree(x: np.ndarray, y: np.ndarray, root: np.ndarray, n_rows: int, *, target: int, least_edge: float) -> QuadTree:
    """A tree from a sample of ``n_rows`` rows whose leaves expect ``target`` rows or fewer.

    Groups are hashed to N_ROOTS roots. No leaf gets smaller than ``least_edge``.
    """
    if len(x) == 0:
        return QuadTree(0.0, 0.0, 1.0, 0, np.arange(N_ROOTS, dtype=np.uint64), np.zeros(N_ROOTS, np.uint64))
    x0, y0 = float(x.min()), float(y.min())
    size = max(float(x.max()) - x0, float(y.max()) - y0, least_edge) * 1.0000001
    depth = int(min(DEEPEST, max(0, np.floor(np.log2(size / least_edge)))))
    none = np.empty(0, np.uint64)
    tree = QuadTree(x0, y0, size, depth, none, none)
    codes = np.sort(tree.codes(x, y, root))
    each = n_rows / len(codes)  # rows that a sampled one stands for
    starts: list[int] = []
    bits: list[int] = []
    todo = [(r << (2 * depth), depth) for r in range(N_ROOTS - 1, -1, -1)]
    while todo:
        start, level = todo.pop()
        width = 1 << (2 * level)
        lo, hi = np.searchsorted(codes, np.array([start, start + width], np.uint64))
        rows = (hi - lo) * each
        if level == 0 or rows <= target:
            starts.append(start)
            bits.append(2 * level)
        elif hi - lo <= 4:
            # the sample says no more here: split evenly for the rows it stands for
            more = min(level, int(np.ceil(np.log2(rows / target) / 2)))
            starts.append(start)
            bits.append(2 * (level - more))
        else:
            quarter = width // 4
            todo.extend((start + q * quarter, level - 1) for q in (3, 2, 1, 0))
    tree.starts, tree.bits = np.array(starts, np.uint64), np.array(bits, np.uint64)
    return tree


def sampled_tree(rows: DataFrame, *, target: int, least_edge: float, sample_rows: int = 100_000, seed: int = 17) -> tuple[QuadTree, int]:
    """(tree, number of rows) for rows (g, id, c0, c1, ..); the driver sees ``sample_rows`` of them."""
    n_rows = rows.count()
    part = min(1.0, sample_rows / max(1, n_rows))
    # the sample is a choice by hash: the same rows whichever executor reads them
    chosen = rows if part >= 1 else rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(part * (1 << 20)))
    sample = chosen.select("g", "c0", "c1").limit(2 * sample_rows).toPandas()
    x, y = sample["c0"].to_numpy(np.float64), sample["c1"].to_numpy(np.float64)
    return build_quadtree(x, y, root_of(sample["g"].to_numpy(np.int64)), n_rows, target=target, least_edge=least_edge), n_rows


# ---- R-tree ------------------------------------------------------------------------------------

FAN = 16


def str_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sort-tile-recursive order: slices by x, each sorted by y."""
    n = len(x)
    slices = max(1, int(np.ceil(np.sqrt(n / FAN))))
    by_x = np.argsort(x, kind="stable")
    tile = np.empty(n, np.int64)
    tile[by_x] = np.arange(n) // max(1, int(np.ceil(n / slices)))
    return np.lexsort((y, tile))


def load_boxes(p: np.ndarray) -> list[np.ndarray]:
    """Levels of an R-tree over points in STR order, leaves first: (nodes, 2, dimensions)."""
    lo = hi = p
    levels = []
    while True:
        first = np.arange(0, len(lo), FAN)
        lo, hi = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
        levels.append(np.stack([lo, hi], 1))
        if len(lo) == 1:
            return levels


def _children(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All child pairs of node pairs with a <= b; below n, the smaller index first."""
    i = (a[:, None] * FAN + np.arange(FAN)).repeat(FAN, 1).ravel()
    j = np.tile(b[:, None] * FAN + np.arange(FAN), (1, FAN)).ravel()
    ok = (i < n) & (j < n) & (i <= j)
    return i[ok], j[ok]


def near_pairs(p: np.ndarray, radius: float, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j (in p's order) at most ``radius`` apart; p is in STR order."""
    if len(p) < 2:
        return
    levels = load_boxes(p)
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    r2 = radius * radius
    while todo:
        level, a, b = todo.pop()
        if len(a) > block:
            todo.append((level, a[block:], b[block:]))
            a, b = a[:block], b[:block]
        if level == 0:
            i, j = _children(a, b, len(p))
            far = i < j
            i, j = i[far], j[far]
            d = p[i] - p[j]
            ok = np.einsum("ij,ij->i", d, d) <= r2
            if ok.any():
                yield i[ok], j[ok]
            continue
        boxes = levels[level - 1]
        i, j = _children(a, b, len(boxes))
        gap = np.maximum(0.0, np.maximum(boxes[i, 0] - boxes[j, 1], boxes[j, 0] - boxes[i, 1]))
        ok = np.einsum("ij,ij->i", gap, gap) <= r2 * 1.000001
        if ok.any():
            todo.append((level - 1, i[ok], j[ok]))


# ---- the join ----------------------------------------------------------------------------------


class _Repeats:
    """Drops rows that repeat an id of the same split, as far as a bounded memory of such ids reaches.

    Copies of one row then never pile up in a leaf; what is left of them counts once there.
    """

    most = 1_000_000

    def __init__(self) -> None:
        self.seen = np.empty(0, np.int64)

    def first_of(self, ids: np.ndarray) -> np.ndarray:
        own, first, n = np.unique(ids, return_index=True, return_counts=True)
        keep = first[~np.isin(own, self.seen)]
        if (n > 1).any() and len(self.seen) < self.most:
            self.seen = np.union1d(self.seen, own[n > 1])
        return np.sort(keep)


def pairs_within(
    points: DataFrame,
    radius: float,
    *,
    group: str = "cloud_id",
    id_col: str = "point_id",
    dims: tuple[str, ...] = ("x", "y", "z"),
    sample_rows: int = 100_000,
    target: int = 20_000,
    seed: int = 17,
    link_cell: float | None = None,
    flag: str | None = None,
    counts: bool = False,
) -> DataFrame:
    """Pairs (<id>_a < <id>_b) of different points of one group at most ``radius`` apart.

    Rows with a null in the group, the id or a coordinate, or with NaN or infinite coordinates,
    have no partners. Rows repeating an id count once. ``sample_rows`` bounds what the driver
    sees of the table; ``target`` is the expected load of a leaf. The first two of ``dims``
    shape the tree, all of them make the distance. With ``link_cell`` a leaf reports a single
    pair for each two cells of that width that any pair links, and none within a cell: enough
    to know what is connected, without all the pairs of dense places. With ``flag`` (a boolean
    column) only pairs come out whose flags differ. With ``counts`` no pairs come out but ``id_col``
    and ``n_near`` of the points that have any, counted in the leaf that owns the point. One
    shuffle, of the points and the copies along leaf edges.
    """
    require(points, group, id_col, *dims, *([flag] if flag else []))
    if not radius >= 0:
        raise ValueError("radius must be a number >= 0")
    finite = F.col(id_col).isNotNull() & F.col(group).isNotNull()
    for c in dims:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    rows = points.where(finite).select(F.xxhash64(group).alias("g"), F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(dims)], *([F.col(flag).cast("double").alias("flag")] if flag else []))
    tree, _ = sampled_tree(rows, target=target, least_edge=max(2.0 * radius, 1e-9), sample_rows=sample_rows, seed=seed)
    root = root_of
    shared = points.sparkSession.sparkContext.broadcast(tree)
    reach = radius * 1.000001
    coords = [f"c{i}" for i in range(len(dims))]
    shipped = coords + (["flag"] if flag else [])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        often = _Repeats()
        for b in batches:
            g, i, *c = [b.column(k).to_numpy(zero_copy_only=False) for k in range(2 + len(shipped))]
            keep = often.first_of(i)
            g, i, c = g[keep], i[keep], [v[keep] for v in c]
            r = root(g)
            # a point's square meets at most the leaves of its four corners: leaves are at least that wide
            found = [t.leaf(c[0] + dx, c[1] + dy, r) for dx in (-reach, reach) for dy in (-reach, reach)]
            found = np.sort(np.stack(found, 1), 1)
            new = np.c_[np.ones(len(i), bool), np.diff(found, axis=1) != 0]
            row, col = np.nonzero(new)
            arrays = [pa.array(found[row, col]), pa.array(g[row]), pa.array(i[row]), *[pa.array(x[row]) for x in c]]
            yield pa.RecordBatch.from_arrays(arrays, names=["leaf", "g", "id", *shipped])

    def probe(table: pa.Table) -> pa.Table:
        t = shared.value
        leaf = table["leaf"][0].as_py()
        g, i = table["g"].to_numpy(), table["id"].to_numpy()
        _, first = np.unique(i, return_index=True)
        p = np.stack([table[c].to_numpy() for c in coords], 1)[first]
        g, i = g[first], i[first]
        side = table["flag"].to_numpy()[first] if flag else None
        found_a, found_b = [], []
        for own in np.unique(g):
            here = np.flatnonzero(g == own)
            order = here[str_order(p[here, 0], p[here, 1])]
            q, k = p[order], i[order]
            owner = root(np.array([own]))
            if link_cell is not None:
                _, cell_no = np.unique(np.floor(q / link_cell), axis=0, return_inverse=True)
                cell_no = cell_no.ravel().astype(np.int64)
                linked = np.empty(0, np.int64)
            if counts:
                n_near = np.zeros(len(q), np.int64)
                for a, b in near_pairs(q, radius):
                    n_near += np.bincount(a, minlength=len(q)) + np.bincount(b, minlength=len(q))
                mine = (n_near > 0) & (t.leaf(q[:, 0], q[:, 1], np.broadcast_to(owner, len(q))) == leaf)
                found_a.append(k[mine])
                found_b.append(n_near[mine])
                continue
            for a, b in near_pairs(q, radius):
                if flag:
                    differ = side[order[a]] != side[order[b]]
                    a, b = a[differ], b[differ]
                ref = np.minimum(q[a], q[b])
                mine = t.leaf(ref[:, 0], ref[:, 1], np.broadcast_to(owner, len(a))) == leaf
                a, b = a[mine], b[mine]
                if link_cell is not None:
                    lo, hi = np.minimum(cell_no[a], cell_no[b]), np.maximum(cell_no[a], cell_no[b])
                    key, at = np.unique(lo * len(q) + hi, return_index=True)
                    new = (lo[at] != hi[at]) & ~np.isin(key, linked)
                    linked = np.union1d(linked, key[new])
                    a, b = a[at[new]], b[at[new]]
                found_a.append(np.minimum(k[a], k[b]))
                found_b.append(np.maximum(k[a], k[b]))
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.table({"a": pa.array(cat(found_a), pa.int64()), "b": pa.array(cat(found_b), pa.int64())})

    leaves = rows.mapInArrow(assign, "leaf bigint, g bigint, id bigint, " + ", ".join(f"{c} double" for c in shipped))
    found = leaves.groupBy("leaf").applyInArrow(probe, "a bigint, b bigint")
    if counts:
        return found.select(F.col("a").alias(id_col), F.col("b").alias("n_near"))
    return found.select(F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"))


def neighbour_counts(points: DataFrame, radius: float, *, group: str = "cloud_id", id_col: str = "point_id", dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``n_near``: the number of other points within ``radius``, for points that have any."""
    return pairs_within(points, radius, group=group, id_col=id_col, dims=dims, counts=True)


def in_ring(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Inside of the closed polygon with vertices (n, 2), by crossings of a ray; its edges count to it."""
    inside, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0), strict=True):
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        edge |= (side == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
        crossed = (ay > y) != (by > y)
        inside ^= crossed & ((side > 0) == (by > ay))
    return inside | edge


def boxes_at(x: np.ndarray, y: np.ndarray, boxes: np.ndarray, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(point, box) for each box (x_lo, x_hi, y_lo, y_hi) that holds a point: descent of an R-tree of the boxes."""
    if not len(x) or not len(boxes):
        return
    order = str_order(boxes[:, 0] + boxes[:, 1], boxes[:, 2] + boxes[:, 3])
    own = boxes[order]
    levels = [own]
    while len(levels[-1]) > 1:
        b, first = levels[-1], np.arange(0, len(levels[-1]), FAN)
        levels.append(np.stack([f.reduceat(b[:, c], first) for c, f in enumerate((np.minimum, np.maximum, np.minimum, np.maximum))], 1))
    todo = [(len(levels) - 1, np.arange(len(x)), np.zeros(len(x), np.int64))]
    while todo:
        level, p, node = todo.pop()
        if len(p) > block:
            todo.append((level, p[block:], node[block:]))
            p, node = p[:block], node[:block]
        b = levels[level][node]
        hit = (x[p] >= b[:, 0]) & (x[p] <= b[:, 1]) & (y[p] >= b[:, 2]) & (y[p] <= b[:, 3])
        p, node = p[hit], node[hit]
        if not len(p):
            continue
        if level == 0:
            yield p, order[node]
            continue
        child = (node[:, None] * FAN + np.arange(FAN)).ravel()
        p = p.repeat(FAN)
        ok = child < len(levels[level - 1])
        todo.append((level - 1, p[ok], child[ok]))


def containing_region(points: DataFrame, regions: DataFrame, *, group: str = "cloud_id", id_col: str = "point_id", sample_rows: int = 100_000, target: int = 20_000) -> DataFrame:
    """id_col, region_id: the regions of its group that each point lies in; edges belong to a region.

    regions: group, region_id and either a box (x_min, x_max, y_min, y_max) or the vertices of a
    polygon (``ring``: array<struct<x, y>>), whose bounding box is then taken. A quadtree shaped by a
    sample of the points parts both sides: a point goes to its leaf, a region to every leaf that
    it meets. In a leaf an R-tree of the regions is probed and the exact test follows. A point
    and a region meet in the point's leaf only, so no pair comes twice. Rows with a null group,
    id or coordinate, boxes with a null or inverted edge and rings of fewer than three vertices
    contain nothing; points without a region don't appear; repeated rows count once.
    """
    require(points, group, id_col, "x", "y")
    require(regions, group, "region_id")
    has_ring = "ring" in regions.columns
    if has_ring:
        corner = lambda f, c: f(F.transform("ring", lambda v: v[c]))
        edges = [corner(f, c).cast("double").alias(f"e{i}") for i, (f, c) in enumerate(((F.array_min, "x"), (F.array_max, "x"), (F.array_min, "y"), (F.array_max, "y")))]
        flat = lambda c: F.transform("ring", lambda v: v[c].cast("double"))
        shape = [F.when(F.size("ring") >= 3, flat(c)).alias(f"r{c}") for c in "xy"]
    else:
        require(regions, "x_min", "x_max", "y_min", "y_max")
        edges = [F.col(c).cast("double").alias(f"e{i}") for i, c in enumerate(("x_min", "x_max", "y_min", "y_max"))]
        shape = [F.array(F.lit(0.0)).alias(f"r{c}") for c in "xy"]
    ok = F.col("region_id").isNotNull() & (F.col("e0") <= F.col("e1")) & (F.col("e2") <= F.col("e3")) & F.col("rx").isNotNull()
    areas = regions.where(F.col(group).isNotNull()).select(F.xxhash64(group).alias("g"), F.col("region_id").cast("bigint").alias("region_id"), *edges, *shape).where(ok)
    valid = F.col(id_col).isNotNull() & F.col(group).isNotNull()
    for c in "xy":
        valid = valid & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    rows = points.where(valid).select(F.xxhash64(group).alias("g"), F.col(id_col).cast("bigint").alias("id"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate("xy")])
    tree, _ = sampled_tree(rows, target=target, least_edge=1e-6, sample_rows=sample_rows)
    shared = points.sparkSession.sparkContext.broadcast(tree)
    schema = "leaf bigint, g bigint, id bigint, is_point boolean, e array<double>, rx array<double>, ry array<double>"
    kind = pa.list_(pa.float64())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, often = shared.value, _Repeats()
        for b in batches:
            keep = often.first_of(b.column("id").to_numpy())
            b = b.take(pa.array(keep))
            g, i, x, y = [b.column(k).to_numpy() for k in range(4)]
            e = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(i) + 1, 2), pa.int32()), pa.array(np.stack([x, y], 1).ravel()))
            none = pa.nulls(len(i), kind)
            yield pa.RecordBatch.from_arrays([pa.array(t.leaf(x, y, root_of(g))), b.column(0), b.column(1), pa.array(np.ones(len(i), bool)), e, none, none], names=["leaf", "g", "id", "is_point", "e", "rx", "ry"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            g = b.column("g").to_numpy()
            e = np.stack([b.column(f"e{i}").to_numpy() for i in range(4)], 1)
            row, leaf = t.touched(*e.T, root_of(g))
            b = b.take(pa.array(row))
            box = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(row) + 1, 4), pa.int32()), pa.array(e[row].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column("g"), b.column("region_id"), pa.array(np.zeros(len(row), bool)), box, b.column("rx").cast(kind), b.column("ry").cast(kind)], names=["leaf", "g", "id", "is_point", "e", "rx", "ry"])

    def probe(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        g, ids, is_point = table["g"].to_numpy(), table["id"].to_numpy(), table["is_point"].to_numpy()
        found: list[list[np.ndarray]] = [[], []]
        for own in np.unique(g):
            p, r = np.flatnonzero((g == own) & is_point), np.flatnonzero((g == own) & ~is_point)
            p = p[np.unique(ids[p], return_index=True)[1]]
            if not len(p) or not len(r):
                continue
            at = table["e"].take(pa.array(p)).combine_chunks().flatten().to_numpy().reshape(-1, 2)
            box = table["e"].take(pa.array(r)).combine_chunks().flatten().to_numpy().reshape(-1, 4)
            for i, k in boxes_at(at[:, 0], at[:, 1], box):
                if has_ring:
                    keep = np.zeros(len(i), bool)
                    for region in np.unique(k):
                        ring = np.stack([np.array(table[c][int(r[region])].values) for c in ("rx", "ry")], 1)
                        here = np.flatnonzero(k == region)
                        keep[here] = in_ring(at[i[here], 0], at[i[here], 1], ring)
                    i, k = i[keep], k[keep]
                found[0].append(ids[p[i]])
                found[1].append(ids[r[k]])
        pairs = np.stack([np.concatenate(x) for x in found], 1) if found[0] else np.empty((0, 2), np.int64)
        pairs = np.unique(pairs, axis=0)  # a region's row can be repeated
        return pa.table({"id": pa.array(pairs[:, 0]), "region_id": pa.array(pairs[:, 1])})

    both = rows.mapInArrow(place, schema).unionByName(areas.mapInArrow(spread, schema))
    out = both.groupBy("leaf").applyInArrow(probe, "id bigint, region_id bigint")
    return out.select(F.col("id").alias(id_col), "region_id")
