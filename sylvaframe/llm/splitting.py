"""Oversized scan files in pieces under a limit, cut where the ground is empty.

A file is parsed into a structure tree: its empty strips (along x, then y) separate the first
siblings, strips inside of a sibling separate the next, and a node without strips is parted at
its sparsest line. Subtrees of siblings are merged bottom-up as long as they stay under the
limit; only nodes above the limit are descended into. Points are first summed up in cells of
half a strip's width; a cell keeps the exact extremes of its points, so strips are exact.

The tree is built in levels of tiles (``TILE`` cells a side, each level ``GROWTH`` times wider),
which bounds a task by area however many rows a file owns. A tile packs what lies inside of it;
subtrees that come within a strip's width of its edge stay apart from each other and are packed
by the next level together with those across the edge, so no piece ends at a tile's edge for the
tile's sake. A single cell with more points than the limit is cut along a fine grid.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaframe.schema import require, valid_points
from sylvaframe.session import cut

TILE = 256
GROWTH = 16
FINE = 64  # parts of a cell's edge, for cells that alone exceed the limit


def cells(points: DataFrame, cell: float) -> DataFrame:
    """Per (file_id, cx, cy): n and the extremes, each with the smallest point_id that has it.

    points: distinct valid points. One shuffle with map-side combination.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(cell))
    low = lambda c: F.min(F.struct(F.col(c).alias("v"), F.col("point_id").alias("id")))
    high = lambda c: F.max(F.struct(F.col(c).alias("v"), (-F.col("point_id")).alias("id")))
    return points.groupBy("file_id", at("x").alias("cx"), at("y").alias("cy")).agg(
        F.count(F.lit(1)).alias("n"), low("x").alias("x_lo"), high("x").alias("x_hi"), low("y").alias("y_lo"), high("y").alias("y_hi")
    )


def profile(cell_rows: DataFrame, min_gap: float) -> DataFrame:
    """Both axes of each file as occupied lines of cells, ``gap`` before each and its segment.

    A strip wider than a cell lies between two occupied lines. ``segment`` counts the strips
    before a line, so it numbers the children that the strips make of the file.
    """
    axis = lambda a: F.struct(F.lit(a).alias("axis_name"), F.col(f"c{a}").alias("line"), F.col(f"{a}_lo").alias("lo"), F.col(f"{a}_hi").alias("hi"))
    rows = cell_rows.select("file_id", F.explode(F.array(axis("x"), axis("y"))).alias("a")).select("file_id", "a.*")
    lines = rows.groupBy("file_id", "axis_name", "line").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    order = W.partitionBy("file_id", "axis_name").orderBy("line")
    lines = lines.withColumn("before", F.lag("hi").over(order))
    is_strip = F.coalesce((F.col("lo.v") - F.col("before.v")) > F.lit(min_gap), F.lit(False))
    return lines.withColumn("is_strip", is_strip).withColumn("segment", F.sum(F.col("is_strip").cast("int")).over(order))


def oversized(cell_rows: DataFrame, limit: int) -> DataFrame:
    """The cells of files with more than ``limit`` points."""
    files = cell_rows.groupBy("file_id").agg(F.sum("n").alias("n_file")).where(F.col("n_file") > limit).select(F.col("file_id").alias("__file"))
    return cell_rows.join(files, F.col("file_id") == F.col("__file")).drop("__file")


def siblings(lines: DataFrame) -> DataFrame:
    """The first siblings of each file's tree: file_id, axis_name, segment and their extremes."""
    return lines.groupBy("file_id", "axis_name", "segment").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def strips(nodes: DataFrame) -> DataFrame:
    """file_id, axis_name, point_id_a < point_id_b: the points on either side of what parts two siblings."""
    before = F.lag("hi").over(W.partitionBy("file_id", "axis_name").orderBy("segment"))
    pairs = nodes.withColumn("before", before).where("before IS NOT NULL")
    a, b = -F.col("before.id"), F.col("lo.id")
    return pairs.select("file_id", "axis_name", F.least(a, b).alias("point_id_a"), F.greatest(a, b).alias("point_id_b"))


# ---- the tree of one tile ---------------------------------------------------------------------


def _runs(lo: np.ndarray, hi: np.ndarray, line: np.ndarray, min_gap: float) -> np.ndarray:
    """Number of the run between strips for each row."""
    order = np.argsort(line, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(line[order]) != 0])
    gap = np.minimum.reduceat(lo[order], first)[1:] - np.maximum.accumulate(np.maximum.reduceat(hi[order], first))[:-1]
    run = np.r_[0, np.cumsum(gap > min_gap)]
    out = np.empty(len(line), np.int64)
    out[order] = np.repeat(run, np.diff(np.r_[first, len(line)]))
    return out


def _sparsest(line: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two sides of the emptiest boundary between lines in the middle half (by points)."""
    lines, code = np.unique(line, return_inverse=True)
    weight = np.bincount(code, n)
    upto = np.cumsum(weight)[:-1] / weight.sum()
    cost = np.minimum(weight[:-1], weight[1:]) / np.diff(lines)  # a line missing in between is emptier still
    middle = (upto >= 0.25) & (upto <= 0.75)
    if not middle.any():
        middle = np.abs(upto - 0.5) == np.abs(upto - 0.5).min()
    best = np.lexsort((np.abs(upto - 0.5), np.where(middle, cost, np.inf)))[0]
    return (line > lines[best]).astype(np.int64)


def pack_tree(c: dict[str, np.ndarray], limit: int, min_gap: float, rect: tuple[float, float, float, float] | None = None) -> np.ndarray:
    """Number of the group of each item (a cell, or a subtree of the level below) of a tile.

    c: cx, cy (first lines), n, the extremes and, in the lowest level, bx and by (segments of the
    whole file). rect: the tile (x_lo, x_hi, y_lo, y_hi) unless it holds the whole file. Groups
    stay within the limit; what comes near the tile's edge isn't merged across a strip.
    """
    first = "bx" in c

    def has_strip(at: np.ndarray, axis: str, depth: int) -> np.ndarray | None:
        if first and depth < 2:
            run = c[f"b{axis}"][at]  # the strips of the whole file come first
        else:
            run = _runs(c[f"{axis}_lo"][at], c[f"{axis}_hi"][at], c[f"c{axis}"][at], min_gap)
        return run if run.min() != run.max() else None

    def strip_children(at: np.ndarray, depth: int) -> list[np.ndarray] | None:
        for d in range(depth, 3):  # a level without strips of the whole file is passed over
            for axis in "xy" if d % 2 == 0 else "yx":
                run = has_strip(at, axis, d)
                if run is not None:
                    return [at[run == r] for r in np.unique(run)]
        return None

    def at_edge(at: np.ndarray) -> bool:
        if rect is None:
            return False
        return c["x_lo"][at].min() - min_gap < rect[0] or c["x_hi"][at].max() + min_gap > rect[1] or c["y_lo"][at].min() - min_gap < rect[2] or c["y_hi"][at].max() + min_gap > rect[3]

    def halves(at: np.ndarray) -> list[np.ndarray]:
        wide = np.ptp(c["cx"][at]) >= np.ptp(c["cy"][at])
        line = c["cx" if wide else "cy"][at]
        if line.min() == line.max():  # subtrees that begin in one line: any order parts them
            upto = np.cumsum(c["n"][at])
            side = (upto > upto[-1] / 2).astype(np.int64)
            side[0], side[-1] = 0, 1
        else:
            side = _sparsest(line, c["n"][at])
        return [at[side == 0], at[side == 1]]

    # iterative post-order: (items, depth) to open, or a number of children to merge
    todo: list = [(np.arange(len(c["n"])), 0)]
    done: list[list[tuple[np.ndarray, int, bool]]] = []  # subtrees in order: items, points, may be merged
    while todo:
        top = todo.pop()
        if isinstance(top, int):
            group, done[len(done) - top :] = done[len(done) - top :], []
            merged: list[tuple[np.ndarray, int, bool]] = []
            for at, n, free in (x for part in group for x in part):
                if merged and free and merged[-1][2] and merged[-1][1] + n <= limit:
                    merged[-1] = (np.concatenate([merged[-1][0], at]), merged[-1][1] + n, True)
                else:
                    merged.append((at, n, free))
            done.append(merged)
            continue
        at, depth = top
        n = int(c["n"][at].sum())
        edge = at_edge(at)
        parts = None
        if len(at) > 1 and (n > limit or edge):
            parts = strip_children(at, min(depth, 2) if first else 2)
            if parts is None and n > limit:
                parts = halves(at)
        if parts is None:
            done.append([(at, n, n <= limit and not edge)])
        else:
            todo.append(len(parts))
            todo.extend((p, depth + 1) for p in reversed(parts))
    out = np.empty(len(c["n"]), np.int64)
    for k, (at, _, _) in enumerate(done[0]):
        out[at] = k
    return out


EXTREMES = ["x_lo", "x_hi", "y_lo", "y_hi"]


def _packer(limit: int, min_gap: float, width: int, level: int):
    """Packs one tile of ``width`` cells a side."""
    cell = min_gap / 2

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        # in a fixed order: the same pieces on every run
        pdf = pdf.sort_values(["cx", "cy", "item"], ignore_index=True)
        names = ["cx", "cy", "n", *EXTREMES] + (["bx", "by"] if level == 0 else [])
        c = {k: pdf[k].to_numpy() for k in names}
        head = pdf.iloc[0]
        rect = None
        if head["wide"] > width:
            x, y = (head[f"{a}0"] + head[f"t{a}"] * width for a in "xy")
            # the file's own outer edge is no tile's edge
            end = lambda t, lo: (t + width) * cell if t + width < lo + head["wide"] else math.inf
            rect = (x * cell if head["tx"] else -math.inf, end(x, head["x0"]), y * cell if head["ty"] else -math.inf, end(y, head["y0"]))
        up = pack_tree(c, limit, min_gap, rect)
        return pdf[["file_id", "item", "cx", "cy", "n", *EXTREMES, "x0", "y0", "wide"]].assign(up=[f"{level}_{head['tx']}_{head['ty']}_{k}" for k in up])

    return pack


def cell_pieces(cell_rows: DataFrame, lines: DataFrame, limit: int, min_gap: float) -> DataFrame:
    """file_id, cx, cy, n, piece of all cells of the oversized files, level by level of tiles."""
    cell = min_gap / 2
    seg = lambda a: lines.where(F.col("axis_name") == a).select(F.col("file_id").alias(f"f{a}"), F.col("line").alias(f"l{a}"), F.col("segment").alias(f"b{a}"))
    sx, sy = seg("x"), seg("y")
    big = cell_rows.join(sx, (F.col("file_id") == F.col("fx")) & (F.col("cx") == F.col("lx"))).join(sy, (F.col("file_id") == F.col("fy")) & (F.col("cy") == F.col("ly")))
    corner = cell_rows.groupBy(F.col("file_id").alias("__file")).agg(*[f(f"c{a}").alias(f"__{k}{a}") for a in "xy" for k, f in (("lo", F.min), ("hi", F.max))])
    corner = corner.withColumn("__wide", F.greatest(F.col("__hix") - F.col("__lox"), F.col("__hiy") - F.col("__loy")) + 1)
    big = big.join(corner, F.col("file_id") == F.col("__file"))
    item = F.concat_ws("_", "cx", "cy")
    items = big.select("file_id", item.alias("item"), "cx", "cy", "n", *[F.col(f"{a}_{e}.v").alias(f"{a}_{e}") for a in "xy" for e in ("lo", "hi")], "bx", "by", F.col("__lox").alias("x0"), F.col("__loy").alias("y0"), F.col("__wide").alias("wide"))
    widest = corner.agg(F.max("__wide")).first()[0] or 1
    placed, width, level = None, TILE, 0
    while True:
        tiled = items.withColumns({f"t{a}": F.floor((F.col(f"c{a}") - F.col(f"{a}0")) / width) for a in "xy"})

        schema = "file_id string, item string, cx bigint, cy bigint, n bigint, x_lo double, x_hi double, y_lo double, y_hi double, x0 bigint, y0 bigint, wide bigint, up string"
        packed = cut(tiled.groupBy("file_id", "tx", "ty").applyInPandas(_packer(limit, min_gap, width, level), schema))
        if placed is None:
            placed = packed.select("file_id", "cx", "cy", "n", F.col("up").alias("piece"))
        else:
            name = packed.select(F.col("file_id").alias("__file"), F.col("item").alias("__item"), "up")
            placed = placed.join(name, (F.col("file_id") == F.col("__file")) & (F.col("piece") == F.col("__item"))).select("file_id", "cx", "cy", "n", F.col("up").alias("piece"))
        if width >= widest:
            return placed
        # a dense cell is a piece of its own already, so it is merged with nothing further up
        items = packed.groupBy("file_id", F.col("up").alias("item")).agg(*[F.min(c).alias(c) for c in ("cx", "cy", "x_lo", "y_lo", "x0", "y0", "wide")], *[F.max(c).alias(c) for c in ("x_hi", "y_hi")], F.sum("n").alias("n"))
        width, level = width * GROWTH, level + 1


def split_oversized(points: DataFrame, limit: int = 1000, margin: float = 1.0, min_gap: float = 3.0) -> DataFrame:
    """file_id, piece_id, point_id, is_margin: the pieces of every file, points shared as margin included.

    Each distinct valid point is the core of exactly one piece and a margin point of every
    other piece of its file whose bounding box it is at most ``margin`` away from. No core has
    more than ``limit`` points. A file within the limit is one piece, '0'. Rows with a null
    file or without usable coordinates are in no piece; repeated rows count once; an empty
    table gives an empty result; other columns play no part.
    """
    require(points, "file_id", "point_id", "x", "y", "z")
    if limit < 1 or margin < 0 or min_gap <= 0:
        raise ValueError("limit >= 1, margin >= 0 and min_gap > 0")
    cell = min_gap / 2
    pts = valid_points(points, "file_id").where(F.col("file_id").isNotNull()).select("file_id", "point_id", "x", "y")
    big = cut(oversized(cells(pts, cell), limit))
    own = cut(cell_pieces(big, profile(big, min_gap), limit, min_gap).withColumnRenamed("n", "n_cell"))
    at = lambda c: F.floor(F.col(c) / F.lit(cell)).alias(f"c{c}")
    placed = cut(pts.select("*", at("x"), at("y")).join(own, ["file_id", "cx", "cy"], "left"))
    dense = placed.where(F.col("n_cell") > limit)
    core = placed.where(F.coalesce(F.col("n_cell") <= limit, F.lit(True))).select("file_id", "point_id", "x", "y", "cx", "cy", F.coalesce("piece", F.lit("0")).alias("piece_id"))
    core = core.unionByName(_cut_dense(dense, limit, cell))
    rows = core.select("file_id", "piece_id", "point_id", F.lit(False).alias("is_margin"))
    if margin == 0:
        return rows
    shared = core.where(F.col("piece_id") != "0")
    extremes = [f(c).alias(f"{k}_{c}") for c in "xy" for k, f in (("lo", F.min), ("hi", F.max))]
    parts = cut(shared.groupBy("file_id", "piece_id", "cx", "cy").agg(*extremes))
    box = parts.groupBy("file_id", "piece_id").agg(*[f(f"{k}_{c}").alias(f"o{k}_{c}") for c in "xy" for k, f in (("lo", F.min), ("hi", F.max))])
    line = lambda c: F.explode(F.sequence(F.floor((F.col(f"olo_{c}") - margin) / cell), F.floor((F.col(f"ohi_{c}") + margin) / cell)))
    reach = box.withColumn("cx", line("x")).withColumn("cy", line("y")).withColumnRenamed("piece_id", "other")
    # cells first: only those that another piece's margin touches send their points
    gap = lambda c, lo, hi: F.greatest(F.lit(0.0), F.col(f"olo_{c}") - F.col(hi), F.col(lo) - F.col(f"ohi_{c}"))
    within = lambda x, y: x * x + y * y <= margin * margin
    met = parts.join(reach, ["file_id", "cx", "cy"]).where(F.col("piece_id") != F.col("other")).where(within(gap("x", "lo_x", "hi_x"), gap("y", "lo_y", "hi_y")))
    met = met.select("file_id", "piece_id", "cx", "cy", "other", *[f"o{k}_{c}" for c in "xy" for k in ("lo", "hi")])
    near = shared.join(met, ["file_id", "piece_id", "cx", "cy"]).where(within(gap("x", "x", "x"), gap("y", "y", "y")))
    return rows.unionByName(near.select("file_id", F.col("other").alias("piece_id"), "point_id", F.lit(True).alias("is_margin")))


def _cut_dense(dense: DataFrame, limit: int, cell: float) -> DataFrame:
    """Cells above the limit, cut along a fine grid.

    Parts of the grid within the limit follow each other and are cut by ranks. A part that alone
    exceeds it (a place that very many points share) is dealt to its own pieces by a hash of the
    point's id, about three quarters full; no window then holds more than such a piece.
    """
    part: Column = F.least(F.lit(FINE - 1), F.floor((F.col("x") / cell - F.col("cx")) * FINE)) * FINE + F.least(F.lit(FINE - 1), F.floor((F.col("y") / cell - F.col("cy")) * FINE))
    key = ["file_id", "cx", "cy"]
    rows = dense.select(*key, "point_id", "x", "y", "piece", part.alias("fine"))
    counts = rows.groupBy(*key, "fine").agg(F.count(F.lit(1)).alias("c"))
    small = F.when(F.col("c") <= limit, F.col("c")).otherwise(0)
    before = F.coalesce(F.sum(small).over(W.partitionBy(*key).orderBy("fine").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    dealt = F.when(F.col("c") > limit, F.ceil(4 * F.col("c") / (3 * limit))).otherwise(1)
    rows = rows.join(counts.select(*key, "fine", "c", before.alias("before"), dealt.alias("dealt")), [*key, "fine"])
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("point_id"), F.col("dealt")))
    within = F.row_number().over(W.partitionBy(*key, "fine", "deal").orderBy("x", "y", "point_id")) - 1
    rows = rows.withColumn("within", within)
    row = F.floor((F.col("before") + F.col("within")) / limit)
    name = F.when(F.col("c") <= limit, F.concat_ws("_", "piece", row)).otherwise(F.concat_ws("_", "piece", F.lit("at"), "fine", "deal", F.floor(F.col("within") / limit)))
    return rows.select("file_id", "point_id", "x", "y", "cx", "cy", name.alias("piece_id"))


def piece_table(members: DataFrame) -> DataFrame:
    """file_id, piece_id, n_core, n_margin."""
    return members.groupBy("file_id", "piece_id").agg(F.count_if(~F.col("is_margin")).alias("n_core"), F.count_if(F.col("is_margin")).alias("n_margin"))


def found_strips(points: DataFrame, limit: int = 1000, min_gap: float = 3.0) -> DataFrame:
    """What parts the first siblings of the trees of the files above the limit: their empty strips."""
    pts = valid_points(points, "file_id").where(F.col("file_id").isNotNull()).select("file_id", "point_id", "x", "y")
    return strips(siblings(profile(oversized(cells(pts, min_gap / 2), limit), min_gap)))
