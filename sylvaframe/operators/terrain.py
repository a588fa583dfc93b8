"""Heights above a terrain model whose nodes are made where the points are.

The nodes outnumber the points, and each takes hundreds of ground points: neither nodes nor
lists are ever rows. Points go to the leaf of a quadtree that owns their voxel, together with the
cloth's heights, and stay there as one packed block. A leaf asks its neighbours for the ground
points that its nodes can need: for a tile of points with the k-th ground point at distance d from
its centre and all nodes within e of it, that is what lies within d + 2 e of the centre. Of those
a visited leaf sends only what its own k nearest leave in question, so far-off tiles stay cheap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.operators.near import QuadTree, root_of, sampled_tree
from sylvaframe.operators.nearest import _bounded, _tiles
from sylvaframe.schema import finite
from sylvaframe.session import cut, pack, sweep, unpack

POINT, CELL = 0, 1
POINTS, GROUND, TILE, LEAF, VISIT = range(5)
#: nodes that are searched together; a leaf's points are parted into about so many tiles for its requests
BLOCK, PARTS = 48, 128


def idw_levels(nodes: np.ndarray, ground: np.ndarray, z: np.ndarray, ids: np.ndarray, k: int, power: float) -> np.ndarray:
    """Inverse-distance mean of the z of each node's k nearest ground points, ties by id; exact.

    Ground points at the node itself hold alone. NaN without ground points.
    """
    out = np.full(len(nodes), np.nan)
    if not len(ground):
        return out
    order = np.argsort(ids, kind="stable")
    gx, gy, z = ground[order, 0], ground[order, 1], z[order]
    for own in _tiles(nodes, BLOCK):
        q = nodes[own]
        cx, cy = (q.max(0) + q.min(0)) / 2
        d2 = (gx - cx) ** 2 + (gy - cy) ** 2
        pick = slice(None)
        if len(d2) > k:
            e = np.sqrt(((q - (cx, cy)) ** 2).sum(1).max())
            pick = np.flatnonzero(d2 <= ((np.sqrt(np.partition(d2, k - 1)[k - 1]) + 2 * e) * 1.000001) ** 2)
        d = (q[:, None, 0] - gx[None, pick]) ** 2
        d += (q[:, None, 1] - gy[None, pick]) ** 2
        near = np.ones(d.shape, bool)
        if d.shape[1] > k:
            kth = np.partition(d, k - 1, axis=1)[:, k - 1]
            near = d <= kth[:, None]
            for i in np.flatnonzero(near.sum(1) > k):  # of equal distances the smallest ids
                tied = np.flatnonzero(d[i] == kth[i])
                near[i, tied[k - int((d[i] < kth[i]).sum()) :]] = False
        exact = near & (d == 0)
        here = exact.any(1)
        with np.errstate(divide="ignore"):
            w = np.where(near, 1 / np.sqrt(d) if power == 1 else d ** (-power / 2), 0.0)
        w[here] = exact[here]
        out[own] = (w * z[None, pick]).sum(1) / w.sum(1)
    return out


def node_heights(xyz: np.ndarray, size: float, ground: np.ndarray, z: np.ndarray, ids: np.ndarray, k: int, power: float) -> np.ndarray:
    """z less the terrain between the four nodes of each point's cell, as ``raster.height_above_terrain`` has it."""
    pos = xyz[:, :2] / size
    low = np.floor(pos).astype(np.int64)
    step = np.array([[0, 0], [0, 1], [1, 0], [1, 1]])
    nodes, at = np.unique((low[:, None] + step[None]).reshape(-1, 2), axis=0, return_inverse=True)
    level = idw_levels(nodes * size, ground, z, ids, k, power)
    level[~(np.abs(level) <= 1000)] = np.nan
    h = level[at.reshape(-1, 4)]
    u, v = (pos - low).T
    w = np.stack([(1 - u) * (1 - v), (1 - u) * v, u * (1 - v), u * v], 1)
    w = np.where(np.isnan(h), 0.0, w)
    with np.errstate(invalid="ignore", divide="ignore"):
        return xyz[:, 2] - (w * np.nan_to_num(h)).sum(1) / w.sum(1)


def _one_per_voxel(g: np.ndarray, xyz: np.ndarray, ids: np.ndarray, size: float) -> np.ndarray:
    """Rows nearest to the centre of their voxel, ties by id, as ``groups.voxel_downsample`` has it."""
    v = np.floor(xyz / size)
    off = (xyz - (v + 0.5) * size) ** 2
    off = off[:, 0] + off[:, 1] + off[:, 2]
    order = np.lexsort((ids, off, v[:, 2], v[:, 1], v[:, 0], g))
    key = np.c_[v[order], root_key(g[order])]
    return order[np.r_[True, (key[1:] != key[:-1]).any(1)]] if len(order) else order


def root_key(g: np.ndarray) -> np.ndarray:
    """Dense numbers of the groups, exact as doubles."""
    return np.unique(g, return_inverse=True)[1].ravel()


def _columns(table: pa.Table, *names: str) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in names], 1)


def terrain_heights(points: DataFrame, cloth: DataFrame, *, resolution: float, threshold: float, voxel: float, node: float, k: int, power: float = 1.0, group: str = "cloud_id", target: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(points with ``terrain`` and ``h``, ground points: group, point_id, x, y, z).

    cloth: group, ix, iy, ground of raster cells of width ``resolution``. Points within ``threshold``
    of their cell's ground have terrain 0, others 1; those without finite coordinates or without a
    cell are left out. One ground point per ``voxel`` is kept; h is the height above the model of
    nodes every ``node``, each from its k nearest ground points of the group.
    """
    spark = points.sparkSession
    kinds = dict(points.dtypes)
    ok = F.col(group).isNotNull() & finite("x") & finite("y") & finite("z")
    rows = points.where(ok).select(F.xxhash64(group).alias("g"), *[F.col(c).cast("double").alias(c) if c in ("x", "y", "z") else F.col(c) for c in points.columns])
    corner = lambda c: F.floor(F.col(c) / voxel) * F.lit(voxel)
    tree, n_rows = sampled_tree(rows.select("g", F.col("point_id").alias("id"), corner("x").alias("c0"), corner("y").alias("c1")), target=target, least_edge=voxel)
    shared = spark.sparkContext.broadcast(tree)
    names = [c for c in points.columns if c not in ("x", "y", "z")]
    typed = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    row_schema = f"leaf bigint, kind tinyint, g bigint, x double, y double, z double, {typed}"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            x, y = (np.floor(b.column(c).to_numpy() / voxel) * voxel for c in "xy")
            leaf = t.leaf(x, y, root_of(b.column("g").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(np.full(len(leaf), POINT), pa.int8()), *[b.column(c) for c in ("g", "x", "y", "z", *names)]], names=["leaf", "kind", "g", "x", "y", "z", *names])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            lo = [b.column(c).to_numpy() * resolution for c in ("x", "y")]
            box = [v + s for v in lo for s in (-1.001 * voxel - 1e-9 * np.abs(v), resolution + 1e-9 * np.abs(v))]
            row, leaf = t.touched(*box, root_of(b.column("g").to_numpy()))
            b = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(np.full(len(leaf), CELL), pa.int8()), *[b.column(c) for c in ("g", "x", "y", "z")]], names=["leaf", "kind", "g", "x", "y", "z"])

    cells = cloth.select(F.xxhash64(group).alias("g"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), F.col("ground").alias("z"))
    cells = cells.mapInArrow(spread, "leaf bigint, kind tinyint, g bigint, x double, y double, z double")
    placed = rows.select("g", "x", "y", "z", *names).mapInArrow(place, row_schema).unionByName(cells, allowMissingColumns=True)
    block_schema = "leaf bigint, kind tinyint, query_id bigint, g bigint, n bigint, c0 double, c1 double, reach double, bound double, lo0 double, hi0 double, lo1 double, hi1 double, block binary"
    kind_of = {f.split()[0]: {"bigint": pa.int64(), "tinyint": pa.int8(), "double": pa.float64(), "binary": pa.binary()}[f.split()[1]] for f in block_schema.split(", ")}
    arrow = pa.schema(list(kind_of.items()))

    def block(table: pa.Table) -> pa.Table:
        t: QuadTree = shared.value
        leaf = table["leaf"][0].as_py()
        kind = table["kind"].to_numpy()
        if not (kind == POINT).any():
            return arrow.empty_table()
        cell, own = table.take(pa.array(np.flatnonzero(kind == CELL))), table.take(pa.array(np.flatnonzero(kind == POINT)))
        own = own.sort_by("point_id")
        xyz, g = _columns(own, "x", "y", "z"), own["g"].to_numpy()
        at = np.floor(xyz[:, :2] / resolution)
        ground = pd.DataFrame({"g": cell["g"].to_numpy(), "ix": cell["x"].to_numpy(), "iy": cell["y"].to_numpy(), "ground": cell["z"].to_numpy(zero_copy_only=False)})
        known = pd.DataFrame({"g": g, "ix": at[:, 0], "iy": at[:, 1], "row": np.arange(len(g))}).merge(ground, on=["g", "ix", "iy"]).sort_values("row")
        keep = known["row"].to_numpy()
        if not len(keep):
            return arrow.empty_table()
        own, xyz, g = own.take(pa.array(keep)), xyz[keep], g[keep]
        terrain = np.where(np.abs(xyz[:, 2] - known["ground"].to_numpy()) <= threshold, 0, 1)
        ids = own["point_id"].to_numpy()
        low = np.flatnonzero(terrain == 0)
        low = low[_one_per_voxel(g[low], xyz[low], ids[low], voxel)]
        out = [{"kind": POINTS, "block": pack(own.drop_columns(["leaf", "kind"]).append_column("terrain", pa.array(terrain, pa.int32())))}]
        if len(low):
            out.append({"kind": GROUND, "block": pack(own.take(pa.array(low)).select(["g", "point_id", "x", "y", "z", group]))})
        square = [float(v[0]) for v in t.squares(np.array([leaf]))]
        square = [square[0] + voxel, square[1], square[2] + voxel, square[3]]  # points go by their voxel's corner
        for one in np.unique(g):
            here, base = xyz[g == one, :2], xyz[low][g[low] == one, :2]
            if len(base):
                lo, hi = base.min(0), base.max(0)
                out.append({"kind": LEAF, "g": one, "n": len(base), "lo0": lo[0], "hi0": hi[0], "lo1": lo[1], "hi1": hi[1]})
            for i, part in enumerate(_tiles(here, max(64, len(here) // PARTS))):
                lo, hi = here[part].min(0) - 1.001 * node, here[part].max(0) + 1.001 * node
                (cx, cy), e = (lo + hi) / 2, np.sqrt(((hi - lo) ** 2).sum()) / 2
                d2 = (base[:, 0] - cx) ** 2 + (base[:, 1] - cy) ** 2
                bound = np.partition(d2, k - 1)[k - 1] if len(d2) >= k else np.inf
                r = np.sqrt(bound) + e
                if lo[0] - r > square[0] and hi[0] + r < square[1] and lo[1] - r > square[2] and hi[1] + r < square[3]:
                    continue
                if not np.isinf(square).all():
                    out.append({"kind": TILE, "query_id": i, "g": one, "c0": cx, "c1": cy, "reach": e, "bound": bound})
        return pa.table({c: pa.array([r.get(c) if c != "leaf" else leaf for r in out], t) for c, t in kind_of.items()})

    blocks = cut(placed.groupBy("leaf").applyInArrow(block, block_schema))
    sweep(spark)
    leaves = blocks.where(F.col("kind") == LEAF).select("g", "leaf", "n", "lo0", "hi0", "lo1", "hi1")
    tiles = blocks.where(F.col("kind") == TILE).select(F.xxhash64("leaf", "g", "query_id").alias("query_id"), F.col("leaf").alias("home"), "g", "c0", "c1", "reach", "bound")
    lacking = tiles.where(F.col("bound") == float("inf"))
    bounded = _bounded(lacking, leaves, shared, 2, k).select("query_id", F.col("bound").alias("b"))
    tiles = tiles.join(bounded, "query_id", "left").withColumn("bound", F.coalesce("b", "bound")).where(F.col("bound") < float("inf")).drop("b")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                x, y, g, e, bound = (part.column(c).to_numpy() for c in ("c0", "c1", "g", "reach", "bound"))
                r = (np.sqrt(bound) + 2 * e) * 1.000001 + voxel
                row, leaf = t.touched(x - r, x + r, y - r, y + r, root_of(g))
                part = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *[part.column(c) for c in ("home", "g", "c0", "c1", "reach", "bound")]], names=["leaf", "home", "g", "c0", "c1", "reach", "bound"])

    visits = tiles.mapInArrow(visit, "leaf bigint, home bigint, g bigint, c0 double, c1 double, reach double, bound double").where("leaf <> home")
    met = visits.join(leaves.select("leaf", "g", "lo0", "hi0", "lo1", "hi1"), ["leaf", "g"])
    gap = [F.greatest(F.lit(0.0), F.col(f"lo{j}") - F.col(f"c{j}"), F.col(f"c{j}") - F.col(f"hi{j}")) for j in (0, 1)]
    met = met.where(F.hypot(*gap) <= (F.sqrt("bound") + 2 * F.col("reach")) * 1.000001)
    met = met.select("leaf", F.lit(VISIT).cast("tinyint").alias("kind"), "home", "g", "c0", "c1", "reach", "bound")
    ground = blocks.where(F.col("kind") == GROUND)

    def answer(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        asked = table.take(pa.array(np.flatnonzero(kind == VISIT))).to_pandas()
        out: dict[int, np.ndarray] = {}
        if len(asked):
            own = unpack(table["block"][int(np.flatnonzero(kind == GROUND)[0])].as_py())
            g, xy = own["g"].to_numpy(), _columns(own, "x", "y")
            for one, part in asked.groupby("g"):
                here = np.flatnonzero(g == one)
                for home, cx, cy, e, bound in part[["home", "c0", "c1", "reach", "bound"]].itertuples(index=False):
                    d2 = (xy[here, 0] - cx) ** 2 + (xy[here, 1] - cy) ** 2
                    if len(d2) > k:
                        bound = min(bound, np.partition(d2, k - 1)[k - 1])
                    out.setdefault(home, np.zeros(len(g), bool))[here] |= d2 <= ((np.sqrt(bound) + 2 * e) * 1.000001) ** 2
        found = {home: pack(own.select(["g", "point_id", "x", "y", "z"]).take(pa.array(np.flatnonzero(m)))) for home, m in out.items() if m.any()}
        return pa.table({"leaf": pa.array(list(found), pa.int64()), "block": pa.array(list(found.values()), pa.binary())})

    asked = ground.select("leaf", "kind", "block").unionByName(met, allowMissingColumns=True)
    sent = asked.groupBy("leaf").applyInArrow(answer, "leaf bigint, block binary").withColumn("kind", F.lit(VISIT).cast("tinyint"))
    whole = blocks.where(F.col("kind").isin(POINTS, GROUND)).select("leaf", "kind", "block").unionByName(sent)

    def finish(table: pa.Table) -> pa.Table:
        kind, block = table["kind"].to_numpy(), table["block"]
        parts = {c: [unpack(block[int(i)].as_py()) for i in np.flatnonzero(kind == c)] for c in (POINTS, GROUND, VISIT)}
        base = [p.select(["g", "point_id", "x", "y", "z"]) for p in parts[GROUND] + parts[VISIT]]
        own = parts[POINTS][0]  # a leaf that sends or is sent ground points has points
        xyz, g, h = _columns(own, "x", "y", "z"), own["g"].to_numpy(), np.full(own.num_rows, np.nan)
        if base:
            low = pa.concat_tables(base)
            low_xyz, low_g, ids = _columns(low, "x", "y", "z"), low["g"].to_numpy(), low["point_id"].to_numpy()
            for one in np.unique(g):
                mine, its = g == one, low_g == one
                h[mine] = node_heights(xyz[mine], node, low_xyz[its, :2], low_xyz[its, 2], ids[its], k, power)
        own = own.append_column("h", pa.array(h, mask=np.isnan(h)))
        return pa.table({"leaf": pa.array([table["leaf"][0].as_py()], pa.int64()), "block": pa.array([pack(own)], pa.binary())})

    done = cut(whole.groupBy("leaf").applyInArrow(finish, "leaf bigint, block binary"))
    to = [*points.columns, "terrain", "h"]

    def rows_of(*columns: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for one in b.column("block"):
                    yield from unpack(one.as_py()).select(list(columns)).combine_chunks().to_batches()

        return run

    final = ", ".join(f"`{c}` {'double' if c in ('x', 'y', 'z') else kinds[c]}" for c in points.columns)
    high = done.select("block").mapInArrow(rows_of(*to), f"{final}, terrain int, h double")
    low = [group, "point_id", "x", "y", "z"]
    return high, ground.select("block").mapInArrow(rows_of(*low), f"`{group}` {kinds[group]}, point_id {kinds['point_id']}, x double, y double, z double")
