"""k nearest neighbours on a quadtree, and what is built on them.

A sample of queries and points shapes a quadtree; both go to the leaf that owns them. In a leaf
the points are parted into small tiles; a tile of queries meets the tiles nearest to it, then
those whose boxes lie nearer than the k-th hit, so far tiles are never looked at. A query whose
k-th hit is nearer than its leaf's edge is done. For the others the distance of the k-th hit
bounds a second search: they visit exactly the leaves whose points' boxes lie within it. A query
with fewer than k points in its leaf takes its bound from the smallest enclosing square that
holds k points of its group; a far-off query therefore visits few leaves and widens none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaframe.operators.near import QuadTree, root_of, sampled_tree
from sylvaframe.session import cut

TILE = 48
POINT, QUERY, BOTH, VISIT = 0, 1, 2, 3


def _tiles(p: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in tiles of ``size`` at most: halves along the widest side."""
    todo, out = [np.arange(len(p))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            if len(at):
                out.append(at)
            continue
        v = p[at]
        v = v[:, int(np.argmax(v.max(0) - v.min(0)))]
        half = np.argpartition(v, len(at) // 2)
        todo += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
    return out


def search(q: np.ndarray, q_ids: np.ndarray, limit2: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of p, squared distance), k or fewer per query in order of distance and id; exact.

    Points further away than ``limit2`` (squared, per query) don't count.
    """
    if not len(q) or not len(p):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    tiles = _tiles(p, TILE)
    at = np.concatenate(tiles)
    size = np.array([len(t) for t in tiles])
    first = np.r_[0, np.cumsum(size)]
    pt, pid = p[at], p_ids[at]
    lo, hi = np.minimum.reduceat(pt, first[:-1]), np.maximum.reduceat(pt, first[:-1])
    want = k + exclude_self
    rows, cols, dist = [], [], []
    for own in _tiles(q, TILE):
        part, limit = q[own], limit2[own]
        gap = np.maximum(0.0, np.maximum(lo - part.max(0), part.min(0) - hi))
        gap2 = (gap * gap).sum(1) * 0.999999
        order = np.argsort(gap2, kind="stable")
        m = min(len(order), int(np.searchsorted(np.cumsum(size[order]), want)) + 2)
        some, kth = order[:m], limit
        pick = np.concatenate([np.arange(first[t], first[t + 1]) for t in some.tolist()])
        d = _distances(part, pt[pick], q_ids[own], pid[pick], exclude_self)
        if d.shape[1] >= k:
            kth = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
        more = order[m:][gap2[order[m:]] <= kth.max()]
        if len(more):
            extra = np.concatenate([np.arange(first[t], first[t + 1]) for t in more.tolist()])
            d = np.concatenate([d, _distances(part, pt[extra], q_ids[own], pid[extra], exclude_self)], 1)
            pick = np.r_[pick, extra]
            if d.shape[1] >= k:
                kth = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero((d <= kth[:, None]) & (d < np.inf))
        near = d[row, col]
        order = np.lexsort((pid[pick[col]], near, row))
        row, col, near = row[order], col[order], near[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        rows.append(own[row[keep]])
        cols.append(at[pick[col[keep]]])
        dist.append(near[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def _distances(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, exclude_self: bool) -> np.ndarray:
    out = (a[:, None, 0] - b[None, :, 0]) ** 2
    for j in range(1, a.shape[1]):
        out += (a[:, None, j] - b[None, :, j]) ** 2
    if exclude_self:
        out[a_ids[:, None] == b_ids[None, :]] = np.inf
    return out


HITS = "ids array<bigint>, d2s array<double>, vs array<double>"
#: (row of each hit, ascending; number of rows; squared distances; carried values) -> a number per row
Reduce = Callable[[np.ndarray, int, np.ndarray, np.ndarray], np.ndarray]


def distance_sum(row: np.ndarray, n: int, d2: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.bincount(row, np.sqrt(d2), minlength=n)


def inverse_distance_mean(power: float) -> Reduce:
    """Mean of the carried values weighted by distance^-power; hits at distance 0 alone hold where there are any."""

    def run(row: np.ndarray, n: int, d2: np.ndarray, v: np.ndarray) -> np.ndarray:
        exact = d2 == 0
        w = np.where(exact, 0.0, np.where(exact, 1.0, d2) ** (-power / 2))
        here = np.bincount(row[exact], minlength=n)
        w = np.where(here[row] > 0, exact, w)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.bincount(row, w * v, minlength=n) / np.bincount(row, w, minlength=n)

    return run


def _ragged(n: int, row: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Lists of n rows from values whose row numbers ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def nearest_lists(queries: DataFrame, points: DataFrame | None, k: int, *, dims: tuple[str, ...] = ("x", "y"), group: str = "cloud_id", query_id: str = "query_id", point_id: str = "point_id", exclude_self: bool = False, radius: float | None = None, target: int = 20_000, carry: str | None = None, reduce: Reduce | None = None) -> DataFrame:
    """query_id and its k nearest points of the same group as lists ``ids`` and ``d2s``, ties by id.

    Without ``points`` the queries are the points, too, and are shipped once. Queries of a group
    with fewer than k points get all of them, those of a group without points an empty list. With
    ``radius`` only points at most that far away count. dims beyond the first two count in the
    distance only. Ids are unique within all groups; rows with null, NaN or infinite coordinates
    have no part. What the driver sees is a bounded sample. With ``reduce`` the lists give way to
    their length ``n`` and the number ``total`` that it makes of them, where the hits are found;
    ``carry`` names a column of the points that it needs.
    """
    spark = queries.sparkSession
    nd = len(dims)
    coords = [f"c{j}" for j in range(nd)]

    def pick(df: DataFrame, i: str, role: int) -> DataFrame:
        ok = F.col(i).isNotNull() & F.col(group).isNotNull()
        for c in dims:
            ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
        v = F.col(carry).cast("double") if carry is not None and role != QUERY else F.lit(0.0)
        return df.where(ok).select(F.xxhash64(group).alias("g"), F.col(i).cast("bigint").alias("id"), F.lit(role).cast("tinyint").alias("role"), *[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(dims)], v.alias("v"))

    rows = pick(queries, query_id, BOTH if points is None else QUERY)
    if points is not None:
        rows = rows.unionByName(pick(points, point_id, POINT))
    rows = cut(rows)
    tree, n_rows = sampled_tree(rows, target=target, least_edge=1e-6)
    schema = f"query_id bigint, {HITS}"
    reduced = "query_id bigint, n bigint, total double"
    if not n_rows:
        return spark.createDataFrame([], reduced if reduce else schema).drop("vs")
    shared = spark.sparkContext.broadcast(tree)
    most2 = np.inf if radius is None else float(radius) * float(radius)
    shipped = [*coords, "v"]
    row_schema = "leaf bigint, g bigint, id bigint, role tinyint, bound double, " + ", ".join(f"{c} double" for c in shipped)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            leaf = t.leaf(b.column("c0").to_numpy(), b.column("c1").to_numpy(), root_of(b.column("g").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column("g"), b.column("id"), b.column("role"), pa.array(np.full(len(leaf), most2)), *[b.column(c) for c in shipped]], names=["leaf", "g", "id", "role", "bound", *shipped])

    def answered(table: pa.Table) -> Iterator[tuple]:
        """Per group of a leaf: (rows of its queries, their hits) of what ``search`` finds."""
        g, ids, role, bound, v = (table[c].to_numpy() for c in ("g", "id", "role", "bound", "v"))
        xyz = np.stack([table[c].to_numpy() for c in coords], 1)
        for own in np.unique(g):
            here = np.flatnonzero(g == own)
            p, q = here[(role[here] == POINT) | (role[here] == BOTH)], here[role[here] != POINT]
            if len(q):
                row, col, d2 = search(xyz[q], ids[q], bound[q], xyz[p], ids[p], k, exclude_self)
                order = np.argsort(row, kind="stable")
                yield q, row[order], ids[p][col[order]], d2[order], v[p][col[order]]

    first_schema = f"query_id bigint, is_open boolean, g bigint, bound double, {', '.join(f'{c} double' for c in coords)}, n bigint, total double, {HITS}"

    def first(table: pa.Table) -> pa.Table:
        t: QuadTree = shared.value
        parts = []
        for q, row, hit, d2, v in answered(table):
            n = np.bincount(row, minlength=len(q))
            bound = np.full(len(q), most2)
            full = n >= k
            bound[full] = d2[np.cumsum(n)[full] - 1]
            own = table.take(pa.array(q))
            x, y = own["c0"].to_numpy(), own["c1"].to_numpy()
            square = t.squares(own["leaf"].to_numpy())
            edge = np.minimum(np.minimum(x - square[0], square[1] - x), np.minimum(y - square[2], square[3] - y)) * 0.999999
            is_open = ~((edge > 0) & (edge * edge > bound))
            is_open &= ~np.isposinf(edge)  # the leaf is all there is
            total = (reduce(row, len(q), d2, v) if reduce else np.zeros(len(q))).astype(float)  # no hits at all give integers
            if reduce or is_open.any():  # lists nobody reads: open queries search anew
                keep = np.zeros(len(row), bool) if reduce else ~is_open[row]
                row, hit, d2, v = row[keep], hit[keep], d2[keep], v[keep]
            parts.append(pa.table({"query_id": own["id"], "is_open": pa.array(is_open), "g": own["g"], "bound": pa.array(bound), **{c: own[c] for c in coords}, "n": pa.array(n), "total": pa.array(total), "ids": _ragged(len(q), row, hit, pa.int64()), "d2s": _ragged(len(q), row, d2, pa.float64()), "vs": _ragged(len(q), row, v, pa.float64())}))
        return pa.concat_tables(parts) if parts else pa.Table.from_pylist([], schema=_arrow(first_schema))

    placed = rows.mapInArrow(place, row_schema)
    near = cut(placed.groupBy("leaf").applyInArrow(first, first_schema))
    done = near.where(~F.col("is_open")).select("query_id", *(("n", "total") if reduce else ("ids", "d2s")))
    open_ = near.where("is_open").select("query_id", "g", "bound", *coords)
    if open_.isEmpty():
        return done
    # where the group's points are: a box per leaf, and the squares above it for queries without a bound
    box = [f(c).alias(f"{n}{j}") for j, c in enumerate(coords) for n, f in (("lo", F.min), ("hi", F.max))]
    leaves = cut(placed.where(F.col("role") != QUERY).groupBy("g", "leaf").agg(F.count(F.lit(1)).alias("n"), *box))
    bounded = open_
    if radius is None:
        lacking = open_.where(F.col("bound") == float("inf"))
        bounded = open_.where(F.col("bound") != float("inf")).unionByName(_bounded(lacking, leaves, shared, nd, k + exclude_self))
    visits = bounded.select("query_id", "g", "bound", *coords).mapInArrow(_visits(shared, nd), row_schema.removesuffix(", v double"))
    there = leaves.select(F.col("g").alias("lg"), F.col("leaf").alias("ll"), *[f"{e}{j}" for j in range(nd) for e in ("lo", "hi")])
    gap2 = _gap2(nd)
    visits = visits.join(there, (F.col("g") == F.col("lg")) & (F.col("leaf") == F.col("ll"))).where(gap2 * 0.999999 <= F.col("bound"))
    visits = cut(visits.select("leaf", "g", "id", "role", "bound", *coords, F.lit(0.0).alias("v")))
    needed = placed.where(F.col("role") != QUERY).withColumn("role", F.lit(POINT).cast("tinyint")).join(visits.select("leaf").distinct(), "leaf", "left_semi")

    def second(table: pa.Table) -> pa.Table:
        parts = []
        for q, row, hit, d2, v in answered(table):
            parts.append(pa.table({"query_id": table["id"].take(pa.array(q)), "ids": _ragged(len(q), row, hit, pa.int64()), "d2s": _ragged(len(q), row, d2, pa.float64()), "vs": _ragged(len(q), row, v, pa.float64())}))
        return pa.concat_tables(parts) if parts else pa.Table.from_pylist([], schema=_arrow(schema))

    again = needed.select("leaf", "g", "id", "role", "bound", *shipped).unionByName(visits).groupBy("leaf").applyInArrow(second, schema)
    # the own leaf is among those visited; a query that visits none has no points at all
    hits = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("d2s").alias("d2"), F.col("ids").alias("id"), F.col("vs").alias("v")))))
    merged = again.groupBy("query_id").agg(F.slice(hits, 1, k).alias("h"))
    merged = open_.select("query_id").join(merged, "query_id", "left")
    merged = merged.select("query_id", *[F.coalesce(F.transform("h", lambda h: h[f]), F.array().cast(f"array<{t}>")).alias(n) for f, t, n in (("id", "bigint", "ids"), ("d2", "double", "d2s"), ("v", "double", "vs"))])
    if not reduce:
        return done.unionByName(merged.drop("vs"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("d2s").value_lengths().to_numpy()
            row = np.repeat(np.arange(b.num_rows), size)
            d2, v = (b.column(c).flatten().to_numpy() for c in ("d2s", "vs"))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array(size, pa.int64()), pa.array(reduce(row, b.num_rows, d2, v).astype(float))], names=["query_id", "n", "total"])

    return done.unionByName(merged.mapInArrow(number, reduced))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def _gap2(nd: int) -> Column:
    """Squared distance of the query to the box of a leaf's points."""
    total = F.lit(0.0)
    for j in range(nd):
        gap = F.greatest(F.lit(0.0), F.col(f"lo{j}") - F.col(f"c{j}"), F.col(f"c{j}") - F.col(f"hi{j}"))
        total = total + gap * gap
    return total


def _visits(shared, nd: int):
    """Each open query once for every leaf that the square around its ball meets."""
    coords = [f"c{j}" for j in range(nd)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                x, y, g = (part.column(c).to_numpy() for c in ("c0", "c1", "g"))
                r = np.sqrt(part.column("bound").to_numpy()) * 1.000001
                row, leaf = t.touched(x - r, x + r, y - r, y + r, root_of(g))
                part = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), part.column("g"), part.column("query_id"), pa.array(np.full(len(row), VISIT), pa.int8()), part.column("bound"), *[part.column(c) for c in coords]], names=["leaf", "g", "id", "role", "bound", *coords])

    return run


def _bounded(lacking: DataFrame, leaves: DataFrame, shared, nd: int, want: int) -> DataFrame:
    """Open queries with too few points in their leaf, bounded by the smallest square above that has enough.

    The bound is the distance to the far corner of the box of that square's points; where even the
    whole group has too few, the whole group's box bounds them.
    """
    tree: QuadTree = shared.value
    levels = list(range(0, tree.depth + 1))
    up = F.explode(F.array(*[F.lit(v) for v in levels])).alias("level")
    edges = [f"{e}{j}" for j in range(nd) for e in ("lo", "hi")]
    squares = leaves.select("g", "n", *edges, "leaf", up).withColumn("square", F.expr("shiftright(leaf, 2 * level)"))
    squares = squares.groupBy("g", "level", "square").agg(F.sum("n").alias("n"), *[(F.min if e.startswith("lo") else F.max)(e).alias(e) for e in edges])
    squares = squares.where((F.col("n") >= want) | (F.col("level") == tree.depth)).withColumnsRenamed({"g": "sg", "level": "sl"})

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            own = t.codes(b.column("c0").to_numpy(), b.column("c1").to_numpy(), root_of(b.column("g").to_numpy())).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("g"), *[b.column(f"c{j}") for j in range(nd)], pa.array(own)], names=["query_id", "g", *[f"c{j}" for j in range(nd)], "code"])

    coords = [f"c{j}" for j in range(nd)]
    coded = lacking.select("query_id", "g", *coords).mapInArrow(code, f"query_id bigint, g bigint, {', '.join(f'{c} double' for c in coords)}, code bigint")
    tried = coded.select("*", up).withColumn("own", F.expr("shiftright(code, 2 * level)"))
    met = tried.join(squares, (F.col("g") == F.col("sg")) & (F.col("level") == F.col("sl")) & (F.col("own") == F.col("square")))
    far = F.lit(0.0)
    for j in range(nd):
        reach = F.greatest(F.abs(F.col(f"c{j}") - F.col(f"lo{j}")), F.abs(F.col(f"c{j}") - F.col(f"hi{j}")))
        far = far + reach * reach
    bound = met.groupBy("query_id").agg((F.min_by(far, "level") * 1.000001).alias("__bound"))
    return lacking.join(bound, "query_id").select("query_id", "g", F.col("__bound").alias("bound"), *coords)


def nearest(queries: DataFrame, points: DataFrame, k: int, *, dims: tuple[str, ...] = ("x", "y"), group: str = "cloud_id", query_id: str = "query_id", point_id: str = "point_id", exclude_self: bool = False, radius: float | None = None) -> DataFrame:
    """query_id, point_id, rank (1..k), d2: ``nearest_lists`` with a row per hit."""
    lists = nearest_lists(queries, points, k, dims=dims, group=group, query_id=query_id, point_id=point_id, exclude_self=exclude_self, radius=radius)
    rows = lists.select("query_id", F.posexplode(F.arrays_zip("ids", "d2s")).alias("at", "hit"))
    return rows.select("query_id", F.col("hit.ids").alias("point_id"), (F.col("at") + 1).alias("rank"), F.col("hit.d2s").alias("d2"))


def mutual_nearest(a: DataFrame, b: DataFrame, limit: float, *, group: str = "cloud_id") -> DataFrame:
    """a_id, b_id: each other's nearest and at most ``limit`` apart. Both need (id, x, y)."""
    left, right = a.withColumnRenamed("id", "query_id"), b.withColumnRenamed("id", "point_id")
    ab = nearest(left, right, 1, group=group).select(F.col("query_id").alias("a_id"), F.col("point_id").alias("b_id"), "d2")
    ba = nearest(right.withColumnRenamed("point_id", "query_id"), left.withColumnRenamed("query_id", "point_id"), 1, group=group)
    ba = ba.select(F.col("query_id").alias("b_id"), F.col("point_id").alias("a_id"))
    return ab.where(F.col("d2") <= limit * limit).join(ba, ["a_id", "b_id"]).select("a_id", "b_id")


def tree_positions(trunks: DataFrame, crowns: DataFrame, limit: float, *, group: str = "cloud_id") -> DataFrame:
    """Trunks, matched ones at their crown's place, and the crowns that match none."""
    match = cut(mutual_nearest(trunks, crowns, limit, group=group))
    place = crowns.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    t = trunks.join(match.withColumnRenamed("a_id", "id"), "id", "left").join(place, "b_id", "left")
    t = t.select(group, "id", F.lit("trunk").alias("kind"), F.coalesce("bx", "x").alias("x"), F.coalesce("by", "y").alias("y"))
    c = crowns.join(match.select(F.col("b_id").alias("id")), "id", "left_anti").select(group, "id", F.lit("crown").alias("kind"), "x", "y")
    return t.unionByName(c)


def mean_neighbour_distance(points: DataFrame, k: int, *, group: str = "cloud_id", dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """point_id and the mean distance to its k nearest others (null where there is none)."""
    near = nearest_lists(points, None, k, dims=dims, group=group, query_id="point_id", exclude_self=True, reduce=distance_sum)
    return near.select(F.col("query_id").alias("point_id"), F.try_divide("total", "n").alias("mean_distance"))


def remove_outliers(points: DataFrame, k: int, multiplier: float, *, group: str = "cloud_id") -> DataFrame:
    """Points whose mean neighbour distance is at most mean + multiplier * deviation of its group.

    A point without another one in its group stays; so do both of two.
    """
    d = cut(mean_neighbour_distance(points, k, group=group))
    rows = points.join(d, "point_id", "left")
    limit = rows.groupBy(F.col(group).alias("__g")).agg((F.avg("mean_distance") + multiplier * F.stddev_pop("mean_distance")).alias("__limit"), F.count(F.lit(1)).alias("__n"))
    out = rows.join(limit, F.col(group) == F.col("__g"))
    keep = F.col("mean_distance").isNull() | (F.col("__n") <= 2) | (F.col("mean_distance") <= F.col("__limit"))
    return out.where(keep).drop("mean_distance", "__g", "__limit", "__n")


def interpolate_terrain(nodes: DataFrame, terrain: DataFrame, k: int, power: float, *, group: str = "cloud_id") -> DataFrame:
    """query_id and h: inverse-distance mean of the k nearest terrain points' z.

    If some of them lie exactly at the node, their mean alone holds.
    """
    near = nearest_lists(nodes, terrain, k, group=group, carry="z", reduce=inverse_distance_mean(power))
    return near.select("query_id", F.when(F.col("n") > 0, F.col("total")).alias("h"))
