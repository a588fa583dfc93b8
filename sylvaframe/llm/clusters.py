"""Points that lie close together in clusters: hierarchical k-means over hashed weighted features.

Rows of one fine cell are summed up to one weighted vector first. Its features are its hashed
weighted coordinates and, far heavier, its hashed cloud. ``kmeans.fit`` divides all vectors into k
coarse clusters, with parallel oversampled seeding over the whole table and steps until the cost
settles. How many groups lie close together grows with the table, so each coarse cluster is then
divided further: within its blocks of 8 m (bounded by volume, however many rows fall into them)
vectors not yet covered are drawn in oversampled rounds, by weight times squared distance, the
farthest one always, until all lie within ``cover`` of a seed; the drawn ones are reclustered.
A Lloyd step assigns every vector to the nearest centroid, copies of which reach into the blocks
around, and moves centroids by one distributed aggregation.

Tight groups. Let G have diameter <= d and no outside point within s of a member. A vector of G
lies in conv(G), which is within 0.62 d of some member (Jung), so vectors outside of G stay
s - 0.62 d - 0.18 away from conv(G) (0.18: diagonal of a fine cell of 0.1). With d = 1.5 and
s = 2.5 that is over 1.3. Seeds cover within 0.4, so a seed of G never covers outside vectors and
vice versa; after one Lloyd step the own centroid is within 0.8 and one from the other side over
0.9 away. So clusters never mix G with others, and G is a union of clusters: the clusters whose
most central members lie within s of each other. An exact check of those unions follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.llm import kmeans as KM
from sylvaframe.operators.near import pairs_within
from sylvaframe.schema import require, valid_points
from sylvaframe.session import cut, default_parallelism

FINE = 0.1
BLOCK_EDGE = 8.0
#: features of a vector: metres, and the cloud so heavy that clouds never share a coarse cluster's middle
NUMBERS, CLOUD_WEIGHT = {"x": 1.0, "y": 1.0, "z": 1.0}, 10_000.0
COARSE = 128
VECTOR = "g bigint, mx bigint, my bigint, mz bigint, id bigint, w bigint, x double, y double, z double"


def _block(edge: float, dx: float = 0.0, dy: float = 0.0, dz: float = 0.0) -> list:
    return [F.floor((F.col(c) + d) / edge).alias(f"b{c}") for c, d in (("x", dx), ("y", dy), ("z", dz))]


def _bucketed(df: DataFrame, n: int) -> DataFrame:
    """A bucket holds many blocks: groups of a useful size for the Python side."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("g", "bx", "by", "bz"), F.lit(n)).cast("int"))


def coarse_model(vecs: DataFrame, k: int = COARSE) -> KM.Model | None:
    """k-means of all vectors over their hashed features."""
    return KM.fit(with_features(vecs).select("id", "w", "features"), k)


def with_features(vecs: DataFrame) -> DataFrame:
    return vecs.withColumn("features", KM.hashed_features(NUMBERS, {"g": CLOUD_WEIGHT}))


def vectors(points: DataFrame) -> DataFrame:
    """One weighted vector per cloud and fine cell. points: distinct valid points."""
    at = [F.floor(F.col(c) / FINE).alias(f"m{c}") for c in "xyz"]
    return points.groupBy(F.xxhash64("cloud_id").alias("g"), *at).agg(
        F.min("point_id").alias("id"), F.count(F.lit(1)).alias("w"), *[F.avg(c).alias(c) for c in "xyz"]
    )


def _blocks_of(table: pa.Table, *more: str) -> Iterator[np.ndarray]:
    """Row numbers of each block of a bucket, or of each (block, more)."""
    keys = np.stack([table[c].to_numpy() for c in ("g", "bx", "by", "bz", *more)], 1)
    if len(keys):
        order = np.lexsort(keys.T[::-1])
        change = np.flatnonzero((np.diff(keys[order], axis=0) != 0).any(1)) + 1
        yield from np.split(order, change)


def _nearest(p: np.ndarray, c: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of c (the first of equals) and the squared distance."""
    at, d2 = np.empty(len(p), np.int64), np.empty(len(p))
    for i in range(0, len(p), block):
        d = ((p[i : i + block, None, :] - c[None, :, :]) ** 2).sum(2) if len(c) < 4096 else _slow(p[i : i + block], c)
        at[i : i + block] = d.argmin(1)
        d2[i : i + block] = d[np.arange(len(d)), at[i : i + block]]
    return at, d2


def _slow(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros((len(p), len(c)))
    for k in range(p.shape[1]):
        out += (p[:, k, None] - c[None, :, k]) ** 2
    return out


def seed_block(p: np.ndarray, w: np.ndarray, ids: np.ndarray, cover: float, oversample: float = 8.0) -> np.ndarray:
    """Row numbers of the seeds of one block: k-means|| rounds, then reclustering."""
    order = np.argsort(ids)
    p, w, ids = p[order], w[order], ids[order]
    fine = 0.6 * cover
    chosen = np.array([int(np.argmax(w))])
    _, d2 = _nearest(p, p[chosen])
    rounds = 0
    while d2.max() > fine * fine:
        cost = w * d2
        rounds += 1
        coin = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(rounds * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)) / float(1 << 53)
        draw = (coin < oversample * (1 + len(p) / 50) * cost / cost.sum()) & (d2 > fine * fine)
        draw[int(np.argmax(d2))] = True
        new = np.flatnonzero(draw)
        _, to_new = _nearest(p, p[new])
        d2 = np.minimum(d2, to_new)
        chosen = np.r_[chosen, new]
    # recluster the drawn ones: by the weight they attract, each kept one absorbs those near it
    owner, _ = _nearest(p, p[chosen])
    rank = np.argsort(-np.bincount(owner, w, len(chosen)), kind="stable")
    kept: list[int] = []
    near = (cover - fine) ** 2
    left = np.ones(len(rank), bool)
    q = p[chosen[rank]]
    for i in range(len(rank)):
        if left[i]:
            kept.append(rank[i])
            left &= ((q - q[i]) ** 2).sum(1) > near
    return order[chosen[kept]]


def seeds(vecs: DataFrame, cover: float) -> DataFrame:
    """g, id, x, y, z, centre: vectors chosen so that each has a seed of its coarse cluster and block within ``cover``."""
    n = 4 * default_parallelism(vecs.sparkSession)

    def kernel(table: pa.Table) -> pa.Table:
        p = np.stack([table[c].to_numpy() for c in "xyz"], 1)
        w, ids = table["w"].to_numpy(), table["id"].to_numpy()
        at = [rows[seed_block(p[rows], w[rows], ids[rows], cover)] for rows in _blocks_of(table, "centre")]
        return table.select(["g", "id", "x", "y", "z", "centre"]).take(pa.array(np.concatenate(at) if at else np.empty(0, np.int64)))

    rows = _bucketed(vecs.select("g", "id", "w", "x", "y", "z", "centre", *_block(BLOCK_EDGE)), n)
    return rows.groupBy("bucket").applyInArrow(kernel, "g bigint, id bigint, x double, y double, z double, centre bigint")


def assign(vecs: DataFrame, centroids: DataFrame, reach: float) -> DataFrame:
    """Each vector with ``cluster``, the id of the nearest centroid of its cloud within ``reach``."""
    n = 4 * default_parallelism(vecs.sparkSession)
    line = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / BLOCK_EDGE), F.floor((F.col(c) + reach) / BLOCK_EDGE)))
    copies = centroids.select("g", "id", "x", "y", "z").withColumn("bx", line("x")).withColumn("by", line("y")).withColumn("bz", line("z"))
    none = F.lit(None).cast("bigint")
    both = vecs.select("g", "mx", "my", "mz", "id", "w", "x", "y", "z", *_block(BLOCK_EDGE)).unionByName(copies.select("g", none.alias("mx"), none.alias("my"), none.alias("mz"), "id", none.alias("w"), "x", "y", "z", "bx", "by", "bz"))

    def kernel(table: pa.Table) -> pa.Table:
        p = np.stack([table[c].to_numpy() for c in "xyz"], 1)
        ids, is_seed = table["id"].to_numpy(), table["w"].is_null().to_numpy()
        rows_out, to = [], []
        for rows in _blocks_of(table):
            s, v = rows[is_seed[rows]], rows[~is_seed[rows]]
            if not len(v):
                continue
            s = s[np.argsort(ids[s])]
            near, _ = _nearest(p[v], p[s])
            rows_out.append(v)
            to.append(ids[s[near]])
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        out = table.select(["g", "mx", "my", "mz", "id", "w", "x", "y", "z"]).take(pa.array(cat(rows_out)))
        return out.append_column("cluster", pa.array(cat(to), pa.int64()))

    return _bucketed(both, n).groupBy("bucket").applyInArrow(kernel, VECTOR + ", cluster bigint")


def fine_clusters(points: DataFrame, cover: float = 0.4, steps: int = 1, k: int = COARSE) -> tuple[DataFrame, DataFrame]:
    """(points with ``cluster`` and ``d2`` to its centroid, clusters with the ``parent`` they were divided from).

    points: distinct valid points with cloud_id, point_id, x, y, z and more columns that are
    kept. ``cluster`` is the point_id behind its seed, ``parent`` the number of a coarse cluster.
    """
    vecs = cut(vectors(points))
    model = coarse_model(vecs, k)
    if model is None:
        none = points.where("false").select("*", F.lit(0).cast("bigint").alias("g"), F.lit(0).cast("bigint").alias("cluster"), F.lit(0.0).alias("d2"))
        return none, none.select("cluster", F.lit(0).cast("bigint").alias("parent"))
    own = with_features(vecs)
    coarse = KM.assign(own, model, *vecs.columns).drop("d2")
    first = cut(seeds(coarse, cover))
    centres, reach = first.drop("centre"), cover
    for _ in range(steps):
        moved = assign(vecs, centres, reach).groupBy("g", F.col("cluster").alias("id")).agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in "xyz"])
        centres, reach = cut(moved), 2 * cover
    labels = assign(vecs, centres, reach).select("g", "mx", "my", "mz", "cluster")
    at = [F.floor(F.col(c) / FINE).alias(f"m{c}") for c in "xyz"]
    named = centres.select(F.col("g").alias("cg"), F.col("id").alias("cluster"), *[F.col(c).alias(f"c{c}") for c in "xyz"])
    rows = points.select("*", F.xxhash64("cloud_id").alias("g"), *at).join(labels, ["g", "mx", "my", "mz"]).drop("mx", "my", "mz")
    rows = rows.join(named, (F.col("g") == F.col("cg")) & (rows["cluster"] == named["cluster"])).drop(named["cluster"]).drop("cg")
    d2 = sum((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz")
    return rows.withColumn("d2", d2).drop("cx", "cy", "cz"), first.select(F.col("id").alias("cluster"), F.col("centre").alias("parent"))


def trunk_points(points: DataFrame) -> DataFrame:
    """Distinct valid points of class 1; rows without a cloud are left out."""
    require(points, "cloud_id", "point_id", "x", "y", "z", "cls", "instance_id")
    return valid_points(points.where((F.col("cls") == 1) & F.col("cloud_id").isNotNull()), "cloud_id", "instance_id")


def describe(labelled: DataFrame, typical: int = 3) -> DataFrame:
    """Per cluster: size, centroid, the ``typical`` most central members and the labels with counts.

    Members are ranked by distance, ties by point_id. Labels are counted before they are put
    together, so a cluster with very many points sends one row per label.
    """
    by_label = labelled.groupBy("cloud_id", "cluster", "instance_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s{c}") for c in "xyz"],
        F.min_by(F.struct("point_id", "x", "y", "z"), F.struct("d2", "point_id")).alias("rep"),
        F.min(F.struct("d2", "point_id")).alias("rep_d"),
        *[f(c).alias(f"{k}_{c}") for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max))],
    )
    whole = by_label.groupBy("cloud_id", "cluster").agg(
        F.sum("n").alias("size"),
        *[(F.sum(f"s{c}") / F.sum("n")).alias(f"centre_{c}") for c in "xyz"],
        F.min_by("rep", "rep_d").alias("rep"),
        F.array_sort(F.collect_list(F.struct(F.col("instance_id").alias("label"), F.col("n")))).alias("labels"),
        *[f(f"{k}_{c}").alias(f"{k}_{c}") for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max))],
    )
    if typical <= 1:
        return whole
    top = labelled.groupBy("cloud_id", "cluster", F.pmod("point_id", F.lit(16)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "point_id"))), 1, typical).alias("t"))
    top = top.groupBy("cloud_id", "cluster").agg(F.slice(F.array_sort(F.flatten(F.collect_list("t"))), 1, typical).alias("t"))
    return whole.join(top.select("cloud_id", "cluster", F.col("t.point_id").alias("typical")), ["cloud_id", "cluster"])


# ---- tight groups ------------------------------------------------------------------------------


def _diameter_within(p: np.ndarray, most: float) -> bool:
    """No two rows further apart than ``most``. Only rows far from the middle are compared."""
    if (np.ptp(p, axis=0) > most).any():
        return False
    mid = (p.min(0) + p.max(0)) / 2
    r = np.sqrt(((p - mid) ** 2).sum(1))
    p = p[r + r.max() > most]
    return all((((p[i : i + 1024, None] - p[None, i:]) ** 2).sum(2) <= most * most).all() for i in range(0, len(p), 1024))


def _apart(p: np.ndarray, q: np.ndarray, least: float) -> bool:
    """No row of q within ``least`` of a row of p."""
    for k in range(p.shape[1]):
        q = q[(q[:, k] >= p[:, k].min() - least) & (q[:, k] <= p[:, k].max() + least)]
    return all((_slow(q[i : i + 1024], p) > least * least).all() for i in range(0, len(q), 1024))


def tight_groups(points: DataFrame, diameter: float = 1.5, separation: float = 2.5, least: int = 5, cover: float = 0.4) -> DataFrame:
    """group_id, point_id: members of the tight groups of trunk points, through k-means clusters.

    Ties and points at the same place are different points; a row without usable coordinates,
    class or cloud is none. An empty table gives an empty result.
    """
    if 0.62 * diameter + 0.18 + 3 * cover >= separation:
        raise ValueError("the separation must exceed 0.62 * diameter + 0.18 + 3 * cover")
    labelled = cut(fine_clusters(trunk_points(points), cover)[0])
    clusters = cut(describe(labelled, typical=1).drop("labels", "centre_x", "centre_y", "centre_z"))
    reps = clusters.select("cloud_id", "cluster", F.col("rep.x").alias("x"), F.col("rep.y").alias("y"), F.col("rep.z").alias("z"))
    near = pairs_within(reps, separation, id_col="cluster")
    ends = near.select(F.col("cluster_a").alias("cluster"), F.col("cluster_b").alias("o")).unionByName(near.select(F.col("cluster_b").alias("cluster"), F.col("cluster_a").alias("o")))
    sets = clusters.join(ends.groupBy("cluster").agg(F.collect_set("o").alias("o")), "cluster", "left")
    # how many clusters can lie within the separation is bounded by geometry, not by rows
    sets = sets.withColumn("around", F.array_sort(F.array_union(F.array("cluster"), F.coalesce("o", F.array().cast("array<bigint>"))))).drop("o")
    box = [f(f"{k}_{c}").alias(f"{k}_{c}") for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max))]
    unions = sets.groupBy("cloud_id", "around").agg(F.count(F.lit(1)).alias("n_here"), F.sum("size").alias("n"), *box)
    unions = unions.where((F.col("n_here") == F.size("around")) & (F.col("n") >= least))
    for c in "xyz":
        unions = unions.where(F.col(f"hi_{c}") - F.col(f"lo_{c}") <= diameter)
    unions = cut(unions.withColumn("u", F.col("around")[0]))
    # clusters that could hold a point within the separation
    edge = separation + 2.0
    span = lambda c, by: F.sequence(F.floor((F.col(f"lo_{c}") - by) / edge), F.floor((F.col(f"hi_{c}") + by) / edge))
    spread = lambda df, by: df.withColumn("ex", F.explode(span("x", by))).withColumn("ey", F.explode(span("y", by))).withColumn("ez", F.explode(span("z", by)))
    wanted = spread(unions.select("cloud_id", "u", "around", *[F.col(f"{k}_{c}") for c in "xyz" for k in ("lo", "hi")]), separation)
    wanted = wanted.select("cloud_id", "u", "around", *[F.col(f"{k}_{c}").alias(f"u{k}_{c}") for c in "xyz" for k in ("lo", "hi")], "ex", "ey", "ez")
    other = spread(clusters.select("cloud_id", "cluster", *[F.col(f"{k}_{c}") for c in "xyz" for k in ("lo", "hi")]), 0.0)
    met = wanted.join(other, ["cloud_id", "ex", "ey", "ez"])
    for c in "xyz":
        met = met.where((F.col(f"lo_{c}") <= F.col(f"uhi_{c}") + separation) & (F.col(f"hi_{c}") >= F.col(f"ulo_{c}") - separation))
    met = met.select("u", "cluster", F.array_contains("around", F.col("cluster")).alias("is_member")).distinct()
    rows = labelled.select("cluster", "point_id", "x", "y", "z").join(met, "cluster")
    n = 4 * default_parallelism(points.sparkSession)

    def check(table: pa.Table) -> pa.Table:
        u, ids, member = table["u"].to_numpy(), table["point_id"].to_numpy(), table["is_member"].to_numpy()
        p = np.stack([table[c].to_numpy() for c in "xyz"], 1)
        order = np.argsort(u, kind="stable")
        group, found = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(u[order])) + 1):
            own, rest = rows[member[rows]], rows[~member[rows]]
            if len(own) >= least and _diameter_within(p[own], diameter) and _apart(p[own], p[rest], separation):
                group.append(np.full(len(own), ids[own].min()))
                found.append(ids[own])
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.table({"group_id": pa.array(cat(group), pa.int64()), "point_id": pa.array(cat(found), pa.int64())})

    return rows.groupBy(F.pmod(F.xxhash64("u"), F.lit(n))).applyInArrow(check, "group_id bigint, point_id bigint")
