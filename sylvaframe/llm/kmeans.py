"""Distributed k-means over hashed weighted features of any columns.

``hashed_features`` turns numbers and categories into one short vector: a column (or a column's
value) is hashed to a slot and a sign, its weight scales what is added there. ``fit`` seeds by
parallel oversampling: in each round one pass over the whole table sums up the cost of the
centres so far and another draws rows with a probability in proportion to weight times squared
distance; the drawn ones, weighted by what they attract, are then reclustered to k. Lloyd steps
follow, one aggregation each, until the cost settles. Rows never leave their splits: the driver
sees the drawn rows and k sums, and the centres it broadcasts are bounded by k, which is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaframe.schema import require

#: what a broadcast of centres may hold
MOST_BYTES = 256 << 20


def _slots(names: list[str], size: int) -> dict[str, tuple[int, int]]:
    """(slot, sign) of each numeric column: hashed, the next free slot where two meet."""
    taken: set[int] = set()
    out = {}
    for name in names:
        h = 14695981039346656037
        for b in name.encode():
            h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
        slot = (h >> 16) % size
        while slot in taken and len(taken) < size:
            slot = (slot + 1) % size
        taken.add(slot)
        out[name] = (slot, 1 if (h >> 8) & 1 else -1)
    return out


def hashed_features(numbers: dict[str, float], categories: dict[str, float] | None = None, size: int = 16) -> Column:
    """array<double> of ``size`` slots from weighted columns.

    A null or NaN number adds nothing; a null category is a value of its own. Numeric columns
    share a slot only if there are more of them than slots.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    fixed: dict[int, Column] = {}
    for name, (slot, sign) in _slots(list(numbers), size).items():
        v = F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)) * (sign * numbers[name])
        fixed[slot] = fixed[slot] + v if slot in fixed else v
    hashed = []
    for name, weight in (categories or {}).items():
        h = F.xxhash64(F.lit(name), F.coalesce(F.col(name).cast("string"), F.lit("\0null")))
        hashed.append((F.pmod(F.shiftrightunsigned(h, 8), F.lit(size)), F.when(h.bitwiseAND(F.lit(1)) == 1, weight).otherwise(-weight)))
    out = []
    for i in range(size):
        total = fixed.get(i, F.lit(0.0))
        for slot, v in hashed:
            total = total + F.when(slot == i, v).otherwise(0.0)
        out.append(total)
    return F.array(*out)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def nearest_centre(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest centre of each row, the first of equals."""
    at, d2 = np.empty(len(x), np.int64), np.empty(len(x))
    mid = centres.mean(0)  # far from the origin the products would lose their digits
    c = centres - mid
    own = (c * c).sum(1)
    for i in range(0, len(x), block):
        p = x[i : i + block] - mid
        d = own[None, :] - 2 * (p @ c.T)
        k = d.argmin(1)
        at[i : i + block] = k
        d2[i : i + block] = ((p - c[k]) ** 2).sum(1)
    return at, d2


@dataclass
class Model:
    """centres: (k, slots); costs: the weighted sum of squared distances after the seeding and after each step."""

    centres: np.ndarray
    costs: list[float]


def _spread_seeds(x: np.ndarray, w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the drawn rows: the heaviest, then each with a probability by weight times squared distance; Lloyd on them."""
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return x
    chosen = [int(np.argmax(w))]
    _, d2 = nearest_centre(x, x[chosen])
    while len(chosen) < k:
        p = w * d2
        if not p.sum() > 0:
            break
        chosen.append(int(rng.choice(len(x), p=p / p.sum())))
        d2 = np.minimum(d2, ((x - x[chosen[-1]]) ** 2).sum(1))
    c = x[chosen]
    for _ in range(10):
        at, _ = nearest_centre(x, c)
        n = np.bincount(at, w, len(c))
        moved = np.stack([np.bincount(at, w * x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, moved / np.where(n > 0, n, 1)[:, None], c)
    return c


def _coin(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) of each id: the same whichever executor draws."""
    v = ids.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
    return ((v ^ (v >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def fit(rows: DataFrame, k: int, *, rounds: int = 3, oversample: float = 1.0, tolerance: float = 1e-3, most_steps: int = 20, seed: int = 1) -> Model | None:
    """Centres of ``rows`` (id bigint, w double, features array<double>); None for an empty table.

    Each round draws about ``oversample * k`` rows of the whole table. Steps end when one lowers
    the cost by less than ``tolerance`` of it, or after ``most_steps``; the model's costs tell
    which. Fewer than k different rows give fewer centres. ``rows`` is read once per pass:
    hand in a written or checkpointed table.
    """
    require(rows, "id", "w", "features")
    if k < 1 or rounds < 1:
        raise ValueError("k and rounds must be at least 1")
    spark = rows.sparkSession
    rows = rows.select("id", F.col("w").cast("double").alias("w"), "features")
    first = rows.agg(F.min_by("features", F.struct(F.xxhash64("id", F.lit(seed)), "id"))).first()[0]
    if first is None:
        return None
    centres = np.array([first], np.float64)
    width = centres.shape[1]
    if k * max(2.0, rounds * oversample * 2) * width * 8 > MOST_BYTES:
        raise ValueError(f"{k} centres of {width} slots exceed what may be broadcast")

    def costs_of(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for b in batches:
                _, d2 = nearest_centre(_matrix(b.column("features")), shared.value)
                total += float(b.column("w").to_numpy() @ d2)
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["cost"])

        return run

    def draws_of(shared, cost: float, salt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, d2 = nearest_centre(_matrix(b.column("features")), shared.value)
                p = oversample * k * b.column("w").to_numpy() * d2 / cost
                yield b.select(["features"]).filter(pa.array(_coin(b.column("id").to_numpy(), salt) < p))

        return run

    def sums_of(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            n, total, cost = np.zeros(len(c)), np.zeros((len(c), width)), np.zeros(len(c))
            for b in batches:
                x, w = _matrix(b.column("features")), b.column("w").to_numpy()
                if len(w):
                    at, d2 = nearest_centre(x, c)
                    n += np.bincount(at, w, len(c))
                    cost += np.bincount(at, w * d2, len(c))
                    total += np.stack([np.bincount(at, w * x[:, j], len(c)) for j in range(width)], 1)
            got = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(n[got]), pa.array(cost[got]), *[pa.array(total[got, j]) for j in range(width)]], names=["at", "n", "cost", *[f"s{j}" for j in range(width)]])

        return run

    sums = ["n", "cost", *[f"s{j}" for j in range(width)]]

    def summed(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        shared = spark.sparkContext.broadcast(c)
        got = rows.mapInArrow(sums_of(shared), "at bigint, " + ", ".join(f"{s} double" for s in sums)).groupBy("at").agg(*[F.sum(s).alias(s) for s in sums]).toPandas().sort_values("at")
        shared.destroy()
        n, moved = np.zeros(len(c)), c.copy()
        at = got["at"].to_numpy()
        n[at] = got["n"]
        moved[at] = got[sums[2:]].to_numpy() / got["n"].to_numpy()[:, None]
        return n, moved, float(got["cost"].sum())

    for r in range(rounds):
        shared = spark.sparkContext.broadcast(centres)
        cost = rows.mapInArrow(costs_of(shared), "cost double").agg(F.sum("cost")).first()[0]
        if not cost > 0:
            break
        drawn = rows.select("id", "w", "features").mapInArrow(draws_of(shared, cost, seed * 1000 + r), "features array<double>").toPandas()["features"]
        shared.destroy()
        if len(drawn):
            centres = np.unique(np.concatenate([centres, np.stack(drawn.to_list())]), axis=0)
    n, _, _ = summed(centres)
    centres = _spread_seeds(centres, np.maximum(n, 1e-12), k, seed)
    _, moved, cost = summed(centres)
    costs = [cost]
    for _ in range(most_steps):
        centres = moved
        _, moved, cost = summed(centres)
        costs.append(cost)
        if costs[-2] - cost <= tolerance * costs[-2]:
            break
    return Model(centres, costs)


def assign(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep``, ``centre`` (number of the nearest one) and ``d2``. rows: features and the columns kept. No shuffle."""
    require(rows, "features", *keep)
    shared = rows.sparkSession.sparkContext.broadcast(model.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d2 = nearest_centre(_matrix(b.column("features")), shared.value)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(at), pa.array(d2)], names=[*keep, "centre", "d2"])

    schema = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep], "centre bigint", "d2 double"])
    return rows.select(*keep, "features").mapInArrow(run, schema)


def typical_members(assigned: DataFrame, id_col: str, most: int = 3) -> DataFrame:
    """centre, ``size``, ``cost`` and ``typical``: the ids of the ``most`` members nearest to the centre, ties by id.

    Salted first, so a centre that owns most rows is no single task.
    """
    require(assigned, "centre", "d2", id_col)
    best = F.slice(F.array_sort(F.collect_list(F.struct("d2", F.col(id_col).alias("id")))), 1, most)
    ranked = assigned.groupBy("centre", F.pmod(F.xxhash64(id_col), F.lit(4096)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("c"), best.alias("t"))
    for width in (64, 1):
        ranked = ranked.groupBy("centre", F.pmod("salt", F.lit(width)).alias("salt")).agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.slice(F.array_sort(F.flatten(F.collect_list("t"))), 1, most).alias("t"))
    return ranked.select("centre", F.col("n").alias("size"), F.col("c").alias("cost"), F.col("t.id").alias("typical"))
