"""Per-key results when a few keys own most rows.

Rows stay in the equal splits in which they are read. Each split dictionary-encodes the keys it
meets and scatter-reduces the values into dense arrays, one slot per key; what leaves a split is
a handful of array blocks, however often a key occurs. Blocks are the hash ranges of the keys,
and a block's arrays are summed up in levels until one is left, so that no task ever receives
more than ``fan_in`` of them at once. A key with a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.operators.fanin import reduce_parts
from sylvaframe.schema import require
from sylvaframe.session import default_parallelism

BLOCK = "block int, part int, keys array<bigint>, n array<bigint>, stats array<double>"
#: keys held in a split's accumulators before they are handed on
MOST_KEYS = 1_000_000


class Dense:
    """Accumulators of a split: counts, and per value column count, sum, minimum and maximum.

    Slots follow the ascending dictionary ``keys``. What is new to it waits in ``late`` and is
    merged in when it has grown to a share of the whole, so a batch never copies all slots.
    """

    def __init__(self, n_values: int) -> None:
        self.n_values = n_values
        self.keys = np.empty(0, np.int64)
        self.n = np.empty(0, np.int64)
        self.stats = self._empty(0)
        self.late: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_late = 0

    def __len__(self) -> int:
        return len(self.keys) + self.n_late

    def _empty(self, size: int) -> np.ndarray:
        s = np.zeros((size, self.n_values, 4))
        s[:, :, 2], s[:, :, 3] = np.inf, -np.inf
        return s

    def add(self, keys: np.ndarray, values: list[np.ndarray]) -> None:
        distinct, code = np.unique(keys, return_inverse=True)
        size = len(distinct)
        stats = self._empty(size)
        for j, v in enumerate(values):
            ok = ~np.isnan(v)
            c, w = code[ok], v[ok]
            stats[:, j, 0] = np.bincount(c, minlength=size)
            stats[:, j, 1] = np.bincount(c, weights=w, minlength=size)
            order = np.argsort(c, kind="stable")
            if len(order):
                first = np.flatnonzero(np.r_[True, np.diff(c[order]) > 0])
                at = c[order][first]
                stats[at, j, 2] = np.minimum.reduceat(w[order], first)
                stats[at, j, 3] = np.maximum.reduceat(w[order], first)
        self.merge(distinct, np.bincount(code, minlength=size), stats)

    def merge(self, keys: np.ndarray, n: np.ndarray, stats: np.ndarray) -> None:
        """keys: distinct."""
        at = np.searchsorted(self.keys, keys)
        here = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        here[inside] = self.keys[at[inside]] == keys[inside]
        slot = at[here]
        self.n[slot] += n[here]
        if self.n_values:
            own, new = self.stats[slot], stats[here]
            own[:, :, :2] += new[:, :, :2]
            own[:, :, 2] = np.minimum(own[:, :, 2], new[:, :, 2])
            own[:, :, 3] = np.maximum(own[:, :, 3], new[:, :, 3])
            self.stats[slot] = own
        if not here.all():
            self.late.append((keys[~here], n[~here], stats[~here]))
            self.n_late += int((~here).sum())
            if self.n_late > max(50_000, len(self.keys) // 2):
                self.settle()

    def settle(self) -> None:
        """Brings what is late into the dictionary."""
        if not self.late:
            return
        parts = [(self.keys, self.n, self.stats), *self.late]
        keys, n, stats = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(keys, kind="stable")
        keys, n, stats = keys[order], n[order], stats[order]
        first = np.flatnonzero(np.r_[True, np.diff(keys) != 0])
        self.keys, self.n = keys[first], np.add.reduceat(n, first)
        out = self._empty(len(first))
        if self.n_values:
            out[:, :, :2] = np.add.reduceat(stats[:, :, :2], first)
            out[:, :, 2], out[:, :, 3] = np.minimum.reduceat(stats[:, :, 2], first), np.maximum.reduceat(stats[:, :, 3], first)
        self.stats, self.late, self.n_late = out, [], 0

    def blocks(self, n_blocks: int, part: int) -> Iterator[pa.RecordBatch]:
        self.settle()
        block = _block(self.keys, n_blocks)
        rows = [(int(b), part, self.keys[m], self.n[m], self.stats[m].ravel()) for b in np.unique(block) for m in [block == b]]
        self.__init__(self.n_values)
        if rows:
            yield _as_batch(rows)


def _block(keys: np.ndarray, n_blocks: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(n_blocks)).astype(np.int64)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    b, p, k, n, s = zip(*rows, strict=True)
    arrays = [pa.array(b, pa.int32()), pa.array(p, pa.int32()), pa.array(k, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int64())), pa.array(s, pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "part", "keys", "n", "stats"])


def _column(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _accumulated(rows: DataFrame, key: str, values: list[str], n_blocks: int | None, fan_in: int) -> DataFrame:
    """One row (block, part 0, keys, n, stats) per block; rows with a null key count in block -1."""
    require(rows, key, *values)
    n_blocks = n_blocks or 4 * default_parallelism(rows.sparkSession)
    n_values = len(values)
    narrow = rows.select(F.col(key).cast("bigint").alias("k"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        acc, without = Dense(n_values), 0
        for batch in batches:
            if batch.column(0).null_count:
                without += batch.column(0).null_count
                batch = batch.filter(batch.column(0).is_valid())
            if batch.num_rows:
                acc.add(batch.column(0).to_numpy(zero_copy_only=False), [_column(batch, 1 + i) for i in range(n_values)])
            if len(acc) > MOST_KEYS:
                yield from acc.blocks(n_blocks, part)
        yield from acc.blocks(n_blocks, part)
        if without:
            yield _as_batch([(-1, part, np.zeros(1, np.int64), np.array([without]), Dense(n_values)._empty(1).ravel())])

    def level(batch: pa.Table) -> pa.Table:
        acc = Dense(n_values)
        for k, n, s in zip(batch["keys"], batch["n"], batch["stats"], strict=True):
            acc.merge(np.array(k.values), np.array(n.values), np.array(s.values).reshape(len(k), n_values, 4))
        acc.settle()
        row = (batch["block"][0].as_py(), batch["part"][0].as_py() // fan_in, acc.keys, acc.n, acc.stats.ravel())
        return pa.Table.from_batches([_as_batch([row])])

    return reduce_parts(narrow.mapInArrow(split, BLOCK), level, fan_in)


def _opened(blocks: DataFrame, key: str, values: list[str]) -> DataFrame:
    """A row per key from a row per block."""
    n_values = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n, s in zip(b.column("keys"), b.column("n"), b.column("stats"), strict=True):
                stats = np.array(s.values).reshape(len(k), n_values, 4)
                cols = [k.values, n.values]
                for j in range(n_values):
                    own = stats[:, j]
                    none = own[:, 0] == 0
                    cols += [pa.array(own[:, 0].astype(np.int64)), *[pa.array(own[:, i], mask=none) for i in (1, 2, 3)]]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in out])

    out = ["key bigint", "n_rows bigint"]
    for i in range(n_values):
        out += [f"n_{i} bigint", f"sum_{i} double", f"min_{i} double", f"max_{i} double"]
    done = blocks.where("block >= 0").select("keys", "n", "stats").mapInArrow(run, ", ".join(out))
    names = [F.col("key").alias(key), "n_rows"]
    for i, v in enumerate(values):
        names += [F.col(f"{s}_{i}").alias(f"{s}_{v}") for s in ("n", "sum", "min", "max")]
    return done.select(*names)


def keyed_statistics(rows: DataFrame, key: str, values: list[str], *, n_blocks: int | None = None, fan_in: int = 64) -> DataFrame:
    """Per non-null integer key: ``n_rows`` and, per value column c, n_c, sum_c, min_c, max_c.

    Null and NaN values don't count; infinities do. Empty input gives no rows. Output columns
    are named by the value columns, other columns of ``rows`` play no part. Shuffles only the
    array blocks: at most one slot per split and key.
    """
    return _opened(_accumulated(rows, key, values, n_blocks, fan_in), key, values)


def hot_keys(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Keys in more than ``share`` of all rows, rows with a null key included in the whole.

    The whole is the sum of the counts already made: the table is read once.
    """
    blocks = _accumulated(rows, key, [], None, 64)
    whole = blocks.agg(F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda t, v: t + v))).first()[0] or 0
    return _opened(blocks, key, []).where(F.col("n_rows") > F.lit(share) * F.lit(whole)).select(key, "n_rows")
