"""Items in containers of fixed capacity: bounded-space online packing per partition.

Every partition keeps a fixed number of open windows. An item goes to the fullest window it
fits in (best fit); when it fits in none, the fullest window is closed and a new one opened.
What is still open at the end of the partitions is merged in a tree of bounded groups: whole
windows are packed best-fit decreasing, and only the emptiest few of each group travel on.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.schema import require
from sylvaframe.session import cut, default_parallelism


class Windows:
    """Open windows by fill, ascending; ids are given in order of opening."""

    def __init__(self, capacity: int, most: int, first_id: int) -> None:
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.open: list[tuple[int, int]] = []

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, size: int) -> int:
        at = bisect_right(self.open, (self.capacity - size, 1 << 62)) - 1
        if at >= 0:
            fill, own = self.open.pop(at)
        else:
            if len(self.open) == self.most:
                self.open.pop()
            fill, own = 0, self.new_id()
        if fill + size < self.capacity:
            insort(self.open, (fill + size, own))
        return own


def best_fit_decreasing(fills: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin of each item, fill of each bin); the items are given largest first."""
    bins: list[tuple[int, int]] = []
    total: list[int] = []
    to = []
    for size in fills:
        at = bisect_right(bins, (capacity - size, 1 << 62)) - 1
        fill, own = bins.pop(at) if at >= 0 else (0, len(total))
        if own == len(total):
            total.append(0)
        total[own] = fill + size
        insort(bins, (fill + size, own))
        to.append(own)
    return to, total


def pack(items: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", *, windows: int = 32, fan_in: int = 64) -> DataFrame:
    """id_col, part_no, size_col, container_id: every item in one container, fills <= capacity.

    Only an item above the capacity is cut: into full containers of its own and a rest that is
    packed like any item (part_no counts from 0). Items of size 0, null or less take no space
    and are placed all the same (their size comes out as 0). Rows repeating an id are items of
    their own. An empty table gives an empty result. One shuffle by id; the driver sees nothing.
    """
    require(items, id_col, size_col)
    if capacity < 1 or windows < 1:
        raise ValueError("capacity and windows must be at least 1")
    n_parts = default_parallelism(items.sparkSession)
    id_type = items.schema[id_col].dataType.simpleString()
    rows = items.select(id_col, F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    rows = rows.repartition(n_parts, id_col).sortWithinPartitions(id_col, "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        w = Windows(capacity, windows, part << 40)
        for b in batches:
            ids, take, no, size, to = b.column(0), [], [], [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                k = 0
                while s > capacity:
                    take.append(i)
                    no.append(k)
                    size.append(capacity)
                    to.append(w.new_id())
                    s, k = s - capacity, k + 1
                take.append(i)
                no.append(k)
                size.append(s)
                to.append(w.place(s))
            yield _rows(ids.take(pa.array(take, pa.int64())), no, size, to)
        # the open windows, told apart by part_no -1
        if w.open:
            none = pa.nulls(len(w.open), b.schema.field(0).type)
            yield _rows(none, [-1] * len(w.open), [f for f, _ in w.open], [c for _, c in w.open])

    def _rows(ids: pa.Array, no: list[int], size: list[int], to: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(no, pa.int64()), pa.array(size, pa.int64()), pa.array(to, pa.int64())], names=["id", "part_no", "size", "container_id"])

    placed = cut(rows.mapInArrow(run, f"id {id_type}, part_no bigint, size bigint, container_id bigint"))
    moves = _merge_open(placed.where(F.col("part_no") == -1).select("container_id", "size"), capacity, windows, fan_in, n_parts)
    out = placed.where(F.col("part_no") >= 0).join(moves, "container_id", "left")
    return out.select(F.col("id").alias(id_col), "part_no", F.col("size").alias(size_col), F.coalesce("into", "container_id").alias("container_id"))


def _merge_open(open_: DataFrame, capacity: int, windows: int, fan_in: int, n_parts: int) -> DataFrame:
    """container_id -> into, for open windows that were merged into another."""
    schema = "container_id bigint, into bigint, grp bigint, size bigint, is_open boolean"

    def level(table: pa.Table) -> pa.Table:
        ids, root, size = table["container_id"].to_numpy(), table["into"].to_numpy(), table["size"].to_numpy()
        roots, at = np.unique(root, return_index=True)
        fill = size[at]
        order = np.lexsort((roots, -fill))
        to, total = best_fit_decreasing(fill[order].tolist(), capacity)
        name = np.full(len(total), np.iinfo(np.int64).max)
        np.minimum.at(name, np.array(to), roots[order])
        new_root = dict(zip(roots[order].tolist(), name[to].tolist(), strict=True))
        new_fill = dict(zip(name.tolist(), total, strict=True))
        still = set(sorted(new_fill, key=lambda k: (new_fill[k], k))[:windows])
        into = np.array([new_root[r] for r in root.tolist()], np.int64)
        grp = table["grp"][0].as_py() // fan_in
        return pa.table(
            {"container_id": ids, "into": into, "grp": np.full(len(ids), grp), "size": np.array([new_fill[i] for i in into.tolist()], np.int64), "is_open": np.array([i in still for i in into.tolist()], bool)}
        )

    state = open_.select("container_id", F.col("container_id").alias("into"), (F.shiftright("container_id", 40) / fan_in).cast("bigint").alias("grp"), "size", F.lit(True).alias("is_open"))
    closed = None
    groups = max(1, -(-n_parts // fan_in))
    while True:
        state = cut(state.groupBy("grp").applyInArrow(level, schema))
        if groups == 1:
            done = state
            break
        groups = -(-groups // fan_in)
        shut = state.where(~F.col("is_open"))
        closed = shut if closed is None else closed.unionByName(shut)
        state = state.where("is_open")
    moves = done if closed is None else done.unionByName(closed)
    return moves.select("container_id", "into")


def container_table(packed: DataFrame, size_col: str = "n_tokens") -> DataFrame:
    """container_id, n_items, fill."""
    return packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum(size_col).alias("fill"))
