"""Percentiles per group from mergeable sketches with relative rank error.

A sketch is a stack of relative-rank compactors. Level h holds items that stand for 2^h values
each. A full level sorts its items, keeps the protected tail untouched and promotes every second
item of a stretch at the other end; how long the stretch is follows the level's schedule, so
items near the protected tail are compacted exponentially rarely. A level has more sections the
oftener it has been compacted. Ranks near the protected tail have a multiplicative error.

The error is also known, not just probable. A compaction of level h moves no rank at or above its
highest item, and below it by 2^h at most, upwards or downwards as its coin fell. Each sketch
keeps these steps (``up`` and ``down``: highest item and weight), so the bounds of a rank count
only compactions that reached above it. Steps are put together when there are too many, each
moved towards the tail by a small part of what stands there: bounds get wider, never wrong.

Coins depend on the split, so the errors of splits and days don't add up in step. Sketches are
plain rows: those of files, days or partitions are stored as any table and merged later, in any
order. A group of up to ``6 k`` values is kept exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaframe.operators.fanin import reduce_parts
from sylvaframe.schema import require
from sylvaframe.session import cut, default_parallelism

SECTIONS = 3
MOST_STEPS = 512
#: steps are put together while they stand on the same sixteenth of the error above them
FINE = 16
LISTS = {"items": pa.float64(), "sizes": pa.int32(), "states": pa.int64(), "up_at": pa.float64(), "up_by": pa.int64(), "down_at": pa.float64(), "down_by": pa.int64()}
COLUMNS = ["n", "seed", *LISTS]
_DDL = {pa.float64(): "array<double>", pa.int32(): "array<int>", pa.int64(): "array<bigint>"}
FIELDS = "n bigint, seed bigint, " + ", ".join(f"{c} {_DDL[t]}" for c, t in LISTS.items())
_MASK = (1 << 64) - 1


def _mixed(*numbers: int) -> int:
    h = 0x243F6A8885A308D3
    for v in numbers:
        h = ((h ^ (v & _MASK)) * 0x9E3779B97F4A7C15) & _MASK
        h ^= h >> 29
    return h


class Steps:
    """Where and by how much ranks can have been moved in one direction."""

    __slots__ = ("at", "by", "new")

    def __init__(self, at: np.ndarray | None = None, by: np.ndarray | None = None) -> None:
        self.at = np.empty(0) if at is None else at
        self.by = np.empty(0, np.int64) if by is None else by
        self.new: list[tuple[float, int]] = []

    def add(self, at: float, by: int) -> None:
        self.new.append((at, by))
        if len(self.new) + len(self.at) > 2 * MOST_STEPS:
            self.settle()

    def join(self, at: np.ndarray, by: np.ndarray) -> None:
        self.at, self.by = np.r_[self.at, at], np.r_[self.by, by]
        if len(self.at) > 2 * MOST_STEPS:
            self.settle()

    def settle(self) -> None:
        """Ascending places; at most about MOST_STEPS of them."""
        if self.new:
            at, by = zip(*self.new, strict=True)
            self.at, self.by, self.new = np.r_[self.at, at], np.r_[self.by, np.array(by, np.int64)], []
        order = np.argsort(self.at, kind="stable")
        self.at, self.by = self.at[order], self.by[order]
        if len(self.at) > MOST_STEPS:
            above = np.cumsum(self.by[::-1])[::-1]  # a step and all above it
            band = np.floor(np.log(above.astype(float)) * FINE)
            last = np.r_[band[1:] != band[:-1], True]  # the highest of a band takes the others
            upto = np.r_[0, np.cumsum(self.by)]
            ends = np.flatnonzero(last)
            self.by = np.diff(upto[np.r_[0, ends + 1]])
            self.at = self.at[ends]

    def below(self, y: np.ndarray) -> np.ndarray:
        """By how much the rank of each y can be off: the steps whose place is above it."""
        self.settle()
        upto = np.r_[0, np.cumsum(self.by)]
        return upto[-1] - upto[np.searchsorted(self.at, y, side="right")]


class Sketch:
    """k: items in a section; a level holds 2 * k * its sections. The high tail is protected."""

    __slots__ = ("down", "k", "levels", "n", "seed", "states", "up")

    def __init__(self, k: int = 64, seed: int = 0) -> None:
        self.k, self.seed, self.n = k, seed, 0
        self.levels: list[list[np.ndarray]] = [[]]
        self.states = [0]
        self.up, self.down = Steps(), Steps()

    @classmethod
    def of(cls, k: int, n: int, seed: int, items: np.ndarray, sizes: np.ndarray, states: np.ndarray, *steps: np.ndarray) -> Sketch:
        s = cls(k, seed)
        s.n, s.states = n, [int(x) for x in states]
        s.levels = [[x] for x in np.split(items, np.cumsum(sizes)[:-1])]
        s.up, s.down = Steps(*steps[:2]), Steps(*steps[2:])
        return s

    @property
    def exact(self) -> bool:
        return len(self.levels) == 1

    def sections(self, h: int) -> int:
        return max(SECTIONS, self.states[h].bit_length() + 1)

    def capacity(self, h: int) -> int:
        return 2 * self.k * self.sections(h)

    def add(self, values: np.ndarray) -> None:
        """values: no NaN."""
        self.n += len(values)
        self.levels[0].append(values)
        if sum(map(len, self.levels[0])) > self.capacity(0):
            self.compress()

    def merge(self, n: int, seed: int, items: np.ndarray, sizes: np.ndarray, states: np.ndarray, up_at: np.ndarray, up_by: np.ndarray, down_at: np.ndarray, down_by: np.ndarray) -> None:
        self.n += n
        self.seed = _mixed(self.seed, seed) >> 1
        self.up.join(up_at, up_by)
        self.down.join(down_at, down_by)
        at = 0
        for h, size in enumerate(sizes):
            if h == len(self.levels):
                self.levels.append([])
                self.states.append(0)
            if size:
                self.levels[h].append(items[at : at + size])
            self.states[h] |= int(states[h])  # the rarer stretches of both stay due
            at += size
        if any(sum(map(len, level)) > self.capacity(h) for h, level in enumerate(self.levels)):
            self.compress()

    def compress(self) -> None:
        h = 0
        while h < len(self.levels):
            items = np.concatenate(self.levels[h]) if self.levels[h] else np.empty(0)
            while len(items) > self.capacity(h):
                items = self._compact(h, np.sort(items))
            self.levels[h] = [items]
            h += 1

    def _compact(self, h: int, items: np.ndarray) -> np.ndarray:
        state, sections = self.states[h], self.sections(h)
        trailing = (~state & (state + 1)).bit_length() - 1
        keep = self.k * sections + (sections - min(sections, trailing + 1)) * self.k
        if (len(items) - keep) % 2:
            keep += 1
        chosen, kept = items[: len(items) - keep], items[len(items) - keep :]
        if h + 1 == len(self.levels):
            self.levels.append([])
            self.states.append(0)
        # two coins in a row are opposite, so their errors tend to cancel
        coin = ((_mixed(self.seed, h, state >> 1) >> 40) ^ state) & 1
        self.levels[h + 1].append(chosen[coin::2])
        if chosen[0] < chosen[-1]:
            (self.down if coin else self.up).add(float(chosen[-1]), 1 << h)
        self.states[h] = state + 1
        return kept

    def row(self) -> tuple:
        parts = [np.concatenate(level) if level else np.empty(0) for level in self.levels]
        self.up.settle()
        self.down.settle()
        return self.n, self.seed, np.concatenate(parts), [len(p) for p in parts], self.states, self.up.at, self.up.by, self.down.at, self.down.by

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct items ascending, and the estimated number of values up to and including each."""
        parts = [np.concatenate(level) if level else np.empty(0) for level in self.levels]
        items = np.concatenate(parts)
        weights = np.repeat(1 << np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(items, kind="stable")
        items, upto = items[order], np.cumsum(weights[order])
        last = np.r_[items[1:] != items[:-1], True]
        return items[last], upto[last]

    def bounds(self, ranks: list[int]) -> list[tuple[float, float, float]]:
        """(lower, estimate, upper) of the value of each 1-based rank; lower < value unless equal to upper."""
        items, upto = self.ranks()
        least, most = upto - self.up.below(items), upto + self.down.below(items)
        most = np.minimum.accumulate(most[::-1])[::-1]  # ranks only rise
        out = []
        for rank in ranks:
            at = items[min(np.searchsorted(upto, rank), len(items) - 1)]
            if self.exact:
                out.append((at, at, at))
                continue
            below, above = np.searchsorted(most, rank) - 1, np.searchsorted(least, rank)
            out.append((items[below] if below >= 0 else -np.inf, at, items[above] if above < len(items) else np.inf))
        return out


def _as_batch(blocks: list[int], parts: list[int], keys: list[tuple], sketches: list[Sketch], key_types: list[pa.DataType]) -> pa.Table:
    rows = [s.row() for s in sketches]
    cols = [pa.array(blocks, pa.int32()), pa.array(parts, pa.int64()), *[pa.array([k[i] for k in keys], t) for i, t in enumerate(key_types)]]
    cols += [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
    cols += [pa.array([r[2 + i] for r in rows], pa.list_(t)) for i, t in enumerate(LISTS.values())]
    return pa.Table.from_arrays(cols, names=["block", "part", *[f"k{i}" for i in range(len(key_types))], *COLUMNS])


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    """n, seed and the lists of each row."""
    one = {c: table.column(c).combine_chunks() if isinstance(table, pa.Table) else table.column(c) for c in COLUMNS}
    one = {c: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for c, v in one.items()}
    flat = [(one[c].offsets.to_numpy(), one[c].values.to_numpy(zero_copy_only=False)) for c in LISTS]
    for i, (n, seed) in enumerate(zip(one["n"].to_pylist(), one["seed"].to_pylist(), strict=True)):
        yield n, seed, *[v[o[i] : o[i + 1]] for o, v in flat]


def _merged(table: pa.Table, n_keys: int, k: int) -> dict[tuple, Sketch]:
    found: dict[tuple, Sketch] = {}
    keys = list(zip(*[table[f"k{i}"].to_pylist() for i in range(n_keys)], strict=True))
    for key, row in zip(keys, _rows(table), strict=True):
        s = found.get(key)
        if s is None:
            found[key] = Sketch.of(k, *row)
        else:
            s.merge(*row)
    return found


def _reduced(partial: DataFrame, key_cols: list[tuple[str, str]], k: int, fan_in: int) -> DataFrame:
    """Merges partial sketches block-wise in levels of at most ``fan_in`` splits."""

    def merge(table: pa.Table) -> pa.Table:
        found = _merged(table, len(key_cols), k)
        block, part = table["block"][0].as_py(), table["part"][0].as_py() // fan_in
        types = [table.schema.field(f"k{i}").type for i in range(len(key_cols))]
        return _as_batch([block] * len(found), [part] * len(found), list(found), list(found.values()), types)

    last = reduce_parts(partial, merge, fan_in)
    return last.select(*[F.col(f"k{i}").alias(name) for i, (name, _) in enumerate(key_cols)], *COLUMNS)


def _types(df: DataFrame, keys: list[str]) -> list[tuple[str, str]]:
    if clash := set(keys) & set(COLUMNS):
        raise ValueError(f"a key can't have the name of a sketch's column: {', '.join(sorted(clash))}")
    return [(c, df.schema[c].dataType.simpleString()) for c in keys]


def sketches(rows: DataFrame, keys: list[str], value: str, *, k: int = 64, protect: str = "high", fan_in: int = 64) -> DataFrame:
    """One sketch per combination of ``keys``: the keys and COLUMNS.

    protect: the tail with the multiplicative error, 'high' or 'low' (a sketch of the negated
    values); it must be the same wherever the sketches are merged or read. Null and NaN values don't count; a null key is a key like any other; infinities count as
    the ends of the order. No rows give no sketches. Every split compacts what it reads before
    anything is shuffled, so a key with most rows weighs no more than others.
    """
    require(rows, value, *keys)
    if k < 4 or k % 2 or protect not in ("high", "low"):
        raise ValueError("k must be even and at least 4, protect 'high' or 'low'")
    n_blocks = 4 * default_parallelism(rows.sparkSession)
    types = _types(rows, keys)
    block = F.pmod(F.xxhash64(*keys), F.lit(n_blocks)).cast("int")
    narrow = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    narrow = narrow.select(block.alias("block"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], (F.col(value).cast("double") * (1.0 if protect == "high" else -1.0)).alias("v"))
    schema = "block int, part bigint, " + ", ".join(f"k{i} {t}" for i, (_, t) in enumerate(types)) + ", " + FIELDS

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        found: dict[tuple, list] = {}
        key_types, held = None, 0
        for b in batches:
            key_types = [b.schema.field(f"k{i}").type for i in range(len(types))]
            codes = np.zeros(b.num_rows, np.int64)
            for i in range(len(types)):
                own = b.column(f"k{i}").dictionary_encode("encode")
                codes = codes * (len(own.dictionary) + 1) + own.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0]) if len(order) else np.empty(0, np.int64)
            heads = b.take(pa.array(order[first]))
            tuples = list(zip(*[heads.column(f"k{i}").to_pylist() for i in range(len(types))], strict=True))
            v = b.column("v").to_numpy(zero_copy_only=False)[order]
            for key, blk, values in zip(tuples, heads.column("block").to_pylist(), np.split(v, first[1:]), strict=True):
                s = found.get(key)
                if s is None:
                    s = found[key] = (Sketch(k, _mixed(part, blk) >> 1), blk)
                s[0].add(values)
            held += b.num_rows
            if len(found) > 200_000 and held > 4 * len(found):
                yield from _as_batch([x[1] for x in found.values()], [part] * len(found), list(found), [x[0] for x in found.values()], key_types).to_batches()
                found, held = {}, 0
        if found:
            yield from _as_batch([x[1] for x in found.values()], [part] * len(found), list(found), [x[0] for x in found.values()], key_types).to_batches()

    return _reduced(narrow.mapInArrow(split, schema), types, k, fan_in)


def merge_sketches(parts: DataFrame, keys: list[str], *, k: int = 64, fan_in: int = 64) -> DataFrame:
    """Sketches of coarser ``keys`` from those of files, days or partitions (same k and tail)."""
    require(parts, *COLUMNS, *keys)
    n_blocks = 4 * default_parallelism(parts.sparkSession)
    types = _types(parts, keys)
    spread, n_parts = fan_in * fan_in, parts.count()
    while n_parts > spread * n_blocks:  # one key could own most of the sketches
        spread *= fan_in
    salt = F.pmod(F.xxhash64("items", "n"), F.lit(spread))
    rows = parts.select(F.pmod(F.xxhash64(*keys), F.lit(n_blocks)).cast("int").alias("block"), salt.alias("part"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], *COLUMNS)
    return _reduced(rows, types, k, fan_in)


def percentiles(parts: DataFrame, keys: list[str], qs: tuple[float, ...], *, k: int = 64, protect: str = "high") -> DataFrame:
    """Per sketch and q: n, ``rank`` (ceil(q n), 1 at least), ``lower``, ``estimate``, ``upper``.

    The value of that rank lies in [lower, upper], always. Works row by row, without a shuffle.
    """
    types = _types(parts, keys)
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("a percentile must lie in [0, 1]")
    sign = 1 if protect == "high" else -1
    schema = ", ".join([*[f"{c} {t}" for c, t in types], "n bigint", "q double", "rank bigint", "lower double", "estimate double", "upper double"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out: list[list] = [[] for _ in range(len(types) + 6)]
            heads = list(zip(*[b.column(c).to_pylist() for c, _ in types], strict=True)) if types else [()] * b.num_rows
            for key, row in zip(heads, _rows(b), strict=True):
                n = row[0]
                ranks = [max(1, int(np.ceil(q * n - 1e-9))) for q in qs]
                found = Sketch.of(k, *row).bounds(ranks if sign > 0 else [n - r + 1 for r in ranks])
                for q, rank, own in zip(qs, ranks, found, strict=True):
                    own = own if sign > 0 else tuple(-v for v in own[::-1])
                    for col, v in zip(out, (*key, n, q, rank, *own), strict=True):
                        col.append(v)
            arrow = [b.schema.field(c).type for c, _ in types] + [pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            names = [c for c, _ in types] + ["n", "q", "rank", "lower", "estimate", "upper"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, arrow, strict=True)], names=names)

    return parts.select(*keys, *COLUMNS).mapInArrow(read, schema)


SALTS = 16


def medians_above(rows: DataFrame, key: str, value: str, threshold: float, least_rows: int, *, k: int = 64) -> DataFrame:
    """Keys with ``least_rows`` values or more whose median (mean of the middle two) exceeds ``threshold``.

    The sketches' bounds decide nearly all keys. For the others an exact selection follows: their
    rows are salted, values below the bounds are counted as one, those above left out, and what
    lies between counted by value, so even a hot key sends little. ``rows`` is read twice.
    """
    require(rows, key, value)
    rows = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = cut(rows)
    middle = cut(_middle_bounds(sketches(rows, ["key"], "v", k=k), "key", k).where(F.col("n") >= least_rows))
    low, high = (F.col("lo1") + F.col("lo2")) / 2, (F.col("hi1") + F.col("hi2")) / 2
    sure = F.when(F.col("exact"), low > threshold).when(low >= threshold, True).when(high <= threshold, False)
    decided = middle.where(sure).select("key")
    open_ = middle.where(sure.isNull()).select(F.col("key").alias("open_key"), "n", "lo1", "hi2")
    if open_.isEmpty():
        return decided.select(F.col("key").alias(key))
    open_ = open_.withColumn("open_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    near = salted.join(open_, F.col("key").eqNullSafe(F.col("open_key")) & (F.col("salt") == F.col("open_salt"))).where(F.col("v") <= F.col("hi2"))
    near = near.select("key", "n", F.greatest("v", "lo1").alias("v")).groupBy("key", "n", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy("key").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    near = near.withColumn("upto", upto)
    at = lambda r: F.min(F.when(F.col("upto") >= r, F.col("v")))
    exact = near.groupBy("key").agg(((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2).alias("m"))
    return decided.unionByName(exact.where(F.col("m") > threshold).select("key")).select(F.col("key").alias(key))


def _middle_bounds(summary: DataFrame, key: str, k: int) -> DataFrame:
    """n, whether the sketch is exact, and the bounds of its two middle values."""
    kind = summary.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, exact = np.empty((b.num_rows, 4)), np.empty(b.num_rows, bool)
            for i, row in enumerate(_rows(b)):
                n = row[0]
                exact[i] = len(row[3]) == 1
                if exact[i]:
                    out[i] = np.sort(row[2])[[(n - 1) // 2] * 2 + [n // 2] * 2]
                    continue
                one, two = Sketch.of(k, *row).bounds([(n + 1) // 2, n // 2 + 1])
                out[i] = one[0], one[2], two[0], two[2]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("n"), pa.array(exact), *[pa.array(out[:, j]) for j in range(4)]], names=[key, "n", "exact", "lo1", "hi1", "lo2", "hi2"])

    return summary.select(key, *COLUMNS).mapInArrow(read, f"{key} {kind}, n bigint, exact boolean, lo1 double, hi1 double, lo2 double, hi2 double")
