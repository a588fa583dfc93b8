"""A byte-level BPE vocabulary as a transducer of words, and exact merging of all other words.

The vocabulary's rank file gives byte sequences and ids. ``Merges`` merges any word exactly as
the ranks say, many words at a time. ``Lexicon`` is a minimal acyclic automaton over the bytes of
known words: equal suffixes share their states, transitions carry the number of words skipped,
so the sum along a path numbers the word, and a table of ids by number is the output. All of it
is one flat array of integers, written to a file and memory-mapped by whoever reads it.
"""

from __future__ import annotations

import base64
import io

import numpy as np

#: The vocabulary's contractions.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
MAGIC = 0x5359_4C56
UNKNOWN = -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """Exact byte-pair merging: the pair of lowest rank first, the leftmost of equals."""

    def __init__(self, byte_ids: np.ndarray, keys: np.ndarray, merged: np.ndarray) -> None:
        self.byte_ids, self.keys, self.merged = byte_ids, keys, merged

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Merges:
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        size = 1 << (2 * len(pairs)).bit_length()
        keys, merged = np.full(size, -1, np.int64), np.full(size, np.iinfo(np.int32).max, np.int64)
        for key, rank in pairs.items():
            at = cls._hash(key, size)
            while keys[at] >= 0:
                at = (at + 1) & (size - 1)
            keys[at], merged[at] = key, rank
        return cls(np.array([ranks[bytes([i])] for i in range(256)], np.int64), keys, merged)

    @staticmethod
    def _hash(key: int, size: int) -> int:
        return (key * 0x9E3779B97F4A7C15 >> 30 & 0x3FFFFFFF) & (size - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank, which is also the id, of each pair; the largest int32 where there is none."""
        none = np.iinfo(np.int32).max
        size = len(self.keys)
        key = a << 20 | b
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(30)) & np.uint64((size - 1) & 0x3FFFFFFF)).astype(np.int64)
        out = np.full(len(key), none, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            seen = self.keys[at[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.merged[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
            at[todo] = (at[todo] + 1) & (size - 1)
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words in one array, ids per word)."""
        sizes = np.array([len(w) for w in words], np.int64)
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # words, their ids
        edges = [0, 4, 8, 12, 16, 24, 32, 48, 64, 96, 128]
        for lo, hi in zip(edges, edges[1:], strict=False):
            at = np.flatnonzero((sizes > lo) & (sizes <= hi))
            for i in range(0, len(at), 8192):
                part = at[i : i + 8192]
                ids, n = self._merge_table([words[j] for j in part.tolist()], sizes[part])
                counts[part] = n
                found.append((part, ids))
        for k in np.flatnonzero(sizes > edges[-1]):
            ids = self._merge_long(words[k])
            counts[k] = len(ids)
            found.append((np.array([k]), ids))
        start = np.r_[0, np.cumsum(counts)]
        flat = np.empty(start[-1], np.int64)
        for part, ids in found:
            n = counts[part]
            upto = np.r_[0, np.cumsum(n)][:-1]
            flat[np.arange(len(ids)) + np.repeat(start[part] - upto, n)] = ids
        return flat, counts

    def _merge_table(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words of a similar size at once: rows of symbols, chained past merged ones."""
        n, width = len(words), int(sizes.max())
        none = np.iinfo(np.int32).max
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        sym = self.byte_ids[raw]
        cols = np.arange(width)
        alive = cols[None, :] < sizes[:, None]
        nxt = np.broadcast_to(cols + 1, (n, width)).copy()
        prv = np.broadcast_to(cols - 1, (n, width)).copy()
        rank = np.full((n, width), none, np.int64)  # of the pair that starts here
        pair = cols[None, :] + 1 < sizes[:, None]
        r, c = np.nonzero(pair)
        rank[r, c] = self.rank(sym[r, c], sym[r, c + 1])
        rows = np.arange(n)
        while len(rows):
            best = rank[rows].argmin(1)
            ok = rank[rows, best] != none
            rows, best = rows[ok], best[ok]
            if not len(rows):
                break
            gone = nxt[rows, best]
            sym[rows, best] = rank[rows, best]
            alive[rows, gone] = False
            rank[rows, gone] = none
            after = nxt[rows, gone]
            nxt[rows, best] = after
            inside = after < sizes[rows]
            prv[rows[inside], after[inside]] = best[inside]
            rank[rows, best] = none
            r, b, a = rows[inside], best[inside], after[inside]
            rank[r, b] = self.rank(sym[r, b], sym[r, a])
            before = prv[rows, best]
            has = before >= 0
            r, b, p = rows[has], best[has], before[has]
            rank[r, p] = self.rank(sym[r, p], sym[r, b])
        return sym[alive], alive.sum(1)

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One word of any length, with a heap of pairs."""
        import heapq

        none = np.iinfo(np.int32).max
        sym = self.byte_ids[np.frombuffer(word, np.uint8)]
        first = self.rank(sym[:-1], sym[1:])
        sym = sym.tolist()
        n = len(sym)
        nxt, prv, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        known: dict[tuple[int, int], int] = {}

        def rank(i: int) -> int:
            key = (sym[i], sym[nxt[i]])
            if key not in known:
                known[key] = int(self.rank(np.array([key[0]]), np.array([key[1]]))[0])
            return known[key]

        heap = [(int(r), i, 0) for i, r in enumerate(first) if r != none]
        heapq.heapify(heap)
        while heap:
            r, i, v = heapq.heappop(heap)
            if v != version[i]:
                continue
            gone = nxt[i]
            sym[i], version[i], version[gone] = r, v + 1, -1
            nxt[i] = nxt[gone]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r2 := rank(i)) != none:
                    heapq.heappush(heap, (r2, i, version[i]))
            if (p := prv[i]) >= 0:
                version[p] += 1
                if (r2 := rank(p)) != none:
                    heapq.heappush(heap, (r2, p, version[p]))
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = nxt[i]
        return np.array(out, np.int64)


def build_automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, skip, final) of the minimal acyclic automaton of sorted distinct words.

    base, check: a double array, the child by byte b of state s is at base[s] + b if check says
    s. skip: words that sort before a transition among those of its state. final: word ends here.
    """
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, tuple]] = []  # (final, ((byte, node), ...)) of finished states

    def finish(final: bool, children: list) -> int:
        key = (final, tuple(children))
        if key not in register:
            register[key] = len(nodes)
            nodes.append(key)
        return register[key]

    # states of the path of the last word: [final, [(byte, node), ...]]; the open child comes last
    path: list[list] = [[False, []]]
    last = b""
    for w in words:
        same = 0
        while same < min(len(last), len(w)) and last[same] == w[same]:
            same += 1
        for depth in range(len(last), same, -1):
            final, children = path.pop()
            path[-1][1].append((last[depth - 1], finish(final, children)))
        path.extend([False, []] for _ in range(len(w) - same))
        path[-1][0] = True
        last = w
    for depth in range(len(last), 0, -1):
        final, children = path.pop()
        path[-1][1].append((last[depth - 1], finish(final, children)))
    root = finish(*path[0])
    # number of words below each node; children were finished before their parents
    below = np.zeros(len(nodes), np.int64)
    for i, (final, children) in enumerate(nodes):
        below[i] = final + sum(below[c] for _, c in children)
    size = 1 << 16
    check, base, skip, final = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    # a state's slot belongs to one transition; shared states get one slot per incoming transition
    used = np.zeros(size, bool)
    used[0] = True
    taken = np.zeros(size, bool)  # no two states have the same base, so check tells them apart
    shared: dict[int, int] = {}  # node -> base, children are laid out once and checked by base
    todo, at_free = [(root, 0)], 1
    while todo:
        node, slot = todo.pop()
        is_final, children = nodes[node]
        final[slot] = is_final
        if not children:
            base[slot] = -1
            continue
        if node in shared:
            base[slot] = shared[node]
            continue
        bytes_ = np.array([b for b, _ in children])
        lead = int(bytes_[0])
        window = at_free
        while True:
            if window + 4096 + 512 >= size:
                grow = size
                check, base = np.r_[check, np.full(grow, -1, np.int64)], np.r_[base, np.zeros(grow, np.int64)]
                skip, final = np.r_[skip, np.zeros(grow, np.int64)], np.r_[final, np.zeros(grow, np.int64)]
                used, taken = np.r_[used, np.zeros(grow, bool)], np.r_[taken, np.zeros(grow, bool)]
                size += grow
            free = np.flatnonzero(~used[window : window + 4096]) + window - lead  # the first child's slot is free
            free = free[free > 0]
            free = free[~taken[free]]
            for b in bytes_[1:]:
                free = free[~used[free + b]]
            if len(free):
                start = int(free[0])
                break
            window += 4096
        while used[at_free]:
            at_free += 1
        if len(children) > 1 and window > at_free + 8 * 4096:
            at_free += 4096  # slots that nothing has fitted into for long
        shared[node] = base[slot] = start
        taken[start] = True
        before = int(is_final)
        for b, c in children:
            used[start + b] = True
            check[start + b] = start
            skip[start + b] = before
            before += int(below[c])
            todo.append((c, start + b))
    return base, check, skip, final


class Lexicon:
    """Words with their ids; looks up many words at once."""

    def __init__(self, base: np.ndarray, check: np.ndarray, skip: np.ndarray, final: np.ndarray, offsets: np.ndarray, ids: np.ndarray, merges: Merges) -> None:
        self.base, self.check, self.skip, self.final, self.offsets, self.ids, self.merges = base, check, skip, final, offsets, ids, merges

    @classmethod
    def of(cls, words: list[bytes], ranks: dict[bytes, int]) -> Lexicon:
        merges = Merges.of(ranks)
        words = sorted(set(words) - {b""})
        flat, counts = merges.merge(words)
        return cls(*build_automaton(words), np.r_[0, np.cumsum(counts)], flat, merges)

    def _parts(self) -> list[np.ndarray]:
        return [self.base, self.check, self.skip, self.final, self.offsets, self.ids, self.merges.byte_ids, self.merges.keys, self.merges.merged]

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(p, np.int64) for p in self._parts()]
        out = io.BytesIO()
        out.write(np.array([MAGIC, *map(len, parts)], np.int64).tobytes())
        for p in parts:
            out.write(p.tobytes())
        return out.getvalue()

    @classmethod
    def open(cls, path: str) -> Lexicon:
        whole = np.memmap(path, np.int64, mode="r")
        if whole[0] != MAGIC:
            raise ValueError(f"{path} holds no lexicon")
        edges = np.cumsum([10, *whole[1:10]])
        parts = [np.asarray(whole[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        return cls(*parts[:6], Merges(*parts[6:]))

    def number(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of the word data[start:end] for each pair, UNKNOWN for words not in it."""
        n = len(start)
        state, total, result = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, UNKNOWN, np.int64)
        live, pos = np.arange(n), start.astype(np.int64).copy()
        size = len(self.check)
        while len(live):
            ended = pos[live] == end[live]
            out = live[ended]
            result[out] = np.where(self.final[state[out]] == 1, total[out], UNKNOWN)
            live = live[~ended]
            base = self.base[state[live]]
            to = np.clip(base + data[pos[live]], 0, size - 1)
            ok = (base >= 0) & (self.check[to] == base)
            live, to = live[ok], to[ok]
            total[live] += self.skip[to]
            state[live] = to
            pos[live] += 1
        return result
