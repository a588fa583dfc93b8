"""How demanding a notebook's prose is to read: features and an ordinal regression.

Prose is what the cells of kind text hold, as written before the layout escaped it. Counts of
sentences, words and letters come from code point classes for a whole batch at once; lexical
diversity, rarity, connectives and clause depth from the words. Rarity reads a table of hashed
word frequencies of the whole corpus, whose size is a parameter. The regression (cumulative
logits, L2) is fitted on the driver to judged documents, at most ``MOST_LABELS`` of them, and
calibrated to their grades on parts it was not fitted to.

No feature ever lowers the regression's score, and each counts within the range of the judged
documents only. So a score has a floor that every text with
sentences and words above given lengths reaches: what lies below it needs no exact check.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.llm.encoding import LETTER, SPACE, classes
from sylvaframe.operators.fanin import reduce_parts
from sylvaframe.schema import require
from sylvaframe.session import cut

MOST_LABELS = 20_000
BUCKETS = 1 << 18
FAN_IN = 64
WORD = re.compile(r"[^\W\d_]+")
#: Words that join clauses or subordinate them, in the corpus' languages.
JOINING = frozenset("and but so or while denn und aber oder mais et donc ou pero y o и но или".split())
SUBORDINATE = frozenset(
    "because although since that which when if whereas unless weil obwohl dass wenn während damit parce puisque que qui quand si bien tandis lorsque porque aunque mientras cuando como donde потому хотя что когда если который".split()
)
#: what the regression reads; more of any of them never lowers its score
FEATURES = ("words_per_sentence", "letters_per_word", "diversity", "rarity", "joining", "clause_depth", "commas", "long_words", "log_words")


def prose(text: str, cells: list[tuple[str | None, int | None, int | None]]) -> str:
    """The text cells of one notebook, unescaped, one after another."""
    out = []
    for kind, start, count in cells:
        if kind != "text" or start is None or not count or start < 0:
            continue
        body = text[start : start + count]
        before = text[max(0, start - 20) : start]
        if before.endswith('"source": "'):
            try:
                body = json.loads(f'"{body}"', strict=False)
            except ValueError:
                pass
        elif before.rstrip("\r\n").endswith("# %% [markdown]"):
            body = re.sub(r"(?m)^# ?", "", body)
        out.append(body)
    return "\n".join(out)


#: documents whose texts are Python strings at the same time
STRETCH = 256


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, STRETCH):
            yield b.slice(i, STRETCH)


def _proses(b: pa.RecordBatch) -> list[str]:
    """Prose of each row of (.., text, cells)."""
    texts, cells = b.column("text").to_pylist(), b.column("cells")
    inner = cells.flatten()
    kind, start, count = [inner.field(inner.type.get_field_index(c)).to_pylist() for c in ("cell_kind", "char_from", "char_count")]
    size = [0 if n is None else n for n in cells.value_lengths().to_pylist()]
    out, at = [], 0
    for t, n in zip(texts, size, strict=True):
        out.append(prose(t, list(zip(kind[at : at + n], start[at : at + n], count[at : at + n], strict=True))) if t and n else "")
        at += n
    return out


def count_prose(proses: list[str]) -> np.ndarray:
    """(sentences, words, letters) of each text, exactly."""
    joined = "".join(p + "\n" for p in proses)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.int32)
    size = np.array([len(p) + 1 for p in proses], np.int64)
    if not len(cp):
        return np.zeros((len(proses), 3), np.int64)
    doc = np.repeat(np.arange(len(proses)), size)
    kind = classes()[np.minimum(cp, 0x10FFFF)]
    letter = kind == LETTER
    first = letter & ~np.r_[False, letter[:-1]]
    # the line break put after each text is both its end and white space
    mark = ((cp == 0x2E) | (cp == 0x21) | (cp == 0x3F)) & np.r_[kind[1:] == SPACE, True]
    ends = mark | (cp == 0x0A) | (cp == 0x0D)
    segment = np.cumsum(ends) - ends
    at = np.flatnonzero(first)
    lead = at[np.r_[True, np.diff(segment[at]) != 0]] if len(at) else at
    n = len(proses)
    return np.stack([np.bincount(doc[lead], minlength=n), np.bincount(doc[at], minlength=n), np.bincount(doc[letter], minlength=n)], 1)


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def word_table(documents: DataFrame) -> np.ndarray:
    """How often the words of each hash bucket occur in the prose of all documents.

    Each split sends one array of BUCKETS numbers; they are summed in levels of bounded groups
    until one is left, which is all that reaches the driver.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(BUCKETS, np.int64)
        place: dict[str, int] = {}
        for b in _stretches(batches):
            seen: Counter = Counter()
            for p in _proses(b):
                seen.update(WORD.findall(p.lower()))
            for w, n in seen.items():
                k = place.get(w)
                if k is None:
                    k = place[w] = bucket(w)
                total[k] += n
            if len(place) > 1 << 20:
                place.clear()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total])], names=["block", "part", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, np.int64)
        for row in table["n"]:
            total += row.values.to_numpy()
        return pa.table({"block": pa.array([0], pa.int32()), "part": [table["part"][0].as_py() // FAN_IN], "n": pa.array([total])})

    rows = documents.select("text", "cells").mapInArrow(split, "block int, part bigint, n array<bigint>")
    found = reduce_parts(rows, add, FAN_IN).toArrow()
    return found["n"][0].values.to_numpy().copy() if found.num_rows else np.zeros(BUCKETS, np.int64)


def prose_features(documents: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_words, n_letters and FEATURES of each document. No shuffle."""
    require(documents, "doc_id", "text", "cells")
    table = word_table(documents)
    rare = -np.log((table + 1.0) / (table.sum() + BUCKETS))
    shared = documents.sparkSession.sparkContext.broadcast(rare.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        known: dict[str, tuple] = {}
        for b in _stretches(batches):
            proses = _proses(b)
            counts = count_prose(proses)
            out = np.zeros((len(proses), len(FEATURES)))
            for i, p in enumerate(proses):
                s, w, letters = counts[i].tolist()
                if not w or not s:
                    continue
                seen = Counter(WORD.findall(p.lower()))
                joining = sub = long = 0
                strange = 0.0
                for word, n in seen.items():
                    k = known.get(word)
                    if k is None:
                        k = known[word] = (float(rarity[bucket(word)]), word in JOINING, word in SUBORDINATE, len(word) > 9)
                    strange += n * k[0]
                    joining += n * k[1]
                    sub += n * k[2]
                    long += n * k[3]
                n = max(1, sum(seen.values()))
                out[i] = (w / s, letters / w, len(seen) / np.sqrt(n), strange / n, joining / n, 1 + (sub + joining) / s, p.count(",") / s, long / n, np.log1p(w))
            if len(known) > 1 << 20:
                known.clear()
            cols = [b.column(0), *[pa.array(counts[:, j]) for j in range(3)], *[pa.array(out[:, j]) for j in range(len(FEATURES))]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_sentences", "n_words", "n_letters", *FEATURES])

    schema = "doc_id bigint, n_sentences bigint, n_words bigint, n_letters bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    return documents.select("doc_id", "text", "cells").mapInArrow(run, schema)


class OrdinalRegression:
    """Cumulative logits: P(level <= k) = sigmoid(t (cut_k - x'w) + s), with an L2 penalty on w.

    Features are clipped to the range met in fitting; the first ``rising`` have weights of 0 or
    more. The scale t and shift s are 1 and 0 until ``calibrate`` has set them.
    """

    def __init__(self, n_levels: int = 5, penalty: float = 1.0, rising: int = 0) -> None:
        self.n_levels, self.penalty, self.rising = n_levels, penalty, rising
        self.scaling, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400) -> OrdinalRegression:
        """y: 1..n_levels. Projected gradient steps of adaptive size; the loss never rises."""
        self.low, self.high = x.min(0), x.max(0)
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        z = self._scaled(x)
        share = np.clip(np.cumsum(np.bincount(y, minlength=self.n_levels + 1)[1:])[:-1] / len(y), 0.02, 0.98)
        start = np.log(share / (1 - share))
        # cuts as a first one and logarithms of steps: they stay in order
        theta = np.r_[np.zeros(z.shape[1]), start[0], np.log(np.maximum(np.diff(start), 0.05))]
        rate, (loss, grad) = 0.5, self._loss(theta, z, y)
        for _ in range(steps):
            while rate > 1e-9:
                new = theta - rate * grad
                new[: self.rising] = np.maximum(new[: self.rising], 0.0)
                new_loss, new_grad = self._loss(new, z, y)
                if new_loss <= loss:
                    break
                rate /= 2
            if rate <= 1e-9 or loss - new_loss < 1e-10:
                break
            theta, loss, grad, rate = new, new_loss, new_grad, rate * 1.5
        self.w, self.cuts = self._parts(theta, z.shape[1])
        return self

    def held_out(self, x: np.ndarray, y: np.ndarray, parts: int = 5) -> np.ndarray:
        """Score of each row less the cuts, (n, n_levels - 1), by models fitted without its part."""
        out = np.zeros((len(x), self.n_levels - 1))
        for p in range(parts):
            own = np.arange(len(x)) % parts == p
            if own.any() and not own.all():
                m = OrdinalRegression(self.n_levels, self.penalty, self.rising).fit(x[~own], y[~own])
                out[own] = m.cuts[None, :] - m.scores(x[own])[:, None]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, parts: int = 5) -> np.ndarray:
        """Sets scale and shift by the likelihood of the held-out rows; returns their probabilities."""
        logits = self.held_out(x, y, parts)

        def loss(t: float, s: float) -> float:
            p = self._levels(t * logits + s)
            return float(-np.log(np.maximum(p[np.arange(len(y)), y - 1], 1e-12)).mean())

        best, width = (1.0, 0.0), 1.0
        while width > 0.01:
            t, s = best
            tried = [(max(0.05, t * f), s + d) for f in (1 - width / 2, 1.0, 1 + width) for d in (-width, 0.0, width)]
            new = min(tried, key=lambda v: (loss(*v), v != best))
            width = width / 2 if new == best else width
            best = new
        self.scaling, self.shift = best
        return self._levels(self.scaling * logits + self.shift)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return (np.clip(x, self.low, self.high) - self.mean) / self.scale

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(x) @ self.w

    def floor(self, least: dict[int, float]) -> float:
        """No row whose features named in ``least`` reach those values has a lower score.

        Holds for features with weights of 0 or more; for the others their whole range counts.
        """
        ends = np.stack([self._scaled(self.low[None])[0], self._scaled(self.high[None])[0]]) * self.w
        lowest = ends.min(0)
        for j, v in least.items():
            at = self.low.copy()
            at[j] = v
            if self.w[j] >= 0:
                lowest[j] = self._scaled(at[None])[0, j] * self.w[j]
        return float(lowest.sum()) - 1e-9

    def _parts(self, theta: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        return theta[:d], theta[d] + np.r_[0.0, np.cumsum(np.exp(np.clip(theta[d + 1 :], -30, 30)))]

    def _loss(self, theta: np.ndarray, z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        d, n = z.shape[1], len(y)
        w, cuts = self._parts(theta, d)
        upper, lower = np.r_[cuts, np.inf][y - 1] - z @ w, np.r_[-np.inf, cuts][y - 1] - z @ w
        sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
        a, b = np.where(np.isinf(upper), 1.0, sig(upper)), np.where(np.isinf(lower), 0.0, sig(lower))
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        g_w = ((da - db)[:, None] * z).sum(0) / n + self.penalty * w / n
        g_cut = np.zeros(self.n_levels - 1)
        np.add.at(g_cut, (y - 1)[y < self.n_levels], -da[y < self.n_levels] / n)
        np.add.at(g_cut, (y - 2)[y > 1], db[y > 1] / n)
        step = np.exp(np.clip(theta[d + 1 :], -30, 30))
        g = np.r_[g_w, g_cut.sum(), [g_cut[k + 1 :].sum() * step[k] for k in range(len(step))]]
        return float(-np.log(p).mean() + self.penalty * (w @ w) / 2 / n), g

    @staticmethod
    def _levels(logits: np.ndarray) -> np.ndarray:
        upto = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
        return np.diff(np.c_[np.zeros(len(logits)), upto, np.ones(len(logits))], axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._levels(self.scaling * (self.cuts[None, :] - self.scores(x)[:, None]) + self.shift)


def judged(labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """doc_id and its level: the mean of its raters' mean judgements, rounded; 1 to 5 only."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("reading_level").between(1, 5)).select("doc_id", "rater", "reading_level").distinct()
    by_rater = good.groupBy("doc_id", "rater").agg(F.avg("reading_level").alias("level"))
    by_doc = by_rater.groupBy("doc_id").agg(F.round(F.avg("level")).cast("int").alias("level"))
    return by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _training(features: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and levels of the judged documents with words, in order of doc_id."""
    train = features.where(F.col("n_words") > 0).join(judged(labels), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    return train[list(FEATURES)].to_numpy(np.float64), train["level"].to_numpy(np.int64)


def _model() -> OrdinalRegression:
    return OrdinalRegression(rising=len(FEATURES))


def reading_levels(documents: DataFrame, labels: DataFrame, least: dict[str, float] | None = None) -> DataFrame:
    """The features of each document, ``level`` (1 to 5, the most probable), ``demand`` (its mean) and ``score``.

    A document without cells, text or words has counts of 0 and null level, demand and score.
    Without any judged document all of these are null. Rows repeating a doc_id come out as
    often. With ``least`` (features and values) a column ``reaches`` tells whether a document's
    score reaches the floor of all texts with these values or more; it is true for all that do,
    and for all documents where there is no model.
    """
    features = cut(prose_features(documents))
    x, y = _training(features, labels)
    if not len(x):
        none = [F.lit(None).cast("int").alias("level"), *[F.lit(None).cast("double").alias(c) for c in ("demand", "score")]]
        return features.select("*", *none, *([F.lit(True).alias("reaches")] if least else []))
    model = _model().fit(x, y)
    model.calibrate(x, y)
    floor = model.floor({FEATURES.index(f): v for f, v in (least or {}).items()})
    names = features.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.stack([b.column(f).to_numpy() for f in FEATURES], 1) if b.num_rows else np.zeros((0, len(FEATURES)))
            p, score = model.probabilities(own), model.scores(own)
            none = b.column("n_words").to_numpy() == 0
            cols = [pa.array(p.argmax(1) + 1, pa.int32(), mask=none), pa.array(p @ np.arange(1, 6), mask=none), pa.array(score, mask=none)]
            if least:
                cols.append(pa.array(~none & (score >= floor)))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*names, "level", "demand", "score", *(["reaches"] if least else [])])

    schema = ", ".join(f"{c} {t}" for c, t in features.dtypes) + ", level int, demand double, score double" + (", reaches boolean" if least else "")
    return features.mapInArrow(run, schema)


def demanding(documents: DataFrame, labels: DataFrame, words: float = 20.0, letters: float = 6.0, sentences: int = 3) -> DataFrame:
    """doc_id of the documents with ``sentences`` or more, over ``words`` a sentence and over ``letters`` a word.

    The regression's scores name the candidates: its floor for such texts leaves none out. The
    counts, exact integers, decide. Each doc_id comes once.
    """
    least = {"words_per_sentence": words, "letters_per_word": letters, "log_words": float(np.log1p(words * sentences))}
    rows = reading_levels(documents, labels, least).where("reaches")
    found = rows.where((F.col("n_sentences") >= sentences) & (F.col("n_words") > words * F.col("n_sentences")) & (F.col("n_letters") > letters * F.col("n_words")))
    return found.select("doc_id").distinct()


def calibration(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per predicted level: judged documents, their mean predicted demand and mean judged level, all held out.

    ``right`` counts those whose predicted level is the judged one.
    """
    x, y = _training(cut(prose_features(documents)), labels)
    schema = "level int, n bigint, demand double, judged double, right bigint"
    spark = documents.sparkSession
    if not len(x):
        return spark.createDataFrame([], schema)
    p = _model().calibrate(x, y)
    level, demand = p.argmax(1) + 1, p @ np.arange(1, 6)
    rows = [(int(k), int((level == k).sum()), float(demand[level == k].mean()), float(y[level == k].mean()), int((y[level == k] == k).sum())) for k in np.unique(level)]
    return spark.createDataFrame(rows, schema)
