import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylvaframe.llm import clusters, kmeans, lexicon, quantiles, reading
from sylvaframe.llm.encoding import DEFAULT_RANKS, Encoder, encode_corpus, token_counts
from sylvaframe.llm.packing import container_table, pack
from sylvaframe.llm.splitting import found_strips, split_oversized

COLS = "cloud_id string, file_id string, point_id bigint, x double, y double, z double, cls bigint, instance_id bigint"


def cloud(spark, p, file="f", cls=1, start=0):
    rows = [("c", file, start + i, float(a), float(b), float(c), cls, 7) for i, (a, b, c) in enumerate(p)]
    return spark.createDataFrame(rows, COLS)


# ---- splitting -----------------------------------------------------------------------------------


def test_pieces(spark):
    rng = np.random.default_rng(1)
    p = np.r_[rng.uniform(0, 10, (300, 3)), rng.uniform(0, 10, (300, 3)) + [20, 0, 0], np.tile([40.0, 5, 1], (250, 1))]
    df = cloud(spark, p).unionByName(cloud(spark, p[:20], "small", start=5000))
    df = df.unionByName(df.limit(100)).withColumn("piece", F.lit(1)).withColumn("n", F.lit(1))
    got = split_oversized(df, limit=100, margin=1.0).toPandas()
    core = got[~got.is_margin]
    assert sorted(core.point_id) == [*range(850), *range(5000, 5020)]
    assert core.groupby(["file_id", "piece_id"]).size().max() <= 100
    big = core[core.file_id == "f"].set_index("point_id")
    assert set(big.loc[range(300)].piece_id).isdisjoint(big.loc[range(300, 600)].piece_id)
    box = big.join(df.select("point_id", "x", "y").distinct().toPandas().set_index("point_id")).groupby("piece_id").agg(lx=("x", "min"), hx=("x", "max"), ly=("y", "min"), hy=("y", "max"))
    want = {(k, i) for k, b in box.iterrows() for i, (x, y, _) in enumerate(p) if big.piece_id[i] != k and max(b.lx - x, x - b.hx, 0) ** 2 + max(b.ly - y, y - b.hy, 0) ** 2 <= 1}
    assert {tuple(r) for r in got[got.is_margin][["piece_id", "point_id"]].itertuples(index=False)} == want
    assert split_oversized(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, limit=0)


def pieces(spark, p, limit, file="f"):
    got = split_oversized(cloud(spark, p, file), limit=limit, margin=0.0).toPandas()
    assert sorted(got.point_id) == list(range(len(p))) and got.groupby("piece_id").size().max() <= limit
    return got.set_index("point_id").piece_id


def test_tiles_leave_no_cuts(spark):
    """A patch across a tile's edge is one piece; a strip beside the edge is cut rather than the edge."""
    rng = np.random.default_rng(6)
    far = [[0.0, 0, 0], [2000.0, 0, 0]]
    patch = np.c_[rng.uniform(374, 394, 200), rng.uniform(0, 20, 200), np.zeros(200)]
    rest = np.c_[rng.uniform(600, 700, 900), rng.uniform(0, 20, 900), np.zeros(900)]
    got = pieces(spark, np.r_[far, patch, rest], 1000)
    assert got.loc[range(2, 202)].nunique() == 1
    left, right = np.c_[rng.uniform(300, 360, 300), rng.uniform(0, 20, 300), np.zeros(300)], np.c_[rng.uniform(370, 398, 900), rng.uniform(0, 20, 900), np.zeros(900)]
    got = pieces(spark, np.r_[far, left, right], 1000)
    assert got.loc[range(302, 1202)].nunique() == 1 and got.loc[range(2, 302)].nunique() == 1 and got[2] != got[302]


def test_a_place_that_most_points_share(spark):
    rng = np.random.default_rng(8)
    p = np.r_[np.tile([[5.0, 5.0, 0.0]], (2500, 1)), np.c_[5 + rng.uniform(0, 0.3, 400), 5 + rng.uniform(0, 0.3, 400), np.zeros(400)]]
    assert pieces(spark, p, 100).nunique() <= 2 * len(p) / 100


def test_strips(spark):
    p = [(0, 0, 0)] * 3 + [(3.0, 0, 0), (6.001, 0, 0), (6.001, 9.0, 0), (float("nan"), 4, 0)]
    assert sorted(tuple(r) for r in found_strips(cloud(spark, p), limit=5).collect()) == [("f", "x", 3, 4), ("f", "y", 0, 5)]
    assert found_strips(cloud(spark, p), limit=6).count() == 0


# ---- clusters ------------------------------------------------------------------------------------


def brute_groups(p, d=1.5, s=2.5, least=5):
    dist = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    found = set()
    for i in range(len(p)):
        g = np.flatnonzero(dist[i] <= s)
        if len(g) >= least and dist[np.ix_(g, g)].max() <= d and all(set(np.flatnonzero(dist[k] <= s)) == set(g) for k in g):
            found |= {(int(g.min()), int(k)) for k in g}
    return found


@pytest.mark.parametrize("seed", range(3))
def test_tight_groups(spark, seed):
    rng = np.random.default_rng(seed)
    parts = [rng.uniform(0, 60, (1, 3)) + rng.uniform(-w, w, (rng.integers(3, 12), 3)) for w in rng.uniform(0.1, 0.7, 60)]
    p = np.round(np.r_[np.concatenate(parts), rng.uniform(0, 60, (40, 3)), np.tile([8.0, 8.0, 8.0], (6, 1))], 3)
    df = cloud(spark, p).withColumn("cluster", F.lit(3)).withColumn("g", F.lit(0))
    got = {tuple(r) for r in clusters.tight_groups(df.unionByName(df.limit(50))).collect()}
    assert got == brute_groups(p) and got


def test_kmeans_describes_all(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(0, 3, (400, 3))
    labelled, divided = clusters.fine_clusters(clusters.trunk_points(cloud(spark, p)), k=5)
    d = clusters.describe(labelled).join(divided, "cluster").collect()
    assert {r.parent for r in d} == set(range(5))
    assert sum(r["size"] for r in d) == 400 and all(1 <= len(r.typical) <= 3 for r in d)
    assert all(r.labels[0].label == 7 for r in d)
    assert clusters.tight_groups(cloud(spark, p).where("false")).count() == 0
    none = spark.createDataFrame([(None, "f", 1, 0.0, 0.0, 0.0, 1, None), ("c", "f", 2, None, 0.0, 0.0, 1, None), ("c", "f", 3, 0.0, 0.0, 0.0, None, 1)], COLS)
    assert clusters.tight_groups(none).count() == 0


def test_hashed_features(spark):
    rows = [(1.0, 2.0, "a"), (1.0, 2.0, "b"), (None, float("nan"), None), (0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, c string")
    f = [r.f for r in df.select(kmeans.hashed_features({"x": 2.0, "y": 0.5}, {"c": 3.0}, 8).alias("f")).collect()]
    assert all(len(v) == 8 for v in f) and f[2] == f[3] and sorted(map(abs, f[3]))[-2:] == [0, 3]
    diff = np.array(f[0]) - np.array(f[1])
    assert set(np.abs(diff[diff != 0])) <= {3.0, 6.0}
    alone = df.limit(1).select(kmeans.hashed_features({"x": 2.0, "y": 0.5}, size=4).alias("f")).first().f
    assert sorted(map(abs, alone)) == [0, 0, 1, 2]


def test_kmeans_finds_separate_clusters(spark):
    rng = np.random.default_rng(0)
    middle = rng.uniform(0, 100, (12, 4))
    x = np.concatenate([m + rng.normal(0, 0.2, (200 if i else 3000, 4)) for i, m in enumerate(middle)])  # one owns most
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id bigint, a double, b double, c double, d double").repartition(6)
    rows = df.select("id", F.lit(1.0).alias("w"), kmeans.hashed_features(dict.fromkeys("abcd", 1.0), size=4).alias("features"))
    model = kmeans.fit(rows, 12, rounds=4, oversample=2.0)
    assert all(b <= a * 1.000001 for a, b in zip(model.costs, model.costs[1:], strict=False)) and model.costs[-1] < 1.5 * len(x) * 4 * 0.04
    got = kmeans.typical_members(kmeans.assign(rows, model, "id"), "id").collect()
    assert sorted(r["size"] for r in got) == [200] * 11 + [3000]
    for r in got:
        own = {0 if t < 3000 else 1 + (t - 3000) // 200 for t in r.typical}
        assert len(own) == 1 and len(r.typical) == 3
    assert kmeans.fit(rows.where("false"), 3) is None
    assert len(kmeans.fit(rows.where("id < 2"), 5).centres) <= 2
    same = rows.withColumn("features", F.array(*[F.lit(1.0)] * 4))
    assert kmeans.fit(same, 3).costs[-1] == 0.0
    with pytest.raises(ValueError):
        kmeans.fit(rows, 10_000_000)


# ---- percentiles ---------------------------------------------------------------------------------


def sketch_of(parts, k):
    """Splits merged one by one, as they come out of a table."""
    whole = None
    for i, part in enumerate(parts):
        t = quantiles.Sketch(k, i)
        for q in np.array_split(part, 3):
            t.add(q)
        row = [np.array(c) if isinstance(c, list) else c for c in t.row()]
        if whole is None:
            whole = quantiles.Sketch.of(k, *row)
        else:
            whole.merge(*row)
    return whole


@pytest.mark.parametrize("order", ["random", "ascending", "descending", "ties"])
def test_sketch_bounds_always_hold(order):
    rng = np.random.default_rng(3)
    v = rng.lognormal(0, 2, 60_000)
    v = {"random": v, "ascending": np.sort(v), "descending": np.sort(v)[::-1], "ties": np.round(v)}[order]
    s = sketch_of(np.array_split(v, 7), 32)
    assert s.n == 60_000 and len(s.row()[2]) < 6000
    o = np.sort(v)
    qs = (0.001, 0.01, 0.5, 0.9, 0.99, 0.999, 0.9999, 1.0)
    ranks = [int(np.ceil(q * 60_000)) for q in qs]
    for q, rank, (lo, est, hi) in zip(qs, ranks, s.bounds(ranks), strict=True):
        assert lo <= o[rank - 1] <= hi
        tail = 60_000 - rank + 1
        off = max(0, np.searchsorted(o, est) + 1 - rank, rank - np.searchsorted(o, est, side="right"))
        assert off <= max(0.05 * tail, 1), q


def test_stated_error_is_relative_to_the_tail():
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, 5_000_000)
    s, o = sketch_of(np.array_split(v, 256), 64), np.sort(v)
    for q, most in ((0.5, 0.05), (0.99, 0.05), (0.999, 0.03), (0.9999, 0.05)):
        rank = int(np.ceil(q * len(v)))
        ((lo, _, hi),) = s.bounds([rank])
        assert lo <= o[rank - 1] <= hi
        assert np.searchsorted(o, hi) - np.searchsorted(o, lo) <= most * (len(v) - rank + 1)
    assert len(s.row()[2]) < 20_000 and len(s.up.at) + len(s.down.at) <= 4 * quantiles.MOST_STEPS


def test_sketch_cases(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", None), ("b", float("nan")), (None, 2.0), ("a", float("inf"))]
    df = spark.createDataFrame(rows, "k string, z double").withColumn("items", F.lit("clash")).withColumn("part", F.lit(0))
    made = quantiles.sketches(df, ["k"], "z")
    got = {(r.k, r.q): (r.n, r.lower, r.upper) for r in quantiles.percentiles(made, ["k"], (0.0, 0.5, 1.0)).collect()}
    assert got["a", 0.5] == (3, 1.0, 1.0) and got["a", 1.0] == (3, float("inf"), float("inf")) and got[None, 0.0] == (1, 2.0, 2.0) and len(got) == 6
    assert quantiles.sketches(df.where("false"), ["k"], "z").count() == 0
    assert quantiles.merge_sketches(made.where("false"), ["k"]).count() == 0
    with pytest.raises(ValueError):
        quantiles.sketches(df.withColumn("n", F.lit(1)), ["n"], "z")


def test_low_tail(spark):
    df = spark.range(50_000).select(F.lit(1).alias("k"), (F.col("id") % 49_999).cast("double").alias("z"))
    got = {r.q: r for r in quantiles.percentiles(quantiles.sketches(df, ["k"], "z", k=16, protect="low"), ["k"], (0.0, 0.001, 0.5), k=16, protect="low").collect()}
    assert got[0.0].lower == 0 and got[0.0].upper <= 1 and got[0.001].lower <= 48 <= got[0.001].upper <= 60


def test_medians_above(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        n = int(rng.integers(5, 40))
        rows += [(k, round(float(x), 3)) for x in rng.normal(12 + rng.normal(0, 1), 0.5, n)]
    rows += [(100, round(float(x), 3)) for x in rng.normal(12.0005, 3, 100_000)] + [(105, round(float(x), 3)) for x in rng.normal(12.5, 0.3, 20_000)] + [(101, 12.0)] * 2000 + [(102, 11.0), (102, 13.0)] * 900 + [(103, 11.0), (103, 13.002)] * 900
    rows += [(104, None), (104, float("nan")), (None, 20.0)]
    df = spark.createDataFrame(rows, "k bigint, z double").withColumn("v", F.lit("clash")).withColumn("n", F.lit(0))
    by: dict = {}
    for k, z in rows:
        if z is not None and z == z:
            by.setdefault(k, []).append(z)
    want = {k for k, z in by.items() if k is not None and len(z) >= 10 and np.median(z) > 12.0}
    got = {r.k for r in quantiles.medians_above(df.repartition(5), "k", "z", 12.0, 10, k=16).collect()}
    assert got == want
    assert quantiles.medians_above(df.where("false"), "k", "z", 12.0, 10).count() == 0


def test_sketches_of_days_merge(spark):
    rows = [(i % 3, i % 5, float(i)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "k bigint, day bigint, z double").repartition(6)
    days = quantiles.sketches(df, ["k", "day"], "z", k=16)
    whole = quantiles.percentiles(quantiles.merge_sketches(days, ["k"], k=16), ["k"], (0.0, 0.5, 0.99), k=16).collect()
    assert len(whole) == 9
    for r in whole:
        exact = sorted(float(i) for i in range(30_000) if i % 3 == r.k)[r["rank"] - 1]
        assert r.n == 10_000 and r.lower <= exact <= r.upper


# ---- encoding ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    ranks = lexicon.read_ranks(DEFAULT_RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(tmp_path_factory):
    ranks = lexicon.read_ranks(DEFAULT_RANKS)
    words = [w for w in ranks if len(w) < 8][:8000]
    path = tmp_path_factory.mktemp("lex") / "l.bin"
    path.write_bytes(lexicon.Lexicon.of(words, ranks).to_bytes())
    return Encoder(lexicon.Lexicon.open(str(path)))


ODD = ["", " ", "'", "a'sabc 'll x''s '", "  \n\n x  y  ", "it's 'tis we'll'd I'VE", "\x1c\x1d a\x85b", "don't\n 's", "a '", "\t\tfoo\r\n\r\n  bar", "١٢٣ ²½ Ⅷ一二", "é́ नमस्ते 👩‍👩‍👧 <|endoftext|>", "x" * 5000, " 　 a"]


def test_ids_equal_the_library(encoder, reference):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices(" '\n\tsdmtlvre xyz12.\xa0é日", k=rng.randint(0, 40))) for _ in range(3000)]
    got = encoder.encode(pa.array(texts, pa.large_string())).to_pylist()
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert encoder.counts(pa.array(texts, pa.large_string())).tolist() == [len(x) for x in got]


def test_lexicon_numbers_its_words():
    words = sorted({b"a", b"ab", b"abc", b"b", b"bc", "é".encode(), b"zabc", b"zab"})
    lex = lexicon.Lexicon.of(words, lexicon.read_ranks(DEFAULT_RANKS))
    asked = [*words, b"", b"abcd", b"z", b"\xff", b"bb"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    end = np.cumsum([len(w) for w in asked])
    got = lex.number(data, end - [len(w) for w in asked], end)
    assert got.tolist() == [*range(len(words)), *[lexicon.UNKNOWN] * 5]


def test_encode_corpus(spark, reference):
    rows = [(1, "A tree. A tree."), (2, None), (3, ""), (1, "A tree. A tree."), (None, "x"), (4, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = encode_corpus(df).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((i or 0, reference.encode_ordinary(t or "")) for i, t in rows)
    n = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert (n[2], n[3], n[4]) == (0, 0, len(reference.encode_ordinary(rows[-1][1])))
    assert encode_corpus(df.where("false")).count() == 0


# ---- packing -------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(7)
    rows = [(i, int(rng.lognormvariate(4, 1.2))) for i in range(4000)] + [(9001, None), (9002, 0), (9003, -5), (9004, 12_345), (1, 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("container_id", F.lit(0)).withColumn("size", F.lit(0))
    got = pack(df, 1000, fan_in=2).toPandas()
    fill = got.groupby("container_id").n_tokens.sum()
    assert fill.max() <= 1000
    want = sum(max(0, n or 0) for _, n in rows)
    assert got.n_tokens.sum() == want and len(got[got.doc_id == 9004]) == 13
    assert (got[(got.part_no > 0) | got.doc_id.duplicated(keep=False)].doc_id.isin([1, 9004, *[i for i, n in rows if n and n > 1000]])).all()
    assert set(got.doc_id) == {i for i, _ in rows}
    assert len(fill) <= 1.02 * want / 1000 + 1
    assert container_table(pack(df, 1000)).where("fill > 1000").count() == 0
    assert pack(df.where("false"), 10).count() == 0


# ---- reading -------------------------------------------------------------------------------------


def test_prose_is_unescaped():
    t = '{"cells": [{"cell_type": "markdown", "source": "One \\"two\\".\\nThree é"}]}'
    at = t.index("One")
    assert reading.prose(t, [("text", at, t.index('"}') - at)]) == 'One "two".\nThree é'
    t = "# %% [markdown]\n# A line.\n#\n# - b\n\n# %%\ncode"
    assert reading.prose(t, [("text", 16, 17), ("code", 40, 4), (None, 0, 3), ("text", None, 1), ("text", 5, None)]) == "A line.\n\n- b"
    assert reading.prose("plain", [("text", 0, 99)]) == "plain"


def test_counts():
    texts = ["One two. Three! 3.5 x?y\nend", "", "...", "a.b c", "Ä ö.", "no end", "one.\n\n. two"]
    got = reading.count_prose(texts).tolist()
    assert [g[0] for g in got] == [4, 0, 0, 1, 1, 1, 2]
    assert [g[1] for g in got] == [6, 0, 0, 3, 2, 2, 2]
    assert got[0][2] == len("OneTwoThreexyend")


def test_ordinal_regression_holds_out():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (600, 4))
    y = np.clip(np.round(3 + x @ np.array([1.0, -0.7, 0.3, 0.0]) + rng.normal(0, 0.3, 600)), 1, 5).astype(int)
    m = reading.OrdinalRegression().fit(x[:400], y[:400])
    p = m.probabilities(x[400:])
    assert np.allclose(p.sum(1), 1) and (np.abs(p.argmax(1) + 1 - y[400:]) <= 1).mean() > 0.97
    assert (p.argmax(1) + 1 == y[400:]).mean() > 0.6


def test_floor_and_calibration():
    rng = np.random.default_rng(4)
    x = rng.gamma(2, 1, (900, 4))
    y = np.clip(np.round(1 + x[:, 0] * 0.8 + x[:, 1] * 0.5 - x[:, 2] * 0.2 + rng.normal(0, 0.4, 900)), 1, 5).astype(int)
    m = reading.OrdinalRegression(rising=4).fit(x[:600], y[:600])
    p = m.calibrate(x[:600], y[:600])
    assert (m.w >= 0).all() and abs((p @ np.arange(1, 6)).mean() - y[:600].mean()) < 0.1
    q = m.probabilities(x[600:])
    demand = q @ np.arange(1, 6)
    for lo, hi in ((1, 2), (2, 3), (3, 4), (4, 5.01)):  # mean judgement of what is predicted alike
        own = (demand >= lo) & (demand < hi)
        assert own.sum() > 10 and abs(demand[own].mean() - y[600:][own].mean()) < 0.25
    far = rng.gamma(2, 3, (5000, 4))  # beyond what was judged, too
    floor = m.floor({0: 2.0, 1: 3.0})
    case = (far[:, 0] >= 2) & (far[:, 1] >= 3)
    score = m.scores(far)
    assert (score[case] >= floor).all() and (score[~case] < floor).any()


def test_reading_levels(spark):
    cell = "array<struct<cell_no:int,cell_kind:string,exec_count:int,char_from:int,char_count:int>>"
    easy, hard = "The cat sat. The dog ran. We saw it.", "Notwithstanding considerable methodological heterogeneity, investigators demonstrated reproducibility, although, because instrumentation deteriorated, quantification remained problematic throughout."
    rows = [(i, t, [(0, "text", None, 0, len(t))]) for i, t in enumerate([easy, hard] * 6)] + [(50, None, None), (51, "x", None), (52, "", []), (53, "code", [(0, "code", 1, 0, 4), None])]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, cells {cell}").withColumn("level", F.lit("clash"))
    labels = spark.createDataFrame([(i, "a", 1 + 4 * (i % 2)) for i in range(8)] + [(0, "b", None), (0, "a", 1), (999, "a", 3), (1, "c", 9)], "doc_id bigint, rater string, reading_level int")
    got = {r.doc_id: r for r in reading.reading_levels(docs, labels).collect()}
    assert len(got) == 16 and got[10].level == 1 and got[11].level == 5
    assert all(got[i].level is None and got[i].n_words == 0 for i in (50, 51, 52, 53))
    assert reading.reading_levels(docs, labels.where("false")).where("level is not null").count() == 0
    found = sorted(r.doc_id for r in reading.demanding(docs, labels, words=10, sentences=1).collect())
    assert found == [1, 3, 5, 7, 9, 11] == sorted(r.doc_id for r in reading.demanding(docs, labels.where("false"), words=10, sentences=1).collect())
    assert sum(r.n for r in reading.calibration(docs, labels).collect()) == 8 and reading.calibration(docs, labels.where("false")).count() == 0
    assert reading.reading_levels(docs.where("false"), labels).count() == 0
