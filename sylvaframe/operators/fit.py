"""Shapes fitted to small groups of points: numpy kernels and the operators that run them.

A group is the points of one stem in one layer; the kernels see such groups only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaframe.session import default_parallelism

SECTORS = 73  # of a circle, for its completeness


def ellipse(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """(cx, cy, a, b, theta) by direct least squares, a >= b, theta in [0, pi); None if there is none."""
    if len(x) < 6:
        return None
    mx, my = x.mean(), y.mean()
    scale = np.sqrt((np.var(x) + np.var(y)) / 2)
    if not scale > 0:
        return None
    u, v = (x - mx) / scale, (y - my) / scale
    quad, lin = np.stack([u * u, u * v, v * v], 1), np.stack([u, v, np.ones_like(u)], 1)
    s1, s2, s3 = quad.T @ quad, quad.T @ lin, lin.T @ lin
    try:
        t = -np.linalg.solve(s3, s2.T)
        m = np.array([[0, 0, 0.5], [0, -1, 0], [0.5, 0, 0]]) @ (s1 + s2 @ t)
        values, vectors = np.linalg.eig(m)
    except np.linalg.LinAlgError:
        return None
    real = np.abs(values.imag) < 1e-9 * max(1.0, np.abs(values).max())
    k = vectors.real
    ok = np.flatnonzero(real & (4 * k[0] * k[2] - k[1] ** 2 > 0))
    if len(ok) != 1:
        return None
    a, b, c = k[:, ok[0]]
    d, e, f = t @ np.array([a, b, c])
    # centre, then the quadratic form's own axes
    q = np.array([[a, b / 2], [b / 2, c]])
    centre = np.linalg.solve(-2 * q, np.array([d, e]))
    rest = centre @ q @ centre - f
    value, axis = np.linalg.eigh(q)
    with np.errstate(invalid="ignore", divide="ignore"):
        size = np.sqrt(rest / value)
    if not np.isfinite(size).all():
        return None
    major = int(np.argmax(size))
    theta = np.arctan2(axis[1, major], axis[0, major]) % np.pi
    return centre[0] * scale + mx, centre[1] * scale + my, size[major] * scale, size[1 - major] * scale, float(theta)


def least_squares_circle(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float] | None:
    mx, my = x.mean(), y.mean()
    u, v = x - mx, y - my
    a = np.stack([2 * u, 2 * v, np.ones_like(u)], 1)
    s, _, rank, _ = np.linalg.lstsq(a, u * u + v * v, rcond=None)
    r2 = s[2] + s[0] ** 2 + s[1] ** 2
    return None if rank < 3 or r2 <= 0 else (s[0] + mx, s[1] + my, float(np.sqrt(r2)))


def robust_circle(x: np.ndarray, y: np.ndarray, low: float, high: float, *, band: float = 0.02, completeness: float = 0.3, tries: int = 256, seed: int = 0) -> tuple[float, float, float] | None:
    """(cx, cy, r) by random triples, refined on its inliers; radius within [low, high]."""
    n = len(x)
    if n < 3:
        return None
    mx, my = x.mean(), y.mean()
    u, v = x - mx, y - my
    rng = np.random.default_rng(seed)
    i, j, k = rng.integers(0, n, (3, tries))
    ax, ay, bx, by = u[j] - u[i], v[j] - v[i], u[k] - u[i], v[k] - v[i]
    den = 2 * (ax * by - ay * bx)
    ok = np.abs(den) > 1e-12
    i, ax, ay, bx, by, den = (w[ok] for w in (i, ax, ay, bx, by, den))
    a2, b2 = ax * ax + ay * ay, bx * bx + by * by
    px, py = (by * a2 - ay * b2) / den, (ax * b2 - bx * a2) / den
    r = np.hypot(px, py)
    ok = (r >= low) & (r <= high)
    px, py, r = px[ok] + u[i][ok], py[ok] + v[i][ok], r[ok]
    if not len(r):
        return None
    off = np.abs(np.hypot(u[None, :] - px[:, None], v[None, :] - py[:, None]) - r[:, None])
    score = (off <= band).sum(1)
    best = int(np.argmax(score))
    near = off[best] <= band
    circle = (px[best], py[best], r[best])
    if near.sum() >= 3:
        fine = least_squares_circle(u[near], v[near])
        if fine is not None and low <= fine[2] <= high:
            circle = fine
    angle = np.arctan2(v[near] - circle[1], u[near] - circle[0])
    seen = len(np.unique(((angle + np.pi) / (2 * np.pi) * SECTORS).astype(int) % SECTORS))
    if seen / SECTORS < completeness and near.sum() >= SECTORS:
        return None
    if near.sum() < SECTORS and seen < completeness * min(SECTORS, near.sum()):
        return None
    return circle[0] + mx, circle[1] + my, float(circle[2])


def spline_outline(theta: np.ndarray, r: np.ndarray, *, knots: int = 20, smooth: float = 0.6) -> np.ndarray:
    """Radii at 360 angles from -pi on of a cyclic penalised cubic spline r(theta)."""

    def basis(t: np.ndarray) -> np.ndarray:
        pos = (t + np.pi) / (2 * np.pi) * knots
        cell = np.floor(pos).astype(int)
        w = pos - cell
        parts = [(1 - w) ** 3 / 6, (3 * w**3 - 6 * w**2 + 4) / 6, (-3 * w**3 + 3 * w**2 + 3 * w + 1) / 6, w**3 / 6]
        out = np.zeros((len(t), knots))
        for k, p in enumerate(parts):
            np.add.at(out, (np.arange(len(t)), (cell + k) % knots), p)
        return out

    b = basis(theta)
    eye = np.eye(knots)
    second = np.roll(eye, -1, 1) - 2 * eye + np.roll(eye, 1, 1)
    coef = np.linalg.solve(b.T @ b + smooth * second.T @ second * max(1e-6, len(r) / 1000) + 1e-9 * eye, b.T @ r)
    return basis(np.linspace(-np.pi, np.pi, 360, endpoint=False)) @ coef


def outline_diameter(x: np.ndarray, y: np.ndarray, cx: float, cy: float, max_difference: float | None) -> float | None:
    """Diameter of the circle as large as the outline; None if the outline isn't plausible."""
    if len(x) < 8:
        return None
    r = spline_outline(np.arctan2(y - cy, x - cx), np.hypot(x - cx, y - cy))
    if (r < 0).any() or (max_difference is not None and r.max() - r.min() > max_difference):
        return None
    t = np.linspace(-np.pi, np.pi, 360, endpoint=False)
    px, py = r * np.cos(t), r * np.sin(t)
    area = abs((px * np.roll(py, -1) - np.roll(px, -1) * py).sum()) / 2
    return float(2 * np.sqrt(area / np.pi))


LAYER_SHAPES = "cloud_id string, stem_id bigint, layer int, mid_height double, n bigint, circle struct<cx:double,cy:double,r:double>, ellipse struct<cx:double,cy:double,a:double,b:double,theta:double>"


def _stretches(pdf: pd.DataFrame, keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a bucket of groups, each in order of x and y."""
    pdf = pdf.sort_values([*keys, "x", "y"], ignore_index=True)
    if len(pdf):
        new = np.flatnonzero((pdf[keys].ne(pdf[keys].shift())).any(axis=1).to_numpy())
        for lo, hi in zip(new, np.r_[new[1:], len(pdf)], strict=True):
            yield pdf.iloc[lo:hi]


def _bucket(points: DataFrame, keys: list[str]) -> Column:
    """Buckets of many small groups: a Python call per bucket, not per group."""
    return F.pmod(F.xxhash64(*keys), F.lit(4 * default_parallelism(points.sparkSession)))


def fit_layers(points: DataFrame, *, min_diameter: float = 0.02, max_diameter: float = 1.0, min_points: int = 15, ellipses: bool = True, least_ratio: float = 0.6, bandwidth: float = 0.01) -> DataFrame:
    """A circle and, where there is none, an ellipse per (cloud_id, stem_id, layer).

    points: cloud_id, stem_id, layer, mid_height, x, y. Layers with too few points are left out.
    A circle's points lie within twice the bandwidth of it.
    """
    keys = ["cloud_id", "stem_id", "layer"]
    names = [*keys, "mid_height", "n", "circle", "ellipse"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for own in _stretches(pdf, keys):
            if len(own) < min_points:
                continue
            x, y, head = own["x"].to_numpy(float), own["y"].to_numpy(float), own.iloc[0]
            c = robust_circle(x, y, min_diameter / 2, max_diameter / 2, band=2 * bandwidth, seed=int(head["stem_id"]) * 64 + int(head["layer"]))
            e = ellipse(x, y) if ellipses and c is None else None
            if e is not None and not (e[3] / e[2] >= least_ratio and min_diameter <= e[2] + e[3] <= max_diameter):
                e = None
            rows.append([*head[keys], head["mid_height"], len(x), c and dict(zip("cx cy r".split(), c, strict=True)), e and dict(zip("cx cy a b theta".split(), e, strict=True))])
        return pd.DataFrame(rows, columns=names)

    return points.select(*keys, "mid_height", "x", "y").groupBy(_bucket(points, keys)).applyInPandas(run, LAYER_SHAPES)


def fit_ellipses(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and the ellipse of each group (null where there is none)."""
    schema = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys) + ", n bigint, cx double, cy double, a double, b double, theta double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [[*own.iloc[0][keys], len(own), *(ellipse(own["x"].to_numpy(float), own["y"].to_numpy(float)) or (None,) * 5)] for own in _stretches(pdf, keys)]
        return pd.DataFrame(rows, columns=[*keys, "n", "cx", "cy", "a", "b", "theta"])

    return points.select(*keys, "x", "y").groupBy(_bucket(points, keys)).applyInPandas(run, schema)


def best_combination(diameter: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, max_std: float, max_std_position: float | None) -> tuple[int, ...] | None:
    """The k of n layers whose diameters agree best, if well enough; the first of equals."""
    if len(diameter) < k:
        return None
    combos = np.array(list(combinations(range(len(diameter)), k)))
    spread = diameter[combos].std(1)
    ok = spread <= max_std
    if max_std_position is not None:
        ok &= (x[combos].std(1) <= max_std_position) & (y[combos].std(1) <= max_std_position)
    if not ok.any():
        return None
    return tuple(int(i) for i in combos[np.argmin(np.where(ok, spread, np.inf))])


def stable_layers(layers: DataFrame, k: int = 6, max_std: float = 0.04, max_std_position: float | None = None) -> DataFrame:
    """The layers of each stem's best combination: circles, or ellipses where circles fail.

    layers: cloud_id, stem_id, layer, mid_height, cx, cy, r, ex, ey, a, b. Up to 15 layers a stem.
    """
    schema = "cloud_id string, stem_id bigint, layer int, mid_height double, x double, y double, diameter double, is_circle boolean"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("layer")
        for is_circle, cols in ((True, ("cx", "cy", "r")), (False, ("ex", "ey", "a", "b"))):
            have = pdf[(pdf[list(cols[2:])] > 0).all(axis=1)]
            x, y = have[cols[0]].to_numpy(float), have[cols[1]].to_numpy(float)
            d = 2 * have["r"].to_numpy(float) if is_circle else (have["a"] + have["b"]).to_numpy(float)
            best = best_combination(d, x, y, k, max_std, max_std_position)
            if best is not None:
                i = list(best)
                return pd.DataFrame({"cloud_id": key[0], "stem_id": key[1], "layer": have["layer"].to_numpy()[i], "mid_height": have["mid_height"].to_numpy()[i], "x": x[i], "y": y[i], "diameter": d[i], "is_circle": is_circle})
        return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return layers.groupBy("cloud_id", "stem_id").applyInPandas(run, schema)


def stem_positions(stable: DataFrame, height: float = 1.3) -> DataFrame:
    """x and y of each stem at breast height, by lines over its stable layers."""
    from sylvaframe.operators.groups import fit_line

    keys = ["cloud_id", "stem_id"]
    px = fit_line(stable, keys, "mid_height", "x", height).select(*keys, F.col("predicted").alias("x"))
    py = fit_line(stable, keys, "mid_height", "y", height).select(*keys, F.col("predicted").alias("y"))
    d = fit_line(stable, keys, "mid_height", "diameter", height).select(*keys, F.col("predicted").alias("diameter"))
    return px.join(py, keys).join(d, keys)


def outline_diameters(points: DataFrame, stable: DataFrame, max_difference: float | None = 0.3) -> DataFrame:
    """Stable layers with the diameter of their outline where that is plausible.

    points: cloud_id, stem_id, layer, x, y around the layer's shape.
    """
    near = points.select("cloud_id", "stem_id", "layer", F.col("x").alias("px"), F.col("y").alias("py")).join(stable, ["cloud_id", "stem_id", "layer"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["px", "py"])
        d = outline_diameter(pdf["px"].to_numpy(float), pdf["py"].to_numpy(float), pdf["x"].iloc[0], pdf["y"].iloc[0], max_difference)
        return pd.DataFrame([[*key, d]], columns=["cloud_id", "stem_id", "layer", "outline"])

    found = near.groupBy("cloud_id", "stem_id", "layer").applyInPandas(run, "cloud_id string, stem_id bigint, layer int, outline double")
    return stable.join(found, ["cloud_id", "stem_id", "layer"], "left").withColumn("diameter", F.coalesce("outline", "diameter")).drop("outline")
