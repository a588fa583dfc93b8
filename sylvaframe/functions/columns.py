"""Column expressions for points, rasters and shapes; none of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUNK, CROWN, BRANCH = 1, 2, 3


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def is_tree_point(cls: Column | str = "cls", branches: bool = True) -> Column:
    """Trunk, crown and, if wanted, branch points; null classes are none."""
    return F.coalesce(_c(cls).isin(TRUNK, CROWN, *([BRANCH] if branches else [])), F.lit(False))


def in_band(h: Column | str, low: float, high: float) -> Column:
    """low <= h < high."""
    return (_c(h) >= low) & (_c(h) < high)


def is_candidate(h: Column | str, threshold: float) -> Column:
    return _c(h) >= threshold


def remap_class(mapping: dict[tuple, int], *keys: Column | str) -> Column:
    """Looks up one or more class columns; a combination that isn't listed is null."""
    listed = F.create_map(*[x for k, v in mapping.items() for x in (F.lit("|".join(map(str, k))), F.lit(v))])
    return F.try_element_at(listed, F.concat_ws("|", *[F.coalesce(_c(k).cast("string"), F.lit("null")) for k in keys]))


def remap_invalid(label: Column | str, invalid: int) -> Column:
    """-1 becomes ``invalid``; with 0 as the invalid id, valid ids move up by one."""
    label = _c(label)
    return F.when(label < 0, F.lit(invalid)).otherwise(label + (1 if invalid == 0 else 0))


def in_ellipse(x: Column | str, y: Column | str, cx, cy, a, b, theta) -> Column:
    """Inside or on the ellipse with semi-axes a (turned by theta from +x) and b."""
    dx, dy = _c(x) - _c(cx), _c(y) - _c(cy)
    u = dx * F.cos(_c(theta)) + dy * F.sin(_c(theta))
    v = dy * F.cos(_c(theta)) - dx * F.sin(_c(theta))
    return (u / _c(a)) * (u / _c(a)) + (v / _c(b)) * (v / _c(b)) <= 1


def polygon_area(vertices: Column | str) -> Column:
    """Area of a closed polygon given as array<struct<x,y>> in order (shoelace)."""
    v = _c(vertices)
    nxt = lambda i: F.element_at(v, F.when(i + 1 == F.size(v), 1).otherwise(i + 2).cast("int"))
    terms = F.transform(v, lambda p, i: p["x"] * nxt(i)["y"] - nxt(i)["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def polar(x, y, cx, cy) -> Column:
    """struct<r, theta> about a centre."""
    dx, dy = _c(x) - _c(cx), _c(y) - _c(cy)
    return F.struct(F.hypot(dx, dy).alias("r"), F.atan2(dy, dx).alias("theta"))


def cell_index(c: Column | str, size: float, origin=0.0) -> Column:
    return F.floor((_c(c) - _c(origin)) / size)


def truncated_index(c: Column | str, size: float, origin=0.0) -> Column:
    """Towards zero, as for positions on a raster."""
    return ((_c(c) - _c(origin)) / size).cast("bigint")


def layer_bounds(n_layers: int, start: float, height: float, overlap: float) -> Column:
    """array<struct<layer, low, high, mid>> of overlapping layers."""
    step = height - overlap
    layer = lambda i: F.struct(F.lit(i).alias("layer"), F.lit(start + i * step).alias("low"), F.lit(start + i * step + height).alias("high"), F.lit(start + i * step + height / 2).alias("mid"))
    return F.array(*[layer(i) for i in range(n_layers)])


def hex_to_rgba(code: Column | str) -> Column:
    """struct<r, g, b, a> in 0..1 from '#RRGGBB' or 'RRGGBB'; null for anything else."""
    h = F.regexp_replace(F.upper(_c(code)), "^#", "")
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("double") / 255
    return F.when(h.rlike("^[0-9A-F]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), F.lit(1.0).alias("a")))


def scale_z(points: DataFrame, factor: float) -> DataFrame:
    if factor == 0:
        raise ValueError("factor must not be 0")
    return points.withColumn("z", F.col("z") / factor)
