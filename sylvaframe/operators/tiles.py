"""Kernels on tiles of rasters: windows with a halo, and halos widened until neighbours agree.

A raster is rows (group, ix, iy, ..). A tile's window holds its own cells and a halo of cells
around; a kernel sees one window as rows, so its task is bounded by the window's area, empty
tiles cost nothing, and one far-off cell makes one small window more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.session import cut, packed_cut, sweep

TILE = 256


def windows(raster: DataFrame, tile: int, halo: int, group: str = "cloud_id") -> DataFrame:
    """Each cell once for every tile with cells of its own whose window holds it, with tx, ty."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    own = raster.select(group, *[F.floor(F.col(f"i{c}") / tile).alias(f"t{c}") for c in "xy"]).distinct()
    return raster.withColumn("tx", span("ix")).withColumn("ty", span("iy")).join(own, [group, "tx", "ty"], "left_semi")


def own_cells(pdf: pd.DataFrame, tile: int, ring: int = 0) -> np.ndarray:
    """Mask of the rows whose cell lies in the window's tile or at most ``ring`` cells around it."""
    out = np.ones(len(pdf), bool)
    for c, t in (("ix", "tx"), ("iy", "ty")):
        start = pdf[t].to_numpy() * tile
        out &= (pdf[c].to_numpy() >= start - ring) & (pdf[c].to_numpy() < start + tile + ring)
    return out


def by_tiles(raster: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, halo: int, group: str = "cloud_id", tile: int = TILE) -> DataFrame:
    """``kernel`` on each window that has cells of its own; it must return rows of its own cells only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not own_cells(pdf, tile).any():
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return kernel(pdf)

    return windows(raster, tile, halo, group).groupBy(group, "tx", "ty").applyInPandas(run, schema)


def agreed(raster: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], values: dict[str, str], *, halo: int, tolerance: float = 0.0, most: int | None = None, group: str = "cloud_id", tile: int = TILE, packed: bool = False) -> DataFrame:
    """group, ix, iy and ``values`` of all cells, from windows wide enough that neighbouring tiles agree.

    kernel: a window's rows to its cells (ix, iy, values). What a tile says of the ring of cells
    around it is compared with what their own tiles say. Tiles that disagree by more than
    ``tolerance`` are done again with twice the halo, in the end with the whole group in the window,
    or with ``most`` cells of halo where a kernel only approximates what no window can decide.
    With ``packed`` the cells are kept packed: less disk, some more time in Python.
    """
    names = list(values)
    schema = f"{group} string, tx bigint, ty bigint, ix bigint, iy bigint, is_own boolean, " + ", ".join(f"{c} {t}" for c, t in values.items())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not own_cells(pdf, tile).any():
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        out = kernel(pdf).assign(tx=pdf["tx"].iloc[0], ty=pdf["ty"].iloc[0])
        out = out[own_cells(out, tile, 1)]
        return out.assign(is_own=own_cells(out, tile), **{group: pdf[group].iloc[0]})[[c.split()[0] for c in schema.split(", ")]]

    keep = packed_cut if packed else cut
    raster = keep(raster)
    span = raster.agg(F.max(F.col("ix")) - F.min("ix"), F.max(F.col("iy")) - F.min("iy")).first()
    widest = max(span[0] or 0, span[1] or 0) + 1
    if packed:
        sweep(raster.sparkSession)
    whole = keep(windows(raster, tile, halo, group).groupBy(group, "tx", "ty").applyInPandas(run, schema))
    if packed:
        sweep(raster.sparkSession)
    while most is None or halo < most:  # a tile done with the widest halo is right, so each round leaves fewer that are not
        edge = F.lit(False)  # the ring around a tile lies on its neighbours' edges
        for c in "xy":
            edge = edge | F.pmod(F.col(f"i{c}"), F.lit(tile)).isin(0, tile - 1)
        own = whole.where(F.col("is_own") & edge).select(F.col(group).alias("g"), F.col("ix").alias("jx"), F.col("iy").alias("jy"), F.col("tx").alias("ox"), F.col("ty").alias("oy"), *[F.col(c).alias(f"own_{c}") for c in names])
        ring = whole.where(~F.col("is_own"))
        differs = F.lit(False)
        for c in names:
            differs = differs | (F.abs(F.col(c) - F.col(f"own_{c}")) > tolerance) | (F.col(c).isNull() != F.col(f"own_{c}").isNull())
        met = ring.join(own, (F.col(group) == F.col("g")) & (F.col("ix") == F.col("jx")) & (F.col("iy") == F.col("jy"))).where(differs)
        bad = cut(met.select(group, F.explode(F.array(F.struct("tx", "ty"), F.struct(F.col("ox").alias("tx"), F.col("oy").alias("ty")))).alias("t")).select(group, "t.*").distinct())
        if bad.isEmpty():
            break
        halo = min(2 * halo, widest, most or widest)
        again = windows(raster, tile, halo, group).join(bad, [group, "tx", "ty"], "left_semi").groupBy(group, "tx", "ty").applyInPandas(run, schema)
        whole = keep(whole.join(bad, [group, "tx", "ty"], "left_anti").unionByName(again))
        if packed:
            del own, ring, met, again
            sweep(raster.sparkSession)
    return whole.where("is_own").select(group, "ix", "iy", *names)
