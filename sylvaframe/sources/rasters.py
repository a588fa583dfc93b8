"""Rasters as image files: heights as GeoTIFF, labels as colour PNG, one file per tile of a cloud.

A task writes one tile, so no raster is ever held whole; a file is written under another name
first, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.functions.colors import BACKGROUND, palette
from sylvaframe.schema import require
from sylvaframe.sources import files

NO_DATA = -9999.0
WRITTEN = "cloud_id string, tx bigint, ty bigint, file string"


def geotiff(image: np.ndarray, x: float, y: float, cell: float) -> bytes:
    """A float32 GeoTIFF; image rows run from north to south, (x, y) is the outer corner of the first one."""
    data = np.ascontiguousarray(image, "<f4").tobytes()
    height, width = image.shape
    scale, tie, none = struct.pack("<3d", cell, cell, 0), struct.pack("<6d", 0, 0, 0, x, y, 0), f"{NO_DATA:g}\0".encode()
    keys = struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 1, 1025, 0, 1, 1)  # projected, pixels are areas
    short, long_, text, double = 3, 4, 2, 12
    tags = [(256, long_, 1, width), (257, long_, 1, height), (258, short, 1, 32), (259, short, 1, 1), (262, short, 1, 1), (273, long_, 1, None), (277, short, 1, 1), (278, long_, 1, height), (279, long_, 1, len(data)), (339, short, 1, 3)]
    extra = [(33550, double, 3, scale), (33922, double, 6, tie), (34735, short, 12, keys), (42113, text, len(none), none)]
    at = 8 + 2 + 12 * (len(tags) + len(extra)) + 4
    place, tail = {}, b""
    for tag, _, _, raw in extra:
        place[tag] = at + len(tail)
        tail += raw + b"\0" * (len(raw) % 2)
    start = at + len(tail)
    out = struct.pack("<2sHIH", b"II", 42, 8, len(tags) + len(extra))
    for tag, kind, n, value in tags:
        out += struct.pack("<HHII", tag, kind, n, start if value is None else value)
    for tag, kind, n, raw in extra:
        out += struct.pack("<HHI", tag, kind, n) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", place[tag]))
    return out + struct.pack("<I", 0) + tail + data


def png(image: np.ndarray) -> bytes:
    """A PNG of (rows, columns, 4) bytes."""
    height, width = image.shape[:2]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(height, -1)], 1)
    chunk = lambda kind, raw: struct.pack(">I", len(raw)) + kind + raw + struct.pack(">I", zlib.crc32(kind + raw))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def _tiled(raster: DataFrame, tile: int) -> DataFrame:
    return raster.withColumns({f"t{c}": F.floor(F.col(f"i{c}") / tile) for c in "xy"})


def write_heights(dtm: DataFrame, folder: str, cell: float, *, x0: float = 0.0, y0: float = 0.0, tile: int = 1024) -> DataFrame:
    """A GeoTIFF per tile of each cloud's raster (cloud_id, ix, iy, h); the rows name the files.

    The files are written when the rows are read. Cells without a row or with a null height hold
    NO_DATA; the smallest height holds where a cell comes twice.
    """
    require(dtm, "cloud_id", "ix", "iy", "h")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cloud, tx, ty = pdf["cloud_id"].iloc[0], int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        pdf = pdf.dropna(subset=["h"]).sort_values("h", ascending=False)
        image = np.full((tile, tile), NO_DATA, np.float32)
        image[tile - 1 - (pdf["iy"].to_numpy(int) - ty * tile), pdf["ix"].to_numpy(int) - tx * tile] = pdf["h"]
        name = files.join(folder, f"{cloud}_{tx}_{ty}.tif")
        files.write(name, geotiff(image, x0 + tx * tile * cell, y0 + (ty + 1) * tile * cell, cell))
        return pd.DataFrame({"cloud_id": [cloud], "tx": [tx], "ty": [ty], "file": [name]})

    return _tiled(dtm.where("cloud_id IS NOT NULL AND ix IS NOT NULL AND iy IS NOT NULL").select("cloud_id", "ix", "iy", "h"), tile).groupBy("cloud_id", "tx", "ty").applyInPandas(run, WRITTEN)


def write_tree_maps(labels: DataFrame, folder: str, positions: DataFrame | None = None, *, tile: int = 1024) -> DataFrame:
    """A PNG per tile of each cloud's label raster (cloud_id, ix, iy, label), trees by colour, positions black.

    positions: cloud_id, ix, iy. The files are written when the rows are read, which name them.
    """
    require(labels, "cloud_id", "ix", "iy", "label")
    rows = labels.select("cloud_id", "ix", "iy", F.col("label").cast("bigint").alias("label"))
    if positions is not None:
        rows = rows.unionByName(positions.select("cloud_id", "ix", "iy", F.lit(-1).cast("bigint").alias("label")))
    colors = np.array([*palette(), BACKGROUND, (0, 0, 0, 255)], np.uint8)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cloud, tx, ty = pdf["cloud_id"].iloc[0], int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        pdf = pdf.sort_values("label", ascending=False)  # positions last, on top
        label = pdf["label"].to_numpy(int)
        number = np.where(label > 0, (label - 1) % (len(colors) - 2), np.where(label < 0, len(colors) - 1, len(colors) - 2))
        image = np.full((tile, tile), len(colors) - 2)
        image[tile - 1 - (pdf["iy"].to_numpy(int) - ty * tile), pdf["ix"].to_numpy(int) - tx * tile] = number
        name = files.join(folder, f"{cloud}_{tx}_{ty}.png")
        files.write(name, png(colors[image]))
        return pd.DataFrame({"cloud_id": [cloud], "tx": [tx], "ty": [ty], "file": [name]})

    return _tiled(rows.where("cloud_id IS NOT NULL AND ix IS NOT NULL AND iy IS NOT NULL"), tile).groupBy("cloud_id", "tx", "ty").applyInPandas(run, WRITTEN)
