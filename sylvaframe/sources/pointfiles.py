"""Point cloud files: CSV with odd headers, PLY and LAS by the Python data source API, and sinks.

Files are split by file; a file's points are read in blocks, so a task holds one block only.
LAZ needs a codec that Spark's environment lacks and is not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sylvaframe.sources import files as FS

BLOCK = 1 << 18
#: PLY scalar types, and the length of a LAS point record by format.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
LAS_SIZES = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36, 8: 38}
EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
LAS_CLASS_AT = {0: 15, 1: 15, 2: 15, 3: 15, 6: 16, 7: 16, 8: 16}


def read_csv_points(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """A CSV or text file with a header such as '//X'; names come out in lower case, all values as doubles.

    A value that is no number is null. ``columns`` projects after the names are normalised.
    """
    raw = spark.read.csv(path, header=True, sep=sep)
    names = [re.sub(r"^/+", "", c).strip().lower() for c in raw.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"header names are not unique: {names}")
    df = raw.toDF(*names)
    return df.select(*[F.col(c).try_cast("double").alias(c) for c in (columns or names)])


class PlyHeader:
    """Properties of the vertices of a PLY file; scalar properties only."""

    def __init__(self, path: str) -> None:
        with FS.open_read(path) as f:
            lines, element = [], None
            self.n, self.props = 0, []
            while (line := f.readline()) and not line.startswith(b"end_header"):
                lines.append(line)
                word = line.decode("ascii", "replace").split()
                if word[:1] == ["format"]:
                    self.format = word[1]
                elif word[:1] == ["element"]:
                    element = word[1]
                    if element == "vertex":
                        self.n = int(word[2])
                elif word[:1] == ["property"] and element == "vertex":
                    self.props.append((word[2], PLY_TYPES[word[1]]))
            self.at = f.tell()
        if not lines or not lines[0].startswith(b"ply"):
            raise ValueError(f"{path} is no PLY file")


class PlyReader(DataSourceReader):
    def __init__(self, files: list[str]) -> None:
        self.files = files
        self.names = [n for n, _ in PlyHeader(files[0]).props]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((f, i)) for f in self.files for i in range(0, max(1, PlyHeader(f).n), BLOCK)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, start = partition.value
        head = PlyHeader(path)
        n = min(BLOCK, head.n - start)
        if n <= 0:
            return
        if head.format == "ascii":
            with FS.open_read(path) as f:
                f.seek(head.at)
                for _ in range(start):
                    f.readline()
                rows = np.array([f.readline().split()[: len(head.props)] for _ in range(n)], float)
            cols = {name: rows[:, i] for i, (name, _) in enumerate(head.props)}
        else:
            order = "<" if "little" in head.format else ">"
            kind = np.dtype([(name, order + t) for name, t in head.props])
            with FS.open_read(path) as f:
                f.seek(head.at + start * kind.itemsize)
                table = np.frombuffer(f.read(n * kind.itemsize), kind)
            cols = {name: table[name] for name in kind.names}
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(cols[c], np.float64)) if c in cols else pa.nulls(n, pa.float64()) for c in self.names], names=self.names)


class PlySource(DataSource):
    """spark.read.format("ply").load(path): one double column per vertex property."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return ", ".join(f"`{n}` double" for n, _ in PlyHeader(FS.files(self.options["path"])[0]).props)

    def reader(self, schema) -> PlyReader:
        return PlyReader(FS.files(self.options["path"]))


class LasHeader:
    def __init__(self, path: str) -> None:
        with FS.open_read(path) as f:
            h = f.read(375)
        if h[:4] != b"LASF":
            raise ValueError(f"{path} is no LAS file")
        self.at, = struct.unpack_from("<I", h, 96)
        self.format, self.size = h[104] & 0x3F, struct.unpack_from("<H", h, 105)[0]
        if h[104] & 0x80:
            raise ValueError(f"{path} is compressed (LAZ), which is not supported")
        self.n = struct.unpack_from("<I", h, 107)[0] or (struct.unpack_from("<Q", h, 247)[0] if len(h) >= 255 else 0)
        self.scale, self.offset = struct.unpack_from("<3d", h, 131), struct.unpack_from("<3d", h, 155)
        self.extra: list[tuple[str, int, str]] = []  # name, place in the record, type
        base = LAS_SIZES.get(self.format)
        with FS.open_read(path) as f:
            f.seek(struct.unpack_from("<H", h, 94)[0])
            for _ in range(struct.unpack_from("<I", h, 100)[0]):
                head = f.read(54)
                body = f.read(struct.unpack_from("<H", head, 20)[0])
                if base is None or not head[2:18].startswith(b"LASF_Spec") or struct.unpack_from("<H", head, 18)[0] != 4:
                    continue
                at = base
                for i in range(0, len(body), 192):
                    kind = EXTRA_TYPES.get(body[i + 2])
                    if kind is None:  # an undocumented field: what follows can't be placed
                        break
                    self.extra.append((body[i + 4 : i + 36].rstrip(b"\0").decode("utf-8", "replace"), at, kind))
                    at += np.dtype(kind).itemsize


class LasReader(DataSourceReader):
    def __init__(self, files: list[str]) -> None:
        self.files = files
        self.extra = [n for n, _, _ in LasHeader(files[0]).extra]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((f, i)) for f in self.files for i in range(0, max(1, LasHeader(f).n), BLOCK)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, start = partition.value
        h = LasHeader(path)
        n = min(BLOCK, h.n - start)
        if n <= 0:
            return
        with FS.open_read(path) as f:
            f.seek(h.at + start * h.size)
            raw = np.frombuffer(f.read(n * h.size), np.uint8).reshape(n, h.size)
        xyz = np.ascontiguousarray(raw[:, :12]).view("<i4").astype(np.float64) * h.scale + h.offset
        intensity = np.ascontiguousarray(raw[:, 12:14]).view("<u2")[:, 0].astype(np.float64)
        cls = raw[:, LAS_CLASS_AT.get(h.format, 15)] & (0xFF if h.format >= 6 else 0x1F)
        more = {}
        for name, at, kind in h.extra:
            v = np.ascontiguousarray(raw[:, at : at + np.dtype(kind).itemsize]).view(kind)[:, 0]
            more[name] = pa.array(v.astype(np.float64))
        extra = [more.get(n, pa.nulls(n_rows, pa.float64())) for n_rows in [n] for n in self.extra]
        yield pa.RecordBatch.from_arrays([*[pa.array(xyz[:, k]) for k in range(3)], pa.array(intensity), pa.array(cls.astype(np.int64)), *extra], names=["x", "y", "z", "intensity", "classification", *self.extra])


class LasWriter(DataSourceArrowWriter):
    """One LAS file per task; nothing appears under its name before all of it is written."""

    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        batches = list(iterator)
        if sum(b.num_rows for b in batches):
            table = pa.Table.from_batches(batches)
            context = TaskContext.get()
            column = lambda c: table[c].to_numpy(zero_copy_only=False) if c in table.column_names else None
            fixed = ("x", "y", "z", "intensity", "classification")
            extra = {c: np.asarray(column(c), np.float64) for c in table.column_names if c not in fixed and (pa.types.is_integer(table[c].type) or pa.types.is_floating(table[c].type))}
            FS.write(FS.join(self.folder, f"part-{context.partitionId():05d}.las"), las_bytes(column("x"), column("y"), column("z"), column("intensity"), column("classification"), extra=extra))
        return WriterCommitMessage()


class LasSource(DataSource):
    """spark.read.format("las").load(path): x, y, z, intensity, classification and the extra fields as doubles.

    df.write.format("las").save(folder) writes x, y, z, intensity, classification; other numeric
    columns become extra fields (null as NaN). Splits should hold what fits in a task.
    """

    def writer(self, schema, overwrite: bool) -> LasWriter:
        return LasWriter(self.options["path"], overwrite)

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        extra = LasHeader(FS.files(self.options["path"])[0]).extra
        return ", ".join(["x double, y double, z double, intensity double, classification bigint", *[f"`{n}` double" for n, _, _ in extra]])

    def reader(self, schema) -> LasReader:
        return LasReader(FS.files(self.options["path"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)
    spark.dataSource.register(LasSource)


def las_bytes(x: np.ndarray, y: np.ndarray, z: np.ndarray, intensity: np.ndarray | None = None, classification: np.ndarray | None = None, scale: float = 0.001, extra: dict[str, np.ndarray] | None = None) -> bytes:
    """A LAS 1.2 file (point format 0) of the points with usable coordinates; extra fields are doubles."""
    p = np.stack([x, y, z], 1).astype(np.float64)
    good = np.isfinite(p).all(1)
    p, extra = p[good], {k: np.asarray(v, np.float64)[good] for k, v in (extra or {}).items()}
    n, size = len(p), 20 + 8 * len(extra)
    low = np.floor(p.min(0)) if n else np.zeros(3)
    rec = np.zeros((n, size), np.uint8)
    rec[:, :12] = np.round((p - low) / scale).astype("<i4").view(np.uint8).reshape(n, 12)
    if intensity is not None:
        rec[:, 12:14] = np.clip(np.nan_to_num(np.asarray(intensity, float)[good]), 0, 65535).astype("<u2").view(np.uint8).reshape(n, 2)
    if classification is not None:
        rec[:, 15] = np.clip(np.nan_to_num(np.asarray(classification, float)[good]), 0, 31)
    fields = b""
    for i, (name, v) in enumerate(extra.items()):
        rec[:, 20 + 8 * i : 28 + 8 * i] = v.astype("<f8").view(np.uint8).reshape(n, 8)
        field = bytearray(192)
        field[2] = 10
        field[4 : 4 + min(32, len(name.encode()))] = name.encode()[:32]
        fields += bytes(field)
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(fields), b"") + fields if extra else b""
    h = bytearray(227)
    h[:4], h[24], h[25] = b"LASF", 1, 2
    struct.pack_into("<HII", h, 94, 227, 227 + len(vlr), 1 if extra else 0)
    struct.pack_into("<HI", h, 105, size, n)
    struct.pack_into("<3d3d", h, 131, *[scale] * 3, *low)
    top, bottom = (p.max(0), p.min(0)) if n else (low, low)
    struct.pack_into("<6d", h, 179, top[0], bottom[0], top[1], bottom[1], top[2], bottom[2])
    return bytes(h) + vlr + rec.tobytes()


def write_las(x: np.ndarray, y: np.ndarray, z: np.ndarray, path: str, intensity: np.ndarray | None = None, classification: np.ndarray | None = None, scale: float = 0.001) -> None:
    """One LAS file from arrays of one cloud."""
    FS.write(path, las_bytes(x, y, z, intensity, classification, scale))


def write_clouds(points: DataFrame, path: str, fmt: str = "parquet", group: str = "cloud_id") -> None:
    """All clouds as one folder each."""
    points.write.mode("overwrite").partitionBy(group).format(fmt).save(path)


def write_table(table: DataFrame, path: str) -> None:
    """A metrics table as CSV with a header."""
    table.write.mode("overwrite").option("header", True).csv(path)
