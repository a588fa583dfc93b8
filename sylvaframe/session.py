"""Session helpers: a local session for tests and the one place that cuts lineage."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.classic.dataframe import DataFrame


def local_session(cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SYLVA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a temporary folder of this machine is used.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        master = sc.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sylva-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; a lost executor loses nothing of it.

    A checkpoint inherits its plan's estimated size, which a join multiplies. In a loop the number
    of its digits doubles from round to round, until planning takes minutes: estimates beyond
    reason are given up, together with what else is known of the plan.
    """
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint(eager=True)
    plan = done._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() > 60:
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), done._jdf.schema(), False), spark)
    return done


def pack(table: pa.Table) -> bytes:
    """A table as one compressed value; checkpoints keep plain rows at several times its size."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(block: bytes) -> pa.Table:
    with pa.ipc.open_stream(block) as read:
        return read.read_all()


def packed_cut(df: DataFrame) -> DataFrame:
    """``cut`` for wide or long tables: batches of rows are packed, a tenth to a quarter of the disk."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pack(pa.Table.from_batches([b]))], pa.binary())], names=["block"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in b.column("block"):
                yield from unpack(one.as_py()).to_batches()

    return cut(df.mapInArrow(write, "block binary")).mapInArrow(read, df.schema)


def sweep(spark: SparkSession) -> None:
    """Spark drops shuffle files and checkpoints of what is referenced no more when the driver collects its garbage: now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def default_parallelism(spark: SparkSession) -> int:
    """Shuffle partitions as configured, the unit in which plans here choose their splits."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
