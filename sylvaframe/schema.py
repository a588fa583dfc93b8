"""Tables, sentinels and the definition of a valid point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INVALID = -1
UNCERTAIN = -2

POINTS = T.StructType(
    [
        T.StructField("cloud_id", T.StringType()),
        T.StructField("point_id", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
    ]
)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def require(df: DataFrame, *names: str) -> None:
    """ValueError when a column that an operator needs is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def finite(c: Column | str) -> Column:
    """Neither null nor NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def is_valid_point(max_abs_z: float = 1000.0) -> Column:
    return finite("x") & finite("y") & finite("z") & (F.abs(F.col("z")) <= max_abs_z)


def valid_points(points: DataFrame, *columns: str, distinct: bool = True) -> DataFrame:
    """Rows with usable coordinates, one per ``point_id``.

    Repeated rows agree in all but ``received_ts``, so any of them stands for all; the
    columns asked for must not include it. Rows without a ``point_id`` can't be told apart
    and are dropped when ``distinct``.
    """
    require(points, "point_id", "x", "y", "z", *columns)
    cols = list(dict.fromkeys([*columns, "point_id", "x", "y", "z"]))
    out = points.where(is_valid_point()).select(*cols)
    if distinct:
        out = out.where(F.col("point_id").isNotNull()).dropDuplicates(["point_id"])
    return out
