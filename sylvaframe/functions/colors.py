"""Colours of instances and classes as columns."""

from __future__ import annotations

import colorsys

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

N_COLORS = 27
BACKGROUND = (220, 219, 209, 127)


def palette(n: int = N_COLORS) -> list[tuple[int, int, int, int]]:
    """n hues by rule: equal steps of the golden ratio, two levels of brightness."""
    out = []
    for i in range(n):
        r, g, b = colorsys.hsv_to_rgb(i * 0.61803398875 % 1.0, 0.65, 0.95 if i % 2 else 0.75)
        out.append((round(r * 255), round(g * 255), round(b * 255), 255))
    return out


def _rgba(c: tuple[int, int, int, int]) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in zip("rgba", c, strict=True)])


#: Predictions without a target, targets without a prediction.
FALSE_POSITIVE, FALSE_NEGATIVE = (255, 0, 0, 255), (0, 0, 255, 255)


def color_errors(points: DataFrame, false_positives: DataFrame, false_negatives: DataFrame, group: str = "cloud_id") -> DataFrame:
    """points whose ``rgba`` is red in false positives (group, prediction_id), blue in false negatives (group, target_id).

    The former hold where both apply; ``rgba`` stays as it is elsewhere, background if there is none.
    """
    fp = false_positives.select(F.col(group).alias("__pg"), F.col("prediction_id").alias("__p"), F.lit(True).alias("__fp")).distinct()
    fn = false_negatives.select(F.col(group).alias("__tg"), F.col("target_id").alias("__t"), F.lit(True).alias("__fn")).distinct()
    out = points.join(fp, (F.col(group) == F.col("__pg")) & (F.col("prediction") == F.col("__p")), "left")
    out = out.join(fn, (F.col(group) == F.col("__tg")) & (F.col("target") == F.col("__t")), "left")
    own = F.col("rgba") if "rgba" in points.columns else _rgba(BACKGROUND)
    out = out.withColumn("rgba", F.when(F.col("__fp"), _rgba(FALSE_POSITIVE)).when(F.col("__fn"), _rgba(FALSE_NEGATIVE)).otherwise(own))
    return out.drop("__pg", "__p", "__fp", "__tg", "__t", "__fn")


def color_instances(points: DataFrame, label: str = "instance_id", group: str = "cloud_id") -> DataFrame:
    """points with ``rgba``: labels in their order cycle through the palette, others are background."""
    ids = points.where(F.col(label) >= 0).select(group, label).distinct()
    rank = F.row_number().over(W.partitionBy(group).orderBy(label)) - 1
    ids = ids.select(F.col(group).alias("__g"), F.col(label).alias("__l"), (rank % N_COLORS).alias("__k"))
    out = points.join(ids, (F.col(group) == F.col("__g")) & (F.col(label) == F.col("__l")), "left")
    colors = F.array(*[_rgba(c) for c in palette()])
    return out.withColumn("rgba", F.coalesce(F.get(colors, F.col("__k")), _rgba(BACKGROUND))).drop("__g", "__l", "__k")


def color_classes(cls: Column | str, colors: dict[int, str]) -> Column:
    """struct<r, g, b, a> (0 to 255) by class from hex codes; others are background."""
    cls = F.col(cls) if isinstance(cls, str) else cls
    out = _rgba(BACKGROUND)
    for k, code in colors.items():
        h = code.lstrip("#")
        out = F.when(cls == k, _rgba((*(int(h[i : i + 2], 16) for i in (0, 2, 4)), 255))).otherwise(out)
    return out
