"""Summing up what splits send, in levels of bounded groups until one row set per block is left."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.session import cut


def reduce_parts(partial: DataFrame, merge: Callable[[pa.Table], pa.Table], fan_in: int = 64) -> DataFrame:
    """``partial`` (block, part, ..) merged until each block has part 0 only; checkpointed.

    merge: the rows of up to ``fan_in`` parts of one block to rows of the same schema, whose part
    must be the old one // fan_in. No task ever receives more parts than that, however many
    splits the table has: two levels come at once, more as long as a part is left over.
    """

    def level(df: DataFrame) -> DataFrame:
        return df.groupBy("block", F.floor(F.col("part") / fan_in)).applyInArrow(merge, partial.schema)

    state = cut(level(level(partial)))
    while not state.where("part > 0").isEmpty():
        state = cut(level(state))
    return state
