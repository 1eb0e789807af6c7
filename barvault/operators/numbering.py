"""Dense numbers over a whole table in sort order, without a one-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barvault.session import materialise

# monotonically_increasing_id() keeps the partition number above this bit.
_PARTITION_SHIFT = 33


def dense_ids(df: DataFrame, order: Sequence[str | Column], out: str = "ID") -> DataFrame:
    """Number the rows 0, 1, 2, … in the given order, which should be total.

    The sort is a range shuffle, so the rows stay spread; only one count per sorted partition is windowed. The sorted
    rows are written out first because a repeated range shuffle may cut the range elsewhere.
    """
    placed = materialise(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _PARTITION_SHIFT)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        F.col("_part"),
        F.coalesce(
            F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    local = F.col("_place").bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    # offsets has one row per sorted partition, never more than the number of shuffle partitions: safe to broadcast
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_offset") + local).cast("int"))
        .select(out, *df.columns)
    )
