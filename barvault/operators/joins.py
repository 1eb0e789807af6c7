"""A join that stays balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_unique(rows: DataFrame, unique: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``rows`` with a table that has at most one row per key, such as a grouped or distinct one.

    A small table is broadcast by its size. Otherwise both sides are sort-merge joined, and adaptive execution can cut
    a hot key of ``rows`` into several tasks only where both sides come straight from a shuffle. A grouped table is
    already partitioned by its key and would be joined in place, so the key is wrapped: that costs one more shuffle
    of the grouped (small) side and keeps the long side splittable. Key columns must have equal types on both sides
    and must not be NULL in ``unique``.
    """
    values = [c for c in unique.columns if c not in on]
    return (
        rows.withColumn("_on", F.struct(*on))
        .join(unique.select(F.struct(*on).alias("_on"), *values), "_on", how)
        .drop("_on")
    )
