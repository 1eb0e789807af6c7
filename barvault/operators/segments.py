"""Ordered work per key without ever putting one key into one task.

A window partitioned by series alone would give a busy series to a single task. Every ordered operator here cuts a
key into *segments*, a column that never decreases along the order (the calendar day or month of a candle, a block
of trade numbers), and works in two steps:

1. ``groupBy(keys + segment)`` reduces each segment to one summary row (partial aggregation before the shuffle);
   windows over these few rows give what comes before, after and around a segment;
2. the rows are windowed by ``keys + segment`` and joined with the summary on the same columns, so both use one
   shuffle of the rows.

Keys, order and segment columns must not be NULL; rows where they are keep NULL results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barvault.functions import clock


def calendar_segment(time: Column, interval: str) -> Column:
    """Natural segment of a candle series: a day of minute candles, a month of day candles."""
    return (clock.day_of(time) if "min" in interval else clock.month_of(time)).cast("date")


def earlier(keys: Sequence[str], segment: str) -> WindowSpec:
    """All segments of the key before this one."""
    return Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)


def later(keys: Sequence[str], segment: str) -> WindowSpec:
    """All segments of the key after this one (as a running frame over the reversed order)."""
    return Window.partitionBy(*keys).orderBy(F.desc(segment)).rowsBetween(Window.unboundedPreceding, -1)


def upto(keys: Sequence[str], segment: str) -> WindowSpec:
    """All segments of the key up to and including this one."""
    return Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, 0)


def whole(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def within(keys: Sequence[str], segment: str, order: Sequence[str | Column]) -> WindowSpec:
    """Rows of one segment in order."""
    return Window.partitionBy(*keys, segment).orderBy(*order)


def attach(df: DataFrame, summary: DataFrame, keys: Sequence[str], segment: str) -> DataFrame:
    """Give every row the summary values of its segment."""
    return df.join(summary, [*keys, segment], "left")


def rows_before(df: DataFrame, keys: Sequence[str], segment: str) -> DataFrame:
    """Per segment: how many rows of the key come before it (``_before``) and how many the key has (``_rows``)."""
    sizes = df.groupBy(*keys, segment).agg(F.count(F.lit(1)).alias("_size"))
    return sizes.select(
        *keys,
        segment,
        F.coalesce(F.sum("_size").over(earlier(keys, segment)), F.lit(0)).alias("_before"),
        F.sum("_size").over(whole(keys)).alias("_rows"),
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    segment: Column,
    out: str = "position",
    first: Column | None = None,
) -> DataFrame:
    """Add the dense position of each row within its key, counted from 0 (or from the column ``first``)."""
    cut = df.withColumn("_segment", segment)
    sizes = rows_before(cut, keys, "_segment").drop("_rows")
    local = F.row_number().over(within(keys, "_segment", order)) - 1
    start = F.lit(0) if first is None else first
    return (
        attach(cut.withColumn("_local", local), sizes, keys, "_segment")
        .withColumn(out, (F.col("_before") + F.col("_local") + start).cast("bigint"))
        .drop("_segment", "_local", "_before")
    )
