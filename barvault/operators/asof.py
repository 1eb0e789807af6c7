"""Nearest row at or after / at or before a moment, for whole tables of moments.

The moments are reduced to the distinct grid cells they fall into (a minute, or a day for day candles). Each cell is
answered once: the candles inside it, and the nearest candles outside it on either side, found by running windows
over the cells and candles of one calendar segment and, beyond the segment, from the segment summary. The moments
then pick up the answer of their cell by an equality join. However many moments ask about one series and day, no task
sees more of them than it has cells, and no moment is paired with more candles than its cell holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barvault.errors import DataNotPresent
from barvault.functions import clock
from barvault.operators import segments
from barvault.operators.joins import join_unique

OPERATIONS = ("<=", ">=")  # fixed values
KEYS = ("series_key",)


def check_operation(operation: str) -> str:
    if operation not in OPERATIONS:
        raise ValueError(f"operation must be one of {OPERATIONS}, not {operation!r}")
    return operation


def asked_cells(asked: DataFrame, moments: Sequence[str], interval: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct cells of all given moment columns."""
    cells = F.array_compact(F.array(*[clock.bucket_of(F.col(m), interval) for m in moments]))
    return asked.select(*keys, F.explode(cells).alias("_cell")).distinct()


def cell_edges(
    cells: DataFrame,
    candles: DataFrame,
    interval: str,
    operations: Sequence[str] = OPERATIONS,
    value: str = "ID",
    time: str = "datetime",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Per cell: ``_inside`` (its candles as time and value), ``_before`` and / or ``_after`` (nearest value outside)."""
    on_segment = [*keys, "_segment"]
    segment = segments.calendar_segment(F.col("_cell"), interval)
    marks = cells.withColumn("_segment", segment)
    rows = candles.select(
        *keys,
        clock.bucket_of(F.col(time), interval).alias("_cell"),
        F.col(time).alias("_time"),
        F.col(value).alias("_value"),
    ).withColumn("_segment", segment)

    # every asked segment needs a summary row, also one without candles
    asked_segments = marks.select(*on_segment).distinct()
    filled = rows.select(*on_segment, "_value").unionByName(asked_segments, allowMissingColumns=True)
    summary = filled.groupBy(*on_segment).agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"))

    # few asked segments are broadcast by size, so only their candles are shuffled
    near = rows.join(asked_segments, on_segment, "left_semi")
    line = near.select(
        *on_segment, "_cell", F.lit(1).alias("_kind"), "_value", F.struct("_time", "_value").alias("_hit")
    ).unionByName(marks.withColumn("_kind", F.lit(0)), allowMissingColumns=True)

    # a cell row sorts before its own candles in both directions, so it sees only candles of other cells
    picks: dict[str, Column] = {}
    edges = []
    if "<=" in operations:
        running = segments.within(keys, "_segment", ["_cell", "_kind"])
        picks["_before"] = F.max("_value").over(running.rowsBetween(Window.unboundedPreceding, 0))
        edges.append(F.max("_high").over(segments.earlier(keys, "_segment")).alias("_before_segment"))
    if ">=" in operations:
        running = segments.within(keys, "_segment", [F.desc("_cell"), "_kind"])
        picks["_after"] = F.min("_value").over(running.rowsBetween(Window.unboundedPreceding, 0))
        edges.append(F.min("_low").over(segments.later(keys, "_segment")).alias("_after_segment"))
    picks["_inside"] = F.collect_list("_hit").over(Window.partitionBy(*on_segment, "_cell"))
    answered = line.withColumns(picks).where("_kind = 0")
    answered = segments.attach(answered, summary.select(*on_segment, *edges), keys, "_segment")
    return answered.select(
        *keys,
        "_cell",
        "_inside",
        *[F.coalesce(side, f"{side}_segment").alias(side) for side in picks if side != "_inside"],
    )


def answer(
    asked: DataFrame,
    edges: DataFrame,
    operation: str,
    *,
    at: str,
    out: str,
    interval: str,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add ``out``, the value nearest to ``at``, from the edges of its cell."""
    backward = check_operation(operation) == "<="
    moment = F.col(at)
    fits = lambda hit: hit["_time"] <= moment if backward else hit["_time"] >= moment
    values = F.transform(F.filter("_inside", fits), lambda hit: hit["_value"])
    found = F.coalesce(
        F.array_max(values) if backward else F.array_min(values), F.col("_before" if backward else "_after")
    )
    side = edges.select(*keys, "_cell", "_inside", "_before" if backward else "_after")
    located = asked.withColumn("_cell", clock.bucket_of(moment, interval))
    return join_unique(located, side, [*keys, "_cell"]).select(*asked.columns, found.alias(out))


def nearest(
    asked: DataFrame,
    candles: DataFrame,
    operation: str,
    *,
    at: str,
    out: str,
    interval: str,
    value: str = "ID",
    time: str = "datetime",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add ``out`` to every asked row: ``value`` of the nearest candle of its series, NULL when there is none.

    ``value`` must not decrease along ``time`` within a series (a row number or an ID): the nearest candle before a
    moment then has the largest value up to it, and equal times settle on the outermost row.
    """
    check_operation(operation)
    cells = asked_cells(asked, [at], interval, keys)
    edges = cell_edges(cells, candles, interval, [operation], value, time, keys)
    return answer(asked, edges, operation, at=at, out=out, interval=interval, keys=keys)


def bracket(
    asked: DataFrame,
    candles: DataFrame,
    *,
    start: str,
    end: str,
    low: str,
    high: str,
    interval: str,
    value: str = "ID",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add ``low`` (nearest value from ``start`` on) and ``high`` (nearest up to ``end``), with one pass over the
    candles."""
    edges = cell_edges(asked_cells(asked, [start, end], interval, keys), candles, interval, value=value, keys=keys)
    found = answer(asked, edges, ">=", at=start, out=low, interval=interval, keys=keys)
    return answer(found, edges, "<=", at=end, out=high, interval=interval, keys=keys)


def closest_id(candles: DataFrame, date_to_check, operation: str, time: str = "datetime") -> int:
    """Strict form on one series (already filtered): the ID of the nearest candle. The date reaches the scan."""
    check_operation(operation)
    moment = F.lit(date_to_check).cast("timestamp_ntz")
    if operation == "<=":
        found = candles.where(F.col(time) <= moment).agg(F.max_by("ID", time).alias("ID"))
    else:
        found = candles.where(F.col(time) >= moment).agg(F.min_by("ID", time).alias("ID"))
    id_ = found.first().ID
    if id_ is None:
        raise DataNotPresent(f"no candle {operation} {date_to_check}")
    return id_
