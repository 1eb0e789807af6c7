"""Chart-ready candles: period breaks, label slots, labels, body geometry and axis bounds for every series at once.

The segments are the calendar days (minute candles) or months (day candles) of a series, so a period can only break
at the first row of a segment. Breaks, the zones around them and all series totals are therefore worked out on the
segment summary, a few rows per series and month or day, and the candles are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barvault.functions import clock, prices, text
from barvault.operators import segments
from barvault.operators.joins import join_unique
from barvault.operators.summaries import axis_bounds

KEYS = ("series_key",)

# Series length limits of the exclusion penalties 0..8 around a break, on minute and on day charts.
DAY_BREAK_LIMITS = (10, 25, 44, 67, 94, 125, 160, 199, 242)
MONTH_BREAK_LIMITS = (20, 30, 43, 59, 78, 100, 125, 153, 184)
LARGEST_PENALTY = 8
# Minute grid; a series shorter than 40*i rows has a label slot every 5*i minutes.
GRID_STEPS = tuple((5 * i, 40 * i) for i in range(1, 15)) + ((120, 720),)
WIDEST_GRID_STEP = 180


def check_chart_interval(interval: str) -> str:
    if "min" not in interval and "day" not in interval:
        raise ValueError(f"timeframe not supported: {interval}")
    return interval


def _stepped(length: Column, limits, otherwise: int) -> Column:
    steps = None
    for value, limit in limits:
        steps = (F if steps is None else steps).when(length < limit, value)
    return steps.otherwise(otherwise)


def penalty(length: Column, interval: str) -> Column:
    """Rows kept free around a break. The shortest series get the largest penalty: 0 counts as not found."""
    limits = MONTH_BREAK_LIMITS if "day" in interval else DAY_BREAK_LIMITS
    found = _stepped(length, enumerate(limits), LARGEST_PENALTY)
    return F.when(found == 0, LARGEST_PENALTY).otherwise(found)


def grid_step(length: Column) -> Column:
    return _stepped(length, GRID_STEPS, WIDEST_GRID_STEP)


def segment_breaks(cut: DataFrame, interval: str, keys: Sequence[str], *totals: Column) -> DataFrame:
    """Summary of ``cut`` per key and ``_segment``: where it starts, whether it starts with a break, nearest breaks."""
    period = F.month("_segment") if "day" in interval else F.dayofmonth("_segment")
    in_order = Window.partitionBy(*keys).orderBy("_segment")
    sizes = cut.groupBy(*keys, "_segment").agg(F.count(F.lit(1)).alias("_size"), *totals)
    placed = sizes.withColumns(
        {
            "_period": period,
            "_before": F.coalesce(F.sum("_size").over(segments.earlier(keys, "_segment")), F.lit(0)),
            "_rows": F.sum("_size").over(segments.whole(keys)),
        }
    )
    # the very first row breaks when the second row shares its period; any other row when its period is new
    opens = (
        F.when(F.col("_rows") == 1, False)
        .when(F.col("_before") > 0, F.col("_period") != F.lag("_period").over(in_order))
        .when(F.col("_size") > 1, True)
        .otherwise(F.col("_period") == F.lead("_period").over(in_order))
    )
    broken = placed.withColumn("_breaks", opens)
    broken = broken.withColumn("_break_at", F.when(F.col("_breaks"), F.col("_before")))
    return broken.select(
        *keys,
        "_segment",
        "_before",
        "_rows",
        "_breaks",
        F.max("_break_at").over(segments.upto(keys, "_segment")).alias("_last_break"),
        F.min("_break_at").over(segments.later(keys, "_segment")).alias("_next_break"),
        F.min("_break_at").over(segments.whole(keys)).alias("_first_break"),
        *[_series_total(c, keys).alias(c) for c in sizes.columns if c in _SERIES_TOTALS],
    )


# how the per-segment value of each total becomes the value of the whole series
_SERIES_TOTALS = {"_high": F.max, "_low": F.min, "_volume": F.max, "_close": lambda c: F.max_by(c, "_segment")}


def _series_total(column: str, keys: Sequence[str]) -> Column:
    return _SERIES_TOTALS[column](column).over(segments.whole(keys))


def _row_marks(interval: str, time: str) -> dict[str, Column]:
    x, rows = F.col("x"), F.col("_rows")
    pen = penalty(rows, interval)
    near = lambda distance: F.coalesce(distance <= pen, F.lit(False))
    # a zone that starts before row 0 reappears at the end of the series
    wrapped = F.coalesce(
        (F.col("_first_break") - pen < 0) & (x - rows >= F.col("_first_break") - pen), F.lit(False)
    )
    excluded = (rows > 1) & (near(x - F.col("_last_break")) | near(F.col("_next_break") - x) | wrapped)
    if "min" in interval:
        from_origin = F.floor(F.abs(F.lit(clock.GRID_ORIGIN_SECONDS) - clock.seconds_of_day(F.col(time))) / 60)
        on_grid = from_origin % grid_step(rows) == 0
    else:
        on_grid = F.weekday(F.col(time)) == 0
    return {"major": F.col("_breaks") & (F.col("_local") == 0), "excluded": excluded, "minor": on_grid & ~excluded}


def _marked(candles: DataFrame, interval: str, keys: Sequence[str], *totals: Column) -> DataFrame:
    """Candles with their index and marks, and the requested totals of their series."""
    check_chart_interval(interval)
    cut = candles.withColumn("_segment", segments.calendar_segment(F.col("datetime"), interval))
    summary = segment_breaks(cut, interval, keys, *totals)
    local = F.row_number().over(segments.within(keys, "_segment", ["datetime", "ID"])) - 1
    rows = segments.attach(cut.withColumn("_local", local), summary, keys, "_segment")
    return rows.withColumn("x", (F.col("_before") + F.col("_local")).cast("bigint")).withColumns(
        _row_marks(interval, "datetime")
    )


def time_splits(candles: DataFrame, interval: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per candle: row index ``x``, ``major`` break, ``excluded`` zone and ``minor`` label slot."""
    return _marked(candles, interval, keys).select(*keys, "ID", "datetime", "x", "major", "excluded", "minor")


def line_series(candles: DataFrame, which: str, interval: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The points of a line chart: one price (or volume) column against the row index."""
    if which not in ("open", "close", "high", "low", "volume"):
        raise ValueError(f"no such series: {which}")
    segment = segments.calendar_segment(F.col("datetime"), interval)
    placed = segments.with_position(candles, keys, ["datetime", "ID"], segment, "x")
    return placed.select(*keys, "x", F.col(which).alias("y"))


def body_geometry(candles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Class, body bottom, signed body height and wick of every candle, scaled by the span of its series."""
    spans = candles.groupBy(*keys).agg(F.max("high").alias("_high"), F.min("low").alias("_low"))
    return join_unique(candles, spans, keys).select(*keys, "ID", "datetime", *_geometry())


def _geometry() -> list[Column]:
    open_, close = F.col("open"), F.col("close")
    doji = prices.doji_height(F.col("_high"), F.col("_low"))
    return [
        prices.candle_class(open_, close).alias("candle_class"),
        prices.body_bottom(open_, close, doji).alias("body_bottom"),
        F.when(open_ == close, doji).otherwise(prices.body_height(open_, close, doji)).alias("body_height"),
        F.col("low").alias("wick_low"),
        F.col("high").alias("wick_high"),
    ]


def chart_frame(candles: DataFrame, interval: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Everything a renderer needs, one row per candle: index, breaks, labels, body, volume label, axis bounds."""
    rows = _marked(
        candles,
        interval,
        keys,
        F.max("high").alias("_high"),
        F.min("low").alias("_low"),
        F.max("volume").alias("_volume"),
        F.max_by("close", "ID").alias("_close"),
    )
    return rows.select(
        "asset_class",
        *keys,
        "ID",
        "datetime",
        "x",
        "open",
        "close",
        "high",
        "low",
        "volume",
        "major",
        "minor",
        text.axis_label(F.col("datetime"), F.col("major"), F.col("minor"), interval).alias("label"),
        *_geometry()[:3],
        prices.bar_class(F.col("open"), F.col("close")).alias("bar_class"),
        text.volume_label(F.col("volume"), F.col("_volume")).alias("volume_label"),
        text.price_label(F.col("_close"), F.col("asset_class")).alias("last_price_label"),
        *axis_bounds(F.col("_high"), F.col("_low"), F.col("_volume"), F.col("_rows")),
    )
