"""One row per series: counts, last IDs, first and last candles. All aggregate partially before the shuffle.

The same summaries come from the archive's kept totals (``CandleArchive.totals``) by ``kept_*``, which read no candles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barvault.functions import clock, prices, text

KEYS = ("series_key",)


def row_counts(table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def latest_timestamp(candles: DataFrame, registry: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Time of the row with the highest ID, which need not be the latest time; NULL for an empty series."""
    latest = candles.groupBy(*keys).agg(F.max_by("datetime", "ID").alias("latest"))
    return latest if registry is None else registry.join(latest, list(keys), "left")


def last_id(candles: DataFrame, registry: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    last = candles.groupBy(*keys).agg(F.max("ID").alias("last_id"))
    return last if registry is None else registry.join(last, list(keys), "left")


def earliest_point(candles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    first = candles.groupBy(*keys).agg(F.min("datetime").alias("datetime"))
    return first.withColumn("unix_time", clock.unix_seconds(F.col("datetime")))


def _at_latest(column: str) -> Column:
    # fixed-width values keyed by the time alone stay in hash aggregation; a struct would force a sort
    return F.max_by(column, "datetime").alias(column)


def latest_candle(candles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    values = ["open", "close", "high", "low", "volume"]
    return candles.groupBy(*keys).agg(F.max("datetime").alias("datetime"), *[_at_latest(c) for c in values])


def last_price(candles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Close of the last candle, its direction and its label."""
    last = candles.groupBy("asset_class", *keys).agg(_at_latest("open"), _at_latest("close"))
    return last.select("asset_class", *keys, *_price(F.col("open"), F.col("close")))


def _price(open_: Column, close: Column) -> list[Column]:
    return [
        close.alias("last_close"),
        prices.candle_class(open_, close).alias("direction"),
        text.price_label(close, F.col("asset_class")).alias("label"),
    ]


def extents(candles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Axis bounds of the chart of each series."""
    totals = candles.groupBy(*keys).agg(
        F.max("high").alias("_high"),
        F.min("low").alias("_low"),
        F.max("volume").alias("_volume"),
        F.count(F.lit(1)).alias("_rows"),
    )
    return totals.select(
        *keys, *axis_bounds(F.col("_high"), F.col("_low"), F.col("_volume"), F.col("_rows"))
    )


def axis_bounds(high: Column, low: Column, volume: Column, rows: Column) -> list[Column]:
    # Margins of the chart.
    offset = (high - low).cast("double") * F.lit(0.1)
    return [
        (low.cast("double") - F.lit(0.8) * offset).alias("chart_bottom"),
        (high.cast("double") + F.lit(1.6) * offset).alias("chart_top"),
        ((rows * F.lit(1.032)).cast("bigint") + 1).alias("x_bound"),
        (volume * F.lit(1.35)).alias("volume_top"),
    ]


# --- from kept totals --------------------------------------------------------------------------------------------
def _kept(totals: DataFrame, registry: DataFrame | None, keys: Sequence[str], *values: Column) -> DataFrame:
    rows = totals.select(*keys, *values)
    return rows if registry is None else registry.join(rows, list(keys), "left")


def kept_row_counts(totals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _kept(totals, None, keys, F.col("rows"))


def kept_latest_timestamp(totals: DataFrame, registry: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    return _kept(totals, registry, keys, F.col("latest"))


def kept_last_id(totals: DataFrame, registry: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    return _kept(totals, registry, keys, F.col("last_id"))


def kept_earliest_point(totals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _kept(totals, None, keys, F.col("earliest").alias("datetime"), clock.unix_seconds(F.col("earliest")).alias("unix_time"))


def kept_latest_candle(totals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    # stored IDs rise with time, so the candle of the last ID is the latest one
    values = [F.col(f"last_{c}").alias(c) for c in ("open", "close", "high", "low", "volume")]
    return _kept(totals, None, keys, F.col("latest").alias("datetime"), *values)


def kept_last_price(totals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    others = [c for c in keys if c != "asset_class"]
    return totals.select("asset_class", *others, *_price(F.col("last_open"), F.col("last_close")))


def kept_extents(totals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _kept(totals, None, keys, *axis_bounds(F.col("high"), F.col("low"), F.col("volume"), F.col("rows")))
