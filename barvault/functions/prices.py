"""Candle shape expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOJI_SHARE = 0.003  # fixed value: smallest body, as a share of the chart's price span


def bearish(open_: Column, close: Column) -> Column:
    return open_ > close


def bullish(open_: Column, close: Column) -> Column:
    return open_ < close


def candle_class(open_: Column, close: Column) -> Column:
    return F.when(close > open_, "bull").when(close < open_, "bear").otherwise("neutral")


def bar_class(open_: Column, close: Column) -> Column:
    """Class of a volume bar; NULL when the candle did not move."""
    return F.when(open_ < close, "bull").when(open_ > close, "bear")


def doji_height(highest: Column, lowest: Column) -> Column:
    return (highest - lowest).cast("double") * F.lit(DOJI_SHARE)


def body_height(open_: Column, close: Column, doji: Column) -> Column:
    """Signed body; too small a body (also a falling one) becomes the positive doji height."""
    move = (close - open_).cast("double")
    return F.when(F.abs(move) > F.abs(doji), move).otherwise(doji)


def body_bottom(open_: Column, close: Column, doji: Column) -> Column:
    start = open_.cast("double")
    return F.when(open_ == close, start - doji / 2).otherwise(start)
