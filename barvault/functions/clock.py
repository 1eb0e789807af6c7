"""Date and time expressions on ``timestamp_ntz`` columns.

Everything is built from date parts, so no result depends on the session time zone: ``date_trunc`` would go through
the zoned TIMESTAMP type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regular session hours, in minutes after midnight.
SESSION_OPEN = 9 * 60 + 30
SESSION_LAST = 15 * 60 + 59
# Fixed value: the minute grid of the chart is counted from 13:30 UTC.
GRID_ORIGIN_SECONDS = (13 * 60 + 30) * 60
# Page size of the provider, share of trading days, candles per trading day.
FULL_PAGE = 4999
TRADING_DAY_SHARE = 0.76
MINUTES_PER_DAY = {"equity": 390, "forex": 1440}


def day_of(ts: Column) -> Column:
    """Midnight of the day of ``ts``."""
    return ts.cast("date").cast("timestamp_ntz")


def month_of(ts: Column) -> Column:
    """First midnight of the month of ``ts``."""
    return F.trunc(ts.cast("date"), "month").cast("timestamp_ntz")


def minute_of(ts: Column) -> Column:
    """``ts`` without its seconds."""
    return ts - F.make_dt_interval(secs=F.extract(F.lit("SECOND"), ts))


def bucket_of(ts: Column, interval: str) -> Column:
    """Start of the candle that ``ts`` falls into."""
    return day_of(ts) if interval == "1day" else minute_of(ts)


def minutes(count: Column | int) -> Column:
    """A number of minutes as an interval."""
    return F.make_dt_interval(mins=count if isinstance(count, Column) else F.lit(count))


def seconds_of_day(ts: Column) -> Column:
    """Seconds since midnight, with microseconds, as a decimal."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)


def unix_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 00:00:00 of a UTC wall-clock timestamp."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def whole_days_between(start: Column, end: Column) -> Column:
    """Number of complete 24-hour days from ``start`` to ``end``, rounded down (also when negative)."""
    days = F.datediff(end.cast("date"), start.cast("date"))
    return days - F.when(seconds_of_day(end) < seconds_of_day(start), 1).otherwise(0)


def clamp_to_session(ts: Column, edge: str) -> Column:
    """Move a timestamp outside the session to the open (``edge='start'``) or the last minute (``edge='end'``)."""
    midnight = day_of(ts)
    first, last = midnight + minutes(SESSION_OPEN), midnight + minutes(SESSION_LAST)
    return F.when(ts.between(first, last), ts).otherwise(first if edge == "start" else last)


def parse_candle_time(text: Column) -> Column:
    """Both text forms of a candle time: date with time for minute candles, date alone for day candles."""
    return text.cast("timestamp_ntz")


def try_candle_time(text: Column) -> Column:
    """``parse_candle_time``, NULL for a text that is no time."""
    return text.try_cast("timestamp_ntz")


def parse_http_date(text: Column) -> Column:
    """``Tue, 24 Mar 2020 09:37:00 GMT`` as a UTC wall-clock timestamp."""
    return F.to_timestamp_ntz(F.substring(text, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))


def page_estimate(first_point: Column, end: Column, interval: Column, asset_class: Column) -> Column:
    """How many provider pages hold the history from ``first_point`` to ``end``; NULL for other intervals."""
    days = (whole_days_between(first_point, end) + 1) * F.lit(TRADING_DAY_SHARE)
    per_day = (
        F.when(interval == "1day", 1)
        .when((interval == "1min") & (asset_class == "equity"), MINUTES_PER_DAY["equity"])
        .when((interval == "1min") & (asset_class == "forex"), MINUTES_PER_DAY["forex"])
    )
    return F.ceil(days * per_day / F.lit(FULL_PAGE)) + 1
