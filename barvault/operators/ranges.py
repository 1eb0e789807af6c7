"""Point, ID and date-range fetches, one request at a time or for whole tables of requests.

A request row is ``(req_id, series_key, start, end, n)`` with an optional day-time interval ``span``. Two of start,
end and (span or n) must be given.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from barvault.errors import DataNotPresent, DataUncertain
from barvault.operators import segments
from barvault.operators.asof import bracket
from barvault.operators.joins import join_unique

# Rows per block of the positional fetch: a join key never gathers more rows of a series than this.
BLOCK_ROWS = 1024

KEYS = ("series_key",)


# --- points ----------------------------------------------------------------------------------------------------
def point_lookup(
    requests: DataFrame,
    candles: DataFrame,
    at: str = "at",
    keys: Sequence[str] = KEYS,
    values: Sequence[str] = ("ID", "open", "close", "high", "low", "volume"),
) -> DataFrame:
    """Answer (series, exact time) requests; ``status`` is ok, not_present or uncertain (more than one candle).

    The ``values`` are filled only for ``ok``. Candles nobody asks for are left out before they are grouped.
    """
    on = [*keys, "datetime"]
    asked = requests.select(*keys, F.col(at).alias("datetime")).distinct()
    by_time = (
        candles.join(asked, on, "left_semi")
        .groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_hits"), *[F.max(c).alias(c) for c in values])
    )
    single = F.col("_hits") == 1
    return (
        join_unique(requests, by_time.withColumnRenamed("datetime", at), [*keys, at])
        .withColumn(
            "status",
            F.when(F.col("_hits").isNull(), "not_present").when(single, "ok").otherwise("uncertain"),
        )
        .withColumns({c: F.when(single, F.col(c)) for c in values})
        .drop("_hits")
    )


def fetch_point(series: DataFrame, date: datetime | str):
    """Strict form of :func:`point_lookup` on one series."""
    rows = series.where(F.col("datetime") == F.lit(date).cast("timestamp_ntz")).take(2)
    if not rows:
        raise DataNotPresent(f"no candle at {date}")
    if len(rows) > 1:
        raise DataUncertain(f"more than one candle at {date}")
    return rows[0]


# --- IDs -------------------------------------------------------------------------------------------------------
def by_id(table: DataFrame, id_: int) -> DataFrame:
    return table.where(F.col("ID") == id_)


def by_id_range(table: DataFrame, start_id: int | None = None, end_id: int | None = None) -> DataFrame:
    """Rows with ``start_id <= ID <= end_id``; the defaults are 0 and the last ID, that is no upper bound."""
    rows = table.where(F.col("ID") >= (0 if start_id is None else start_id))
    return rows if end_id is None else rows.where(F.col("ID") <= end_id)


def fetch_positions(
    requests: DataFrame,
    rows: DataFrame,
    low: str,
    high: str,
    position: str = "ID",
    keys: Sequence[str] = KEYS,
    carry: Sequence[str] = ("req_id",),
) -> DataFrame:
    """All rows with ``low <= position <= high`` per request, as an equality join on blocks of positions.

    Each request is expanded to the blocks it touches, so a wide request is spread over many tasks, and each block
    holds at most ``BLOCK_ROWS`` distinct positions of one series.
    """
    block = lambda c: F.floor(c / BLOCK_ROWS)
    last = rows.groupBy(*keys).agg(F.max(position).alias("_last"))
    asked = (
        join_unique(
            # without both bounds there is nothing to fetch; least() and greatest() below would skip the NULL
            requests.select(*carry, *keys, F.col(low).alias("_low"), F.col(high).alias("_high")).where(
                "_low IS NOT NULL AND _high IS NOT NULL"
            ),
            last,
            keys,
            "inner",
        )
        .withColumn("_high", F.least("_high", "_last"))
        .withColumn("_low", F.greatest("_low", F.lit(0)))
        .where("_low <= _high")
        .withColumn("_block", F.explode(F.sequence(block(F.col("_low")), block(F.col("_high")))))
        .drop("_last")
    )
    return (
        rows.withColumn("_block", block(F.col(position)))
        .join(asked, [*keys, "_block"])
        .where(F.col(position).between(F.col("_low"), F.col("_high")))
        .select(*carry, *rows.columns)
    )


# --- date arguments --------------------------------------------------------------------------------------------
def one_request(spark: SparkSession, start, end, span, n) -> Row:
    """A single request completed as ``complete_requests`` completes a table of them; an error for bad arguments."""
    given = spark.createDataFrame(
        [(start, end, span, n)], "start timestamp_ntz, end timestamp_ntz, span interval day to second, n int"
    )
    request = complete_requests(given).first()
    if request.status != "ok":
        raise LookupError("give two dates, or one date with a time span or a number of candles")
    return request


def complete_requests(requests: DataFrame) -> DataFrame:
    """Derive the missing date from ``span`` and add ``status`` (ok or bad_arguments)."""
    start, end, n = F.col("start"), F.col("end"), F.col("n")
    if "span" in requests.columns:
        zero = F.expr("INTERVAL '0 00:00:00' DAY TO SECOND")
        span = F.when(F.col("span") != zero, F.col("span"))
        from_start, from_end = start + span, end - span
    else:
        span = from_start = from_end = F.lit(None)
    count = F.when(n != 0, n)
    missing = start.isNull().cast("int") + end.isNull().cast("int") + (span.isNull() & count.isNull()).cast("int")
    return (
        requests.withColumn("_missing", missing)
        .withColumns(
            {
                "start": F.coalesce(start, from_end.cast("timestamp_ntz")),
                "end": F.coalesce(end, from_start.cast("timestamp_ntz")),
                "n": count,
            }
        )
        .withColumn("status", F.when(F.col("_missing") > 1, "bad_arguments").otherwise("ok"))
        .drop("_missing", "span")
    )


def id_bracket(requests: DataFrame, candles: DataFrame, interval: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """``(earliest_id, latest_id)`` per request.

    A count reaches past the last row (the upper end is not capped) but never below 0. ``status`` is ok,
    bad_arguments, or not_present when a given date has no candle on its side.
    """
    full = complete_requests(requests)
    found = bracket(full, candles, start="start", end="end", low="_low", high="_high", interval=interval, keys=keys)
    low, high, n = F.col("_low"), F.col("_high"), F.col("n")
    lost = (F.col("start").isNotNull() & low.isNull()) | (F.col("end").isNotNull() & high.isNull())
    status = F.when((F.col("status") == "ok") & lost, "not_present").otherwise(F.col("status"))
    good = F.col("status") == "ok"
    return (
        found.withColumn("status", status)
        .withColumn("earliest_id", F.when(good, F.greatest(F.coalesce(low, high - n + 1), F.lit(0))))
        .withColumn("latest_id", F.when(good, F.coalesce(high, low + n - 1)))
        .select("req_id", *keys, "status", "earliest_id", "latest_id")
    )


def fetch_by_dates(
    requests: DataFrame,
    candles: DataFrame,
    interval: str,
    position: str | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The candles of every request.

    start and end: both inclusive, at most ``n`` of them from the start if ``n`` is given; end and ``n``: the latest
    ``n`` up to the end; start and ``n``: the first ``n`` from the start. A request nothing matches has no rows.

    ``position`` names a column that already counts each series densely from 0 in time order, such as the ID the
    archive gives; without it the positions are counted here.
    """
    place = position or "_position"
    if position is None:
        candles = segments.with_position(
            candles, keys, ["datetime", "ID"], segments.calendar_segment(F.col("datetime"), interval), place
        )
    full = complete_requests(requests).where("status = 'ok'")
    found = bracket(
        full, candles, start="start", end="end", low="_from", high="_to", interval=interval, value=place, keys=keys
    )
    first, last, n = F.col("_from"), F.col("_to"), F.col("n")
    both = F.col("start").isNotNull() & F.col("end").isNotNull()
    low = F.when(F.col("start").isNotNull(), first).otherwise(last - n + 1)
    high: Column = F.when(both & n.isNotNull(), F.least(last, first + n - 1)).when(
        F.col("end").isNotNull(), last
    ).otherwise(first + n - 1)
    # least() skips NULL: a request without any candle from its start on must stay without bounds
    high = F.when(both & (first.isNull() | last.isNull()), None).otherwise(high)
    bounds = found.withColumns({"_low": low, "_high": high})
    return fetch_positions(bounds, candles, "_low", "_high", place, keys).drop("_position")


def fetch_series_by_dates(
    series: DataFrame,
    start_date: datetime | None = None,
    end_date: datetime | None = None,
    time_span: timedelta | None = None,
    trading_time_span: int | None = None,
) -> DataFrame:
    """One request on one series: the dates are plain predicates that reach the scan, the count is a limit."""
    request = one_request(series.sparkSession, start_date, end_date, time_span, trading_time_span)
    time = F.col("datetime")
    bounds = [time >= F.lit(request.start).cast("timestamp_ntz")] if request.start else []
    bounds += [time <= F.lit(request.end).cast("timestamp_ntz")] if request.end else []
    rows = series.where(reduce(and_, bounds))
    if request.n:
        # counted from the start where there is one, else back from the end
        rows = rows.orderBy(*(["datetime", "ID"] if request.start else [F.desc("datetime"), F.desc("ID")])).limit(request.n)
    return rows.orderBy("ID")


def series_id_bracket(
    series: DataFrame,
    start_date: datetime | None = None,
    end_date: datetime | None = None,
    time_span: timedelta | None = None,
    trading_time_span: int | None = None,
) -> tuple[int, int]:
    """Strict form of :func:`id_bracket` for one request on one series."""
    spark = series.sparkSession
    request = one_request(spark, start_date, end_date, time_span, trading_time_span)
    asked = spark.createDataFrame(
        [(0, 0, request.start, request.end, request.n)],
        "req_id int, _series int, start timestamp_ntz, end timestamp_ntz, n int",
    )
    found = id_bracket(asked, series.withColumn("_series", F.lit(0)), "1min", ["_series"]).first()
    if found.status != "ok":
        raise DataNotPresent("no candle on the asked side of a date")
    return found.earliest_id, found.latest_id
