"""Column expressions on literal rows."""

from datetime import datetime
from math import ceil

import pytest
from pyspark.sql import functions as F

from barvault.functions import clock, text


def column(spark, rows, ddl, expression):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(expression).collect()]


@pytest.mark.parametrize(
    "edge, expected",
    [
        ("start", [(10, 0), (9, 30), (9, 30), (15, 59), (9, 30), None]),
        ("end", [(10, 0), (15, 59), (9, 30), (15, 59), (15, 59), None]),
    ],
)
def test_session_clamp(spark, edge, expected):
    times = [(10, 0), (8, 0), (9, 30), (15, 59), (16, 0)]
    rows = [(datetime(2023, 1, 1, *t),) for t in times] + [(None,)]
    got = column(spark, rows, "t timestamp_ntz", clock.clamp_to_session(F.col("t"), edge))
    assert got == [e and datetime(2023, 1, 1, *e) for e in expected]


def test_page_estimate(spark):
    cases = [
        (datetime(2020, 1, 1), datetime(2020, 12, 31), "1day", "equity", 1),
        (datetime(2020, 1, 1), datetime(2020, 1, 2), "1min", "equity", 390),
        (datetime(2020, 1, 1, 12), datetime(2022, 7, 2, 11), "1min", "forex", 1440),
        (datetime(2001, 1, 1), datetime(2024, 7, 2), "1min", "forex", 1440),
        (datetime(2020, 1, 1), datetime(2020, 1, 2), "1h", "equity", None),
    ]
    got = column(
        spark, [c[:4] for c in cases], "a timestamp_ntz, b timestamp_ntz, i string, c string",
        clock.page_estimate(F.col("a"), F.col("b"), F.col("i"), F.col("c")),
    )
    want = [per and ceil(((b - a).days + 1) * 0.76 * per / 4999) + 1 for a, b, _, _, per in cases]
    assert got == want


def test_times(spark):
    assert column(spark, [("Tue, 24 Mar 2020 09:37:00 GMT",)], "s string", clock.parse_http_date(F.col("s"))) == [
        datetime(2020, 3, 24, 9, 37)
    ]
    both = column(spark, [("2020-03-24",), ("2020-03-24 09:37:00",)], "s string", clock.parse_candle_time(F.col("s")))
    assert both == [datetime(2020, 3, 24), datetime(2020, 3, 24, 9, 37)]
    ts = [(datetime(2024, 2, 29, 23, 59, 59, 999999),), (datetime(1969, 12, 31, 23, 0),)]
    assert column(spark, ts, "t timestamp_ntz", clock.month_of(F.col("t"))) == [datetime(2024, 2, 1), datetime(1969, 12, 1)]
    assert column(spark, ts, "t timestamp_ntz", clock.minute_of(F.col("t")))[0] == datetime(2024, 2, 29, 23, 59)
    assert column(spark, ts, "t timestamp_ntz", clock.unix_seconds(F.col("t"))) == [1709251199, -3600]


def test_times_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        gap = [(datetime(2024, 3, 10, 2, 30, 15),)]  # a local time that New York skips
        assert column(spark, gap, "t timestamp_ntz", clock.minute_of(F.col("t"))) == [datetime(2024, 3, 10, 2, 30)]
        label = text.axis_label(F.col("t"), F.lit(False), F.lit(True), "1min")
        assert column(spark, gap, "t timestamp_ntz", label) == ["02:30"]
        assert column(spark, gap, "t timestamp_ntz", clock.unix_seconds(F.col("t"))) == [1710037815]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_symbols(spark):
    pair = [("usd/GBp", "1min")]
    assert column(spark, pair, "p string, i string", text.forex_key(F.col("p"), F.col("i"))) == ["USD_GBP_1min"]
    assert column(spark, pair, "p string, i string", text.looks_like_pair(F.col("p"))) == [True]
    assert column(spark, [("",), ("China",)], "c string", text.known_country(F.col("c"))) == ["Unknown", "China"]


def test_timeframe_names(spark):
    rows = [("1min",), ("15min",), ("4h",), ("1day",), ("1week",), ("month",)]
    assert column(spark, rows, "f string", text.timeframe_name(F.col("f"))) == [
        "1 minute", "15 minute", "4 hour", "1 day", "1 week", " month",
    ]
    with pytest.raises(Exception, match="unsupported timeframe"):
        column(spark, [("1year",)], "f string", text.timeframe_name(F.col("f")))


@pytest.mark.parametrize(
    "volume, largest, expected",
    [
        (5_999_999_999, 6_000_000_000, "5.0B"),
        (3_100_000, 6_000_000_000, "0.0B"),
        (3_100_000, 3_100_000, "3.0M"),
        (1999, 2001, "1.0k"),
        (1999, 2000, "1999"),
        (3_000_000_000, None, "3000.0M"),
        (3_000_000_001, None, "3.0B"),
        (3_000_000, None, "3000.0k"),
        (4001, None, "4.0k"),
        (4000, None, "4000"),
    ],
)
def test_volume_labels(spark, volume, largest, expected):
    limit = None if largest is None else F.col("m")
    assert column(spark, [(volume, largest)], "v bigint, m bigint", text.volume_label(F.col("v"), limit)) == [expected]


def test_price_labels_round_ties_to_even(spark):
    rows = [("2.34500", "equity"), ("2.35500", "equity"), ("1.23456", "forex")]
    label = text.price_label(F.col("p").cast("decimal(10,5)"), F.col("c"))
    assert column(spark, rows, "p string, c string", label) == ["2.34", "2.36", "1.23456"]
