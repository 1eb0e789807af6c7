"""Chart marks and frames against plain loops written from the chart rules."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from barvault.operators import chart, summaries
from tests import samples

LENGTHS = [1, 2, 3, 5, 9, 10, 19, 20, 24, 25, 29, 30, 39, 43, 44, 60, 67, 80, 94, 100, 125, 153, 160, 184, 199, 242, 400]


@pytest.fixture(scope="module", params=["1day", "1min"])
def archive(request, spark):
    rng, rows, times = random.Random(23), [], {}
    for length in LENGTHS:
        for copy in range(2):
            key = f"S{length}_{copy}"
            times[key] = samples.random_times(rng, request.param, length)
            rows += samples.candle_rows(rng, key, request.param, times[key])
    # a break between the first two rows, and the same day number a month later
    times["early"] = [datetime(2021, 1, 29), datetime(2021, 2, 1), datetime(2021, 2, 2)]
    times["same"] = [datetime(2021, 1, 4, 10), datetime(2021, 2, 4, 10), datetime(2021, 2, 5, 10)]
    times["year"] = [datetime(2020, 1, 6), datetime(2021, 1, 5), datetime(2021, 1, 11), datetime(2021, 2, 8)]
    for key in ("early", "same", "year"):
        rows += samples.candle_rows(rng, key, request.param, times[key])
    return request.param, samples.candle_frame(spark, rows).cache(), times


def expected_marks(times, interval):
    """(major, excluded, minor) per row."""
    n = len(times)
    of = (lambda t: t.month) if interval == "1day" else (lambda t: t.day)
    limits = [20, 30, 43, 59, 78, 100, 125, 153, 184] if interval == "1day" else [10, 25, 44, 67, 94, 125, 160, 199, 242]
    pen = next((i for i, limit in enumerate(limits) if n < limit), 8) or 8
    major, zone = [False] * n, [False] * n
    if n > 1:
        major[0] = of(times[0]) == of(times[1])
        for i in range(1, n):
            major[i] = of(times[i]) != of(times[i - 1])
        for i in (i for i in range(n) if major[i]):
            for j in range(i - pen, i + pen + 1):
                if -n <= j < n:
                    zone[j] = True  # negative places count from the end
    step = next((5 * i for i in range(1, 15) if n < 40 * i), 120 if n < 720 else 180)
    minor = []
    for time, blocked in zip(times, zone):
        if interval == "1day":
            slot = time.isoweekday() == 1
        else:
            origin = time.replace(hour=13, minute=30, second=0, microsecond=0)
            slot = abs((origin - time).total_seconds()) // 60 % step == 0
        minor.append(slot and not blocked)
    return list(zip(major, zone, minor))


def test_time_splits_equal_loop(archive):
    interval, candles, times = archive
    got = {}
    for row in chart.time_splits(candles, interval).orderBy("series_key", "x").collect():
        got.setdefault(row.series_key, []).append((row.major, row.excluded, row.minor))
    assert got.keys() == times.keys()
    for key, known in times.items():
        assert got[key] == expected_marks(known, interval), key


def expected_label(time, major, minor, interval):
    if interval == "1day":
        if major:
            return time.strftime("%Y") if time.month == 1 else time.strftime("%b")
        return str(time.day) if minor else ""
    return time.strftime("%a") if major else time.strftime("%H:%M") if minor else ""


def test_chart_frame_equals_loop(archive):
    interval, candles, times = archive
    rows, frame = {}, {}
    for row in candles.collect():
        rows.setdefault(row.series_key, []).append(row)
    for row in chart.chart_frame(candles, interval).collect():
        frame.setdefault(row.series_key, []).append(row)
    for key in times:
        source, got = sorted(rows[key], key=lambda r: r.ID), sorted(frame[key], key=lambda r: r.x)
        marks = expected_marks(times[key], interval)
        high, low = max(r.high for r in source), min(r.low for r in source)
        doji, volume = 0.003 * float(high - low), max(r.volume for r in source)
        offset = float(high - low) * 0.1
        for r, g, (major, _, minor) in zip(source, got, marks):
            assert (g.ID, g.x, g.major, g.minor) == (r.ID, r.ID, major, minor)
            assert g.label == expected_label(r.datetime, major, minor, interval)
            move = float(r.close - r.open)
            assert g.candle_class == ("bull" if move > 0 else "bear" if move < 0 else "neutral")
            assert g.bar_class == ("bull" if move > 0 else "bear" if move < 0 else None)
            assert g.body_height == (move if abs(move) > abs(doji) else doji)
            assert g.body_bottom == (float(r.open) if move else float(r.open) - doji / 2)
            assert g.volume_label == (f"{r.volume // 1000}.0k" if volume > 2000 else str(r.volume))
            assert g.last_price_label == f"{source[-1].close:.2f}"
            assert g.chart_bottom == float(low) - 0.8 * offset
            assert g.chart_top == float(high) + 1.6 * offset
            assert g.x_bound == int(len(source) * 1.032) + 1
            assert g.volume_top == volume * 1.35


def test_flat_and_tiny_bodies(spark):
    prices = [("10", "10", "20", "0"), ("10", "9.99", "10", "9"), ("10", "8", "10", "8")]
    rows = [
        ("forex", "1day", "A", i, datetime(2021, 1, 4) + timedelta(days=i), *[Decimal(p) for p in p4], None)
        for i, p4 in enumerate(prices)
    ]
    got = chart.body_geometry(samples.candle_frame(spark, rows)).orderBy("ID").collect()
    doji = 0.003 * 20
    # too small a fall is drawn as a small rise
    assert [(r.candle_class, r.body_bottom, r.body_height) for r in got] == [
        ("neutral", 10 - doji / 2, doji), ("bear", 10.0, doji), ("bear", 10.0, -2.0),
    ]
    last = summaries.last_price(samples.candle_frame(spark, rows)).first()
    assert (last.last_close, last.direction, last.label) == (Decimal("8"), "bear", "8.00000")


def test_line_series_and_errors(archive):
    interval, candles, times = archive
    points = chart.line_series(candles, "close", interval)
    assert points.where("series_key = 'S60_0'").agg({"x": "max"}).first()[0] == 59
    with pytest.raises(ValueError):
        chart.line_series(candles, "average", interval)
    with pytest.raises(ValueError):
        chart.time_splits(candles, "1h")
