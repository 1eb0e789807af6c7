"""Point, nearest, bracket and range fetches against linear scans."""

import random
from bisect import bisect_left, bisect_right
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barvault.errors import DataNotPresent, DataUncertain
from barvault.operators import asof, ranges, segments, summaries
from tests import samples

REQUEST = (
    "req_id bigint, series_key string, start timestamp_ntz, end timestamp_ntz, span interval day to second, n int"
)


@pytest.fixture(scope="module", params=["1day", "1min"])
def archive(request, spark):
    """Three series of 25 to 400 candles, one of them spread over many segments."""
    rng = random.Random(7)
    rows = []
    for key, count in (("A", 25), ("B", 130), ("C", 400)):
        rows += samples.candle_rows(rng, key, request.param, samples.random_times(rng, request.param, count))
    times = {}
    for row in rows:
        times.setdefault(row[2], []).append(row[4])
    return request.param, samples.candle_frame(spark, rows).cache(), times


def five_forms(start, end, count):
    """The same bracket said in five ways."""
    span = end - start
    return [
        (start, end, None, None),
        (start, None, span, None),
        (None, end, span, None),
        (start, None, None, count),
        (None, end, None, count),
    ]


def brackets(rng, times):
    """Whole series, wider, inside, before, after, between candles."""
    far = timedelta(days=90)
    inside = sorted(rng.sample(times, 2))
    gap = timedelta(seconds=31)
    return [
        (times[0], times[-1]),
        (times[0] - far, times[-1] + far),
        tuple(inside),
        (inside[0] + gap, inside[1] + gap),
        (times[0] - far, times[0] - far / 2),
        (times[-1] + far / 2, times[-1] + far),
    ]


def make_requests(times_by_key):
    rng, requests, expected = random.Random(3), [], {}
    for key, times in times_by_key.items():
        for low, high in brackets(rng, times):
            first, last = bisect_left(times, low), bisect_right(times, high) - 1
            count = max(last - first + 1, 4)
            for start, end, span, n in five_forms(low, high, count):
                number = len(requests)
                requests.append((number, key, start, end, span, n))
                if n is None:
                    rows = range(first, last + 1)
                elif end is None:
                    rows = range(first, min(first + n, len(times)))
                else:
                    rows = range(max(last - n + 1, 0), last + 1)
                expected[number] = list(rows)
        # a count beyond the series, both dates with a count, and too few arguments
        extra = [
            ((times[0], None, None, 3 * len(times)), list(range(len(times)))),
            ((None, times[-1], None, 3 * len(times)), list(range(len(times)))),
            ((times[0], times[-1], None, 5), [0, 1, 2, 3, 4]),
            ((times[0], None, None, None), []),
            ((times[0], None, timedelta(0), None), []),
        ]
        for (start, end, span, n), rows in extra:
            expected[len(requests)] = rows
            requests.append((len(requests), key, start, end, span, n))
    return requests, expected


@pytest.mark.parametrize("position", [None, "ID"])
def test_batch_range_fetch_equals_scan(spark, archive, position):
    interval, candles, times = archive
    requests, expected = make_requests(times)
    found = ranges.fetch_by_dates(spark.createDataFrame(requests, REQUEST), candles, interval, position)
    got = {number: [] for number in expected}
    for row in found.select("req_id", "ID").collect():
        got[row.req_id].append(row.ID)
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_range_fetch_without_dense_ids(spark, archive):
    interval, candles, times = archive
    sparse = candles.withColumn("ID", F.col("ID") * 3 + 100)
    requests, expected = make_requests(times)
    found = ranges.fetch_by_dates(spark.createDataFrame(requests, REQUEST), sparse, interval)
    got = {number: [] for number in expected}
    for row in found.select("req_id", "ID").collect():
        got[row.req_id].append((row.ID - 100) // 3)
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_single_range_fetch_equals_batch(archive):
    _, candles, times = archive
    one = candles.where("series_key = 'B'").cache()
    requests, expected = make_requests({"B": times["B"]})
    for number, _key, start, end, span, n in requests[::3]:
        if not expected[number] and (start is None or end is None) and not span and not n:
            continue
        try:
            rows = ranges.fetch_series_by_dates(one, start, end, span, n).collect()
        except LookupError:
            assert expected[number] == []
            continue
        assert [r.ID for r in rows] == expected[number]


@pytest.mark.parametrize(
    "arguments",
    [(None,) * 4, (datetime(2020, 1, 1), None, None, None), (None, None, timedelta(3), None), (None, None, None, 5),
     (datetime(2020, 1, 1), None, timedelta(0), 0)],
)
def test_too_few_arguments(archive, arguments):
    with pytest.raises(LookupError):
        ranges.fetch_series_by_dates(archive[1], *arguments)
    with pytest.raises(LookupError):
        ranges.series_id_bracket(archive[1], *arguments)


def test_id_bracket(spark, archive):
    interval, candles, times = archive
    requests, _ = make_requests(times)
    rows = ranges.id_bracket(spark.createDataFrame(requests, REQUEST), candles, interval).collect()
    got = {r.req_id: (r.status, r.earliest_id, r.latest_id) for r in rows}
    for number, key, start, end, span, n in requests:
        known = times[key]
        if [start is None, end is None, not span and not n].count(True) > 1:
            assert got[number] == ("bad_arguments", None, None)
            continue
        end = start + span if end is None and span else end
        start = end - span if start is None and span else start
        low = bisect_left(known, start) if start is not None else None
        high = bisect_right(known, end) - 1 if end is not None else None
        if low == len(known) or high == -1:
            assert got[number] == ("not_present", None, None)
            continue
        high = low + n - 1 if high is None else high
        low = high - n + 1 if low is None else low
        assert got[number] == ("ok", max(low, 0), high)


def test_strict_bracket(archive):
    _, candles, times = archive
    one, known = candles.where("series_key = 'A'"), times["A"]
    assert ranges.series_id_bracket(one, known[0], None, None, 75) == (0, 74)
    assert ranges.series_id_bracket(one, None, known[-1], None, 75) == (0, 24)
    with pytest.raises(DataNotPresent):
        ranges.series_id_bracket(one, known[-1] + timedelta(days=20), known[-1] + timedelta(days=30))


@pytest.mark.parametrize("operation", ["<=", ">="])
def test_nearest_equals_scan(spark, archive, operation):
    interval, candles, times = archive
    rng, asked = random.Random(11), []
    for key, known in times.items():
        span = (known[-1] - known[0]).total_seconds()
        for _ in range(150):
            asked.append((key, known[0] + timedelta(seconds=rng.uniform(-0.1, 1.1) * span)))
        asked += [(key, t) for t in known[::7]] + [(key, known[0] - timedelta(days=400)), (key, None)]
    asked.append(("unknown", times["A"][0]))
    frame = spark.createDataFrame(asked, "series_key string, at timestamp_ntz")
    for row in asof.nearest(frame, candles, operation, at="at", out="id", interval=interval).collect():
        known = times.get(row.series_key, [])
        if row["at"] is None or not known:
            want = None
        elif operation == "<=":
            want = bisect_right(known, row["at"]) - 1
            want = None if want < 0 else want
        else:
            want = bisect_left(known, row["at"])
            want = None if want == len(known) else want
        assert row.id == want, row


def test_nearest_with_seconds_and_equal_times(spark):
    base = datetime(2020, 3, 24, 9, 37)
    moments = [base + timedelta(seconds=s) for s in (5, 20, 20, 50)] + [base + timedelta(days=40)]
    rng = random.Random(1)
    candles = samples.candle_frame(spark, samples.candle_rows(rng, "A", "1min", moments))
    asked = spark.createDataFrame(
        [("A", base + timedelta(seconds=s)) for s in (0, 5, 19, 20, 51)], "series_key string, at timestamp_ntz"
    )
    answers = {}
    for operation in ("<=", ">="):
        found = asof.nearest(asked, candles, operation, at="at", out="id", interval="1min")
        answers[operation] = [r.id for r in found.orderBy("at").collect()]
    assert answers == {"<=": [None, 0, 0, 2, 3], ">=": [0, 0, 1, 1, 4]}


def test_weekend_goes_to_friday_and_monday(spark):
    friday, monday = datetime(2022, 3, 4), datetime(2022, 3, 7)
    candles = samples.candle_frame(spark, samples.candle_rows(random.Random(1), "A", "1day", [friday, monday]))
    saturday = friday + timedelta(days=1)
    assert asof.closest_id(candles, saturday, "<=") == 0
    assert asof.closest_id(candles, saturday, ">=") == 1
    with pytest.raises(DataNotPresent):
        asof.closest_id(candles, monday + timedelta(days=1), ">=")
    with pytest.raises(ValueError):
        asof.closest_id(candles, saturday, "<")


def test_points(spark, archive):
    _, candles, times = archive
    doubled = candles.unionByName(candles.where("series_key = 'A' AND ID = 3").withColumn("ID", F.lit(99).cast("bigint")))
    asked = [("A", times["A"][0]), ("A", times["A"][3]), ("A", times["A"][0] - timedelta(days=1)), ("B", times["B"][5])]
    frame = spark.createDataFrame(asked, "series_key string, at timestamp_ntz")
    got = {(r.series_key, r["at"]): (r.status, r.ID) for r in ranges.point_lookup(frame, doubled).collect()}
    assert [got[a] for a in asked] == [("ok", 0), ("uncertain", None), ("not_present", None), ("ok", 5)]
    one = doubled.where("series_key = 'A'")
    assert ranges.fetch_point(one, times["A"][1]).ID == 1
    with pytest.raises(DataUncertain):
        ranges.fetch_point(one, times["A"][3])
    with pytest.raises(DataNotPresent):
        ranges.fetch_point(one, times["A"][0] - timedelta(days=1))


def test_id_ranges(archive):
    one = archive[1].where("series_key = 'A'")
    assert ranges.by_id(one, 7).count() == 1
    for bounds, count in (((None, None), 25), ((0, 24), 25), ((-50, 900), 25), ((4, 4), 1), ((3, 9), 7), ((9, 3), 0)):
        assert ranges.by_id_range(one, *bounds).count() == count


def test_positions_go_over_block_borders(spark):
    rows = spark.range(5000).select(F.lit("A").alias("series_key"), F.col("id").alias("ID"))
    asked = spark.createDataFrame(
        [(1, "A", 1000, 3100), (2, "A", -5, 2), (3, "A", 4990, 10**9), (4, "A", 5, 4), (5, "A", None, 4), (6, "A", 4, None)],
        "req_id bigint, series_key string, low bigint, high bigint",
    )
    found = ranges.fetch_positions(asked, rows, "low", "high").groupBy("req_id").count().collect()
    assert {r.req_id: r["count"] for r in found} == {1: 2101, 2: 3, 3: 10}


def test_positions_follow_time_not_input_order(spark):
    rng = random.Random(5)
    times = samples.random_times(rng, "1min", 300)
    rows = samples.candle_rows(rng, "A", "1min", times)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    frame = samples.candle_frame(spark, shuffled)
    segment = segments.calendar_segment(F.col("datetime"), "1min")
    for row in segments.with_position(frame, ["series_key"], ["datetime"], segment, first=F.lit(10)).collect():
        assert row.position == row.ID + 10


def test_summaries(spark, archive):
    _, candles, times = archive
    registry = spark.createDataFrame([(k,) for k in ("A", "B", "C", "empty")], "series_key string")
    latest = {r.series_key: r.latest for r in summaries.latest_timestamp(candles, registry).collect()}
    assert latest == {k: v[-1] for k, v in times.items()} | {"empty": None}
    last = {r.series_key: r.last_id for r in summaries.last_id(candles, registry).collect()}
    assert last == {"A": 24, "B": 129, "C": 399, "empty": None}
    # the highest ID decides, not the highest time
    odd = candles.withColumn("ID", -F.col("ID"))
    assert {r.series_key: r.latest for r in summaries.latest_timestamp(odd).collect()} == {k: v[0] for k, v in times.items()}
    first = {r.series_key: r.datetime for r in summaries.earliest_point(candles).collect()}
    assert first == {k: v[0] for k, v in times.items()}
    assert {r.series_key: r.datetime for r in summaries.latest_candle(candles).collect()} == {k: v[-1] for k, v in times.items()}
