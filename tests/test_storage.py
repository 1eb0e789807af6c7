"""Landed responses, the archive, the catalogue, save / update and the stream."""

import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barvault import schemas
from barvault.errors import SeriesExists, SeriesNotFound
from barvault.plans import load_lists, series_updates
from barvault.session import fresh_folder
from barvault.sources import catalog, landing
from barvault.sources.archive import SERIES, CandleArchive
from barvault.streaming import ingest
from tests import samples

names = iter(range(1000))


@pytest.fixture()
def archive(spark):
    database = f"warehouse_{next(names)}"
    catalog.build_warehouse(spark, database, fresh_folder(spark, database))
    yield CandleArchive(spark, database)
    catalog.purge_warehouse(spark, database)


def land(path, number, **response):
    path.mkdir(exist_ok=True)
    (path / f"{number:04d}.json").write_text(json.dumps(response))


def value(time, price=5, volume="490"):
    row = {"datetime": time, "open": "3", "high": "8", "low": "1.50", "close": str(price)}
    return row | ({"volume": volume} if volume else {})


EQUITY = {"symbol": "AAPL", "interval": "1min", "mic_code": "XNGS", "currency": "USD", "type": "Common Stock"}
PAIR = {"symbol": "USD/EUR", "interval": "1day", "currency_base": "US Dollar", "currency_quote": "Euro"}


@pytest.fixture()
def pages(tmp_path):
    """Two stitched pages of a stock, one of a pair, an error and a page without values."""
    folder = tmp_path / "pages"
    land(folder, 0, meta=EQUITY, status="ok", values=[value("2020-03-24 09:39:00"), value("2020-03-24 09:38:00")])
    land(folder, 1, meta=EQUITY, status="ok", values=[value("2020-03-24 09:38:00"), value("2020-03-24 09:37:00", 4)])
    land(folder, 2, meta=PAIR, status="ok", values=[value("2020-03-24", 5, None), value("2020-03-23", 5, None)])
    land(folder, 3, code=404, message="symbol not found", status="error")
    land(folder, 4, meta=EQUITY, status="ok")
    land(folder, 5, meta=EQUITY, code=400, status="ok", values=[value("2020-03-24 09:36:00")])
    return str(folder)


def test_pages(spark, pages):
    read = landing.read_pages(spark, pages)
    assert sorted((r.code or 0, r.message or "") for r in landing.response_errors(read, "values").collect()) == [
        (0, ""), (404, "symbol not found"),
    ]
    rows = landing.stitch(landing.page_candles(read))
    assert rows.count() == 6  # the shared minute once
    stock = rows.where("series_key = 'AAPL_XNGS'").orderBy(F.desc("datetime")).collect()
    assert [r.datetime.minute for r in stock] == [39, 38, 37, 36]
    assert (stock[2].close, stock[2].low, stock[2].volume) == (Decimal("4"), Decimal("1.5"), 490)
    pair = rows.where("asset_class = 'forex'").collect()
    assert {(r.series_key, r.time_interval, r.volume) for r in pair} == {("USD_EUR_1day", "1day", None)}


def test_candle_page_query(spark, pages):
    rows = landing.page_candles(landing.read_pages(spark, pages))
    at = lambda m: datetime(2020, 3, 24, 9, m)
    minutes = lambda **kw: [r.datetime.minute for r in landing.candle_page(rows, "AAPL", **kw).collect()]
    assert minutes() == [39, 38, 37, 36]
    assert minutes(start_date=at(37), end_date=at(38)) == [38, 37]
    assert minutes(date=at(38)) == [38]
    assert minutes(points=2) == [39, 38]
    assert minutes(mic_code="XNYS") == []
    assert landing.candle_page(rows, "USD/EUR", time_interval="1day").count() == 2


def test_csv(spark, tmp_path):
    folder = tmp_path / "csv" / "series_key=AAPL_XNGS" / "time_interval=1day"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("datetime;open;high;low;close;volume\n2020-03-24;3;8;1.5;5;490\n")
    (row,) = landing.read_candle_csv(spark, str(tmp_path / "csv"), ";").collect()
    assert (row.series_key, row.datetime, row.high, row.close, row.volume) == (
        "AAPL_XNGS", datetime(2020, 3, 24), Decimal("8"), Decimal("5"), 490,
    )


def test_lists(spark, tmp_path):
    folder = tmp_path / "lists"
    rows = [dict(zip(("symbol", "currency_group", "currency_base", "currency_quote"), r)) for r in samples.FOREX]
    land(folder, 0, data=rows, status="ok")
    land(folder, 1, code=404, message="gone")
    read = landing.read_forex_pairs(spark, str(folder))
    assert [r.symbol for r in read.orderBy("input_pos").collect()] == [r[0] for r in samples.FOREX]
    equity = {"symbol": "A", "name": "a", "currency": "USD", "mic_code": "XNGS", "country": "", "type": "ETF"}
    land(tmp_path / "plain", 0, data=[equity])  # plans were not asked for
    assert landing.read_equities(spark, str(tmp_path / "plain")).first().access is None
    own = landing.read_list(spark, str(folder), "symbol string")
    assert own.columns == ["symbol", "input_pos"] and own.count() == 7


def test_usage_report(spark):
    log = spark.createDataFrame([("k", "Tue, 24 Mar 2020 09:37:00 GMT", 3, 5, 800, 700)], schemas.USAGE_LOG)
    assert tuple(landing.usage_report(log).first()) == ("k", datetime(2020, 3, 24, 9, 37), 3, 8, 100, 800)


def series_rows(spark, key="AAPL_XNGS", interval="1min", count=40, seed=1):
    rng = random.Random(seed)
    times = samples.random_times(rng, interval, count)
    return samples.candle_frame(spark, samples.candle_rows(rng, key, interval, times)).drop("ID"), times


def test_append_continues_and_is_idempotent(spark, archive):
    rows, times = series_rows(spark, interval="1day", count=60)
    archive.append(rows.where(F.col("datetime") <= times[29]).orderBy(F.desc("datetime")))
    archive.append(rows.where(F.col("datetime") >= times[20]))
    archive.append(rows)
    stored = archive.candles().orderBy("ID").collect()
    assert [r.ID for r in stored] == list(range(60))
    assert [r.datetime for r in stored] == times
    assert archive.candles().join(rows, rows.columns).count() == 60
    progress = archive.progress().first()
    assert (progress.last_id, progress.latest) == (59, times[-1])


def test_append_after_an_unlogged_append(spark, archive):
    rows, times = series_rows(spark, interval="1day", count=30)
    archive.append(rows.where(F.col("datetime") <= times[19]))
    spark.sql(f"TRUNCATE TABLE {archive.database}.series_log")  # as if the writer was lost in between
    archive.append(rows.where(F.col("datetime") >= times[15]))
    assert [r.ID for r in archive.candles().orderBy("datetime").collect()] == list(range(30))


def test_append_many_series(spark, archive):
    frames = {f"S{i}": series_rows(spark, f"S{i}", "1min", 20 + i, i) for i in range(4)}
    for low, high in ((0, 10), (5, 100)):
        part = None
        for df, times in frames.values():
            chosen = df.where(F.col("datetime").isin(times[low:high]))
            part = chosen if part is None else part.unionByName(chosen)
        archive.append(part)
    for key, (_, times) in frames.items():
        got = archive.scan("equity", "1min", key).orderBy("ID").collect()
        assert [(r.ID, r.datetime) for r in got] == list(enumerate(times))


def test_scan_prunes_partitions(spark, archive):
    rows, times = series_rows(spark, interval="1day", count=200)
    archive.append(rows)
    found = archive.scan("equity", "1day", "AAPL_XNGS", start=times[50], end=times[60])
    assert found.count() == 11
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(asset_class" in plan.replace("\n", " ")
    assert "period" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(datetime" in plan


def test_registry(spark, archive):
    new = spark.createDataFrame([("equity", "1min", "A"), ("equity", "1min", "A")], schemas.REGISTRY)
    archive.register(new)
    archive.register(new)
    assert archive.registry().count() == 1
    assert archive.series("equity", "1min", "A").count() == 0  # registered and empty
    with pytest.raises(SeriesNotFound):
        archive.series("equity", "1min", "B")
    assert not archive.exists("equity", "1min", "_")  # no pattern matching


def test_delete_and_drop(spark, archive):
    a, times = series_rows(spark, "A", "1day", 50, 3)
    b, _ = series_rows(spark, "B", "1day", 50, 4)
    lone = a.limit(1).withColumns(
        {"series_key": F.lit("L"), "datetime": F.lit(datetime(1999, 5, 5)).cast("timestamp_ntz")}
    )
    both = a.unionByName(b).unionByName(lone)
    archive.register(both)
    archive.append(both)
    archive.delete_row("equity", "1day", "A", 7)
    archive.delete_row("equity", "1day", "A", 12345)
    archive.delete_row("equity", "1day", "L", 0)  # its month becomes empty
    assert sorted(r.ID for r in archive.scan("equity", "1day", "A").collect()) == [i for i in range(50) if i != 7]
    assert archive.scan("equity", "1day", "L").count() == 0
    assert archive.scan("equity", "1day", "B").count() == 50
    archive.delete_row("equity", "1day", "A", 49)
    archive.append(a.where(F.col("datetime") == times[49]))  # the last ID is free again
    assert archive.scan("equity", "1day", "A").agg(F.max("ID")).first()[0] == 49
    archive.drop_series("equity", "1day", "B")
    archive.drop_series("equity", "1day", "B")
    assert archive.candles().select("series_key").distinct().collect() == [("A",)]
    assert not archive.exists("equity", "1day", "B") and archive.exists("equity", "1day", "A")


def test_catalogue(spark, archive):
    db = archive.database
    tables = {r.table_name for r in catalog.list_tables(spark, db).collect()}
    assert tables == {*schemas.TABLES, "candles", "series_registry", "series_log"}
    assert {r.table_name for r in catalog.list_views(spark, db).collect()} == set(catalog.VIEWS)
    assert catalog.view_exists(spark, db, "stocks_explained") and not catalog.view_exists(spark, db, "stocks")
    assert catalog.list_columns(spark, db, "plans").count() == 3
    assert db in {r.schema_name for r in catalog.list_schemas(spark).collect()}
    assert catalog.list_functions(spark, db).count() == 0
    rows, _ = series_rows(spark)
    archive.append(rows)
    catalog.create_series_view(spark, db, "equity", "1min", "AAPL_XNGS")
    view = spark.table(f"{db}.`AAPL_XNGS_1min_view`")
    assert view.count() == 40 and view.where("bearish <> (open > close) OR bullish <> (open < close)").count() == 0
    catalog.rebuild_warehouse(spark, db, fresh_folder(spark, db))
    assert archive.candles().count() == 0 and not catalog.view_exists(spark, db, "AAPL_XNGS_1min_view")


def test_store_lists(spark, archive):
    tables = load_lists.load_lists(samples.forex_list(spark), samples.exchange_list(spark), samples.equity_list(spark))
    load_lists.store_lists(spark, archive.database, tables)
    stored = catalog.warehouse_tables(spark, archive.database)
    assert stored["stocks"].count() == 6 and stored["time_tracking_info"].count() == 0
    assert spark.table(f"{archive.database}.markets_explained").where("mic_code = 'XLON'").first().timezone_name == "Europe/London"
    bad = [*samples.EQUITIES, ("Z", "Z", "XXX", "XNGS", "China", "ETF", "Basic")]
    broken = load_lists.load_lists(samples.forex_list(spark), samples.exchange_list(spark), samples.equity_list(spark, bad))
    with pytest.raises(ValueError, match="lacks currency"):
        load_lists.store_lists(spark, archive.database, broken)


CATALOGUE = [("AAPL",), ("NVDA",)], [("USD/EUR",)]


def catalogue(spark):
    return [spark.createDataFrame(rows, "symbol string") for rows in CATALOGUE]


def test_save_and_update(spark, archive, pages, tmp_path):
    stocks, pairs = catalogue(spark)
    read = landing.read_pages(spark, pages)
    with pytest.raises(SeriesNotFound):
        series_updates.update_one(archive, read, stocks, pairs, "AAPL", "1min", "XNGS")
    series_updates.save_one(archive, read, stocks, pairs, "AAPL", "1min", "XNGS")
    with pytest.raises(SeriesExists):
        series_updates.save_one(archive, read, stocks, pairs, "AAPL", "1min", "XNGS")
    assert archive.candles().count() == 4  # the pair was not asked for
    later = tmp_path / "later"
    land(later, 0, meta=EQUITY, status="ok", values=[value("2020-03-24 09:41:00"), value("2020-03-24 09:39:00")])
    later = landing.read_pages(spark, str(later))
    with pytest.raises(SeriesExists):
        series_updates.update_one(archive, later, stocks, pairs, "AAPL", "1min", "XNGS", datetime(2020, 1, 1))
    series_updates.update_one(archive, later, stocks, pairs, "AAPL", "1min", "XNGS", datetime(2020, 3, 24, 9, 40))
    assert archive.candles().count() == 4
    series_updates.update_one(archive, later, stocks, pairs, "AAPL", "1min", "XNGS")
    stored = archive.series("equity", "1min", "AAPL_XNGS").orderBy("ID").collect()
    assert [(r.ID, r.datetime.minute) for r in stored] == [(0, 36), (1, 37), (2, 38), (3, 39), (4, 41)]


def test_worklist_statuses(spark, archive, pages):
    work = spark.createDataFrame(
        [("AAPL", "XNGS", "1min"), ("USD/EUR", None, "1day"), ("NVDA", None, "1min"), ("XX", None, "1day"), ("NVDA", "XNGS", "1h")],
        "symbol string, mic_code string, time_interval string",
    )
    read = landing.read_pages(spark, pages)
    status = lambda report: {(r.symbol, r.time_interval): r.status for r in report.collect()}
    saved = status(series_updates.save_series(archive, work, read, *catalogue(spark)))
    assert saved == {
        ("AAPL", "1min"): "stored", ("USD/EUR", "1day"): "stored", ("NVDA", "1min"): "mic_missing",
        ("XX", "1day"): "uncertain", ("NVDA", "1h"): "bad_interval",
    }
    assert archive.candles().count() == 6
    assert status(series_updates.save_series(archive, work, read, *catalogue(spark)))[("AAPL", "1min")] == "exists"


def test_stream_stores_each_candle_once(spark, archive, tmp_path):
    archive.register(spark.createDataFrame([("equity", "1min", "AAPL_XNGS")], schemas.REGISTRY))
    folder, progress = tmp_path / "stream", str(tmp_path / "progress")
    base = datetime(2020, 3, 24, 9, 0)
    for wave in range(3):  # each wave repeats the last two minutes of the one before
        minutes = [base + timedelta(minutes=m) for m in range(wave * 8 - (2 if wave else 0), wave * 8 + 8)]
        land(folder, 2 * wave, meta=EQUITY, status="ok", values=[value(str(m)) for m in reversed(minutes)])
        land(folder, 2 * wave + 1, meta={**EQUITY, "symbol": "NVDA"}, status="ok", values=[value(str(minutes[0]))])
        ingest.ingest_pages(archive, ingest.page_stream(spark, str(folder)), progress).awaitTermination()
    stored = archive.candles().orderBy("ID").collect()
    assert [(r.ID, r.datetime) for r in stored] == [(i, base + timedelta(minutes=i)) for i in range(24)]
    assert archive.progress().select(*SERIES).collect() == [("equity", "1min", "AAPL_XNGS")]
