"""Loads with bad values, pages that form chains, commits of the archive, and series at different paces."""

import json
import random
import threading
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barvault import schemas
from barvault.errors import ConcurrentWrite
from barvault.operators import summaries
from barvault.plans import series_updates
from barvault.sources import archive as archive_module
from barvault.sources import chains, checked, landing
from barvault.sources.archive import SERIES, CandleArchive
from barvault.streaming import ingest
from tests.test_storage import EQUITY, archive, land, series_rows, value  # noqa: F401

BASE = datetime(2024, 2, 1, 9, 0)


def page(minutes, meta=EQUITY, **more):
    return {"meta": meta, "status": "ok", "values": [value(str(BASE + timedelta(minutes=m)), **more) for m in minutes]}


def stored(archive, key=None):
    rows = archive.candles() if key is None else archive.candles().where(F.col("series_key") == key)
    return [(r.series_key, r.ID, r.datetime) for r in rows.orderBy("series_key", "ID").collect()]


# --- bad values ------------------------------------------------------------------------------------------------
BAD = [
    ("datetime", "soon", "malformed"), ("datetime", None, "missing"), ("open", "n/a", "malformed"),
    ("high", "600000.0", "out_of_range"), ("close", "-100000", "out_of_range"), ("low", None, "missing"),
    ("close", "NaN", "malformed"), ("open", "Infinity", "malformed"), ("low", "", "malformed"),
    ("volume", "12.5", "malformed"), ("volume", "9" * 30, "out_of_range"), ("volume", "many", "malformed"),
]


def test_each_bad_value_is_one_reject_row(spark, tmp_path):
    good = value("2024-02-01 09:00:00", "99999.99999")
    rows = [good, *[good | {field: bad} for field, bad, _ in BAD], good | {"open": "x", "volume": "y"}, good | {"volume": None}]
    folder = tmp_path / "pages"
    land(folder, 0, meta=EQUITY, status="ok", values=rows)
    pages = landing.read_pages(spark, str(folder))
    found = landing.page_rejects(pages).collect()
    expected = [(i, *bad) for i, bad in enumerate(BAD, 1)] + [(13, "open", "x", "malformed"), (13, "volume", "y", "malformed")]
    assert sorted((r.value_pos, r.field, r.value, r.problem) for r in found) == sorted(expected, key=lambda x: (x[0], x[1]))
    assert {(r.time_interval, r.series_key, r.source_file[-9:]) for r in found} == {("1min", "AAPL_XNGS", "0000.json")}
    kept = landing.page_candles(pages).collect()
    assert [(r.close, r.volume) for r in kept] == [(Decimal("99999.99999"), 490), (Decimal("99999.99999"), None)]


def test_pages_that_are_no_pages(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    lines = [
        json.dumps(page([0])), '{"meta": {"symbol": "AAPL"', json.dumps({"meta": EQUITY, "values": "none"}),
        json.dumps({"meta": EQUITY, "status": "ok"}), json.dumps({"code": 404, "message": "gone"}),
        json.dumps(page([1], {**EQUITY, "interval": "1h"})), json.dumps(page([2], {"interval": "1min", "mic_code": "X"})),
        json.dumps(page([3], {"symbol": "AAPL", "interval": "1min"})), json.dumps(page([], EQUITY)),
        json.dumps(page([4], {"symbol": "AAPL", "mic_code": "XNGS"})),
    ]
    (folder / "a.json").write_text("\n".join(lines))
    pages = landing.read_pages(spark, str(folder))
    found = sorted(((r.field, r.problem, r.value) for r in landing.page_rejects(pages).collect()), key=str)
    kinds = [(f, p) for f, p, _ in found]
    assert kinds == [
        ("interval", "missing"), ("interval", "not_allowed"), ("mic_code", "missing"), ("record", "malformed"),
        ("record", "malformed"), ("symbol", "missing"), ("values", "missing"),
    ]
    assert {v for f, _, v in found if f == "record"} == {lines[1], lines[2]}
    assert [r.datetime for r in landing.page_candles(pages).collect()] == [BASE]


def test_csv_with_bad_lines(spark, tmp_path):
    folder = tmp_path / "csv" / "series_key=AAPL_XNGS" / "time_interval=1day"
    folder.mkdir(parents=True)
    lines = ["2024-03-24;3;8;1.5;5;490", "2024-03-25;3;8", "someday;3;8;1.5;5;490", "2024-03-26;3;8;1.5;600000.0;1", "2024-03-27;3;8;1;5;"]
    (folder / "a.csv").write_text("\n".join(["datetime;open;high;low;close;volume", *lines]))
    path = str(tmp_path / "csv")
    assert sorted(r.datetime.day for r in landing.read_candle_csv(spark, path, ";").collect()) == [24, 27]
    rejects = {(r.field, r.value, r.problem) for r in landing.csv_rejects(spark, path, ";").collect()}
    assert rejects == {
        ("record", "2024-03-25;3;8", "malformed"), ("datetime", "someday", "malformed"), ("close", "600000.0", "out_of_range"),
    }


def test_save_keeps_the_rejects(spark, archive, tmp_path):  # noqa: F811
    folder = tmp_path / "pages"
    bad = page([5, 4, 3])
    bad["values"][1]["open"] = "n/a"
    land(folder, 0, **bad)
    land(folder, 1, **page([9], {**EQUITY, "symbol": "MSFT"}, price="bad"))
    stocks, pairs = (spark.createDataFrame(rows, "symbol string") for rows in ([("AAPL",)], [("USD/EUR",)]))
    read = landing.read_pages(spark, str(folder))
    series_updates.save_one(archive, read, stocks, pairs, "AAPL", "1min", "XNGS")
    assert [t.minute for _, _, t in stored(archive)] == [3, 5]
    assert [(r.series_key, r.field, r.value) for r in archive.rejects().collect()] == [("AAPL_XNGS", "open", "n/a")]
    series_updates.update_one(archive, read, stocks, pairs, "AAPL", "1min", "XNGS")
    assert archive.rejects().count() == 1  # the same one again


# --- chains ----------------------------------------------------------------------------------------------------
def chain_pages(spark, tmp_path, pages):
    folder = tmp_path / "pages"
    for number, one in enumerate(pages):
        land(folder, number, **one)
    return landing.read_pages(spark, str(folder))


def reports(df):
    minute = lambda t: None if t is None else int((t - BASE).total_seconds() // 60)
    return sorted(
        (r.series_key, minute(r.newest), minute(r.oldest), r.pages, r.candles, r.status, minute(r.gap_from), minute(r.gap_to))
        for r in df.collect()
    )


def test_chain_of_many_pages_with_a_missing_one(spark, tmp_path):
    """Pages of three minutes, landed in any order; the one from 40 to 38 never came."""
    starts = list(range(60, 0, -2))
    pages = [page([s, s - 1, s - 2]) for s in starts if s != 40]
    random.Random(4).shuffle(pages)
    pages.append(pages[0])  # landed twice
    pages.append(page([7, 6], {**EQUITY, "symbol": "LONE"}))
    read = chain_pages(spark, tmp_path, pages)
    assert reports(landing.page_chains(read)) == [
        ("AAPL_XNGS", 38, 0, 19, 39, "complete", None, None),
        ("AAPL_XNGS", 60, 40, 10, 21, "gap", 40, 38),
        ("LONE_XNGS", 7, 6, 1, 2, "complete", None, None),
    ]
    linked = chain_report_places(read)
    assert linked[60] == 0 and linked[42] == 9 and linked[38] == 0 and linked[2] == 18


def chain_report_places(pages):
    rows = chains.linked_pages(checked.page_table(pages).where("series_key = 'AAPL_XNGS'")).collect()
    return {int((r.newest - BASE).total_seconds() // 60): r.place for r in rows}


def test_full_last_page_and_earliest_point(spark, tmp_path):
    full = page(range(6000, 6000 - 4999, -1))
    read = chain_pages(spark, tmp_path, [full])
    assert reports(landing.page_chains(read))[0][5] == "unfinished"
    first = spark.createDataFrame([("equity", "1min", "AAPL_XNGS", BASE + timedelta(minutes=1002))], f"{schemas.REGISTRY}, datetime timestamp_ntz")
    assert reports(landing.page_chains(read, first))[0][5] == "complete"


def test_overlapping_downloads_are_no_gap(spark, tmp_path):
    read = chain_pages(spark, tmp_path, [page([20, 10, 5]), page([18, 17]), page([4, 3])])
    assert [(r[1], r[5], r[6], r[7]) for r in reports(landing.page_chains(read))] == [
        (4, "complete", None, None), (18, "gap", 5, 4), (20, "overlap", None, None),
    ]


def test_bad_edge_does_not_break_the_chain(spark, tmp_path):
    first, second = page([9, 8, 7]), page([7, 6])
    first["values"][2]["open"] = "n/a"
    read = chain_pages(spark, tmp_path, [first, second])
    assert reports(landing.page_chains(read)) == [("AAPL_XNGS", 9, 6, 2, 4, "complete", None, None)]
    assert landing.stitch(landing.page_candles(read)).count() == 4  # the good copy of minute 7 stays


@pytest.mark.parametrize("seed", range(4))
def test_the_copy_of_the_newer_page_wins(spark, tmp_path, seed):
    pages = [page([9, 8, 7], price=30), page([7, 6, 5], price=20), page([5, 4], price=10)]
    random.Random(seed).shuffle(pages)
    rows = landing.stitch(landing.page_candles(chain_pages(spark, tmp_path, pages).repartition(3)))
    close = {int((r.datetime - BASE).total_seconds() // 60): int(r.close) for r in rows.collect()}
    assert close == {9: 30, 8: 30, 7: 30, 6: 20, 5: 20, 4: 10}


# --- commits ---------------------------------------------------------------------------------------------------
def test_two_appends_at_once(spark, archive):  # noqa: F811
    rows, times = series_rows(spark, interval="1day", count=40)
    parts = [rows.where(F.col("datetime") <= times[24]), rows.where(F.col("datetime") <= times[39])]
    failures = []

    def run(part):
        try:
            CandleArchive(spark, archive.database).append(part)
        except Exception as error:  # noqa: BLE001
            failures.append(error)

    threads = [threading.Thread(target=run, args=(p,)) for p in parts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures
    own = stored(archive)
    assert [i for _, i, _ in own] == list(range(40)) and [t for *_, t in own] == times


def test_the_second_writer_starts_again(spark, archive, monkeypatch):  # noqa: F811
    """Another writer commits between the reading and the commit of the first one."""
    rows, times = series_rows(spark, interval="1day", count=30)
    other = CandleArchive(spark, archive.database)
    write, calls = CandleArchive._write, []

    def overtaken(self, numbered, batch):
        calls.append(batch)
        if len(calls) == 1:
            monkeypatch.setattr(CandleArchive, "_write", write)
            other.append(rows.where(F.col("datetime") <= times[9]))
        return write(self, numbered, batch)

    monkeypatch.setattr(CandleArchive, "_write", overtaken)
    archive.append(rows.where(F.col("datetime") <= times[19]))
    assert [(i, t) for _, i, t in stored(archive)] == list(enumerate(times[:20]))
    assert archive.candles().count() == archive.totals().first().rows == 20
    versions = archive.manifest.versions()
    assert not archive.manifest.commit(versions[-1], "late")  # the number is taken
    monkeypatch.setattr(archive_module, "ATTEMPTS", 0)
    with pytest.raises(ConcurrentWrite):
        archive.append(rows)


def test_a_killed_append_is_invisible(spark, archive, monkeypatch):  # noqa: F811
    rows, times = series_rows(spark, interval="1day", count=30)
    archive.append(rows.where(F.col("datetime") <= times[9]))
    with monkeypatch.context() as patch:
        patch.setattr(archive.manifest.__class__, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            archive.append(rows)
    assert spark.table(f"{archive.database}.candles").count() == 30  # its files are there
    assert archive.candles().count() == 10 and archive.progress().first().last_id == 9
    assert spark.table(f"{archive.database}.candles_explained").count() == 10
    assert archive.totals().first().rows == 10
    archive.append(rows)
    assert [(i, t) for _, i, t in stored(archive)] == list(enumerate(times))
    assert archive.candles(version=1).count() == 10  # what was stored then


def test_a_source_is_taken_once(spark, archive):  # noqa: F811
    rows, _ = series_rows(spark, interval="1day", count=5)
    for _ in range(2):
        archive.append(rows, source="epoch 7", registered_only=True)
    assert [(r.reason, r.times) for r in archive.set_aside().collect()] == [("unregistered", 1)] * 5
    assert archive.candles().count() == 0


def test_append_reads_only_the_months_of_the_batch(spark, archive):  # noqa: F811
    rows, _ = series_rows(spark, interval="1day", count=3)
    at = lambda *days: rows.limit(1).select(
        *[c for c in rows.columns if c != "datetime"], F.explode(F.array(*[F.lit(d).cast("timestamp_ntz") for d in days])).alias("datetime")
    )
    for year in range(2018, 2025):
        archive.append(at(datetime(year, 5, 1)))
    found = archive.unseen(at(datetime(2018, 5, 1), datetime(2024, 5, 1), datetime(2024, 5, 2)))
    assert [r.datetime for r in found.collect()] == [datetime(2024, 5, 2)]
    executed = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in executed
    scanned = archive.unseen(at(datetime(2018, 5, 1), datetime(2024, 5, 1)))
    scanned.collect()
    assert partitions_read(scanned) == 2


def partitions_read(df):
    """Partitions of the candle scan, as its metrics tell after the run."""
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec" and "numPartitions" in str(node.metrics()):
            found.append(node.metrics().apply("numPartitions").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    (count,) = found
    return count


# --- deletes, months, totals -------------------------------------------------------------------------------------
def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def check_totals(archive):
    """The kept totals say what scans of the candles say."""
    candles, totals = archive.candles(), archive.totals()
    keys = list(SERIES)
    same(totals.select(*keys, "rows"), summaries.row_counts(candles, keys))
    same(totals.select(*keys, "last_id"), summaries.last_id(candles, keys=keys))
    same(totals.select(*keys, "latest"), summaries.latest_timestamp(candles, keys=keys))
    same(totals.select(*keys, F.col("earliest").alias("datetime")), summaries.earliest_point(candles, keys))
    bounds = summaries.axis_bounds(F.col("high"), F.col("low"), F.col("volume"), F.col("rows"))
    same(totals.select(*keys, *bounds), summaries.extents(candles, keys))
    last = summaries.latest_candle(candles, keys).select(*keys, F.col("open").alias("last_open"), F.col("close").alias("last_close"))
    same(totals.select(*keys, "last_open", "last_close"), last)
    for kept, scanned in (
        (summaries.kept_row_counts, summaries.row_counts),
        (summaries.kept_earliest_point, summaries.earliest_point),
        (summaries.kept_latest_candle, summaries.latest_candle),
        (summaries.kept_extents, summaries.extents),
    ):
        same(kept(totals, keys), scanned(candles, keys))
    others = [k for k in keys if k != "asset_class"]
    same(summaries.kept_last_price(totals, keys), summaries.last_price(candles, others))
    registry = archive.registry()
    same(summaries.kept_last_id(totals, registry, keys), summaries.last_id(candles, registry, keys))
    same(summaries.kept_latest_timestamp(totals, registry, keys), summaries.latest_timestamp(candles, registry, keys))


def test_deletes_are_tombstones_until_they_are_folded(spark, archive):  # noqa: F811
    a, times = series_rows(spark, "A", "1day", 120, 3)
    b, _ = series_rows(spark, "B", "1day", 60, 4)
    archive.register(a.unionByName(b))
    archive.append(a.where(F.col("datetime") <= times[60]).unionByName(b))
    archive.append(a)
    files = lambda: set(spark.table(f"{archive.database}.candles").inputFiles())
    before = files()
    check_totals(archive)
    for gone in (7, 64, 119, 118, 500):
        archive.delete_row("equity", "1day", "A", gone)
    assert files() == before  # nothing was rewritten
    check_totals(archive)
    archive.append(a.where(F.col("datetime") >= times[118]))  # the last two IDs are given again
    left = [i for i in range(120) if i not in (7, 64)]
    assert [i for _, i, _ in stored(archive, "A")] == left
    archive.append(a.where(F.col("datetime") == times[7]))  # an old candle cannot come back in between
    assert [(r.datetime, r.reason) for r in archive.set_aside().collect()] == [(times[7], "late")]
    archive.drop_series("equity", "1day", "B")
    check_totals(archive)
    view = spark.table(f"{archive.database}.candles_explained")
    assert sorted(r.ID for r in view.collect()) == left
    expected = stored(archive)
    snapshot = archive.snapshot()
    assert snapshot.deleted and snapshot.dropped
    archive.compact()
    folded = archive.snapshot()
    assert not folded.deleted and not folded.dropped and folded.replaced
    assert stored(archive) == expected
    assert sorted(r.ID for r in spark.table(f"{archive.database}.candles_explained").collect()) == left
    check_totals(archive)
    assert archive.candles(snapshot.version).count() == len(expected)
    archive.register(b)
    archive.append(b)  # a dropped series begins anew
    assert [i for _, i, _ in stored(archive, "B")] == list(range(60))
    check_totals(archive)
    archive.compact()  # nothing to do


def test_by_id_reads_its_month(spark, archive):  # noqa: F811
    rows, times = series_rows(spark, "A", "1day", 200, 5)
    archive.append(rows)
    found = archive.by_id("equity", "1day", "A", 77)
    assert [(r.ID, r.datetime) for r in found.collect()] == [(77, times[77])]
    assert partitions_read(found) == 1
    assert [r.ID for r in archive.by_id("equity", "1day", "A", 190, 500).orderBy("ID").collect()] == list(range(190, 200))
    assert archive.by_id("equity", "1day", "A", 200).count() == archive.by_id("equity", "1day", "B", 0).count() == 0
    assert "candles" not in "".join(archive.totals().inputFiles())
    for kept in (summaries.kept_extents, summaries.kept_latest_candle, summaries.kept_last_price):
        assert "candles" not in "".join(kept(archive.totals(), list(SERIES)).inputFiles())


# --- series at different paces -----------------------------------------------------------------------------------
def test_a_lagging_series_is_stored(spark, archive, tmp_path):  # noqa: F811
    """A is in March when the first candles of B, of February, arrive."""
    archive.register(spark.createDataFrame([("equity", "1min", f"{k}_XNGS") for k in "AB"], schemas.REGISTRY))
    folder, progress = tmp_path / "stream", str(tmp_path / "progress")
    meta = lambda k: {**EQUITY, "symbol": k}
    march = 29 * 24 * 60
    waves = [
        [page([march + 2, march + 1, march], meta("A"))],
        [page([1441, 1440, 0], meta("B"))],
        [page([march + 1, march - 5], meta("A")), page([2000, 1441, 7], meta("B")), page([0], meta("C")), page([0], meta("A"), price="x")],
    ]
    for number, wave in enumerate(waves):
        for i, one in enumerate(wave):
            land(folder, 10 * number + i, **one)
        ingest.ingest_pages(archive, ingest.page_stream(spark, str(folder)), progress).awaitTermination()
    minutes = [(k[0], i, int((t - BASE).total_seconds() // 60)) for k, i, t in stored(archive)]
    assert minutes == [
        ("A", 0, march), ("A", 1, march + 1), ("A", 2, march + 2), ("B", 0, 0), ("B", 1, 1440), ("B", 2, 1441), ("B", 3, 2000),
    ]
    aside = {(r.series_key[0], int((r.datetime - BASE).total_seconds() // 60), r.reason, r.times) for r in archive.set_aside().collect()}
    assert aside == {("A", march - 5, "late", 1), ("B", 7, "late", 1), ("C", 0, "unregistered", 1)}
    assert [(r.series_key, r.field, r.value) for r in archive.rejects().collect()] == [("A_XNGS", "close", "x")]
