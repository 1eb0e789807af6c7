"""Queries over loads that go wrong in part, commits and deletes of the archive, and series at different paces."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barvault.functions import text
from barvault.operators import summaries
from barvault.plans import adapters
from barvault.plans.registered import MID, REGISTERED, filled, landed_pages, new_warehouse, register, symbols_of
from barvault.session import fresh_folder, materialise
from barvault.sources import landing
from barvault.sources.archive import SERIES
from barvault.streaming import ingest

__all__ = ["REGISTERED"]

LOST_DAYS = ("2024-01-10", "2024-01-20")


def damaged_pages(spark, sf_dir) -> DataFrame:
    """Landed pages of one day each, as a provider in trouble would send them: some minutes carry a bad value, and the
    pages of one day of the month name an interval that is not allowed."""
    rows = symbols_of(adapters.unnumbered_candles(spark, sf_dir, "1min"))
    minute, shown = F.minute("datetime"), lambda c: F.col(c).cast("string")
    value = F.struct(
        F.when(minute == 13, "soon").otherwise(shown("datetime")).alias("datetime"),
        F.when(minute == 7, "n/a").otherwise(shown("open")).alias("open"),
        F.when(minute != 19, shown("high")).alias("high"),
        shown("low").alias("low"),
        F.when(minute == 11, "600000.0").otherwise(shown("close")).alias("close"),
        F.when(minute == 17, "12.5").otherwise(shown("volume")).alias("volume"),
    )
    interval = F.when(F.dayofmonth("datetime") == 10, "1h").otherwise(F.col("time_interval"))
    days = rows.groupBy("symbol", interval.alias("interval"), "mic_code", "currency", F.col("datetime").cast("date").alias("day"))
    pages = days.agg(F.sort_array(F.collect_list(F.struct("datetime", value.alias("v"))), asc=False).alias("rows"))
    path = fresh_folder(spark, "pages")
    pages.select(
        F.struct("symbol", "interval", "mic_code", "currency").alias("meta"), F.col("rows.v").alias("values"), F.lit("ok").alias("status")
    ).write.json(path)
    return landing.read_pages(spark, path)


def _counted(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("time_interval", "series_key", "field", "value", "problem").agg(F.count(F.lit(1)).alias("n"))


@register("s5_page_rejects")
def s5_rejects(spark, sf_dir):
    """What is wrong with the values of the damaged pages."""
    return _counted(landing.page_rejects(damaged_pages(spark, sf_dir)))


@register("s5_quarantined_load")
def s5_load(spark, sf_dir):
    """The good candles of the damaged pages, stored; the others do not stop the load."""
    archive = new_warehouse(spark)
    pages = damaged_pages(spark, sf_dir)
    archive.append(landing.stitch(landing.page_candles(pages)), rejects=landing.page_rejects(pages))
    return archive.candles()


@register("s5_stored_rejects")
def s5_stored(spark, sf_dir):
    """The bad values of the damaged pages as a load keeps them, also when it is repeated."""
    archive = new_warehouse(spark)
    pages = damaged_pages(spark, sf_dir)
    for _ in range(2):
        archive.append(landing.stitch(landing.page_candles(pages)), rejects=landing.page_rejects(pages))
    return _counted(archive.rejects())


@register("s6_csv_rejects")
def s6_rejects(spark, sf_dir):
    """Bad values of candles landed as CSV."""
    hour, shown = F.hour("datetime"), lambda c: F.col(c).cast("string")
    rows = adapters.unnumbered_candles(spark, sf_dir, "1min").select(
        "series_key",
        F.when(hour == 5, "5min").otherwise(F.col("time_interval")).alias("time_interval"),
        shown("datetime").alias("datetime"),
        shown("open").alias("open"),
        F.when(hour == 7, "1e9").otherwise(shown("high")).alias("high"),
        F.when(hour == 11, "?").otherwise(shown("low")).alias("low"),
        shown("close").alias("close"),
        shown("volume").alias("volume"),
    )
    path = fresh_folder(spark, "csv")
    rows.write.partitionBy("series_key", "time_interval").option("header", True).option("sep", ";").csv(path)
    return _counted(landing.csv_rejects(spark, path, ";"))


@register("s8_page_chains")
def s8_chains(spark, sf_dir):
    """The chains that the landed pages form when those of two days never came."""
    pages = landing.read_pages(spark, landed_pages(spark, sf_dir, "1min"))
    day = F.substring(F.element_at("values", -1)["datetime"], 1, 10)
    return landing.page_chains(pages.where(~day.isin(*LOST_DAYS)))


@register("s8_conflicting_copies")
def s8_conflicts(spark, sf_dir):
    """Stitched pages whose copy of the candle that the newer page ends with says something else."""
    pages = landing.read_pages(spark, landed_pages(spark, sf_dir, "1min"))
    first, second = F.element_at("values", 1), F.try_element_at("values", F.lit(2))
    copied = F.substring(first["datetime"], 1, 10) != F.substring(second["datetime"], 1, 10)
    other = F.concat(F.array(first.withField("close", F.lit("1.00000"))), F.slice("values", 2, F.size("values")))
    # a page of one copied candle and one of its own has them on two days as well
    pages = pages.withColumn("values", F.when(copied, other).otherwise(F.col("values")))
    return landing.stitch(landing.page_candles(pages))


@register("s11_as_of_version")
def s11_version(spark, sf_dir):
    """What the archive held after the first of two appends."""
    archive = filled(spark, sf_dir)
    return archive.candles(version=archive.manifest.versions()[1])


@register("p9_archive_by_id", 3)
@register("p10_archive_ids", 5, 12)
def archive_ids(spark, sf_dir, first, last=None):
    return filled(spark, sf_dir).by_id("equity", "1day", "error", first, last)


@register("s14_folded_deletes")
def s14_folded(spark, sf_dir):
    """Deleted candles and a dropped series, folded into the files."""
    archive = filled(spark, sf_dir)
    archive.delete_row("equity", "1day", "error", 3)
    archive.delete_row("equity", "1day", "purchase", 0)
    archive.drop_series("equity", "1day", "click")
    archive.compact()
    return archive.candles()


@register("a1_kept_totals")
def a1_totals(spark, sf_dir):
    """Rows, IDs, times, extremes and last prices per series, from the summaries of the months after a delete."""
    archive = filled(spark, sf_dir, "1min")
    archive.delete_row("equity", "1min", "error", 3)
    return archive.totals().drop("last_high", "last_low", "last_volume")


@register("a1_kept_summaries")
def kept_summaries(spark, sf_dir):
    """All summaries of series, chart bounds included, from the kept totals, after a candle in between and the last candle of
    a series were deleted; no candle is read for them."""
    archive = filled(spark, sf_dir)
    archive.delete_row("equity", "1day", "error", 3)
    last = archive.progress().where("series_key = 'purchase'").first().last_id
    archive.delete_row("equity", "1day", "purchase", last)
    totals = materialise(archive.totals())
    out = summaries.kept_latest_candle(totals).withColumnRenamed("datetime", "latest_time")
    for one in (
        summaries.kept_row_counts(totals),
        summaries.kept_latest_timestamp(totals),
        summaries.kept_last_id(totals),
        summaries.kept_earliest_point(totals),
        summaries.kept_last_price(totals),
        summaries.kept_extents(totals),
    ):
        out = out.join(one, "series_key")
    return out


@register("r1_lagging_series")
def r1_lagging(spark, sf_dir):
    """Series at different paces: one is complete when others have just begun, one comes late as a whole, one has a hole
    that is filled too late. Every landed candle is stored or set aside."""
    archive = new_warehouse(spark)
    named = symbols_of(adapters.unnumbered_candles(spark, sf_dir, "1day"))
    forex = F.col("asset_class") == "forex"
    key = F.when(forex, text.forex_key(F.col("symbol"), F.col("time_interval"))).otherwise(
        text.equity_key(F.col("symbol"), F.col("mic_code"))
    )
    archive.register(named.select("asset_class", "time_interval", key.alias("series_key")))
    day, at = F.col("datetime"), lambda d: F.lit(d).cast("timestamp_ntz")
    hole = day.between(at(datetime(2024, 1, 5)), at(datetime(2024, 1, 8)))
    early = (
        (F.col("series_key") == "click")
        | (F.col("series_key") == "purchase") & (day <= at(datetime(2024, 1, 10)))
        | (F.col("series_key") == "error") & (day <= at(datetime(2024, 1, 3)))
        | (F.col("series_key") == "signup") & (day <= at(MID)) & ~hole
    )
    path, checkpoint = fresh_folder(spark, "pages"), fresh_folder(spark, "progress")
    for number, wave in enumerate((named.where(early), named)):
        landing.land_pages(wave, f"{path}/wave={number}")
        ingest.ingest_pages(archive, ingest.page_stream(spark, f"{path}/*"), checkpoint).awaitTermination()
    held = archive.candles().select(*SERIES, "ID", "datetime", "close", F.lit("stored").alias("status"))
    aside = archive.set_aside().select(
        *SERIES, F.lit(None).cast("bigint").alias("ID"), "datetime", "close", F.col("reason").alias("status")
    )
    return held.unionByName(aside)

