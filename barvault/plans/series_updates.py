"""First save and later updates of candle series from landed pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barvault.errors import SeriesExists, SeriesNotFound
from barvault.operators.joins import join_unique
from barvault.operators.series import flag_registered, resolve_one, resolve_series
from barvault.session import materialise
from barvault.sources import checked
from barvault.sources.archive import SERIES, CandleArchive
from barvault.sources.landing import stitch


def _rejects_for(judged: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bad values of the wanted series, and of pages that do not tell their series."""
    found = checked.rejected(judged)
    named = wanted.select("time_interval", "series_key").distinct()
    return found.join(named, ["time_interval", "series_key"], "left_semi").unionByName(found.where("series_key IS NULL"))


def save_series(
    archive: CandleArchive, worklist: DataFrame, pages: DataFrame, stocks: DataFrame, forex_pairs: DataFrame
) -> DataFrame:
    """Store the full landed history of every series of the worklist that has no candles yet. Bad values do not stop the
    load; they come into the archive's rejects.

    Returns the worklist with its ``status``: stored, exists (has candles already) or why it was not resolved.
    """
    known = resolve_series(worklist, stocks, forex_pairs)
    held = archive.progress().select(*SERIES, F.lit(True).alias("_held"))
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("_held"), "exists").otherwise("stored")
    report = materialise(known.join(held, list(SERIES), "left").withColumn("status", status).drop("_held"))
    wanted = report.where("status = 'stored'").select(*SERIES).distinct()
    archive.register(wanted)
    judged = materialise(checked.judged_pages(pages))
    rows = stitch(checked.good(judged).join(wanted, list(SERIES), "left_semi"))
    archive.append(rows, rejects=_rejects_for(judged, wanted))
    return report


def update_series(
    archive: CandleArchive,
    worklist: DataFrame,
    pages: DataFrame,
    stocks: DataFrame,
    forex_pairs: DataFrame,
    end_date: datetime | None = None,
) -> DataFrame:
    """Append landed candles from the latest stored one on (up to ``end_date``) to registered series.

    Returns the worklist with its ``status``: updated, not_found (never saved), exists (the archive already goes past
    ``end_date``) or why it was not resolved.
    """
    known = flag_registered(resolve_series(worklist, stocks, forex_pairs), archive.registry())
    known = known.join(archive.progress().select(*SERIES, "latest"), list(SERIES), "left")
    limit = F.lit(end_date).cast("timestamp_ntz")
    status = (
        F.when(F.col("status") != "ok", F.col("status"))
        .when(~F.col("registered"), "not_found")
        .when(F.coalesce(F.col("latest") > limit, F.lit(False)), "exists")
        .otherwise("updated")
    )
    report = materialise(known.withColumn("status", status).drop("registered"))
    wanted = report.where("status = 'updated'").select(*SERIES, "latest").distinct()
    judged = materialise(checked.judged_pages(pages))
    rows = join_unique(stitch(checked.good(judged)), wanted, SERIES, "inner")
    rows = rows.where(F.col("latest").isNull() | (F.col("datetime") >= F.col("latest")))
    if end_date is not None:
        rows = rows.where(F.col("datetime") <= limit)
    archive.append(rows.drop("latest"), rejects=_rejects_for(judged, wanted))
    return report.drop("latest")


def _one(archive: CandleArchive, symbol: str, mic_code: str | None, time_interval: str) -> DataFrame:
    return archive.spark.createDataFrame(
        [(symbol, mic_code, time_interval)], "symbol string, mic_code string, time_interval string"
    )


def save_one(archive, pages, stocks, forex_pairs, symbol: str, time_interval: str, mic_code: str | None = None) -> None:
    """Strict form of :func:`save_series`."""
    resolve_one(symbol, time_interval, stocks, forex_pairs, mic_code=mic_code)
    work = _one(archive, symbol, mic_code, time_interval)
    if save_series(archive, work, pages, stocks, forex_pairs).first().status == "exists":
        raise SeriesExists(f"{symbol} has candles already; update it instead")


def update_one(
    archive, pages, stocks, forex_pairs, symbol: str, time_interval: str, mic_code=None, end_date=None
) -> None:
    """Strict form of :func:`update_series`."""
    resolve_one(symbol, time_interval, stocks, forex_pairs, mic_code=mic_code)
    work = _one(archive, symbol, mic_code, time_interval)
    status = update_series(archive, work, pages, stocks, forex_pairs, end_date).first().status
    if status == "not_found":
        raise SeriesNotFound(f"{symbol} was never saved; save it first")
    if status == "exists":
        raise SeriesExists(f"{symbol} already goes past {end_date}")
