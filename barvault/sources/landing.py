"""Readers for landed provider responses: instrument lists, candle pages, usage logs.

A landing folder holds responses as JSON lines (or one response per file with ``multi_line=True``). Every reader
takes an explicit schema and reads the whole folder in one job.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barvault import schemas
from barvault.functions import clock
from barvault.sources import chains, checked

NOT_FOUND = 404  # fixed value: the only error code that stops a query
DEFAULT_POINTS = 5000  # fixed values: defaults of a candle query
DEFAULT_MIC = "XNGS"
DEFAULT_INTERVAL = "1min"
DEFAULT_CURRENCY = "USD"


def read_responses(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .json(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


# --- error envelope --------------------------------------------------------------------------------------------
def response_errors(responses: DataFrame, payload: str) -> DataFrame:
    """Responses that carry no usable payload: code 404, or the payload field is missing."""
    return responses.where(_is_error(payload)).select("source_file", "code", "message")


def good_responses(responses: DataFrame, payload: str) -> DataFrame:
    return responses.where(~_is_error(payload))


def _is_error(payload: str):
    return F.coalesce(F.col("code") == NOT_FOUND, F.lit(False)) | F.col(payload).isNull()


# --- instrument lists ------------------------------------------------------------------------------------------
def read_list(spark: SparkSession, path: str, row_ddl: str, multi_line: bool = False) -> DataFrame:
    """The rows under ``data`` of all list responses, with ``input_pos`` for ties in later sorts.

    ``row_ddl`` is one of ``schemas.LISTS``, or the caller's own for fund and index lists.
    """
    responses = read_responses(spark, path, schemas.list_response(row_ddl), multi_line)
    return (
        good_responses(responses, "data")
        .select("source_file", F.posexplode("data").alias("_pos", "_row"))
        .select("_row.*", F.struct("source_file", "_pos").alias("input_pos"))
    )


def read_equities(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_list(spark, path, schemas.EQUITY_ROW, **options)


def read_forex_pairs(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_list(spark, path, schemas.FOREX_ROW, **options)


def read_exchanges(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_list(spark, path, schemas.EXCHANGE_ROW, **options)


# --- candle pages ----------------------------------------------------------------------------------------------
def read_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Landed pages; a record that is not of their form is kept as text in a column of its own."""
    return read_responses(spark, path, f"{schemas.PAGE}, {schemas.CORRUPT} string", multi_line)


def page_candles(pages: DataFrame) -> DataFrame:
    """Every good value of every good page as a typed candle, with the series and the page it belongs to.

    What is missing, malformed or too large is in ``page_rejects``; the rest of the load goes on without it.
    """
    return checked.good(checked.judged_pages(pages)).drop("source_file", "value_pos")


def page_rejects(pages: DataFrame) -> DataFrame:
    """One row per bad value of the pages: file, place, series, field, text and what is wrong with it."""
    return checked.rejected(checked.judged_pages(pages))


def page_chains(pages: DataFrame, earliest: DataFrame | None = None) -> DataFrame:
    """The chains that the pages of each series form, with the gaps between them (see ``chains.chain_report``)."""
    return chains.chain_report(checked.page_table(pages), earliest)


def stitch(page_rows: DataFrame) -> DataFrame:
    """Neighbouring pages share one candle: keep the copy of the newer page. Sort by ``datetime`` descending for the
    provider's order."""
    return chains.stitched(page_rows)


def candle_page(
    page_rows: DataFrame,
    symbol: str,
    mic_code: str | None = None,
    time_interval: str | None = None,
    currency: str | None = None,
    start_date: datetime | None = None,
    end_date: datetime | None = None,
    date: datetime | None = None,
    points: int | None = DEFAULT_POINTS,
) -> DataFrame:
    """One query on the landed candles: inclusive dates, newest first, at most ``points`` rows."""
    rows = page_rows.where(
        (F.col("symbol") == symbol) & (F.col("time_interval") == (time_interval or DEFAULT_INTERVAL))
    )
    if "/" not in symbol:
        rows = rows.where(
            (F.col("mic_code") == (mic_code or DEFAULT_MIC)) & (F.col("currency") == (currency or DEFAULT_CURRENCY))
        )
    moment = lambda d: F.lit(d).cast("timestamp_ntz")
    if start_date:
        rows = rows.where(F.col("datetime") >= moment(start_date))
    if end_date:
        rows = rows.where(F.col("datetime") <= moment(end_date))
    if date:
        rows = rows.where(F.col("datetime") == moment(date))
    rows = stitch(rows).orderBy(F.desc("datetime"))
    return rows.limit(points) if points else rows


def read_candle_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Good candles landed as CSV in folders ``series_key=…/time_interval=…``; the separator is the caller's."""
    return checked.good(checked.judged_csv(spark, path, sep)).drop("source_file")


def csv_rejects(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """One row per bad value of the CSV files, and per line with too few or too many fields."""
    return checked.rejected(checked.judged_csv(spark, path, sep))


# --- usage log -------------------------------------------------------------------------------------------------
def usage_report(log: DataFrame) -> DataFrame:
    """Credits used per logged response header."""
    return log.select(
        "key_name",
        clock.parse_http_date(F.col("date")).alias("timestamp"),
        F.col("credits_used").alias("current_usage"),
        (F.col("credits_left") + F.col("credits_used")).alias("plan_limit"),
        (F.col("daily_limit") - F.col("daily_remaining")).alias("daily_usage"),
        F.col("daily_limit").alias("plan_daily_limit"),
    )


# --- writing landed responses (test data and re-landing) ---------------------------------------------------------
def land_list(rows: DataFrame, path: str) -> None:
    """Write list rows as one-row responses; no list is ever gathered into one task."""
    rows.select(F.array(F.struct(*rows.columns)).alias("data"), F.lit("ok").alias("status")).write.json(path)


def land_pages(candles: DataFrame, path: str) -> None:
    """Write candles (with ``symbol``, ``mic_code``, ``currency``) as pages, newest first, one per calendar day of a
    series, each but the latest starting with the oldest candle of the page after it."""
    identity = ["symbol", "time_interval", "mic_code", "currency"]
    text_time = F.when(F.col("time_interval") == "1day", F.col("datetime").cast("date").cast("string")).otherwise(
        F.col("datetime").cast("string")
    )
    value = F.struct(
        text_time.alias("datetime"),
        *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")],
    )
    days = (
        candles.withColumn("_day", F.col("datetime").cast("date"))
        .groupBy(*identity, "_day")
        .agg(F.sort_array(F.collect_list(value), asc=False).alias("_values"))
    )
    # one page per day: at most 1,440 minute candles; the window sees one row per page
    next_page = F.lead(F.element_at("_values", -1)).over(Window.partitionBy(*identity).orderBy("_day"))
    pages = days.withColumn("_next", next_page).select(
        F.struct(
            "symbol", F.col("time_interval").alias("interval"), "mic_code", "currency"
        ).alias("meta"),
        F.when(F.col("_next").isNull(), F.col("_values"))
        .otherwise(F.concat(F.array("_next"), F.col("_values")))
        .alias("values"),
        F.lit("ok").alias("status"),
    )
    pages.write.json(path)
