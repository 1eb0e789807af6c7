"""Landed candles with every field judged: good candles go on, each bad value becomes one row of a reject table.

Prices are stored as decimal(10,5), so 99,999.99999 is the largest one either way; a larger one is refused, not cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barvault import schemas
from barvault.functions import clock, text

PRICES = ("open", "close", "high", "low")
MISSING, MALFORMED, TOO_LARGE, NOT_ALLOWED = "missing", "malformed", "out_of_range", "not_allowed"
SHOWN = 1000  # characters of a broken record that its reject row shows

_RAW = ("datetime", *PRICES, "volume")


def _problem(field: str, value: Column, problem: Column) -> Column:
    """What is wrong with a field, or NULL."""
    found = F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), problem.alias("problem"))
    return F.when(problem.isNotNull(), found)


def _price_problem(value: Column) -> Column:
    """A price must be a number that the stored type holds."""
    number = value.try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < float("inf"))
    return (
        F.when(value.isNull(), MISSING)
        .when(~F.coalesce(finite, F.lit(False)), MALFORMED)
        .when(value.try_cast(schemas.PRICE).isNull(), TOO_LARGE)
    )


def _volume_problem(value: Column) -> Column:
    """A volume may be absent; otherwise it must be a whole number that a long holds."""
    whole = value.rlike(r"^\s*[+-]?\d+\s*$")
    return F.when(value.try_cast("bigint").isNull() & value.isNotNull(), F.when(whole, TOO_LARGE).otherwise(MALFORMED))


def _time_problem(value: Column) -> Column:
    return F.when(value.isNull(), MISSING).when(clock.try_candle_time(value).isNull(), MALFORMED)


def _judged(rows: DataFrame, raw: Callable[[str], Column], volume: Column, identity: Sequence[Column]) -> DataFrame:
    """``rows`` with typed fields, NULL where they cannot be read, and ``problems`` of the series and of the fields."""
    found = [
        *identity,
        _problem("datetime", raw("datetime"), _time_problem(raw("datetime"))),
        *[_problem(name, raw(name), _price_problem(raw(name))) for name in PRICES],
        _problem("volume", volume, _volume_problem(volume)),
    ]
    typed = {name: raw(name).try_cast(schemas.PRICE) for name in PRICES}
    return rows.withColumns(
        {
            "datetime": clock.try_candle_time(raw("datetime")),
            **typed,
            "volume": volume.try_cast("bigint"),
            "problems": F.filter(F.array(*found), lambda p: p.isNotNull()),
        }
    )


def _pages(pages: DataFrame) -> DataFrame:
    """One row per page that is not of code 404: its series, its name, its newest and oldest time, its values."""
    broken = F.col(schemas.CORRUPT) if schemas.CORRUPT in pages.columns else F.lit(None).cast("string")
    page = pages.where(~F.coalesce(F.col("code") == 404, F.lit(False))).select(
        "source_file",
        broken.alias("_broken"),
        F.col("meta.symbol").alias("symbol"),
        F.col("meta.interval").alias("time_interval"),
        F.col("meta.mic_code").alias("mic_code"),
        F.col("meta.currency").alias("currency"),
        F.when(broken.isNull(), F.col("values")).alias("_values"),
    )
    pair = F.coalesce(text.looks_like_pair(F.col("symbol")), F.lit(False))
    forex = text.forex_key(F.col("symbol"), F.col("time_interval"))
    equity = F.when(F.col("mic_code").isNotNull(), text.equity_key(F.col("symbol"), F.col("mic_code")))
    content = [F.xxhash64(F.lit(seed), "symbol", "time_interval", "mic_code", "_values") for seed in (0, 1)]
    times = F.transform("_values", lambda v: clock.try_candle_time(v["datetime"]))
    return page.withColumns(
        {
            "asset_class": F.when(pair, "forex").otherwise("equity"),
            "series_key": F.when(F.col("symbol").isNotNull(), F.when(pair, forex).otherwise(equity)),
            "page": F.concat(*[F.lower(F.lpad(F.hex(h), 16, "0")) for h in content]),
            "newest": F.array_max(times),
            "oldest": F.array_min(times),
        }
    )


def page_table(pages: DataFrame) -> DataFrame:
    """(series, page, newest, oldest, candles) per page whose series is known and that holds a time, each page once.

    ``page`` names a page by its contents, so one that was landed twice has one name. Rejected values count as candles:
    a page with bad values is still there.
    """
    known = _pages(pages).where(F.col("series_key").isNotNull() & F.col("newest").isNotNull())
    return known.select(
        "asset_class", "time_interval", "series_key", "page", "newest", "oldest",
        F.size("_values").cast("bigint").alias("candles"),
    ).distinct()


def judged_pages(pages: DataFrame) -> DataFrame:
    """Every value of every page as a row: its series, its typed fields and its ``problems``, an empty list for a good one.

    Pages of code 404 give no rows. A record that is not JSON of the page's form and a page without ``values`` give one
    row, which says so. A page's series must be known: a symbol, one of the two intervals, and for an equity the exchange code.
    """
    rows = _pages(pages).withColumn("_empty", F.col("_values").isNull())
    kept = [c for c in rows.columns if c != "_values"]
    rows = rows.select(*kept, F.posexplode_outer("_values").alias("value_pos", "_v"))
    rows = rows.where(F.col("_empty") | F.col("value_pos").isNotNull())
    interval, full, pair = F.col("time_interval"), ~F.col("_empty"), F.col("asset_class") == "forex"
    allowed = F.when(interval.isNull(), MISSING).when(~interval.isin(*schemas.ALLOWED_INTERVALS), NOT_ALLOWED)
    identity = [
        _problem("record", F.substring("_broken", 1, SHOWN), F.when(F.col("_broken").isNotNull(), MALFORMED)),
        _problem("values", F.lit(None), F.when(F.col("_empty"), MISSING)),
        _problem("symbol", F.col("symbol"), F.when(full & F.col("symbol").isNull(), MISSING)),
        _problem("interval", interval, F.when(full, allowed)),
        _problem("mic_code", F.col("mic_code"), F.when(full & ~pair & F.col("mic_code").isNull(), MISSING)),
    ]
    judged = _judged(rows, lambda name: F.col(f"_v.{name}"), F.when(~pair, F.col("_v.volume")), identity)
    # what is no page has this one problem, not another one for each field
    problems = F.when(F.col("_empty"), F.slice("problems", 1, 1)).otherwise(F.col("problems"))
    return judged.withColumn("problems", problems).select(
        "asset_class", "time_interval", "series_key", "symbol", "mic_code", "currency", *_RAW,
        "source_file", "page", "newest", "oldest", "value_pos", "problems",
    )


def judged_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Candles landed as CSV in folders ``series_key=…/time_interval=…`` as rows with ``problems``, like ``judged_pages``.

    A line with too few or too many fields is one malformed record; a header of other columns raises.
    """
    rows = (
        spark.read.schema(f"{schemas.CANDLE_ROW}, {schemas.CORRUPT} string, series_key string, time_interval string")
        .option("header", True)
        .option("sep", sep)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .csv(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
        .withColumnsRenamed({name: f"_{name}" for name in _RAW})
    )
    broken, interval = F.col(schemas.CORRUPT), F.col("time_interval")
    identity = [
        _problem("record", F.substring(broken, 1, SHOWN), F.when(broken.isNotNull(), MALFORMED)),
        _problem("interval", interval, F.when(~interval.isin(*schemas.ALLOWED_INTERVALS), NOT_ALLOWED)),
    ]
    judged = _judged(rows, lambda name: F.col(f"_{name}"), F.col("_volume"), identity)
    problems = F.when(broken.isNotNull(), F.slice("problems", 1, 1)).otherwise(F.col("problems"))
    return judged.withColumn("problems", problems).select("series_key", "time_interval", *_RAW, "source_file", "problems")


def good(judged: DataFrame) -> DataFrame:
    """Rows without a problem."""
    return judged.where(F.size("problems") == 0).drop("problems")


def rejected(judged: DataFrame) -> DataFrame:
    """One row per bad value: where it stood, the series it was meant for, the field, its text and what is wrong."""
    place = [c for c in ("source_file", "page", "value_pos", "time_interval", "series_key") if c in judged.columns]
    return judged.select(*place, F.explode("problems").alias("_p")).select(*place, "_p.field", "_p.value", "_p.problem")
