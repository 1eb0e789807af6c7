"""Which series does a request mean, and does it exist?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barvault.errors import DataUncertain
from barvault.functions import text
from barvault.operators.joins import join_unique
from barvault.operators.lookups import flag_known
from barvault.schemas import ALLOWED_INTERVALS


def check_interval(time_interval: str) -> str:
    """Driver-side guard for an interval argument."""
    if time_interval not in ALLOWED_INTERVALS:
        raise ValueError(f"time interval must be one of {ALLOWED_INTERVALS}, not {time_interval!r}")
    return time_interval


def split_by_interval(df: DataFrame, column: str = "time_interval") -> tuple[DataFrame, DataFrame]:
    """The same guard on data: accepted rows and rejected rows (NULL is rejected)."""
    allowed = F.coalesce(F.col(column).isin(*ALLOWED_INTERVALS), F.lit(False))
    return df.where(allowed), df.where(~allowed)


def resolve_series(worklist: DataFrame, stocks: DataFrame, forex_pairs: DataFrame) -> DataFrame:
    """Add ``asset_class``, ``series_key`` and ``status`` to rows of (symbol, mic_code, time_interval[, is_equity]).

    A given ``is_equity`` decides the class; otherwise the symbol is looked up in both tables.
    ``status`` is one of ok, bad_interval, uncertain, mic_missing, mic_not_allowed.
    """
    rows = flag_known(worklist, "symbol", stocks, "symbol", "_stock")
    rows = flag_known(rows, "symbol", forex_pairs, "symbol", "_pair")
    equity, pair = F.col("_stock"), F.col("_pair")
    if "is_equity" in worklist.columns:
        equity = F.coalesce(F.col("is_equity"), equity)
        pair = F.when(F.col("is_equity").isNull(), pair).otherwise(~F.col("is_equity"))
    status = (
        F.when(~F.coalesce(F.col("time_interval").isin(*ALLOWED_INTERVALS), F.lit(False)), "bad_interval")
        .when(equity == pair, "uncertain")
        .when(equity & F.col("mic_code").isNull(), "mic_missing")
        .when(pair & F.col("mic_code").isNotNull(), "mic_not_allowed")
        .otherwise("ok")
    )
    symbol = F.col("symbol")
    key = F.when(equity, text.equity_key(symbol, F.col("mic_code"))).otherwise(
        text.forex_key(symbol, F.col("time_interval"))
    )
    return (
        rows.withColumn("status", status)
        .withColumn("asset_class", F.when(F.col("status") == "ok", F.when(equity, "equity").otherwise("forex")))
        .withColumn("series_key", F.when(F.col("status") == "ok", key))
        .drop("_stock", "_pair")
    )


def resolve_one(
    symbol: str,
    time_interval: str,
    stocks: DataFrame,
    forex_pairs: DataFrame,
    is_equity: bool | None = None,
    mic_code: str | None = None,
) -> tuple[str, str]:
    """Strict form for one request: ``(asset_class, series_key)`` or the matching error."""
    check_interval(time_interval)
    work = stocks.sparkSession.createDataFrame(
        [(symbol, mic_code, time_interval, is_equity)],
        "symbol string, mic_code string, time_interval string, is_equity boolean",
    )
    row = resolve_series(work, stocks, forex_pairs).first()
    if row.status == "uncertain":
        raise DataUncertain(f"{symbol} is not exactly one of stock and currency pair")
    if row.status == "mic_missing":
        raise ValueError("a stock needs a market identification code")
    if row.status == "mic_not_allowed":
        raise ValueError("a currency pair takes no market identification code")
    return row.asset_class, row.series_key


def flag_registered(worklist: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``registered``: is this series in the registry? Compared by equality, never by pattern."""
    on = ["asset_class", "time_interval", "series_key"]
    known = registry.select(*on).distinct().withColumn("_hit", F.lit(True))
    return join_unique(worklist, known, on).withColumn("registered", F.coalesce("_hit", F.lit(False))).drop("_hit")
