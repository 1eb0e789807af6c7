"""String expressions: symbols, series keys, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_COUNTRY = "Unknown"  # fixed value


def base_symbol(pair: Column) -> Column:
    return F.split_part(pair, F.lit("/"), F.lit(1))


def quote_symbol(pair: Column) -> Column:
    return F.split_part(pair, F.lit("/"), F.lit(2))


def looks_like_pair(symbol: Column) -> Column:
    return symbol.contains("/")


def equity_key(symbol: Column, mic: Column) -> Column:
    return F.concat_ws("_", symbol, mic)


def forex_key(pair: Column, interval: Column) -> Column:
    return F.concat_ws("_", F.upper(base_symbol(pair)), F.upper(quote_symbol(pair)), interval)


def known_country(country: Column) -> Column:
    return F.when(country == "", UNKNOWN_COUNTRY).otherwise(country)


def timeframe_name(timeframe: Column) -> Column:
    """``5min`` -> ``5 minute``; an unsupported unit makes the query fail, as an assertion would."""
    digits = F.regexp_extract(timeframe, "^([0-9]*)", 1)
    unit = F.regexp_extract(timeframe, "^[0-9]*(.*)$", 1)
    name = (
        F.when(unit == "min", "minute")
        .when(unit == "h", "hour")
        .when(unit.isin("day", "week", "month"), unit)
        .otherwise(F.raise_error(F.concat(F.lit("unsupported timeframe: "), timeframe)).cast("string"))
    )
    return F.concat(digits, F.lit(" "), name)


def axis_label(ts: Column, major: Column, minor: Column, interval: str) -> Column:
    """Text below one candle: weekday / hour:minute on minute charts, year or month / day number on day charts."""
    if "min" in interval:
        two = lambda part: F.lpad(part.cast("string"), 2, "0")
        on_major = F.dayname(ts.cast("date"))
        on_minor = F.concat(two(F.hour(ts)), F.lit(":"), two(F.minute(ts)))
    elif "day" in interval:
        on_major = F.when(F.month(ts) == 1, F.year(ts).cast("string")).otherwise(F.monthname(ts.cast("date")))
        on_minor = F.dayofmonth(ts).cast("string")
    else:
        raise ValueError(f"timeframe not supported: {interval}")
    return F.when(major, on_major).when(minor, on_minor).otherwise("")


def volume_label(volume: Column, largest: Column | None = None) -> Column:
    """Short form of a volume; the unit follows the largest volume of the chart when it is known."""
    # Cuts with and without a known largest volume.
    cuts = (2_000_000_000, 2_000_000, 2_000) if largest is not None else (3_000_000_000, 3_000_000, 4_000)
    measure = volume if largest is None else F.coalesce(largest, F.lit(0))
    shortened = lambda unit, suffix: F.concat(
        F.floor(volume / unit).cast("string"), F.lit(f".0{suffix}")
    )
    return (
        F.when(measure > cuts[0], shortened(1_000_000_000, "B"))
        .when(measure > cuts[1], shortened(1_000_000, "M"))
        .when(measure > cuts[2], shortened(1_000, "k"))
        .otherwise(volume.cast("string"))
    )


def price_label(price: Column, asset_class: Column) -> Column:
    """Two decimals for equities, five for currency pairs; ties round to the even digit."""
    return F.when(
        asset_class == "equity", F.bround(price, 2).cast("decimal(12,2)").cast("string")
    ).otherwise(price.cast("decimal(12,5)").cast("string"))
