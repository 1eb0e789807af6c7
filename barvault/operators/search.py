"""Pattern search over dimensions and explained views.

``LIKE`` is case-sensitive with ``%`` and ``_``. ``None`` means no filter, an empty pattern is refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def like_all(df: DataFrame, **patterns: str | None) -> DataFrame:
    """Rows whose named columns match all given patterns; the patterns travel as literals."""
    if "" in patterns.values():
        raise ValueError("an empty pattern is not a valid filter; pass None for no filter")
    tests = [F.col(name).like(pattern) for name, pattern in patterns.items() if pattern is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def fetch_markets(
    markets_explained,
    name_like=None,
    market_identification_code_like=None,
    timezone_name_like=None,
    plan_name_like=None,
    country_name_like=None,
) -> DataFrame:
    return like_all(
        markets_explained,
        name=name_like,
        mic_code=market_identification_code_like,
        timezone_name=timezone_name_like,
        access_plan=plan_name_like,
        country_name=country_name_like,
    )


def fetch_stocks(
    stocks_explained,
    symbol_like=None,
    name_like=None,
    currency_symbol_like=None,
    market_identification_code_like=None,
    country_name_like=None,
    investment_type_name_like=None,
    access_plan_name_like=None,
) -> DataFrame:
    return like_all(
        stocks_explained,
        symbol=symbol_like,
        name=name_like,
        currency_symbol=currency_symbol_like,
        exchange_mic_code=market_identification_code_like,
        country_name=country_name_like,
        investment_type=investment_type_name_like,
        access_plan=access_plan_name_like,
    )


def fetch_forex_pairs(
    forex_pairs_explained,
    currency_group_name_like=None,
    symbol_like=None,
    base_symbol_like=None,
    quote_symbol_like=None,
    base_name_like=None,
    quote_name_like=None,
) -> DataFrame:
    return like_all(
        forex_pairs_explained,
        currency_group_name=currency_group_name_like,
        symbol=symbol_like,
        base_currency_symbol=base_symbol_like,
        quote_currency_symbol=quote_symbol_like,
        base_currency_name=base_name_like,
        quote_currency_name=quote_name_like,
    )


def fetch_currencies(currencies, symbol_like=None, name_like=None) -> DataFrame:
    return like_all(currencies, symbol=symbol_like, name=name_like)


def fetch_plans(plans, name_like=None) -> DataFrame:
    return like_all(plans, plan=name_like)


def fetch_named(dimension, name_like=None) -> DataFrame:
    """Currency groups, time zones, countries and investment types share one filter."""
    return like_all(dimension, name=name_like)


fetch_forex_currency_groups = fetch_timezones = fetch_countries = fetch_investment_types = fetch_named
