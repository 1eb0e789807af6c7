"""Landed lists to numbered dimension and entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barvault import schemas
from barvault.functions import text
from barvault.operators.lookups import find_id
from barvault.operators.numbering import dense_ids

# Currencies quoted on exchanges that no currency pair lists.
EXTRA_CURRENCIES = (("South Africa cent", "ZAC"), ("Israeli agora", "ILA"))


def _values(df: DataFrame, **columns) -> DataFrame:
    return df.select(*[expr.alias(name) for name, expr in columns.items()]).distinct()


def currency_values(forex_list: DataFrame, extra=EXTRA_CURRENCIES) -> DataFrame:
    """Name and symbol of both legs of every pair plus the fixed rows, upper-cased before they are made distinct."""
    leg = lambda name, symbol: forex_list.select(
        F.col(name).alias("name"), F.upper(symbol).alias("symbol")
    )
    legs = leg("currency_base", text.base_symbol(F.col("symbol"))).unionByName(
        leg("currency_quote", text.quote_symbol(F.col("symbol")))
    )
    if extra:
        legs = legs.unionByName(forex_list.sparkSession.createDataFrame(list(extra), "name string, symbol string"))
    return legs.distinct()


def currencies(forex_list: DataFrame, extra=EXTRA_CURRENCIES) -> DataFrame:
    return dense_ids(currency_values(forex_list, extra), ["name", "symbol"])


def forex_currency_groups(forex_list: DataFrame) -> DataFrame:
    return dense_ids(_values(forex_list, name=F.col("currency_group")), ["name"])


def plan_values(exchange_list: DataFrame) -> DataFrame:
    return _values(exchange_list, **{"global": F.col("access.global"), "plan": F.col("access.plan")})


def plans(exchange_list: DataFrame) -> DataFrame:
    return dense_ids(plan_values(exchange_list), ["plan", "global"])


def country_values(exchange_list: DataFrame) -> DataFrame:
    """Countries of the exchanges and the ``Unknown`` row that stands in for an empty country."""
    unknown = exchange_list.sparkSession.createDataFrame([(text.UNKNOWN_COUNTRY,)], "name string")
    return exchange_list.select(F.col("country").alias("name")).unionByName(unknown).distinct()


def countries(exchange_list: DataFrame) -> DataFrame:
    return dense_ids(country_values(exchange_list), ["name"])


def timezones(exchange_list: DataFrame) -> DataFrame:
    return dense_ids(_values(exchange_list, name=F.col("timezone")), ["name"])


def investment_types(equity_list: DataFrame) -> DataFrame:
    return dense_ids(_values(equity_list, name=F.col("type")), ["name"])


def forex_pairs(forex_list: DataFrame, groups: DataFrame, currency_table: DataFrame) -> DataFrame:
    """Pairs in symbol order, ties in input order; keys without a match stay NULL."""
    rows = dense_ids(forex_list, ["symbol", "input_pos"])
    rows = find_id(rows, F.col("currency_group"), groups, "name", "_group")
    rows = find_id(rows, F.upper(text.base_symbol(F.col("symbol"))), currency_table, "symbol", "_base")
    rows = find_id(rows, F.upper(text.quote_symbol(F.col("symbol"))), currency_table, "symbol", "_quote")
    return rows.select(
        "ID",
        F.col("_group").alias("currency_group"),
        F.upper("symbol").alias("symbol"),
        F.col("_base").alias("currency_base"),
        F.col("_quote").alias("currency_quote"),
    )


def markets(exchange_list: DataFrame, plan_table: DataFrame, zone_table: DataFrame, country_table: DataFrame):
    """Markets in name order, ties in input order; keys without a match stay NULL."""
    rows = dense_ids(exchange_list, ["name", "input_pos"])
    rows = find_id(rows, F.col("access.plan"), plan_table, "plan", "_plan")
    rows = find_id(rows, F.col("timezone"), zone_table, "name", "_zone")
    rows = find_id(rows, text.known_country(F.col("country")), country_table, "name", "_country")
    return rows.select(
        "ID",
        "name",
        F.col("_plan").alias("access"),
        F.col("_zone").alias("timezone"),
        F.col("_country").alias("country"),
        "code",
    )


def stocks_with_rejects(
    equity_list: DataFrame,
    currency_table: DataFrame,
    market_table: DataFrame,
    country_table: DataFrame,
    type_table: DataFrame,
    plan_table: DataFrame,
) -> DataFrame:
    """Stocks in symbol order with all five keys; ``missing`` names the required keys that found nothing."""
    rows = dense_ids(equity_list, ["symbol", "input_pos"])
    rows = find_id(rows, F.upper("currency"), currency_table, "symbol", "_currency")
    rows = find_id(rows, F.col("mic_code"), market_table, "code", "_exchange")
    rows = find_id(rows, text.known_country(F.col("country")), country_table, "name", "_country")
    rows = find_id(rows, F.col("type"), type_table, "name", "_type")
    rows = find_id(rows, F.col("access.plan"), plan_table, "plan", "_plan")
    keys = [c.name for c in schemas.TABLES["stocks"] if c.required and c.name != "ID"]
    missing = F.concat_ws(",", *[F.when(F.col(f"_{k}").isNull(), k) for k in keys])
    return rows.select("ID", "symbol", "name", *[F.col(f"_{k}").alias(k) for k in keys], missing.alias("missing"))


def accepted(stocks: DataFrame) -> DataFrame:
    return stocks.where("missing = ''").drop("missing")


def rejected(stocks: DataFrame) -> DataFrame:
    return stocks.where("missing <> ''").select("ID", "symbol", "missing")
