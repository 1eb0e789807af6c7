"""From three landed lists to all dimension and entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barvault import schemas
from barvault.operators import dimensions as d
from barvault.operators.audit import audit_warehouse
from barvault.session import materialise


def load_lists(forex_list: DataFrame, exchange_list: DataFrame, equity_list: DataFrame) -> dict[str, DataFrame]:
    """Numbered tables, keys resolved. ``stock_rejects`` holds equities with a required key that found nothing."""
    # tables that others look up in, and the stocks that are both accepted and rejected, are written once
    currencies, groups = materialise(d.currencies(forex_list)), materialise(d.forex_currency_groups(forex_list))
    timezones, countries = materialise(d.timezones(exchange_list)), materialise(d.countries(exchange_list))
    plans, types = materialise(d.plans(exchange_list)), materialise(d.investment_types(equity_list))
    markets = materialise(d.markets(exchange_list, plans, timezones, countries))
    stocks = materialise(d.stocks_with_rejects(equity_list, currencies, markets, countries, types, plans))
    return {
        "currencies": currencies,
        "forex_currency_groups": groups,
        "forex_pairs": d.forex_pairs(forex_list, groups, currencies),
        "timezones": timezones,
        "countries": countries,
        "plans": plans,
        "markets": markets,
        "investment_types": types,
        "stocks": d.accepted(stocks),
        "stock_rejects": d.rejected(stocks),
    }


def store_lists(spark: SparkSession, database: str, tables: dict[str, DataFrame], strict: bool = True) -> None:
    """Write the loaded tables into the warehouse; ``strict`` refuses rejects and broken constraints first."""
    stored = {name: df for name, df in tables.items() if name in schemas.TABLES}
    if strict:
        problem = tables["stock_rejects"].first()
        if problem is not None:
            raise ValueError(f"stock {problem.symbol} lacks {problem.missing}")
        problem = audit_warehouse(stored).first()
        if problem is not None:
            raise ValueError(f"{problem.table}.{problem.column} breaks {problem.rule} at {problem.key}")
    for name, df in stored.items():
        columns = [c.name for c in schemas.TABLES[name]]
        materialise(df.select(*columns)).write.mode("overwrite").insertInto(f"{database}.{name}")
