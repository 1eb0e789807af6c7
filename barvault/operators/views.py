"""Star-join views: entity tables with their foreign keys replaced by readable values.

The dimension side is never hinted: the optimizer broadcasts it only while its size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merge joins, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barvault.functions import prices


class Lookup(NamedTuple):
    """One dimension role: ``fk`` of the main table finds ``key`` of ``table``; ``columns`` maps output to source."""

    table: DataFrame
    fk: str
    columns: dict[str, str]
    key: str = "ID"


def explain_keys(main: DataFrame, keep: Sequence[str], lookups: Sequence[Lookup]) -> DataFrame:
    """Left join ``main`` with every lookup and keep the ``keep`` columns plus the looked-up ones."""
    out, chosen = main, [*keep]
    for role, lookup in enumerate(lookups):
        fields = {name: f"_r{role}_{name}" for name in lookup.columns}
        side = lookup.table.select(
            F.col(lookup.key).alias(f"_r{role}_key"),
            *[F.col(source).alias(fields[name]) for name, source in lookup.columns.items()],
        )
        out = out.join(side, F.col(lookup.fk) == F.col(f"_r{role}_key"), "left")
        chosen += [F.col(field).alias(name) for name, field in fields.items()]
    return out.select(*chosen)


def stocks_explained(stocks, currencies, markets, countries, investment_types, plans) -> DataFrame:
    return explain_keys(
        stocks,
        ["ID", "symbol", "name"],
        [
            Lookup(currencies, "currency", {"currency_symbol": "symbol"}),
            Lookup(markets, "exchange", {"exchange_mic_code": "code"}),
            Lookup(countries, "country", {"country_name": "name"}),
            Lookup(investment_types, "type", {"investment_type": "name"}),
            Lookup(plans, "plan", {"access_plan": "plan"}),
        ],
    )


def markets_explained(markets, timezones, countries, plans) -> DataFrame:
    return explain_keys(
        markets,
        ["ID", "name", F.col("code").alias("mic_code")],
        [
            Lookup(timezones, "timezone", {"timezone_name": "name"}),
            Lookup(plans, "access", {"access_plan": "plan"}),
            Lookup(countries, "country", {"country_name": "name"}),
        ],
    )


def forex_pairs_explained(forex_pairs, forex_currency_groups, currencies) -> DataFrame:
    """The currency dimension is used twice, once per leg of the pair."""
    return explain_keys(
        forex_pairs,
        ["ID", "symbol"],
        [
            Lookup(forex_currency_groups, "currency_group", {"currency_group_name": "name"}),
            Lookup(
                currencies, "currency_base", {"base_currency_symbol": "symbol", "base_currency_name": "name"}
            ),
            Lookup(
                currencies, "currency_quote", {"quote_currency_symbol": "symbol", "quote_currency_name": "name"}
            ),
        ],
    ).select(
        "ID",
        "currency_group_name",
        "symbol",
        "base_currency_symbol",
        "quote_currency_symbol",
        "base_currency_name",
        "quote_currency_name",
    )


def tracked_indexes(time_tracking_info, stocks, markets) -> DataFrame:
    """Tracking rows with their stock and, through the stock, its market."""
    flags = ["is_tracked_1day", "is_tracked_1min", "worker_name"]
    with_stock = explain_keys(
        time_tracking_info,
        flags,
        [Lookup(stocks, "stock", {"equity_name": "name", "symbol": "symbol", "_exchange": "exchange"})],
    )
    return explain_keys(
        with_stock, ["equity_name", "symbol", *flags], [Lookup(markets, "_exchange", {"market_name": "name"})]
    ).select("equity_name", "symbol", "market_name", *flags)


def candle_view(candles: DataFrame) -> DataFrame:
    """Candles of any series with ``bearish`` / ``bullish``; both are false when open equals close."""
    open_, close = F.col("open"), F.col("close")
    return candles.withColumns({"bearish": prices.bearish(open_, close), "bullish": prices.bullish(open_, close)})
