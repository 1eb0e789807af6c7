"""Every schema of the warehouse, stated once. Nothing is ever inferred from data."""

from __future__ import annotations

import re
from typing import NamedTuple


class Col(NamedTuple):
    """One stored column: Spark type, longest text allowed (``None`` = no limit) and whether NULL is refused."""

    name: str
    type: str
    width: int | None = None
    required: bool = False


# --- landed responses ------------------------------------------------------------------------------------------
# Field names are fixed values: they are the provider's JSON keys.
EQUITY_ROW = (
    "symbol string, name string, currency string, exchange string, mic_code string, country string, type string, "
    "access struct<global:string,plan:string>"
)
FOREX_ROW = "symbol string, currency_group string, currency_base string, currency_quote string"
EXCHANGE_ROW = (
    "name string, code string, country string, timezone string, access struct<global:string,plan:string>"
)
CANDLE_ROW = "datetime string, open string, high string, low string, close string, volume string"
PAGE_META = (
    "symbol string, interval string, currency string, exchange string, exchange_timezone string, mic_code string, "
    "currency_base string, currency_quote string, type string"
)
LISTS = {"equities": EQUITY_ROW, "forex_pairs": FOREX_ROW, "exchanges": EXCHANGE_ROW}

PAGE = (
    f"meta struct<{PAGE_META.replace(' string', ':string')}>, "
    f"values array<struct<{CANDLE_ROW.replace(' string', ':string')}>>, "
    "status string, code int, message string"
)
#: what a record that is not of the expected form is kept in
CORRUPT = "corrupt_record"
USAGE_LOG = (
    "key_name string, date string, credits_used int, credits_left int, daily_limit int, daily_remaining int"
)


def list_response(row_ddl: str) -> str:
    """A list response: the rows under ``data``, plus the fields of the error envelope."""
    return f"data array<struct<{_as_struct_fields(row_ddl)}>>, status string, code int, message string"


def _as_struct_fields(row_ddl: str) -> str:
    return re.sub(r"(\w+) (string|bigint|int|double|struct)", r"\1:\2", row_ddl)


# --- stored tables ---------------------------------------------------------------------------------------------
# Column widths are fixed values: they are the longest text each stored column may hold.
TABLES: dict[str, tuple[Col, ...]] = {
    "countries": (Col("ID", "int", None, True), Col("name", "string", 60)),
    "currencies": (Col("ID", "int", None, True), Col("name", "string", 35), Col("symbol", "string", 10)),
    "forex_currency_groups": (Col("ID", "int", None, True), Col("name", "string", 25)),
    "investment_types": (Col("ID", "int", None, True), Col("name", "string", 40)),
    "plans": (Col("ID", "int", None, True), Col("global", "string", 30), Col("plan", "string", 30)),
    "timezones": (Col("ID", "int", None, True), Col("name", "string", 100)),
    "forex_pairs": (
        Col("ID", "int", None, True),
        Col("currency_group", "int"),
        Col("symbol", "string", 10),
        Col("currency_base", "int"),
        Col("currency_quote", "int"),
    ),
    "markets": (
        Col("ID", "int", None, True),
        Col("name", "string", 50, True),
        Col("access", "int"),
        Col("timezone", "int"),
        Col("country", "int"),
        Col("code", "string", 20, True),
    ),
    "stocks": (
        Col("ID", "int", None, True),
        Col("symbol", "string", 20),
        Col("name", "string", 170),
        Col("currency", "int", None, True),
        Col("exchange", "int", None, True),
        Col("country", "int", None, True),
        Col("type", "int", None, True),
        Col("plan", "int", None, True),
    ),
    "time_tracking_info": (
        Col("ID", "int", None, True),
        Col("is_tracked_1min", "boolean", None, True),
        Col("is_tracked_1day", "boolean", None, True),
        Col("stock", "int", None, True),
        Col("worker_name", "string", 35, True),
    ),
}

# Foreign keys: table -> column -> referenced table (always its ID).
FOREIGN_KEYS: dict[str, dict[str, str]] = {
    "forex_pairs": {
        "currency_group": "forex_currency_groups",
        "currency_base": "currencies",
        "currency_quote": "currencies",
    },
    "markets": {"access": "plans", "timezone": "timezones", "country": "countries"},
    "stocks": {
        "currency": "currencies",
        "exchange": "markets",
        "country": "countries",
        "type": "investment_types",
        "plan": "plans",
    },
    "time_tracking_info": {"stock": "stocks"},
}

#: stored prices; the largest one is 99,999.99999
PRICE = "decimal(10,5)"
CANDLES = (
    "asset_class string, time_interval string, series_key string, ID bigint, datetime timestamp_ntz, "
    "open decimal(10,5), close decimal(10,5), high decimal(10,5), low decimal(10,5), volume bigint"
)
REGISTRY = "asset_class string, time_interval string, series_key string"
REQUESTS = "req_id bigint, series_key string, start timestamp_ntz, end timestamp_ntz, n int"
TRADES = "run_id bigint, trade_no bigint, win boolean"


def ddl(table: str) -> str:
    """DDL of one stored table, as ``CREATE TABLE`` and ``createDataFrame`` take it."""
    return ", ".join(f"`{c.name}` {c.type}" for c in TABLES[table])


ALLOWED_INTERVALS = ("1min", "1day")  # fixed values
