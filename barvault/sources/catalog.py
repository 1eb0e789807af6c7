"""The warehouse in the Spark catalogue: build, purge, rebuild, list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barvault import schemas

# Explained views as the catalogue stores them.
VIEWS = {
    "stocks_explained": """
        SELECT s.ID, s.symbol, s.name, cur.symbol AS currency_symbol, mkt.code AS exchange_mic_code,
               cty.name AS country_name, typ.name AS investment_type, pln.plan AS access_plan
        FROM {db}.stocks s
        LEFT JOIN {db}.currencies cur ON cur.ID = s.currency
        LEFT JOIN {db}.markets mkt ON mkt.ID = s.exchange
        LEFT JOIN {db}.countries cty ON cty.ID = s.country
        LEFT JOIN {db}.investment_types typ ON typ.ID = s.type
        LEFT JOIN {db}.plans pln ON pln.ID = s.plan""",
    "markets_explained": """
        SELECT m.ID, m.name, m.code AS mic_code, zone.name AS timezone_name, pln.plan AS access_plan,
               cty.name AS country_name
        FROM {db}.markets m
        LEFT JOIN {db}.timezones zone ON zone.ID = m.timezone
        LEFT JOIN {db}.plans pln ON pln.ID = m.access
        LEFT JOIN {db}.countries cty ON cty.ID = m.country""",
    "forex_pairs_explained": """
        SELECT f.ID, grp.name AS currency_group_name, f.symbol, base.symbol AS base_currency_symbol,
               quote.symbol AS quote_currency_symbol, base.name AS base_currency_name,
               quote.name AS quote_currency_name
        FROM {db}.forex_pairs f
        LEFT JOIN {db}.forex_currency_groups grp ON grp.ID = f.currency_group
        LEFT JOIN {db}.currencies base ON base.ID = f.currency_base
        LEFT JOIN {db}.currencies quote ON quote.ID = f.currency_quote""",
    "tracked_indexes": """
        SELECT s.name AS equity_name, s.symbol, m.name AS market_name, t.is_tracked_1day, t.is_tracked_1min,
               t.worker_name
        FROM {db}.time_tracking_info t
        LEFT JOIN {db}.stocks s ON s.ID = t.stock
        LEFT JOIN {db}.markets m ON m.ID = s.exchange""",
    # written anew with every commit, so that it shows committed candles only
    "candles_explained": """
        SELECT asset_class, time_interval, series_key, ID, datetime, open, close, high, low, volume, period,
               open > close AS bearish, open < close AS bullish
        FROM {db}.candles WHERE {committed}""",
}

ARCHIVE_TABLES = {
    "candles": (f"{schemas.CANDLES}, period date, batch string", ("batch", "asset_class", "time_interval", "period")),
    "series_registry": (f"{schemas.REGISTRY}, batch string", ("batch",)),
    "series_log": (f"{schemas.REGISTRY}, last_id bigint, latest timestamp_ntz, batch string", ("batch",)),
}


def build_warehouse(spark: SparkSession, database: str, location: str) -> None:
    """Create the database, its tables and its views; what exists already stays as it is."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    for name in schemas.TABLES:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schemas.ddl(name)}) USING parquet")
    for name, (columns, partitions) in ARCHIVE_TABLES.items():
        split = f"PARTITIONED BY ({', '.join(partitions)})"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet {split}")
    for name, query in VIEWS.items():
        if not view_exists(spark, database, name):
            spark.sql(f"CREATE VIEW {database}.{name} AS {query.format(db=database, committed='false')}")


def refresh_candle_view(spark: SparkSession, database: str, committed: str) -> None:
    """Let the candle view show the rows that a condition on ``candles`` selects."""
    query = VIEWS["candles_explained"].format(db=database, committed=committed)
    spark.sql(f"CREATE OR REPLACE VIEW {database}.candles_explained AS {query}")


def purge_warehouse(spark: SparkSession, database: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")


def rebuild_warehouse(spark: SparkSession, database: str, location: str) -> None:
    """Start from nothing. Everything stored in the database is lost."""
    purge_warehouse(spark, database)
    build_warehouse(spark, database, location)


def warehouse_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    return {name: spark.table(f"{database}.{name}") for name in schemas.TABLES}


def create_series_view(spark: SparkSession, database: str, asset_class: str, time_interval: str, series_key: str):
    """A view over one series with the bearish and bullish columns; its name ends in ``_view``."""
    name = f"{database}.`{series_key}_{time_interval}_view`"
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    spark.sql(
        f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {database}.candles_explained "
        f"WHERE asset_class = {quoted(asset_class)} AND time_interval = {quoted(time_interval)} "
        f"AND series_key = {quoted(series_key)}"
    )


# --- listings ----------------------------------------------------------------------------------------------------
def list_tables(spark: SparkSession, database: str) -> DataFrame:
    rows = [(database, t.name) for t in spark.catalog.listTables(database) if t.tableType != "VIEW" and not t.isTemporary]
    return spark.createDataFrame(rows, "table_schema string, table_name string")


def table_rows(spark: SparkSession, database: str) -> DataFrame:
    """Every stored table with its row count, counted in one job."""
    counts = [
        spark.table(f"{database}.{t.table_name}").agg(F.lit(t.table_name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        for t in list_tables(spark, database).collect()
    ]
    return reduce(DataFrame.unionByName, counts)


def list_views(spark: SparkSession, database: str) -> DataFrame:
    rows = [(database, t.name) for t in spark.catalog.listTables(database) if t.tableType == "VIEW" and not t.isTemporary]
    return spark.createDataFrame(rows, "table_schema string, table_name string")


def list_columns(spark: SparkSession, database: str, table: str) -> DataFrame:
    rows = [(table, c.name, c.dataType) for c in spark.catalog.listColumns(f"{database}.{table}")]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def list_functions(spark: SparkSession, database: str) -> DataFrame:
    """User functions of the database; the built-in ones belong to no database."""
    rows = [
        (database, f.name) for f in spark.catalog.listFunctions(database) if f.namespace and f.namespace[-1] == database
    ]
    return spark.createDataFrame(rows, "routine_schema string, routine_name string")


def list_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name,) for d in spark.catalog.listDatabases()], "schema_name string")


def view_exists(spark: SparkSession, database: str, view: str) -> bool:
    return any(t.name == view and t.tableType == "VIEW" for t in spark.catalog.listTables(database))
