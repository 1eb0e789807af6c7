"""Star-schema tables seen as market data, so that every operator runs on whole real tables.

Test-data shims only: candles are built from events, ledgers from the events of a user, landed lists from parts,
suppliers, customers and nations.
"""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barvault.functions import clock
from barvault.operators import segments

FOREX_TYPES = ("signup", "view")  # event types that play currency pairs; the others play equities
SERIES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asset_class():
    return F.when(F.col("event_type").isin(*FOREX_TYPES), "forex").otherwise("equity")


def unnumbered_candles(spark: SparkSession, sf_dir: str, interval: str) -> DataFrame:
    """One candle per event type and day or minute; currency pairs have no volume."""
    order = F.struct("ts", "event_id")
    price = lambda c: c.cast("decimal(10,5)")
    bars = (
        table(spark, sf_dir, "events")
        .select("event_type", "ts", "event_id", "value", clock.bucket_of(F.col("ts"), interval).alias("datetime"))
        .groupBy("event_type", "datetime")
        .agg(
            price(F.min_by("value", order)).alias("open"),
            price(F.max_by("value", order)).alias("close"),
            price(F.max("value")).alias("high"),
            price(F.min("value")).alias("low"),
            F.count(F.lit(1)).alias("volume"),
        )
    )
    return bars.select(
        asset_class().alias("asset_class"),
        F.lit(interval).alias("time_interval"),
        F.col("event_type").alias("series_key"),
        "datetime",
        "open",
        "close",
        "high",
        "low",
        F.when(asset_class() == "equity", F.col("volume")).alias("volume"),
    )


def candles(spark: SparkSession, sf_dir: str, interval: str) -> DataFrame:
    """The candles with their dense ID per series."""
    bars = unnumbered_candles(spark, sf_dir, interval)
    segment = segments.calendar_segment(F.col("datetime"), interval)
    return segments.with_position(bars, ["series_key"], ["datetime"], segment, "ID").select(
        "asset_class", "time_interval", "series_key", "ID", "datetime", "open", "close", "high", "low", "volume"
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a run; an event above 15 is a won trade."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", (F.col("value") > 15).alias("win")
    )
    # minutes keep the segments of a very busy user small
    minute = clock.minute_of(F.col("ts"))
    return segments.with_position(events, ["run_id"], ["ts", "event_id"], minute, "trade_no").select(
        "run_id", "trade_no", "win"
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One range request per customer: the nation chooses series and count, the balance the dates, the segment
    which two of start, end, span and count are given."""
    form = F.col("c_mktsegment")
    start = F.lit("2024-01-01").cast("timestamp_ntz") + clock.minutes(F.floor(F.col("c_acctbal") * 5).cast("int"))
    width = clock.minutes(F.lit(60) * (F.col("c_nationkey") + 1))
    series = F.element_at(F.array(*[F.lit(s) for s in SERIES]), F.col("c_nationkey") % len(SERIES) + 1)
    has = lambda *forms: form.isin(*forms)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("req_id"),
        series.alias("series_key"),
        F.when(has("AUTOMOBILE", "BUILDING", "HOUSEHOLD"), start).alias("start"),
        F.when(has("AUTOMOBILE", "FURNITURE", "MACHINERY"), start + width).alias("end"),
        F.when(has("BUILDING", "FURNITURE"), width).alias("span"),
        F.when(has("HOUSEHOLD", "MACHINERY"), F.col("c_nationkey") + 1).alias("n"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One moment per event, three hours and a second later than the event."""
    late = F.expr("INTERVAL '0 03:00:01' DAY TO SECOND")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("req_id"), F.col("event_type").alias("series_key"), (F.col("ts") + late).alias("at")
    )


# --- landed lists ----------------------------------------------------------------------------------------------
# plan and global of an exchange by region name
PLANS = {
    "AFRICA": ("Level C", "Enterprise"),
    "AMERICA": ("Basic", "Basic"),
    "ASIA": ("Level B", "Pro"),
    "EUROPE": ("Level A", "Grow"),
    "MIDDLE EAST": ("Level C", "Enterprise"),
}


def _located(df: DataFrame, nation: DataFrame, region: DataFrame, nation_key: str) -> DataFrame:
    return df.join(nation, F.col(nation_key) == F.col("n_nationkey"), "left").join(
        region, F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )


def _access(region: str = "r_name"):
    level = {name: F.lit(pair[0]) for name, pair in PLANS.items()}
    plan = {name: F.lit(pair[1]) for name, pair in PLANS.items()}
    chosen = lambda m: F.element_at(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v)]), F.col(region))
    return F.struct(chosen(level).alias("global"), chosen(plan).alias("plan"))


def exchange_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as exchanges; the first nation has no country name, its suppliers fall back to Unknown."""
    rows = _located(
        table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), "s_nationkey"
    )
    return rows.select(
        F.col("s_name").alias("name"),
        F.concat(F.lit("X"), F.col("s_suppkey").cast("string")).alias("code"),
        F.when(F.col("n_nationkey") == 0, "").otherwise(F.col("n_name")).alias("country"),
        F.col("r_name").alias("timezone"),
        _access().alias("access"),
    )


def forex_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of nations that trade with each other, in mixed case, grouped by the region of the base."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    lineitem, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    # reduce both long tables to small keys before they meet
    buyers = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sellers = (
        lineitem.select("l_orderkey", "l_suppkey")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", "s_nationkey")
    )
    pairs = (
        sellers.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("c_nationkey", "s_nationkey")
        .distinct()
        .where("c_nationkey <> s_nationkey")
    )
    base = nation.select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.col("n_name").alias("currency_base"),
        F.col("n_regionkey").alias("_region"),
    )
    quote = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("currency_quote"))
    symbol = lambda key: F.concat(F.lit("c"), F.lpad(F.col(key).cast("string"), 2, "0"))
    return (
        pairs.join(base, "c_nationkey")
        .join(quote, "s_nationkey")
        .join(region, F.col("_region") == F.col("r_regionkey"))
        .select(
            F.concat(symbol("c_nationkey"), F.lit("/"), symbol("s_nationkey")).alias("symbol"),
            F.col("r_name").alias("currency_group"),
            "currency_base",
            "currency_quote",
        )
    )


def equity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as equities, each listed at the first supplier that sold it; parts never sold have no exchange."""
    first_seller = (
        table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("_suppkey"))
    )
    rows = table(spark, sf_dir, "part").join(first_seller, F.col("p_partkey") == F.col("l_partkey"), "left")
    rows = rows.join(table(spark, sf_dir, "supplier"), F.col("_suppkey") == F.col("s_suppkey"), "left")
    rows = _located(rows, table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), "s_nationkey")
    return rows.select(
        F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("symbol"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("c"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("currency"),
        F.col("s_name").alias("exchange"),
        F.concat(F.lit("X"), F.col("s_suppkey").cast("string")).alias("mic_code"),
        F.when(F.col("n_nationkey") == 0, "").otherwise(F.col("n_name")).alias("country"),
        F.col("p_type").alias("type"),
        _access().alias("access"),
    )


