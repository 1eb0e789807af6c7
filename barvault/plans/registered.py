"""The queries of the entry module: every operator on the whole star-schema tables (see ``adapters``)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barvault import schemas
from barvault.functions import clock, text
from barvault.operators import (
    asof,
    audit,
    chart,
    dimensions,
    ledger,
    lookups,
    ranges,
    search,
    segments,
    series,
    summaries,
    views,
)
from barvault.plans import adapters, load_lists, series_updates
from barvault.schemas import Col
from barvault.session import fresh_folder, materialise
from barvault.sources import catalog, landing
from barvault.sources.archive import CandleArchive
from barvault.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def register(name: str, *args, **kwargs):
    """Add the decorated function under ``name``; extra arguments are passed on to it."""

    def add(function):
        REGISTERED[name] = lambda spark, sf_dir: function(spark, sf_dir, *args, **kwargs)
        return function

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return adapters.table(spark, sf_dir, name)


MID = datetime(2024, 1, 15, 12, 0)


# === landed lists ================================================================================================
def landed(spark: SparkSession, rows: DataFrame, purpose: str) -> str:
    path = fresh_folder(spark, purpose)
    landing.land_list(rows, path)
    return path


def list_equities(spark, sf_dir) -> DataFrame:
    return landing.read_equities(spark, landed(spark, adapters.equity_list(spark, sf_dir), "equities"))


def list_pairs(spark, sf_dir) -> DataFrame:
    return landing.read_forex_pairs(spark, landed(spark, adapters.forex_list(spark, sf_dir), "pairs"))


def list_exchanges(spark, sf_dir) -> DataFrame:
    return landing.read_exchanges(spark, landed(spark, adapters.exchange_list(spark, sf_dir), "exchanges"))


class Loaded:
    """The dimension and entity tables of the landed lists, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def equity_list(self):
        return list_equities(self.spark, self.sf_dir)

    @cached_property
    def forex_list(self):
        return list_pairs(self.spark, self.sf_dir)

    @cached_property
    def exchange_list(self):
        return list_exchanges(self.spark, self.sf_dir)

    @cached_property
    def currencies(self):
        return dimensions.currencies(self.forex_list)

    @cached_property
    def forex_currency_groups(self):
        return dimensions.forex_currency_groups(self.forex_list)

    @cached_property
    def forex_pairs(self):
        return dimensions.forex_pairs(self.forex_list, self.forex_currency_groups, self.currencies)

    @cached_property
    def countries(self):
        return dimensions.countries(self.exchange_list)

    @cached_property
    def timezones(self):
        return dimensions.timezones(self.exchange_list)

    @cached_property
    def plans(self):
        return dimensions.plans(self.exchange_list)

    @cached_property
    def markets(self):
        return dimensions.markets(self.exchange_list, self.plans, self.timezones, self.countries)

    @cached_property
    def investment_types(self):
        return dimensions.investment_types(self.equity_list)

    @cached_property
    def judged_stocks(self):
        return dimensions.stocks_with_rejects(
            self.equity_list, self.currencies, self.markets, self.countries, self.investment_types, self.plans
        )

    @cached_property
    def stocks(self):
        return dimensions.accepted(self.judged_stocks)

    @cached_property
    def stocks_explained(self):
        return views.stocks_explained(
            self.stocks, self.currencies, self.markets, self.countries, self.investment_types, self.plans
        )

    @cached_property
    def markets_explained(self):
        return views.markets_explained(self.markets, self.timezones, self.countries, self.plans)

    @cached_property
    def forex_pairs_explained(self):
        return views.forex_pairs_explained(self.forex_pairs, self.forex_currency_groups, self.currencies)


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[c for c in rows.columns if c not in ("access", "input_pos")],
        F.col("access.global").alias("access_global"),
        F.col("access.plan").alias("access_plan"),
    )


@register("s1_equity_list")
def s1(spark, sf_dir):
    return _flat(list_equities(spark, sf_dir))


@register("s2_forex_list")
def s2(spark, sf_dir):
    return list_pairs(spark, sf_dir).drop("input_pos")


@register("s3_exchange_list")
def s3(spark, sf_dir):
    return _flat(list_exchanges(spark, sf_dir))


@register("s4_index_list")
def s4(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select(
        F.col("c_name").alias("symbol"), F.col("c_mktsegment").alias("name"), F.lit("").alias("country")
    )
    path = landed(spark, rows, "indices")
    return landing.read_list(spark, path, "symbol string, name string, country string").drop("input_pos")


@register("s7_error_envelope")
def s7(spark, sf_dir):
    customer = t(spark, sf_dir, "customer")
    broke = F.col("c_acctbal") < 0
    responses = customer.select(
        F.when(~broke, F.array(F.struct(F.col("c_name").alias("symbol")))).alias("data"),
        F.when(broke, 404).when(F.col("c_mktsegment") == "BUILDING", 400).alias("code"),
        F.when(broke, F.concat(F.lit("no data for "), F.col("c_name"))).alias("message"),
    )
    path = fresh_folder(spark, "responses")
    responses.write.json(path)
    read = landing.read_responses(spark, path, schemas.list_response("symbol string"))
    return landing.response_errors(read, "data").select("code", "message")


@register("s9_countries", "countries")
@register("s9_timezones", "timezones")
@register("s9_plans", "plans")
@register("s9_currencies", "currencies")
@register("s9_currency_groups", "forex_currency_groups")
@register("s9_investment_types", "investment_types")
@register("s10_markets", "markets")
@register("s10_forex_pairs", "forex_pairs")
@register("s10_stocks", "stocks")
@register("j1_stocks_explained", "stocks_explained")
@register("j2_markets_explained", "markets_explained")
@register("j3_forex_pairs_explained", "forex_pairs_explained")
def loaded_table(spark, sf_dir, name):
    return getattr(Loaded(spark, sf_dir), name)


@register("j7_stock_rejects")
def j7(spark, sf_dir):
    """Equities whose exchange, and with it country or plan, is missing when no exchange of one time zone is loaded."""
    tables = Loaded(spark, sf_dir)
    tables.exchange_list = tables.exchange_list.where("timezone <> 'ASIA'")
    return dimensions.rejected(tables.judged_stocks)


@register("j4_tracked_indexes")
def j4(spark, sf_dir):
    tables = Loaded(spark, sf_dir)
    tracking = t(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("ID"),
        (F.col("c_acctbal") > 0).alias("is_tracked_1min"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_tracked_1day"),
        F.col("c_custkey").cast("int").alias("stock"),
        F.col("c_mktsegment").alias("worker_name"),
    )
    return views.tracked_indexes(tracking, tables.stocks, tables.markets)


def stored_lists(spark, sf_dir) -> str:
    """A new warehouse with the whole list load stored in it."""
    database = new_warehouse(spark).database
    tables = load_lists.load_lists(
        list_pairs(spark, sf_dir), list_exchanges(spark, sf_dir), list_equities(spark, sf_dir)
    )
    load_lists.store_lists(spark, database, tables, strict=False)
    return database


@register("c1_load_lists")
def c1(spark, sf_dir):
    return spark.table(f"{stored_lists(spark, sf_dir)}.stocks_explained")


@register("s17_table_rows")
def s17(spark, sf_dir):
    """The catalogue of a loaded warehouse with the rows of each table."""
    return catalog.table_rows(spark, stored_lists(spark, sf_dir))


# --- search ------------------------------------------------------------------------------------------------------
@register("p2_fetch_markets")
def p2(spark, sf_dir):
    return search.fetch_markets(
        Loaded(spark, sf_dir).markets_explained, name_like="Supplier#%", plan_name_like="%r%", country_name_like="NATION__"
    )


@register("p3_fetch_stocks")
def p3(spark, sf_dir):
    return search.fetch_stocks(
        Loaded(spark, sf_dir).stocks_explained,
        name_like="% bolt",
        currency_symbol_like="C%",
        market_identification_code_like="X_%",
        investment_type_name_like="%O%",
        access_plan_name_like="%r%",
    )


@register("p4_fetch_forex_pairs")
def p4(spark, sf_dir):
    return search.fetch_forex_pairs(
        Loaded(spark, sf_dir).forex_pairs_explained, currency_group_name_like="A%", base_symbol_like="C_1", quote_name_like="NATION\\_1%"
    )


@register("p5_fetch_currencies")
def p5(spark, sf_dir):
    return search.fetch_currencies(Loaded(spark, sf_dir).currencies, symbol_like="C1%", name_like="%N\\_1%")


@register("p6_fetch_currency_groups", "forex_currency_groups", "A%")
@register("p6_fetch_timezones", "timezones", "%ST")
@register("p6_fetch_countries", "countries", "%N%_")
@register("p6_fetch_investment_types", "investment_types", "%M")
def p6(spark, sf_dir, name, pattern):
    return search.fetch_named(getattr(Loaded(spark, sf_dir), name), pattern)


@register("p6_fetch_plans")
def p6_plans(spark, sf_dir):
    return search.fetch_plans(Loaded(spark, sf_dir).plans, "%r%")


@register("f1_like_parts")
def f1(spark, sf_dir):
    return search.like_all(t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), p_name="%b__t%", p_type="%A%")


# --- series ------------------------------------------------------------------------------------------------------
def worklist(spark, sf_dir) -> DataFrame:
    """One requested series per customer: stocks with and without exchange, pairs with and without, unknown symbols."""
    form, key = F.col("c_mktsegment"), F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    stock = F.concat(F.lit("P"), F.lpad(key.cast("string"), 10, "0"))
    pair = F.concat(F.lit("C"), two(F.col("c_nationkey")), F.lit("/C"), two((F.col("c_nationkey") + 1) % 25))
    return t(spark, sf_dir, "customer").select(
        key.alias("req_id"),
        F.when(form.isin("AUTOMOBILE", "BUILDING"), stock)
        .when(form.isin("FURNITURE", "MACHINERY"), pair)
        .otherwise(F.col("c_name"))
        .alias("symbol"),
        F.when(form.isin("AUTOMOBILE", "MACHINERY"), "X1").alias("mic_code"),
        F.when(F.col("c_acctbal") > 5000, "1min").when(F.col("c_acctbal") > 0, "1day").otherwise("1h").alias("time_interval"),
    )


@register("p12_interval_guard")
def p12(spark, sf_dir):
    return series.split_by_interval(worklist(spark, sf_dir))[1]


@register("p13_resolve_series")
def p13(spark, sf_dir):
    tables = Loaded(spark, sf_dir)
    return series.resolve_series(
        worklist(spark, sf_dir), tables.equity_list.select("symbol"), tables.forex_list.select(F.upper("symbol").alias("symbol"))
    )


@register("p14_series_exists")
def p14(spark, sf_dir):
    """Which requested series does the archive know: those of the candles at hand."""
    asked = adapters.requests(spark, sf_dir).select(
        "req_id",
        F.when(F.col("series_key").isin(*adapters.FOREX_TYPES), "forex").otherwise("equity").alias("asset_class"),
        F.when(F.col("n").isNull(), "1day").otherwise("1h").alias("time_interval"),
        "series_key",
    )
    return series.flag_registered(asked, adapters.unnumbered_candles(spark, sf_dir, "1day"))


@register("j8_known_customers")
def j8(spark, sf_dir):
    """Does the buyer of an order have a market segment entry with credit?"""
    good = t(spark, sf_dir, "customer").where("c_acctbal >= 0")
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lookups.flag_known(orders, "o_custkey", good, "c_custkey", "known")


@register("j8_only_known")
def j8_only(spark, sf_dir):
    good = t(spark, sf_dir, "customer").where("c_acctbal >= 0")
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lookups.only_known(orders, "o_custkey", good, "c_custkey")


@register("j9_ambiguous_keys")
def j9(spark, sf_dir):
    return lookups.ambiguous_keys(t(spark, sf_dir, "part"), "p_name")


@register("j10_constraint_audit")
def j10(spark, sf_dir):
    """Double names, buyers without orders, lines without parents, over-long segments."""
    customer, lineitem = t(spark, sf_dir, "customer"), t(spark, sf_dir, "lineitem")
    orders = t(spark, sf_dir, "orders")
    widths = [Col("c_mktsegment", "string", 8, True), Col("c_name", "string", 18, True)]
    buyers = {"c_custkey": (orders, "o_custkey")}
    lines = {
        "l_orderkey": (orders, "o_orderkey"),
        "l_partkey": (t(spark, sf_dir, "part"), "p_partkey"),
        "l_suppkey": (t(spark, sf_dir, "supplier"), "s_suppkey"),
    }
    double = audit.duplicate_keys(t(spark, sf_dir, "part"), "part", "p_name")
    return double.unionByName(audit.row_violations(customer, "customer", widths, buyers, "c_custkey")).unionByName(
        audit.row_violations(lineitem, "lineitem", parents=lines, key="l_orderkey")
    )


@register("j1_star_join")
def j1(spark, sf_dir):
    """Order lines with order, part, supplier, nation and region: five left joins on keys."""
    supplier = t(spark, sf_dir, "supplier")
    lines = views.explain_keys(
        t(spark, sf_dir, "lineitem"),
        ["l_orderkey", "l_linenumber", "l_quantity"],
        [
            views.Lookup(t(spark, sf_dir, "orders"), "l_orderkey", {"order_status": "o_orderstatus"}, "o_orderkey"),
            views.Lookup(t(spark, sf_dir, "part"), "l_partkey", {"part_name": "p_name"}, "p_partkey"),
            views.Lookup(supplier, "l_suppkey", {"supplier_name": "s_name", "_nation": "s_nationkey"}, "s_suppkey"),
        ],
    )
    nations = views.Lookup(
        t(spark, sf_dir, "nation"), "_nation", {"nation_name": "n_name", "_region": "n_regionkey"}, "n_nationkey"
    )
    keep = ["l_orderkey", "l_linenumber", "l_quantity", "order_status", "part_name", "supplier_name"]
    lines = views.explain_keys(lines, keep, [nations])
    regions = views.Lookup(t(spark, sf_dir, "region"), "_region", {"region_name": "r_name"}, "r_regionkey")
    return views.explain_keys(lines, [*keep, "nation_name"], [regions])


@register("j2_order_places")
def j2(spark, sf_dir):
    """Orders with buyer, nation and region."""
    buyers = views.Lookup(
        t(spark, sf_dir, "customer"), "o_custkey", {"customer_name": "c_name", "_nation": "c_nationkey"}, "c_custkey"
    )
    nations = views.Lookup(
        t(spark, sf_dir, "nation"), "_nation", {"nation_name": "n_name", "_region": "n_regionkey"}, "n_nationkey"
    )
    regions = views.Lookup(t(spark, sf_dir, "region"), "_region", {"region_name": "r_name"}, "r_regionkey")
    rows = views.explain_keys(t(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], [buyers])
    rows = views.explain_keys(rows, ["o_orderkey", "o_totalprice", "customer_name"], [nations])
    return views.explain_keys(rows, ["o_orderkey", "o_totalprice", "customer_name", "nation_name"], [regions])


@register("j3_trade_nations")
def j3(spark, sf_dir):
    """Order lines with the nation table in two roles: of the buyer (base) and of the seller (quote)."""
    nation = t(spark, sf_dir, "nation")
    keep = ["l_orderkey", "l_linenumber"]
    rows = views.explain_keys(
        t(spark, sf_dir, "lineitem"),
        keep,
        [
            views.Lookup(t(spark, sf_dir, "orders"), "l_orderkey", {"_buyer": "o_custkey"}, "o_orderkey"),
            views.Lookup(t(spark, sf_dir, "supplier"), "l_suppkey", {"_quote": "s_nationkey"}, "s_suppkey"),
        ],
    )
    buyers = views.Lookup(t(spark, sf_dir, "customer"), "_buyer", {"_base": "c_nationkey"}, "c_custkey")
    rows = views.explain_keys(rows, [*keep, "_quote"], [buyers])
    return views.explain_keys(
        rows,
        keep,
        [
            views.Lookup(nation, "_base", {"base_name": "n_name"}, "n_nationkey"),
            views.Lookup(nation, "_quote", {"quote_name": "n_name"}, "n_nationkey"),
        ],
    )


# === candles =====================================================================================================
@register("w1_row_ids", "1min")
@register("s16_scan_1day", "1day")
def candles(spark, sf_dir, interval):
    return adapters.candles(spark, sf_dir, interval)


@register("p1_candle_view", "1min")
def p1(spark, sf_dir, interval):
    return views.candle_view(adapters.candles(spark, sf_dir, interval))


def archived(spark, sf_dir, interval) -> DataFrame:
    """The candles as a stored table, for operators that read them more than once."""
    return materialise(adapters.candles(spark, sf_dir, interval))


def latest_before(spark, sf_dir, count: int = 10) -> DataFrame:
    """The flagship: the latest day candles up to a date, per series, with their direction."""
    day = archived(spark, sf_dir, "1day")
    asked = t(spark, sf_dir, "events").select(F.col("event_type").alias("series_key")).distinct()
    asked = asked.select(
        F.xxhash64("series_key").alias("req_id"),
        "series_key",
        F.lit(None).cast("timestamp_ntz").alias("start"),
        F.lit(MID).cast("timestamp_ntz").alias("end"),
        F.lit(count).alias("n"),
    )
    found = ranges.fetch_by_dates(asked, day, "1day", position="ID").drop("req_id")
    return views.candle_view(found).orderBy("series_key", "ID")


register("p11_latest_before")(latest_before)


@register("p8_point_lookup")
def p8(spark, sf_dir):
    asked = adapters.probes(spark, sf_dir).withColumn("at", clock.minute_of(F.col("at")))
    return ranges.point_lookup(asked, adapters.candles(spark, sf_dir, "1min")).select(
        "req_id", "series_key", "at", "status", "ID", "open", "close"
    )


@register("p8_point_lookup_doubles")
def p8_doubles(spark, sf_dir):
    """Moments looked up among the events themselves, taken to the hour: mostly more than one candle answers."""
    hour = lambda c: clock.day_of(c) + clock.minutes(F.hour(c) * 60)
    points = t(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_key"), hour(F.col("ts")).alias("datetime"), F.col("event_id").alias("ID")
    )
    asked = adapters.probes(spark, sf_dir).withColumn("at", hour(F.col("at")))
    return ranges.point_lookup(asked, points, values=["ID"])


@register("p9_by_id")
def p9(spark, sf_dir):
    return ranges.by_id(adapters.candles(spark, sf_dir, "1min"), 5)


@register("p10_id_range")
def p10(spark, sf_dir):
    return ranges.by_id_range(adapters.candles(spark, sf_dir, "1min"), 10, 500)


@register("p10_id_range_requests")
def p10_batch(spark, sf_dir):
    asked = adapters.requests(spark, sf_dir).join(
        t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("req_id"), "c_nationkey"), "req_id"
    )
    asked = asked.select(
        "req_id", "series_key", F.col("c_nationkey").alias("low"), (F.col("c_nationkey") * 2).alias("high")
    )
    return ranges.fetch_positions(asked, archived(spark, sf_dir, "1min"), "low", "high").select(
        "req_id", "series_key", "ID", "datetime", "close"
    )


@register("p11_range_fetch", "1day", None)
@register("p11_range_fetch_1min", "1min", "ID")
def p11(spark, sf_dir, interval, position):
    found = ranges.fetch_by_dates(
        adapters.requests(spark, sf_dir), archived(spark, sf_dir, interval), interval, position
    )
    return found.select("req_id", "series_key", "ID", "datetime", "open", "close", "high", "low")


@register("t3_last_n", end_date=MID, trading_time_span=25)
@register("t4_first_n", start_date=MID, trading_time_span=25)
@register("p11_between", start_date=MID, time_span=timedelta(days=3))
def p11_single(spark, sf_dir, **dates):
    one = adapters.candles(spark, sf_dir, "1min").where("series_key = 'click'")
    return ranges.fetch_series_by_dates(one, **dates)


@register("c4_id_bracket", "1day")
def c4(spark, sf_dir, interval):
    return ranges.id_bracket(adapters.requests(spark, sf_dir), archived(spark, sf_dir, interval), interval)


@register("j11_nearest_before", "<=")
@register("j11_nearest_after", ">=")
def j11(spark, sf_dir, operation):
    return asof.nearest(
        adapters.probes(spark, sf_dir),
        archived(spark, sf_dir, "1min"),
        operation,
        at="at",
        out="nearest_id",
        interval="1min",
    )


@register("p15_line_series")
def p15(spark, sf_dir):
    return chart.line_series(adapters.candles(spark, sf_dir, "1min"), "close", "1min")


# --- per-series summaries ------------------------------------------------------------------------------------------
@register("a1_row_counts", summaries.row_counts)
@register("a2_latest_timestamp", summaries.latest_timestamp)
@register("a3_last_id", summaries.last_id)
@register("a5_earliest_point", summaries.earliest_point)
@register("a6_latest_candle", summaries.latest_candle)
@register("a7_extents", summaries.extents)
@register("a8_last_price", summaries.last_price)
def summary(spark, sf_dir, operator):
    return operator(adapters.candles(spark, sf_dir, "1min"))


@register("a4_currency_values", dimensions.currency_values, "forex_list")
@register("a4_plan_values", dimensions.plan_values, "exchange_list")
@register("a4_country_values", dimensions.country_values, "exchange_list")
def a4(spark, sf_dir, operator, source):
    return operator(getattr(Loaded(spark, sf_dir), source))


# --- chart -----------------------------------------------------------------------------------------------------------
@register("w2_time_splits_1min", "1min")
@register("w2_time_splits_1day", "1day")
def w2(spark, sf_dir, interval):
    return chart.time_splits(adapters.candles(spark, sf_dir, interval), interval)


@register("f15_body_geometry")
def f15(spark, sf_dir):
    return chart.body_geometry(adapters.candles(spark, sf_dir, "1min"))


@register("c5_chart_frame_1min", "1min")
@register("c5_chart_frame_1day", "1day")
def c5(spark, sf_dir, interval):
    return chart.chart_frame(adapters.candles(spark, sf_dir, interval), interval)


# --- ledger ------------------------------------------------------------------------------------------------------------
def trades(spark, sf_dir) -> DataFrame:
    return adapters.trades(spark, sf_dir)


@register("w5_running_balance")
def w5(spark, sf_dir):
    return ledger.running_balance(trades(spark, sf_dir))


@register("w6_streak_balance")
def w6(spark, sf_dir):
    return ledger.streak_balance(trades(spark, sf_dir))


@register("w8_run_results")
def w8(spark, sf_dir):
    return ledger.run_results(ledger.running_balance(trades(spark, sf_dir)))


@register("a9_flat_summary", ledger.running_balance)
@register("a9_streak_summary", ledger.streak_balance)
def a9(spark, sf_dir, scheme):
    return ledger.scheme_summary(ledger.run_results(scheme(trades(spark, sf_dir))))


# --- expressions ---------------------------------------------------------------------------------------------------
@register("f3_pair_parts")
def f3(spark, sf_dir):
    symbol = F.col("symbol")
    return Loaded(spark, sf_dir).forex_list.select(
        "symbol",
        F.upper(text.base_symbol(symbol)).alias("base"),
        F.upper(text.quote_symbol(symbol)).alias("quote"),
        text.looks_like_pair(symbol).alias("is_pair"),
        text.forex_key(symbol, F.lit("1min")).alias("series_key"),
    )


@register("f5_known_country")
def f5(spark, sf_dir):
    return Loaded(spark, sf_dir).exchange_list.select(
        "code", text.known_country(F.col("country")).alias("country"), text.equity_key(F.col("name"), F.col("code")).alias("series_key")
    )


@register("f6_timeframe_name")
def f6(spark, sf_dir):
    unit = F.when(F.col("o_orderstatus") == "F", "min").when(F.col("o_orderstatus") == "O", "h").otherwise("week")
    frame = F.concat(F.month("o_orderdate").cast("string"), unit)
    return t(spark, sf_dir, "orders").select("o_orderkey", text.timeframe_name(frame).alias("timeframe"))


@register("f8_volume_label")
def f8(spark, sf_dir):
    volume = F.floor(F.col("l_extendedprice") * F.col("l_quantity"))
    return t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", volume.alias("volume"), text.volume_label(volume).alias("label")
    )


@register("f11_session_clamp")
def f11(spark, sf_dir):
    ts = F.col("ts")
    return t(spark, sf_dir, "events").select(
        "event_id", clock.clamp_to_session(ts, "start").alias("start"), clock.clamp_to_session(ts, "end").alias("end")
    )


@register("f12_calendar")
def f12(spark, sf_dir):
    d = F.col("ts")
    return t(spark, sf_dir, "events").select(
        "event_id",
        clock.month_of(d).alias("month_start"),
        clock.day_of(d).alias("day_start"),
        (clock.day_of(d) + clock.minutes(24 * 60)).alias("next_day"),
        (F.weekday(d) + 1).alias("iso_weekday"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        clock.unix_seconds(d).alias("unix_time"),
    )


@register("f14_page_estimate")
def f14(spark, sf_dir):
    first = F.col("o_orderdate")
    interval = F.when(F.col("o_orderstatus") == "F", "1day").otherwise("1min")
    asset = F.when(F.col("o_orderstatus") == "O", "forex").otherwise("equity")
    end = F.lit(MID).cast("timestamp_ntz")
    return t(spark, sf_dir, "orders").select("o_orderkey", clock.page_estimate(first, end, interval, asset).alias("pages"))


@register("f17_json_fields")
def f17(spark, sf_dir):
    props = F.from_json("props", "k int")
    return t(spark, sf_dir, "events").select("event_id", props["k"].alias("k"))


# === landed pages and the archive ====================================================================================
def symbols_of(candles: DataFrame) -> DataFrame:
    """Provider identity of the test candles: pairs are called like ``sig/nup``, equities trade on XNGS in USD."""
    pair = F.col("asset_class") == "forex"
    key = F.col("series_key")
    return candles.withColumns(
        {
            "symbol": F.when(pair, F.concat(F.substring(key, 1, 3), F.lit("/"), F.substring(key, 4, 9))).otherwise(key),
            "mic_code": F.when(~pair, "XNGS"),
            "currency": F.when(~pair, "USD"),
        }
    )


def landed_pages(spark, sf_dir, interval: str, where: str = "true") -> str:
    path = fresh_folder(spark, "pages")
    landing.land_pages(symbols_of(adapters.unnumbered_candles(spark, sf_dir, interval)).where(where), path)
    return path


@register("s5_candle_page", symbol="click", end_date=MID)
@register("s5_candle_page_pair", symbol="vie/w", start_date=MID)
def s5(spark, sf_dir, symbol, **arguments):
    rows = landing.page_candles(landing.read_pages(spark, landed_pages(spark, sf_dir, "1min")))
    return landing.candle_page(rows, symbol, **arguments)


@register("s6_candle_csv")
def s6(spark, sf_dir):
    rows = adapters.unnumbered_candles(spark, sf_dir, "1min").select(
        "series_key", "time_interval", F.col("datetime").cast("string").alias("datetime"), "open", "high", "low", "close", "volume"
    )
    path = fresh_folder(spark, "csv")
    rows.write.partitionBy("series_key", "time_interval").option("header", True).option("sep", ";").csv(path)
    return landing.read_candle_csv(spark, path, ";")


@register("s8_page_stitch", "1min")
@register("s8_page_stitch_1day", "1day")
def s8(spark, sf_dir, interval):
    return landing.stitch(landing.page_candles(landing.read_pages(spark, landed_pages(spark, sf_dir, interval))))


@register("f18_page_edges")
def f18(spark, sf_dir):
    """First, last and number of further values of every landed page."""
    pages = landing.read_pages(spark, landed_pages(spark, sf_dir, "1min"))
    return pages.select(
        F.col("meta.symbol").alias("symbol"),
        F.element_at("values", 1)["datetime"].alias("newest"),
        F.element_at("values", -1)["datetime"].alias("oldest"),
        F.size(F.slice("values", 2, F.size("values"))).alias("further"),
    )


@register("s18_usage_report")
def s18(spark, sf_dir):
    date = F.col("o_orderdate")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    header = F.concat(
        F.dayname(date.cast("date")), F.lit(", "), two(F.dayofmonth(date)), F.lit(" "), F.monthname(date.cast("date")),
        F.lit(" "), F.year(date).cast("string"), F.lit(" 09:37:00 GMT"),
    )
    log = t(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("key_name"),
        header.alias("date"),
        F.month(date).alias("credits_used"),
        F.dayofmonth(date).alias("credits_left"),
        F.lit(800).alias("daily_limit"),
        F.dayofyear(date).alias("daily_remaining"),
    )
    path = fresh_folder(spark, "usage")
    log.write.json(path)
    return landing.usage_report(spark.read.schema(schemas.USAGE_LOG).json(path))


def new_warehouse(spark: SparkSession) -> CandleArchive:
    name = f"wh_{uuid.uuid4().hex}"
    catalog.build_warehouse(spark, name, fresh_folder(spark, name))
    return CandleArchive(spark, name)


def filled(spark, sf_dir, interval: str = "1day") -> CandleArchive:
    """A new archive, filled in two appends that meet at a date."""
    archive = new_warehouse(spark)
    rows = adapters.unnumbered_candles(spark, sf_dir, interval)
    moment = F.lit(MID).cast("timestamp_ntz")
    archive.register(rows)
    archive.append(rows.where(F.col("datetime") <= moment))
    archive.append(rows.where(F.col("datetime") >= F.lit(MID - timedelta(days=2)).cast("timestamp_ntz")))
    return archive


@register("s11_append", "1min")
def s11(spark, sf_dir, interval):
    return filled(spark, sf_dir, interval).candles()


@register("s12_register")
def s12(spark, sf_dir):
    archive = new_warehouse(spark)
    for _ in range(2):
        archive.register(adapters.unnumbered_candles(spark, sf_dir, "1day"))
    return archive.registry()


@register("s13_drop_series")
def s13(spark, sf_dir):
    archive = filled(spark, sf_dir)
    archive.drop_series("equity", "1day", "click")
    return archive.candles()


@register("s14_delete_row")
def s14(spark, sf_dir):
    archive = filled(spark, sf_dir)
    archive.delete_row("equity", "1day", "error", 3)
    return archive.candles()


@register("s16_scan_dates")
def s16(spark, sf_dir):
    return filled(spark, sf_dir).scan("equity", "1day", "purchase", start=datetime(2024, 1, 10), end=MID)


@register("j12_unseen")
def j12(spark, sf_dir):
    """Candles on offer that an archive filled up to a date does not hold yet."""
    archive = new_warehouse(spark)
    rows = adapters.unnumbered_candles(spark, sf_dir, "1min")
    archive.append(rows.where(F.col("datetime") <= F.lit(MID).cast("timestamp_ntz")))
    return archive.unseen(rows)


def _catalogue(spark, sf_dir):
    """Stocks and pairs that name the series of the landed pages."""
    named = symbols_of(adapters.unnumbered_candles(spark, sf_dir, "1day")).select("asset_class", "symbol").distinct()
    return named.where("asset_class = 'equity'"), named.where("asset_class = 'forex'")


def _all_series(spark, sf_dir) -> DataFrame:
    candles = symbols_of(adapters.unnumbered_candles(spark, sf_dir, "1day"))
    return candles.select("symbol", "mic_code", "time_interval").distinct()


@register("c2_save_series")
def c2(spark, sf_dir):
    archive = new_warehouse(spark)
    pages = landing.read_pages(spark, landed_pages(spark, sf_dir, "1day"))
    series_updates.save_series(archive, _all_series(spark, sf_dir), pages, *_catalogue(spark, sf_dir))
    return archive.candles()


@register("c3_update_series")
def c3(spark, sf_dir):
    archive = new_warehouse(spark)
    early = landing.read_pages(spark, landed_pages(spark, sf_dir, "1day", f"datetime <= timestamp_ntz'{MID}'"))
    every = landing.read_pages(spark, landed_pages(spark, sf_dir, "1day"))
    names = _catalogue(spark, sf_dir)
    series_updates.save_series(archive, _all_series(spark, sf_dir), early, *names)
    series_updates.update_series(archive, _all_series(spark, sf_dir), every, *names)
    return archive.candles()


@register("r1_stream_ingest")
def r1(spark, sf_dir):
    """Two waves of landed pages that overlap by two days, each drained by the stream into the archive."""
    archive = new_warehouse(spark)
    candles = adapters.unnumbered_candles(spark, sf_dir, "1day")
    named = symbols_of(candles)
    known = named.select(
        "asset_class",
        "time_interval",
        F.when(F.col("asset_class") == "forex", text.forex_key(F.col("symbol"), F.col("time_interval")))
        .otherwise(text.equity_key(F.col("symbol"), F.col("mic_code")))
        .alias("series_key"),
    )
    archive.register(known)
    path, checkpoint = fresh_folder(spark, "pages"), fresh_folder(spark, "progress")
    for number, where in enumerate(
        [f"datetime <= timestamp_ntz'{MID}'", f"datetime >= timestamp_ntz'{MID - timedelta(days=2)}'"]
    ):
        landing.land_pages(named.where(where), f"{path}/wave={number}")
        ingest.ingest_pages(archive, ingest.page_stream(spark, f"{path}/*"), checkpoint).awaitTermination()
    return archive.candles()
