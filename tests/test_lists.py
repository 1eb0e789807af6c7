"""List load, explained views, search, lookups and audits on the sample lists."""

import pytest
from pyspark.sql import functions as F

from barvault import schemas
from barvault.errors import DataUncertain
from barvault.operators import audit, dimensions, lookups, search, series, views
from barvault.operators.numbering import dense_ids
from barvault.plans import load_lists
from tests import samples


@pytest.fixture(scope="module")
def tables(spark):
    return load_lists.load_lists(
        samples.forex_list(spark), samples.exchange_list(spark), samples.equity_list(spark)
    )


def ids(df):
    return sorted(r.ID for r in df.collect())


def test_counts_after_load(tables):
    expected = {
        "currencies": 12,  # ten of the pairs and two fixed ones
        "forex_currency_groups": 4,
        "forex_pairs": 7,
        "timezones": 4,
        "countries": 6,  # four names, the empty one and Unknown
        "plans": 4,
        "markets": 6,
        "investment_types": 3,
        "stocks": 6,
        "stock_rejects": 0,
    }
    assert {name: tables[name].count() for name in expected} == expected


def test_ids_are_dense_in_key_order(tables):
    for name, key in {"currencies": "name", "countries": "name", "stocks": "symbol", "forex_pairs": "symbol"}.items():
        rows = sorted(tables[name].collect(), key=lambda r: r.ID)
        assert [r.ID for r in rows] == list(range(len(rows)))
        assert [r[key] for r in rows] == sorted(r[key] for r in rows)


def test_equal_names_keep_input_order(tables):
    codes = [r.code for r in tables["markets"].orderBy("ID").collect()]
    assert codes == ["XBAH", "XLON", "XNGS", "XNMS", "PINX", "XSHE"]


def test_symbols_are_upper_case_before_distinct(tables):
    assert tables["currencies"].where("symbol = 'GBP'").count() == 1
    assert tables["forex_pairs"].where("symbol = 'USD/GBP'").count() == 1


def test_dense_ids_over_many_partitions(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("v")).repartition(16)
    rows = sorted(dense_ids(df, ["v"]).collect(), key=lambda r: r.ID)
    assert [r.ID for r in rows] == list(range(10_000))
    assert [r.v for r in rows] == sorted(r.v for r in rows)


@pytest.fixture(scope="module")
def stocks_view(tables):
    t = tables
    return views.stocks_explained(
        t["stocks"], t["currencies"], t["markets"], t["countries"], t["investment_types"], t["plans"]
    ).cache()


def test_stocks_explained(stocks_view):
    first = stocks_view.orderBy("ID").first()
    assert tuple(first) == (
        0, "AADV", "Albion Development VCT PLC", "GBP", "XLON", "United Kingdom", "Common Stock", "Grow",
    )
    assert stocks_view.where("symbol = 'BKISF'").first().country_name == "Unknown"


@pytest.mark.parametrize(
    "filters, expected",
    [
        ({}, [0, 1, 2, 3, 4, 5]),
        ({"symbol_like": "M%"}, []),
        ({"name_like": "%PLC"}, [0, 3]),
        ({"currency_symbol_like": "USD", "market_identification_code_like": "X%"}, [1, 2, 4, 5]),
        ({"symbol_like": "A%", "investment_type_name_like": "%Note"}, [2]),
        ({"country_name_like": "united%"}, []),  # case matters
        ({"symbol_like": "AAP_"}, [1]),
        ({"access_plan_name_like": "Grow"}, [0]),
    ],
)
def test_fetch_stocks(stocks_view, filters, expected):
    assert ids(search.fetch_stocks(stocks_view, **filters)) == expected


def test_fetch_pairs_markets_and_dimensions(tables):
    t = tables
    pairs = views.forex_pairs_explained(t["forex_pairs"], t["forex_currency_groups"], t["currencies"])
    assert ids(search.fetch_forex_pairs(pairs, base_name_like="%Dollar%", quote_name_like="%Pound%")) == [5]
    assert ids(search.fetch_forex_pairs(pairs, currency_group_name_like="M%", quote_symbol_like="%PY")) == [6]
    markets = views.markets_explained(t["markets"], t["timezones"], t["countries"], t["plans"])
    assert ids(search.fetch_markets(markets, timezone_name_like="%New_York")) == [2, 3, 4]
    assert ids(search.fetch_markets(markets, name_like="%E%")) == [1, 5]
    assert ids(search.fetch_currencies(t["currencies"], symbol_like="E%")) == [3]
    assert ids(search.fetch_plans(t["plans"], "%o%")) == [2, 3]
    assert ids(search.fetch_timezones(t["timezones"], "Asia%")) == [1, 2]


@pytest.mark.parametrize("position", range(7))
def test_empty_filter_is_refused(stocks_view, position):
    with pytest.raises(ValueError):
        search.fetch_stocks(stocks_view, *["" if i == position else None for i in range(7)])


def test_quotes_in_patterns_are_harmless(stocks_view):
    assert search.fetch_stocks(stocks_view, name_like="x' OR '1' = '1").count() == 0


def test_unmatched_stock_becomes_a_reject(spark, tables):
    rows = [*samples.EQUITIES, ("ZZZ", "Lost Inc", "XXX", "NONE", "Nowhere", "ETF", "Basic")]
    judged = dimensions.stocks_with_rejects(
        samples.equity_list(spark, rows), tables["currencies"], tables["markets"], tables["countries"],
        tables["investment_types"], tables["plans"],
    )
    assert dimensions.accepted(judged).count() == 6
    (reject,) = dimensions.rejected(judged).collect()
    assert (reject.symbol, reject.missing) == ("ZZZ", "currency,exchange,country")


def test_used_ambiguous_key_fails_and_unused_does_not(spark):
    dim = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "ID int, name string")
    assert [tuple(r) for r in lookups.ambiguous_keys(dim, "name").collect()] == [("a", 2)]
    rows = spark.createDataFrame([("b",), (None,), ("c",)], "k string")
    found = {r.k: r.id for r in lookups.find_id(rows, F.col("k"), dim, "name", "id").collect()}
    assert found == {"b": 2, None: None, "c": None}
    with pytest.raises(Exception, match="more than one row"):
        lookups.find_id(spark.createDataFrame([("a",)], "k string"), F.col("k"), dim, "name", "id").collect()


def test_existence(spark, tables):
    work = spark.createDataFrame([("NVDA",), ("USD/CAD",), ("KGS/RUB",)], "symbol string")
    flagged = lookups.flag_known(work, "symbol", tables["stocks"], "symbol", "stock")
    flagged = lookups.flag_known(flagged, "symbol", tables["forex_pairs"], "symbol", "pair")
    assert {tuple(r) for r in flagged.collect()} == {
        ("NVDA", True, False), ("USD/CAD", False, False), ("KGS/RUB", False, True),
    }
    assert [r.symbol for r in lookups.only_known(work, "symbol", tables["stocks"], "symbol").collect()] == ["NVDA"]


@pytest.mark.parametrize(
    "arguments, expected",
    [
        (("AAPL", "1day", None, "XNGS"), ("equity", "AAPL_XNGS")),
        (("USD/EUR", "1min", None, None), ("forex", "USD_EUR_1min")),
        (("AAPL", "1day", None, None), ValueError),
        (("USD/EUR", "1day", None, "XNGS"), ValueError),
        (("AAPL", "1h", None, "XNGS"), ValueError),
        (("NOPE", "1day", None, "XNGS"), DataUncertain),
        (("NOPE", "1day", True, "XNGS"), ("equity", "NOPE_XNGS")),
        (("AAPL", "1min", False, "XNGS"), ValueError),
    ],
)
def test_resolve(tables, arguments, expected):
    symbol, interval, is_equity, mic = arguments
    call = lambda: series.resolve_one(symbol, interval, tables["stocks"], tables["forex_pairs"], is_equity, mic)
    if isinstance(expected, tuple):
        assert call() == expected
    else:
        with pytest.raises(expected):
            call()


def test_interval_guard(spark):
    df = spark.createDataFrame([("1min",), ("1day",), ("1h",), (None,)], "time_interval string")
    good, bad = series.split_by_interval(df)
    assert (good.count(), bad.count()) == (2, 2)


def test_audit_finds_every_kind(spark, tables):
    assert audit.audit_warehouse({k: v for k, v in tables.items() if k in schemas.TABLES}).count() == 0
    broken = spark.createDataFrame(
        [(0, "M", None, 9, 0, "C"), (0, "x" * 51, 0, 0, 0, None)],
        "ID int, name string, access int, timezone int, country int, code string",
    )
    report = audit.audit_warehouse({"markets": broken, "timezones": tables["timezones"]})
    found = {(r.rule, r.column, r.key, r.detail) for r in report.collect() if r.table == "markets"}
    assert found == {
        ("unique", "ID", "0", "2"),
        ("foreign_key", "timezone", "0", "9"),
        ("length", "name", "0", "51"),
        ("not_null", "code", "0", None),
    }


def test_tracked_indexes(spark, tables):
    tracking = spark.createDataFrame(
        [(0, True, False, 1, "w"), (1, False, True, 99, "v")],
        "ID int, is_tracked_1min boolean, is_tracked_1day boolean, stock int, worker_name string",
    )
    rows = {tuple(r) for r in views.tracked_indexes(tracking, tables["stocks"], tables["markets"]).collect()}
    assert rows == {
        ("Apple Inc", "AAPL", "NASDAQ", False, True, "w"),
        (None, None, None, True, False, "v"),
    }
