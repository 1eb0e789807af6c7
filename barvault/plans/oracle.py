"""Each registered query as plain SQL over the star-schema tables, for comparison in another engine."""

from __future__ import annotations

MID = "TIMESTAMP '2024-01-15 12:00:00'"
ORACLE: dict[str, str] = {}


def bars(interval: str) -> str:
    """``bars``: candles without ID."""
    unit = "day" if interval == "1day" else "minute"
    return f"""
grouped AS (
    SELECT event_type AS series_key, date_trunc('{unit}', ts) AS datetime,
           CAST(arg_min(value, {{'a': ts, 'b': event_id}}) AS DECIMAL(10,5)) AS open,
           CAST(arg_max(value, {{'a': ts, 'b': event_id}}) AS DECIMAL(10,5)) AS close,
           CAST(max(value) AS DECIMAL(10,5)) AS high, CAST(min(value) AS DECIMAL(10,5)) AS low,
           count(*) AS hits
    FROM events GROUP BY 1, 2),
bars AS (
    SELECT CASE WHEN series_key IN ('signup', 'view') THEN 'forex' ELSE 'equity' END AS asset_class,
           '{interval}' AS time_interval, series_key, datetime, open, close, high, low,
           CASE WHEN series_key NOT IN ('signup', 'view') THEN hits END AS volume
    FROM grouped)"""


def candles(interval: str) -> str:
    """``candles``: the bars with their dense ID per series."""
    return f"""{bars(interval)},
candles AS (
    SELECT asset_class, time_interval, series_key,
           row_number() OVER (PARTITION BY series_key ORDER BY datetime) - 1 AS "ID",
           datetime, open, close, high, low, volume
    FROM bars)"""


REQUESTS = f"""
requests AS (
    SELECT c_custkey AS req_id, c_nationkey,
           ['click', 'error', 'purchase', 'signup', 'view'][c_nationkey % 5 + 1] AS series_key,
           CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD') THEN first END AS start_given,
           CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE', 'MACHINERY') THEN first + width END AS end_given,
           CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN width END AS span,
           CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN c_nationkey + 1 END AS n
    FROM (SELECT *, TIMESTAMP '2024-01-01' + to_minutes(CAST(floor(c_acctbal * 5) AS BIGINT)) AS first,
                 to_minutes(CAST(60 * (c_nationkey + 1) AS BIGINT)) AS width
          FROM customer)),
dated AS (
    SELECT req_id, series_key, n, coalesce(start_given, end_given - span) AS a, coalesce(end_given, start_given + span) AS b
    FROM requests)"""

PROBES = """
probes AS (
    SELECT event_id AS req_id, event_type AS series_key, ts + INTERVAL '3 hours 1 second' AS "at" FROM events)"""

# --- landed lists --------------------------------------------------------------------------------------------------
ACCESS = """
access(r_name, access_global, access_plan) AS (
    VALUES ('AFRICA', 'Level C', 'Enterprise'), ('AMERICA', 'Basic', 'Basic'), ('ASIA', 'Level B', 'Pro'),
           ('EUROPE', 'Level A', 'Grow'), ('MIDDLE EAST', 'Level C', 'Enterprise'))"""

LISTS = f"""{ACCESS},
exchange_list AS (
    SELECT s_name AS name, 'X' || s_suppkey AS code, CASE WHEN n_nationkey = 0 THEN '' ELSE n_name END AS country,
           r_name AS timezone, access_global, access_plan
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN access USING (r_name)),
traded AS (
    SELECT DISTINCT c_nationkey, s_nationkey
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
forex_list AS (
    SELECT 'c' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '/c' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS symbol,
           r_name AS currency_group, b.n_name AS currency_base, q.n_name AS currency_quote
    FROM traded JOIN nation b ON c_nationkey = b.n_nationkey JOIN nation q ON s_nationkey = q.n_nationkey
    JOIN region ON b.n_regionkey = r_regionkey),
first_seller AS (SELECT l_partkey, min(l_suppkey) AS seller FROM lineitem GROUP BY 1),
equity_list AS (
    SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS symbol, p_name AS name,
           'c' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS currency, s_name AS exchange,
           'X' || s_suppkey AS mic_code, CASE WHEN n_nationkey = 0 THEN '' ELSE n_name END AS country,
           p_type AS type, access_global, access_plan
    FROM part LEFT JOIN first_seller ON p_partkey = l_partkey LEFT JOIN supplier ON seller = s_suppkey
    LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN access USING (r_name))"""


def _numbered(order: str) -> str:
    return f'CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS "ID"'


TABLES = f"""{LISTS},
currency_values AS (
    SELECT currency_base AS name, upper(split_part(symbol, '/', 1)) AS symbol FROM forex_list
    UNION SELECT currency_quote, upper(split_part(symbol, '/', 2)) FROM forex_list
    UNION SELECT 'South Africa cent', 'ZAC' UNION SELECT 'Israeli agora', 'ILA'),
currencies AS (SELECT {_numbered('name, symbol')}, name, symbol FROM currency_values),
forex_currency_groups AS (
    SELECT {_numbered('name')}, name FROM (SELECT DISTINCT currency_group AS name FROM forex_list)),
country_values AS (SELECT country AS name FROM exchange_list UNION SELECT 'Unknown'),
countries AS (SELECT {_numbered('name')}, name FROM country_values),
timezones AS (SELECT {_numbered('name')}, name FROM (SELECT DISTINCT timezone AS name FROM exchange_list)),
plan_values AS (SELECT DISTINCT access_global AS "global", access_plan AS plan FROM exchange_list),
plans AS (SELECT {_numbered('plan, "global"')}, "global", plan FROM plan_values),
investment_types AS (SELECT {_numbered('name')}, name FROM (SELECT DISTINCT type AS name FROM equity_list)),
markets AS (
    SELECT {_numbered('e.name')}, e.name, p."ID" AS access, z."ID" AS timezone, c."ID" AS country, e.code
    FROM exchange_list e LEFT JOIN plans p ON p.plan = e.access_plan LEFT JOIN timezones z ON z.name = e.timezone
    LEFT JOIN countries c ON c.name = CASE WHEN e.country = '' THEN 'Unknown' ELSE e.country END),
forex_pairs AS (
    SELECT {_numbered('f.symbol')}, g."ID" AS currency_group, upper(f.symbol) AS symbol, b."ID" AS currency_base,
           q."ID" AS currency_quote
    FROM forex_list f LEFT JOIN forex_currency_groups g ON g.name = f.currency_group
    LEFT JOIN currencies b ON b.symbol = upper(split_part(f.symbol, '/', 1))
    LEFT JOIN currencies q ON q.symbol = upper(split_part(f.symbol, '/', 2))),
judged AS (
    SELECT {_numbered('e.symbol')}, e.symbol, e.name, cur."ID" AS currency, m."ID" AS exchange, c."ID" AS country,
           ty."ID" AS type, p."ID" AS plan
    FROM equity_list e LEFT JOIN currencies cur ON cur.symbol = upper(e.currency)
    LEFT JOIN markets m ON m.code = e.mic_code
    LEFT JOIN countries c ON c.name = CASE WHEN e.country = '' THEN 'Unknown' ELSE e.country END
    LEFT JOIN investment_types ty ON ty.name = e.type LEFT JOIN plans p ON p.plan = e.access_plan),
stocks AS (
    SELECT * FROM judged WHERE currency IS NOT NULL AND exchange IS NOT NULL AND country IS NOT NULL
    AND type IS NOT NULL AND plan IS NOT NULL),
stocks_explained AS (
    SELECT s."ID", s.symbol, s.name, cur.symbol AS currency_symbol, m.code AS exchange_mic_code, c.name AS country_name,
           ty.name AS investment_type, p.plan AS access_plan
    FROM stocks s LEFT JOIN currencies cur ON s.currency = cur."ID" LEFT JOIN markets m ON s.exchange = m."ID"
    LEFT JOIN countries c ON s.country = c."ID" LEFT JOIN investment_types ty ON s.type = ty."ID"
    LEFT JOIN plans p ON s.plan = p."ID"),
markets_explained AS (
    SELECT m."ID", m.name, m.code AS mic_code, z.name AS timezone_name, p.plan AS access_plan, c.name AS country_name
    FROM markets m LEFT JOIN timezones z ON m.timezone = z."ID" LEFT JOIN plans p ON m.access = p."ID"
    LEFT JOIN countries c ON m.country = c."ID"),
forex_pairs_explained AS (
    SELECT f."ID", g.name AS currency_group_name, f.symbol, b.symbol AS base_currency_symbol,
           q.symbol AS quote_currency_symbol, b.name AS base_currency_name, q.name AS quote_currency_name
    FROM forex_pairs f LEFT JOIN forex_currency_groups g ON f.currency_group = g."ID"
    LEFT JOIN currencies b ON f.currency_base = b."ID" LEFT JOIN currencies q ON f.currency_quote = q."ID")"""


def _from_tables(name: str, table: str, where: str = "true") -> None:
    ORACLE[name] = f"WITH {TABLES} SELECT * FROM {table} WHERE {where}"


ORACLE["s1_equity_list"] = f"WITH {LISTS} SELECT * FROM equity_list"
ORACLE["s2_forex_list"] = f"WITH {LISTS} SELECT * FROM forex_list"
ORACLE["s3_exchange_list"] = f"WITH {LISTS} SELECT * FROM exchange_list"
ORACLE["s4_index_list"] = "SELECT c_name AS symbol, c_mktsegment AS name, '' AS country FROM customer"
ORACLE["s7_error_envelope"] = """
SELECT 404 AS code, 'no data for ' || c_name AS message FROM customer WHERE c_acctbal < 0"""
for _name, _table in {
    "s9_countries": "countries",
    "s9_timezones": "timezones",
    "s9_plans": "plans",
    "s9_currencies": "currencies",
    "s9_currency_groups": "forex_currency_groups",
    "s9_investment_types": "investment_types",
    "s10_markets": "markets",
    "s10_forex_pairs": "forex_pairs",
    "s10_stocks": "stocks",
    "j1_stocks_explained": "stocks_explained",
    "j2_markets_explained": "markets_explained",
    "j3_forex_pairs_explained": "forex_pairs_explained",
    "c1_load_lists": "stocks_explained",
    "a4_currency_values": "currency_values",
    "a4_plan_values": "plan_values",
    "a4_country_values": "country_values",
}.items():
    _from_tables(_name, _table)
ORACLE["j7_stock_rejects"] = f"""WITH {TABLES},
listed AS (SELECT * FROM exchange_list WHERE timezone <> 'ASIA'),
found AS (
    SELECT j."ID", j.symbol, j.currency, j.type, l.code AS exchange,
           (SELECT count(*) FROM (SELECT country FROM listed UNION SELECT 'Unknown') c(name)
            WHERE c.name = CASE WHEN e.country = '' THEN 'Unknown' ELSE e.country END) > 0 AS country,
           e.access_plan IN (SELECT access_plan FROM listed) AS plan
    FROM judged j JOIN equity_list e ON e.symbol = j.symbol LEFT JOIN listed l ON l.code = e.mic_code),
named AS (
    SELECT "ID", symbol, concat_ws(',', CASE WHEN currency IS NULL THEN 'currency' END,
           CASE WHEN exchange IS NULL THEN 'exchange' END, CASE WHEN NOT country THEN 'country' END,
           CASE WHEN type IS NULL THEN 'type' END, CASE WHEN NOT plan THEN 'plan' END) AS missing
    FROM found)
SELECT * FROM named WHERE missing <> ''"""
ORACLE["j4_tracked_indexes"] = f"""WITH {TABLES}
SELECT s.name AS equity_name, s.symbol, m.name AS market_name, c_mktsegment = 'BUILDING' AS is_tracked_1day,
       c_acctbal > 0 AS is_tracked_1min, c_mktsegment AS worker_name
FROM customer LEFT JOIN stocks s ON s."ID" = c_custkey LEFT JOIN markets m ON s.exchange = m."ID\""""

ORACLE["s17_table_rows"] = f"WITH {TABLES} " + " UNION ALL ".join(
    f"SELECT '{_table}' AS table_name, count(*) AS \"rows\" FROM {_table}"
    for _table in (
        "countries", "currencies", "forex_currency_groups", "forex_pairs", "investment_types", "markets", "plans",
        "stocks", "timezones",
    )
) + "".join(
    f" UNION ALL SELECT '{_table}', 0" for _table in ("time_tracking_info", "candles", "series_registry", "series_log")
)

# --- search ----------------------------------------------------------------------------------------------------------
_from_tables(
    "p2_fetch_markets", "markets_explained",
    "name LIKE 'Supplier#%' AND access_plan LIKE '%r%' AND country_name LIKE 'NATION__'",
)
_from_tables(
    "p3_fetch_stocks", "stocks_explained",
    "name LIKE '% bolt' AND currency_symbol LIKE 'C%' AND exchange_mic_code LIKE 'X_%' AND investment_type LIKE '%O%' "
    "AND access_plan LIKE '%r%'",
)
_from_tables(
    "p4_fetch_forex_pairs", "forex_pairs_explained",
    r"currency_group_name LIKE 'A%' AND base_currency_symbol LIKE 'C_1' AND quote_currency_name LIKE 'NATION\_1%' ESCAPE '\'",
)
_from_tables("p5_fetch_currencies", "currencies", r"symbol LIKE 'C1%' AND name LIKE '%N\_1%' ESCAPE '\'")
_from_tables("p6_fetch_currency_groups", "forex_currency_groups", "name LIKE 'A%'")
_from_tables("p6_fetch_timezones", "timezones", "name LIKE '%ST'")
_from_tables("p6_fetch_countries", "countries", "name LIKE '%N%_'")
_from_tables("p6_fetch_investment_types", "investment_types", "name LIKE '%M'")
_from_tables("p6_fetch_plans", "plans", "plan LIKE '%r%'")
ORACLE["f1_like_parts"] = """
SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE '%b__t%' AND p_type LIKE '%A%'"""

# --- series ----------------------------------------------------------------------------------------------------------
WORKLIST = """
worklist AS (
    SELECT c_custkey AS req_id,
           CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'P' || lpad(CAST(c_custkey AS VARCHAR), 10, '0')
                WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY')
                THEN 'C' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '/C'
                     || lpad(CAST((c_nationkey + 1) % 25 AS VARCHAR), 2, '0')
                ELSE c_name END AS symbol,
           CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'X1' END AS mic_code,
           CASE WHEN c_acctbal > 5000 THEN '1min' WHEN c_acctbal > 0 THEN '1day' ELSE '1h' END AS time_interval
    FROM customer)"""
ORACLE["p12_interval_guard"] = f"WITH {WORKLIST} SELECT * FROM worklist WHERE time_interval NOT IN ('1min', '1day')"
ORACLE["p13_resolve_series"] = f"""WITH {LISTS}, {WORKLIST},
flagged AS (
    SELECT *, symbol IN (SELECT symbol FROM equity_list) AS stock,
           symbol IN (SELECT upper(symbol) FROM forex_list) AS pair
    FROM worklist),
judged AS (
    SELECT *, CASE WHEN time_interval NOT IN ('1min', '1day') THEN 'bad_interval' WHEN stock = pair THEN 'uncertain'
                   WHEN stock AND mic_code IS NULL THEN 'mic_missing'
                   WHEN pair AND mic_code IS NOT NULL THEN 'mic_not_allowed' ELSE 'ok' END AS status
    FROM flagged)
SELECT req_id, symbol, mic_code, time_interval, status,
       CASE WHEN status = 'ok' THEN CASE WHEN stock THEN 'equity' ELSE 'forex' END END AS asset_class,
       CASE WHEN status = 'ok' THEN CASE WHEN stock THEN symbol || '_' || mic_code
            ELSE replace(symbol, '/', '_') || '_' || time_interval END END AS series_key
FROM judged"""
ORACLE["p14_series_exists"] = f"""WITH {bars('1day')}, {REQUESTS},
asked AS (
    SELECT req_id, CASE WHEN series_key IN ('signup', 'view') THEN 'forex' ELSE 'equity' END AS asset_class,
           CASE WHEN n IS NULL THEN '1day' ELSE '1h' END AS time_interval, series_key FROM requests)
SELECT *, EXISTS (SELECT 1 FROM bars b WHERE b.asset_class = a.asset_class AND b.time_interval = a.time_interval
                  AND b.series_key = a.series_key) AS registered
FROM asked a"""
ORACLE["j8_known_customers"] = """
SELECT o_orderkey, o_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) AS known FROM orders"""
ORACLE["j8_only_known"] = """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"""
ORACLE["j9_ambiguous_keys"] = """
SELECT p_name AS "key", count(*) AS "rows" FROM part GROUP BY 1 HAVING count(*) > 1"""
ORACLE["j10_constraint_audit"] = """
SELECT 'part' AS "table", 'unique' AS rule, 'p_name' AS "column", p_name AS "key", CAST(count(*) AS VARCHAR) AS detail
FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'customer', 'foreign_key', 'c_custkey', CAST(c_custkey AS VARCHAR), CAST(c_custkey AS VARCHAR)
FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'lineitem', 'foreign_key', 'l_orderkey', CAST(l_orderkey AS VARCHAR), CAST(l_orderkey AS VARCHAR)
FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'lineitem', 'foreign_key', 'l_partkey', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR)
FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL SELECT 'lineitem', 'foreign_key', 'l_suppkey', CAST(l_orderkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)
FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)
UNION ALL SELECT 'customer', 'not_null', 'c_mktsegment', CAST(c_custkey AS VARCHAR), NULL
FROM customer WHERE c_mktsegment IS NULL
UNION ALL SELECT 'customer', 'not_null', 'c_name', CAST(c_custkey AS VARCHAR), NULL FROM customer WHERE c_name IS NULL
UNION ALL SELECT 'customer', 'length', 'c_mktsegment', CAST(c_custkey AS VARCHAR), CAST(length(c_mktsegment) AS VARCHAR)
FROM customer WHERE length(c_mktsegment) > 8
UNION ALL SELECT 'customer', 'length', 'c_name', CAST(c_custkey AS VARCHAR), CAST(length(c_name) AS VARCHAR)
FROM customer WHERE length(c_name) > 18"""
ORACLE["j1_star_join"] = """
SELECT l_orderkey, l_linenumber, l_quantity, o_orderstatus AS order_status, p_name AS part_name,
       s_name AS supplier_name, n_name AS nation_name, r_name AS region_name
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey"""
ORACLE["j2_order_places"] = """
SELECT o_orderkey, o_totalprice, c_name AS customer_name, n_name AS nation_name, r_name AS region_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey"""
ORACLE["j3_trade_nations"] = """
SELECT l_orderkey, l_linenumber, b.n_name AS base_name, q.n_name AS quote_name
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation b ON c_nationkey = b.n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation q ON s_nationkey = q.n_nationkey"""

# --- candles ---------------------------------------------------------------------------------------------------------
ORACLE["w1_row_ids"] = f"WITH {candles('1min')} SELECT * FROM candles"
ORACLE["s16_scan_1day"] = f"WITH {candles('1day')} SELECT * FROM candles"
ORACLE["p1_candle_view"] = f"""WITH {candles('1min')}
SELECT *, open > close AS bearish, open < close AS bullish FROM candles"""
ORACLE["p11_latest_before"] = f"""WITH {candles('1day')}
SELECT *, open > close AS bearish, open < close AS bullish FROM candles WHERE datetime <= {MID}
QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY datetime DESC) <= 10"""
ORACLE["p8_point_lookup"] = f"""WITH {candles('1min')}, {PROBES}
SELECT req_id, p.series_key, date_trunc('minute', "at") AS "at",
       CASE WHEN "ID" IS NULL THEN 'not_present' ELSE 'ok' END AS status, "ID", open, close
FROM probes p LEFT JOIN candles c ON c.series_key = p.series_key AND c.datetime = date_trunc('minute', p."at")"""
ORACLE["p8_point_lookup_doubles"] = f"""WITH {PROBES},
points AS (SELECT event_type AS series_key, date_trunc('hour', ts) AS datetime, max(event_id) AS "ID", count(*) AS hits
           FROM events GROUP BY 1, 2)
SELECT req_id, p.series_key, date_trunc('hour', "at") AS "at",
       CASE WHEN hits IS NULL THEN 'not_present' WHEN hits = 1 THEN 'ok' ELSE 'uncertain' END AS status,
       CASE WHEN hits = 1 THEN "ID" END AS "ID"
FROM probes p LEFT JOIN points c ON c.series_key = p.series_key AND c.datetime = date_trunc('hour', p."at")"""
ORACLE["p9_by_id"] = f"""WITH {candles('1min')} SELECT * FROM candles WHERE "ID" = 5"""
ORACLE["p10_id_range"] = f"""WITH {candles('1min')} SELECT * FROM candles WHERE "ID" BETWEEN 10 AND 500"""
ORACLE["p10_id_range_requests"] = f"""WITH {candles('1min')}, {REQUESTS}
SELECT req_id, c.series_key, "ID", datetime, close
FROM requests r JOIN candles c ON c.series_key = r.series_key AND "ID" BETWEEN c_nationkey AND c_nationkey * 2"""


def _range_fetch(interval: str) -> str:
    return f"""WITH {candles(interval)}, {REQUESTS},
hits AS (
    SELECT req_id, c.series_key, "ID", datetime, open, close, high, low, n,
           row_number() OVER (PARTITION BY req_id ORDER BY datetime) AS up,
           row_number() OVER (PARTITION BY req_id ORDER BY datetime DESC) AS down, a, b
    FROM dated d JOIN candles c
      ON c.series_key = d.series_key AND (a IS NULL OR datetime >= a) AND (b IS NULL OR datetime <= b))
SELECT req_id, series_key, "ID", datetime, open, close, high, low FROM hits
WHERE n IS NULL OR (a IS NULL AND down <= n) OR (a IS NOT NULL AND up <= n)"""


ORACLE["p11_range_fetch"] = _range_fetch("1day")
ORACLE["p11_range_fetch_1min"] = _range_fetch("1min")
ORACLE["t3_last_n"] = f"""WITH {candles('1min')}
SELECT * FROM candles WHERE series_key = 'click' AND datetime <= {MID} ORDER BY datetime DESC LIMIT 25"""
ORACLE["t4_first_n"] = f"""WITH {candles('1min')}
SELECT * FROM candles WHERE series_key = 'click' AND datetime >= {MID} ORDER BY datetime LIMIT 25"""
ORACLE["p11_between"] = f"""WITH {candles('1min')}
SELECT * FROM candles WHERE series_key = 'click' AND datetime BETWEEN {MID} AND {MID} + INTERVAL '3 days'"""
ORACLE["c4_id_bracket"] = f"""WITH {candles('1day')}, {REQUESTS},
edges AS (
    SELECT req_id, d.series_key, any_value(a) AS a, any_value(b) AS b, any_value(n) AS n,
           min("ID") FILTER (WHERE datetime >= a) AS low, max("ID") FILTER (WHERE datetime <= b) AS high
    FROM dated d LEFT JOIN candles c ON c.series_key = d.series_key GROUP BY req_id, d.series_key),
judged AS (
    SELECT *, CASE WHEN (a IS NOT NULL AND low IS NULL) OR (b IS NOT NULL AND high IS NULL) THEN 'not_present'
                   ELSE 'ok' END AS status FROM edges)
SELECT req_id, series_key, status, CASE WHEN status = 'ok' THEN greatest(coalesce(low, high - n + 1), 0) END AS earliest_id,
       CASE WHEN status = 'ok' THEN coalesce(high, low + n - 1) END AS latest_id
FROM judged"""
ORACLE["j11_nearest_before"] = f"""WITH {candles('1min')}, {PROBES}
SELECT p.req_id, p.series_key, p."at", c."ID" AS nearest_id
FROM probes p ASOF LEFT JOIN candles c ON p.series_key = c.series_key AND p."at" >= c.datetime"""
ORACLE["j11_nearest_after"] = f"""WITH {candles('1min')}, {PROBES}
SELECT p.req_id, p.series_key, p."at", c."ID" AS nearest_id
FROM probes p ASOF LEFT JOIN candles c ON p.series_key = c.series_key AND p."at" <= c.datetime"""
ORACLE["p15_line_series"] = f"""WITH {candles('1min')} SELECT series_key, "ID" AS x, close AS y FROM candles"""

# --- per-series summaries ----------------------------------------------------------------------------------------------
ORACLE["a1_row_counts"] = f"""WITH {candles('1min')} SELECT series_key, count(*) AS "rows" FROM candles GROUP BY 1"""
ORACLE["a2_latest_timestamp"] = f"""WITH {candles('1min')}
SELECT series_key, arg_max(datetime, "ID") AS latest FROM candles GROUP BY 1"""
ORACLE["a3_last_id"] = f"""WITH {candles('1min')} SELECT series_key, max("ID") AS last_id FROM candles GROUP BY 1"""
ORACLE["a5_earliest_point"] = f"""WITH {candles('1min')}
SELECT series_key, min(datetime) AS datetime, CAST(epoch(min(datetime)) AS BIGINT) AS unix_time FROM candles GROUP BY 1"""
ORACLE["a6_latest_candle"] = f"""WITH {candles('1min')}
SELECT series_key, datetime, open, close, high, low, volume FROM candles
QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY datetime DESC) = 1"""

_OFFSET = "(CAST(max(high) - min(low) AS DOUBLE) * 0.1::DOUBLE)"
BOUNDS = f"""
bounds AS (
    SELECT series_key, max(high) AS top_price, min(low) AS bottom_price, max(volume) AS top_volume, count(*) AS n,
           CAST(min(low) AS DOUBLE) - 0.8::DOUBLE * {_OFFSET} AS chart_bottom,
           CAST(max(high) AS DOUBLE) + 1.6::DOUBLE * {_OFFSET} AS chart_top,
           CAST(floor(count(*) * 1.032::DOUBLE) AS BIGINT) + 1 AS x_bound,
           max(volume) * 1.35::DOUBLE AS volume_top, arg_max(close, "ID") AS last_close, arg_max(open, "ID") AS last_open
    FROM candles GROUP BY 1)"""


def _price_label(price: str) -> str:
    return f"""CASE WHEN asset_class = 'equity' THEN CAST(CAST(round_even({price}, 2) AS DECIMAL(12,2)) AS VARCHAR)
            ELSE CAST(CAST({price} AS DECIMAL(12,5)) AS VARCHAR) END"""


ORACLE["a7_extents"] = f"""WITH {candles('1min')}, {BOUNDS}
SELECT series_key, chart_bottom, chart_top, x_bound, volume_top FROM bounds"""
ORACLE["a8_last_price"] = f"""WITH {candles('1min')}, {BOUNDS}
SELECT DISTINCT asset_class, series_key, last_close,
       CASE WHEN last_close > last_open THEN 'bull' WHEN last_close < last_open THEN 'bear' ELSE 'neutral' END AS direction,
       {_price_label('last_close')} AS label
FROM candles JOIN bounds USING (series_key)"""

# --- chart -------------------------------------------------------------------------------------------------------------
_DAY_LIMITS = (10, 25, 44, 67, 94, 125, 160, 199, 242)
_MONTH_LIMITS = (20, 30, 43, 59, 78, 100, 125, 153, 184)


def marks(interval: str) -> str:
    """``marks``: row index, major break, exclusion zone and minor slot, all from windows over whole series."""
    day = interval == "1day"
    part = "month" if day else "day"
    limits = _MONTH_LIMITS if day else _DAY_LIMITS
    penalty = " ".join(f"WHEN n < {limit} THEN {i or 8}" for i, limit in enumerate(limits))
    step = " ".join(f"WHEN n < {40 * i} THEN {5 * i}" for i in range(1, 15)) + " WHEN n < 720 THEN 120"
    slot = (
        "isodow(datetime) = 1"
        if day
        else "floor(abs(epoch(datetime) - epoch(date_trunc('day', datetime)) - 48600) / 60) % step = 0"
    )
    return f"""
placed AS (
    SELECT *, count(*) OVER (PARTITION BY series_key) AS n, row_number() OVER w - 1 AS x,
           {part}(datetime) AS period, lag({part}(datetime)) OVER w AS before, lead({part}(datetime)) OVER w AS after
    FROM candles WINDOW w AS (PARTITION BY series_key ORDER BY datetime, "ID")),
broken AS (
    SELECT *, CASE WHEN n = 1 THEN false WHEN x = 0 THEN period = after ELSE period <> before END AS major,
           CASE {penalty} ELSE 8 END AS pen, CASE {step} ELSE 180 END AS step
    FROM placed),
zones AS (
    SELECT *, max(CASE WHEN major THEN x END) OVER (PARTITION BY series_key ORDER BY x) AS last_break,
           min(CASE WHEN major THEN x END) OVER (PARTITION BY series_key ORDER BY x
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_break,
           min(CASE WHEN major THEN x END) OVER (PARTITION BY series_key) AS first_break
    FROM broken),
excluding AS (
    SELECT *, n > 1 AND (coalesce(x - last_break <= pen, false) OR coalesce(next_break - x <= pen, false)
           OR coalesce(first_break - pen < 0 AND x - n >= first_break - pen, false)) AS excluded
    FROM zones),
marks AS (SELECT *, {slot} AND NOT excluded AS minor FROM excluding)"""


_DOJI = "(CAST(top_price - bottom_price AS DOUBLE) * 0.003::DOUBLE)"
GEOMETRY = f"""
CASE WHEN close > open THEN 'bull' WHEN close < open THEN 'bear' ELSE 'neutral' END AS candle_class,
CASE WHEN open = close THEN CAST(open AS DOUBLE) - {_DOJI} / 2 ELSE CAST(open AS DOUBLE) END AS body_bottom,
CASE WHEN open <> close AND abs(CAST(close - open AS DOUBLE)) > abs({_DOJI}) THEN CAST(close - open AS DOUBLE)
     ELSE {_DOJI} END AS body_height"""


def _chart_frame(interval: str) -> str:
    if interval == "1day":
        major = "CASE WHEN month(datetime) = 1 THEN CAST(year(datetime) AS VARCHAR) ELSE strftime(datetime, '%b') END"
        minor = "CAST(day(datetime) AS VARCHAR)"
    else:
        major, minor = "strftime(datetime, '%a')", "strftime(datetime, '%H:%M')"
    volume = " ".join(
        f"WHEN top_volume > {cut} THEN CAST(volume // {unit} AS VARCHAR) || '.0{suffix}'"
        for cut, unit, suffix in ((2_000_000_000, 10**9, "B"), (2_000_000, 10**6, "M"), (2_000, 1000, "k"))
    )
    return f"""WITH {candles(interval)}, {BOUNDS}, {marks(interval)}
SELECT asset_class, series_key, "ID", datetime, x, open, close, high, low, volume, major, minor,
       CASE WHEN major THEN {major} WHEN minor THEN {minor} ELSE '' END AS label, {GEOMETRY},
       CASE WHEN open < close THEN 'bull' WHEN open > close THEN 'bear' END AS bar_class,
       CASE {volume} ELSE CAST(volume AS VARCHAR) END AS volume_label,
       {_price_label('last_close')} AS last_price_label, chart_bottom, chart_top, x_bound, volume_top
FROM marks JOIN bounds USING (series_key)"""


for _interval in ("1min", "1day"):
    ORACLE[f"w2_time_splits_{_interval}"] = f"""WITH {candles(_interval)}, {marks(_interval)}
SELECT series_key, "ID", datetime, x, major, excluded, minor FROM marks"""
    ORACLE[f"c5_chart_frame_{_interval}"] = _chart_frame(_interval)
ORACLE["f15_body_geometry"] = f"""WITH {candles('1min')}, {BOUNDS}
SELECT series_key, "ID", datetime, {GEOMETRY}, low AS wick_low, high AS wick_high
FROM candles JOIN bounds USING (series_key)"""

# --- ledger --------------------------------------------------------------------------------------------------------------
TRADES = """
trades AS (
    SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS trade_no,
           value > 15 AS win
    FROM events)"""
_AMOUNT = "DECIMAL(24,4)"


def _balances(source: str, bet: int, stake: str) -> str:
    won, lost = f"{bet} * 2.3 - 1.74", f"-{bet} - 1.74"
    return f"""
summed AS (
    SELECT *, CAST(800 + sum(CAST({stake} * CASE WHEN win THEN {won} ELSE {lost} END AS {_AMOUNT}))
           OVER (PARTITION BY run_id ORDER BY trade_no ROWS UNBOUNDED PRECEDING) AS {_AMOUNT}) AS balance
    FROM {source}),
balances AS (
    SELECT *, least(CAST(800 AS {_AMOUNT}), min(balance) OVER (PARTITION BY run_id ORDER BY trade_no
           ROWS UNBOUNDED PRECEDING)) AS lowest
    FROM summed)"""


FLAT = f"{TRADES}, {_balances('trades', 10, '1')}"
STREAK = f"""{TRADES},
streaks AS (
    SELECT *, trade_no - 1 - coalesce(max(CASE WHEN NOT win THEN trade_no END) OVER (PARTITION BY run_id ORDER BY trade_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS streak
    FROM trades),
staked AS (
    SELECT run_id, trade_no, win, CASE WHEN streak <= 3 THEN streak + 1 ELSE 1 END AS stake FROM streaks),
{_balances('staked', 8, 'stake')}"""
RESULTS = f"""
results AS (
    SELECT run_id, arg_max(balance, trade_no) AS end_balance, min(lowest) AS drawdown FROM balances GROUP BY 1)"""
SUMMARY = """
SELECT count(*) AS runs, avg(CAST(end_balance > 800 AS INTEGER)) AS profitability,
       avg(CAST(drawdown > -550 AS INTEGER)) AS chance_600, avg(CAST(drawdown > -950 AS INTEGER)) AS chance_1000,
       min(drawdown) AS minimum_drawdown, max(end_balance) AS maximum_end_balance,
       CAST(sum(end_balance) AS DOUBLE) / count(*) AS expectancy,
       CAST(sum(end_balance) AS DOUBLE) / count(*) / 800 AS interest_rate
FROM results"""
ORACLE["w5_running_balance"] = f"WITH {FLAT} SELECT run_id, trade_no, win, balance, lowest FROM balances"
ORACLE["w6_streak_balance"] = f"WITH {STREAK} SELECT run_id, trade_no, win, stake, balance, lowest FROM balances"
ORACLE["w8_run_results"] = f"""WITH {FLAT}, {RESULTS}
SELECT *, end_balance > 800 AS made_money, drawdown > -550 AS safe_for_600, drawdown > -950 AS safe_for_1000 FROM results"""
ORACLE["a9_flat_summary"] = f"WITH {FLAT}, {RESULTS} {SUMMARY}"
ORACLE["a9_streak_summary"] = f"WITH {STREAK}, {RESULTS} {SUMMARY}"

# --- expressions ---------------------------------------------------------------------------------------------------------
ORACLE["f3_pair_parts"] = f"""WITH {LISTS}
SELECT symbol, upper(split_part(symbol, '/', 1)) AS base, upper(split_part(symbol, '/', 2)) AS quote,
       contains(symbol, '/') AS is_pair, replace(upper(symbol), '/', '_') || '_1min' AS series_key
FROM forex_list"""
ORACLE["f5_known_country"] = f"""WITH {LISTS}
SELECT code, CASE WHEN country = '' THEN 'Unknown' ELSE country END AS country, name || '_' || code AS series_key
FROM exchange_list"""
ORACLE["f6_timeframe_name"] = """
SELECT o_orderkey, month(o_orderdate) || CASE o_orderstatus WHEN 'F' THEN ' minute' WHEN 'O' THEN ' hour'
       ELSE ' week' END AS timeframe
FROM orders"""
ORACLE["f8_volume_label"] = """
SELECT l_orderkey, l_linenumber, volume,
       CASE WHEN volume > 3000000000 THEN CAST(volume // 1000000000 AS VARCHAR) || '.0B'
            WHEN volume > 3000000 THEN CAST(volume // 1000000 AS VARCHAR) || '.0M'
            WHEN volume > 4000 THEN CAST(volume // 1000 AS VARCHAR) || '.0k' ELSE CAST(volume AS VARCHAR) END AS label
FROM (SELECT *, CAST(floor(l_extendedprice * l_quantity) AS BIGINT) AS volume FROM lineitem)"""
ORACLE["f11_session_clamp"] = """
SELECT event_id, CASE WHEN inside THEN ts ELSE first END AS start, CASE WHEN inside THEN ts ELSE last END AS "end"
FROM (SELECT *, ts BETWEEN first AND last AS inside
      FROM (SELECT *, date_trunc('day', ts) + INTERVAL '9 hours 30 minutes' AS first,
                   date_trunc('day', ts) + INTERVAL '15 hours 59 minutes' AS last FROM events))"""
ORACLE["f12_calendar"] = """
SELECT event_id, date_trunc('month', ts) AS month_start, date_trunc('day', ts) AS day_start,
       date_trunc('day', ts) + INTERVAL '1 day' AS next_day, CAST(isodow(ts) AS INTEGER) AS iso_weekday,
       CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
       CAST(floor(epoch(ts)) AS BIGINT) AS unix_time
FROM events"""
ORACLE["f14_page_estimate"] = f"""
SELECT o_orderkey, CAST(ceil(days * per_day / 4999::DOUBLE) AS BIGINT) + 1 AS pages
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 1440 ELSE 390 END AS per_day,
             (CAST(floor(date_diff('second', o_orderdate, {MID}) / 86400) AS BIGINT) + 1) * 0.76::DOUBLE AS days
      FROM orders)"""
ORACLE["f17_json_fields"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"

# --- landed pages and the archive -------------------------------------------------------------------------------------------
NAMED = """
named AS (
    SELECT *, CASE series_key WHEN 'signup' THEN 'sig/nup' WHEN 'view' THEN 'vie/w' ELSE series_key END AS symbol,
           CASE series_key WHEN 'signup' THEN 'SIG_NUP_' || time_interval WHEN 'view' THEN 'VIE_W_' || time_interval
                ELSE series_key || '_XNGS' END AS stored_key
    FROM {source})"""
_ROW = "asset_class, time_interval, stored_key AS series_key, datetime, open, close, high, low, volume"


def _landed(interval: str) -> str:
    return f"WITH {bars(interval)}, {NAMED.format(source='bars')}"


ORACLE["s5_candle_page"] = f"""{_landed('1min')} SELECT {_ROW} FROM named
WHERE symbol = 'click' AND datetime <= {MID} ORDER BY datetime DESC LIMIT 5000"""
ORACLE["s5_candle_page_pair"] = f"""{_landed('1min')} SELECT {_ROW} FROM named
WHERE symbol = 'vie/w' AND datetime >= {MID} ORDER BY datetime DESC LIMIT 5000"""
ORACLE["s6_candle_csv"] = f"""WITH {bars('1min')}
SELECT series_key, time_interval, datetime, open, close, high, low, volume FROM bars"""
ORACLE["s8_page_stitch"] = f"{_landed('1min')} SELECT {_ROW} FROM named"
ORACLE["s8_page_stitch_1day"] = f"{_landed('1day')} SELECT {_ROW} FROM named"
ORACLE["f18_page_edges"] = f"""{_landed('1min')},
days AS (SELECT symbol, date_trunc('day', datetime) AS day, min(datetime) AS first, max(datetime) AS last, count(*) AS n
         FROM named GROUP BY 1, 2),
linked AS (SELECT *, lead(first) OVER (PARTITION BY symbol ORDER BY day) AS next FROM days)
SELECT symbol, strftime(coalesce(next, last), '%Y-%m-%d %H:%M:%S') AS newest,
       strftime(first, '%Y-%m-%d %H:%M:%S') AS oldest, CAST(n - CASE WHEN next IS NULL THEN 1 ELSE 0 END AS INTEGER) AS further
FROM linked"""
ORACLE["s18_usage_report"] = """
SELECT o_orderpriority AS key_name, date_trunc('day', o_orderdate) + INTERVAL '9 hours 37 minutes' AS "timestamp",
       CAST(month(o_orderdate) AS INTEGER) AS current_usage,
       CAST(month(o_orderdate) + day(o_orderdate) AS INTEGER) AS plan_limit,
       CAST(800 - dayofyear(o_orderdate) AS INTEGER) AS daily_usage, 800 AS plan_daily_limit
FROM orders"""
ORACLE["s11_append"] = ORACLE["w1_row_ids"]
ORACLE["s12_register"] = f"WITH {bars('1day')} SELECT DISTINCT asset_class, time_interval, series_key FROM bars"
ORACLE["s13_drop_series"] = f"WITH {candles('1day')} SELECT * FROM candles WHERE series_key <> 'click'"
ORACLE["s14_delete_row"] = f"""WITH {candles('1day')}
SELECT * FROM candles WHERE NOT (series_key = 'error' AND "ID" = 3)"""
ORACLE["s16_scan_dates"] = f"""WITH {candles('1day')}
SELECT * FROM candles WHERE series_key = 'purchase' AND datetime BETWEEN TIMESTAMP '2024-01-10' AND {MID}"""
ORACLE["j12_unseen"] = f"WITH {bars('1min')} SELECT * FROM bars WHERE datetime > {MID}"
for _name in ("c2_save_series", "c3_update_series", "r1_stream_ingest"):
    ORACLE[_name] = f"""WITH {candles('1day')}, {NAMED.format(source='candles')}
SELECT "ID", {_ROW} FROM named"""
