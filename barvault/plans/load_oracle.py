"""SQL of the queries in ``load_queries``."""

from __future__ import annotations

from barvault.plans.oracle import _ROW, BOUNDS, MID, NAMED, ORACLE, _landed, _price_label, bars, candles

__all__ = ["ORACLE"]

_DAMAGED = f"""{_landed('1min')},
raw AS (
    SELECT *, minute(datetime) AS m, CASE WHEN day(datetime) = 10 THEN '1h' ELSE '1min' END AS i FROM named
),
keyed AS (
    SELECT *, CASE WHEN asset_class = 'forex' THEN replace(upper(symbol), '/', '_') || '_' || i ELSE stored_key END AS k FROM raw
)"""

_REJECTS = f"""{_DAMAGED}
SELECT i AS time_interval, k AS series_key, field, value, problem, count(*) AS n FROM (
    SELECT i, k, 'interval' AS field, '1h' AS value, 'not_allowed' AS problem FROM keyed WHERE i = '1h'
    UNION ALL SELECT i, k, 'datetime', 'soon', 'malformed' FROM keyed WHERE m = 13
    UNION ALL SELECT i, k, 'open', 'n/a', 'malformed' FROM keyed WHERE m = 7
    UNION ALL SELECT i, k, 'close', '600000.0', 'out_of_range' FROM keyed WHERE m = 11
    UNION ALL SELECT i, k, 'high', NULL, 'missing' FROM keyed WHERE m = 19
    UNION ALL SELECT i, k, 'volume', '12.5', 'malformed' FROM keyed WHERE m = 17 AND asset_class = 'equity'
) GROUP BY ALL"""

_TOTALS = """
SELECT asset_class, time_interval, series_key, count(*) AS rows, min("ID") AS first_id, max("ID") AS last_id,
       min(datetime) AS earliest, arg_max(datetime, "ID") AS latest, max(high) AS high, min(low) AS low,
       max(volume) AS volume, arg_max(open, "ID") AS last_open, arg_max(close, "ID") AS last_close
FROM kept GROUP BY 1, 2, 3"""

ORACLE |= {
    "s5_page_rejects": _REJECTS,
    "s5_stored_rejects": _REJECTS,
    "s5_quarantined_load": f"""{_DAMAGED}
SELECT asset_class, time_interval, k AS series_key, row_number() OVER (PARTITION BY k ORDER BY datetime) - 1 AS "ID",
       datetime, open, close, high, low, volume
FROM keyed WHERE i = '1min' AND m NOT IN (7, 11, 13, 19) AND NOT (m = 17 AND asset_class = 'equity')""",
    "s6_csv_rejects": f"""WITH {bars('1min')}
SELECT CASE hour(datetime) WHEN 5 THEN '5min' ELSE '1min' END AS time_interval, series_key,
       CASE hour(datetime) WHEN 5 THEN 'interval' WHEN 7 THEN 'high' ELSE 'low' END AS field,
       CASE hour(datetime) WHEN 5 THEN '5min' WHEN 7 THEN '1e9' ELSE '?' END AS value,
       CASE hour(datetime) WHEN 5 THEN 'not_allowed' WHEN 7 THEN 'out_of_range' ELSE 'malformed' END AS problem,
       count(*) AS n
FROM bars WHERE hour(datetime) IN (5, 7, 11) GROUP BY ALL""",
    "s8_page_chains": f"""{_landed('1min')},
days AS (
    SELECT asset_class, time_interval, stored_key AS series_key, date_trunc('day', datetime) AS day,
           min(datetime) AS first, max(datetime) AS last, count(*) AS n
    FROM named GROUP BY 1, 2, 3, 4
),
pages AS (
    SELECT *, coalesce(lead(first) OVER w, last) AS newest, n + CASE WHEN lead(first) OVER w IS NULL THEN 0 ELSE 1 END AS held
    FROM days WINDOW w AS (PARTITION BY series_key ORDER BY day)
),
chains AS (
    SELECT asset_class, time_interval, series_key, max(newest) AS newest, min(first) AS oldest, count(*) AS pages,
           CAST(sum(held) - count(*) + 1 AS BIGINT) AS candles
    FROM pages WHERE day NOT IN (DATE '2024-01-10', DATE '2024-01-20')
    GROUP BY 1, 2, 3, CASE WHEN day < DATE '2024-01-10' THEN 0 WHEN day < DATE '2024-01-20' THEN 1 ELSE 2 END
),
older AS (SELECT *, lead(newest) OVER (PARTITION BY series_key ORDER BY newest DESC) AS back FROM chains)
SELECT asset_class, time_interval, series_key, newest, oldest, pages, candles,
       CASE WHEN back IS NULL THEN 'complete' ELSE 'gap' END AS status,
       CASE WHEN back IS NOT NULL THEN oldest END AS gap_from, back AS gap_to
FROM older""",
    "s8_conflicting_copies": f"{_landed('1min')} SELECT {_ROW} FROM named",
    "s11_as_of_version": f"WITH {candles('1day')} SELECT * FROM candles WHERE datetime <= {MID}",
    "p9_archive_by_id": f"""WITH {candles('1day')} SELECT * FROM candles WHERE series_key = 'error' AND "ID" = 3""",
    "p10_archive_ids": f"""WITH {candles('1day')}
SELECT * FROM candles WHERE series_key = 'error' AND "ID" BETWEEN 5 AND 12""",
    "s14_folded_deletes": f"""WITH {candles('1day')}
SELECT * FROM candles WHERE series_key <> 'click' AND NOT (series_key = 'error' AND "ID" = 3)
    AND NOT (series_key = 'purchase' AND "ID" = 0)""",
    "a1_kept_totals": f"""WITH {candles('1min')},
kept AS (SELECT * FROM candles WHERE NOT (series_key = 'error' AND "ID" = 3)) {_TOTALS}""",
    "a1_kept_summaries": f"""WITH {candles('1day')},
kept AS (
    SELECT * FROM candles WHERE NOT (series_key = 'error' AND "ID" = 3)
        AND NOT (series_key = 'purchase' AND "ID" = (SELECT max("ID") FROM candles WHERE series_key = 'purchase'))
),
{BOUNDS.replace('FROM candles', 'FROM kept')},
newest AS (
    SELECT *, datetime AS latest_time FROM kept QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY datetime DESC) = 1
),
spans AS (
    SELECT series_key, count(*) AS "rows", arg_max(datetime, "ID") AS latest, max("ID") AS last_id, min(datetime) AS first
    FROM kept GROUP BY 1
)
SELECT series_key, latest_time, open, close, high, low, volume, "rows", latest, last_id, first AS datetime,
       CAST(epoch(first) AS BIGINT) AS unix_time, asset_class, last_close,
       CASE WHEN last_close > last_open THEN 'bull' WHEN last_close < last_open THEN 'bear' ELSE 'neutral' END AS direction,
       {_price_label('last_close')} AS label, chart_bottom, chart_top, x_bound, volume_top
FROM newest JOIN spans USING (series_key) JOIN bounds USING (series_key)""",
    "r1_lagging_series": f"""WITH {bars('1day')}, {NAMED.format(source='bars')},
told AS (
    SELECT *, series_key = 'signup' AND datetime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-08' AS late FROM named
)
SELECT asset_class, time_interval, stored_key AS series_key,
       CASE WHEN NOT late THEN row_number() OVER (PARTITION BY stored_key, late ORDER BY datetime) - 1 END AS "ID",
       datetime, close, CASE WHEN late THEN 'late' ELSE 'stored' END AS status
FROM told""",
}
