"""Registered queries against their SQL on the smallest tables; tools/check_oracle.py runs all of them at any size."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from barvault.plans import oracle, registered
from tools.check_oracle import SAME_TYPE, TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"
CHECKED = (
    "p1_candle_view p8_point_lookup_doubles p10_id_range_requests p11_range_fetch p11_latest_before p13_resolve_series "
    "c4_id_bracket j4_tracked_indexes j8_known_customers j10_constraint_audit j11_nearest_after j1_star_join "
    "a6_latest_candle a9_streak_summary c5_chart_frame_1min c5_chart_frame_1day f14_page_estimate s7_error_envelope "
    "s8_page_stitch r1_lagging_series s5_quarantined_load s5_stored_rejects s8_page_chains s14_folded_deletes a1_kept_totals "
    "a1_kept_summaries"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_of_the_warehouse_has_sql():
    assert set(registered.REGISTERED) == set(oracle.ORACLE) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, db, name):
    df = queries()[name](spark, SF_DIR)
    found = db.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    types = {d[0]: str(d[1]).replace(" ", "") for d in found.description}
    assert sorted(df.columns) == sorted(names)
    assert {c: SAME_TYPE.get(t, t.upper()) for c, t in df.dtypes} == types
    rows = rows_of(df.collect(), df.columns)
    assert rows and rows == rows_of(found.fetchall(), names)


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 50 and rows == sorted(rows, key=lambda r: (r.series_key, r.ID))
