"""Registered queries against their DuckDB checks on the smallest tables.

A cross-section runs by default; QUOTEMILL_ALL_QUERIES=1 runs every query.
"""

import os

import duckdb
import pytest

from quotemill.plans.catalog import CHECKS, QUERIES
from tests.conftest import SMALL

SAMPLE = (
    "src1_context_bars", "src4_full_bars", "src6_line_bars", "src6_event_bars", "rel5_last_arrival", "ctx2_ratios",
    "win8_weighted_mean", "fn7_null_handling", "ind7_context_rsi", "ind26_hurst", "ind30_all_indicators",
    "sigd_all_rules_long", "pos1_timed_positions", "pos2_open_positions", "pos3_open_positions_proxy", "met3_treynor",
    "met11_run_summary", "swp1_holding_sweep", "swp3_sell_threshold_sweep", "brd1_latest_scan", "brd2_alerts",
    "str1_stream_bars", "str3_stream_monitor",
)
NAMES = sorted(QUERIES) if os.environ.get("QUOTEMILL_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted(zip(*[table.column(n).to_pylist() for n in names]), key=lambda r: [(v is not None, str(v)) for v in r])


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, database, name):
    got = QUERIES[name](spark, SMALL).toArrow()
    want = database.sql(CHECKS[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
    assert got.num_rows > 0
