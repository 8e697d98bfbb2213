"""Registered queries against their SQL twins on the smallest tables (tools/check.py runs all of them)."""

import pathlib
import sys

import duckdb
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))
import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

DIR = "/root/testdata/sf0.001"
NAMES = [
    "daily_zscore_ranking", "bars_weekly_by_supplier", "exponential_indicators", "structure_flags", "technical_panel",
    "fundamental_scores", "news_per_symbol", "hour_rule_record", "first_touch_results", "event_study", "walk_forward_stop",
    "tick_bars", "live_bias", "freshness_audit", "rolling_percentile_rank",
]


@pytest.mark.skipif(not pathlib.Path(DIR).exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(cols, cur.fetchall())


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
