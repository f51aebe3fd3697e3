"""Registered queries against their SQL text on the smallest data set.

A sample of every family runs by default; TIDEPANEL_ALL_QUERIES=1 runs all of them.
"""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import comparable, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "a01_bars", "a03_coverage_audit", "b05_completed_day", "c03_point_in_time", "c05_membership_coverage",
    "d04_leave_one_out", "d06_winsorised", "e04_volume_and_rank_wide", "e10_limit_streaks", "e12_pairwise_correlation",
    "e15_herding_index", "e16_rolling_beta", "g02_walk_forward_windows", "i02_rank_ic_strict", "i06_top_n_portfolio",
    "i19_block_bootstrap", "j01_data_issues", "j04_stability_index", "k01_one_feature_linear", "k09_rolling_ensemble",
    "l04_optimised_weights", "l06_price_limit_execution", "l07_policy_history", "m04_average_costs", "m04_cash_ledger",
]
NAMES = sorted(oracle_sql()) if os.environ.get("TIDEPANEL_ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test data is not mounted")


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, database, name):
    got = queries()[name](spark, FOLDER).toPandas()
    want = database.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


def test_every_sql_text_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship_runs(spark):
    assert entry(spark).limit(1).count() == 1
