from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.helpers import days, predictions
from tidepanel.operators import labels as la
from tidepanel.operators import splits
from tidepanel.operators import universe as un


def _dates(spark, count):
    return spark.createDataFrame([(d,) for d in days(count)], "date date")


def test_windows_keep_the_purge_gap(spark):
    windows = splits.walk_forward_windows(_dates(spark, 30), 3, 1, 1, 5, 2).toPandas()
    assert windows["window_id"].nunique() == (30 - 15) // 2 + 1
    for _, window in windows.groupby("window_id"):
        train = window.loc[window["role"] == "train", "date_idx"]
        validation = window.loc[window["role"] == "validation", "date_idx"]
        test = window.loc[window["role"] == "test", "date_idx"]
        assert validation.min() - train.max() == 6 and test.min() - validation.max() == 6


def test_too_few_dates_give_no_window(spark):
    assert splits.walk_forward_windows(_dates(spark, 14)).count() == 0


def test_expanding_cutoff_lies_a_horizon_earlier(spark):
    signals = splits.expanding_signals(_dates(spark, 60), horizon=10, minimum_dates=20, step=7).toPandas()
    assert (signals["signal_idx"] - signals["cutoff_idx"] == 10).all()
    assert signals["signal_idx"].min() == 29 and set(signals["signal_idx"].diff().dropna()) == {7}


def test_usable_signals_need_complete_dates(spark):
    rows = [(d, t, None if (i == 30 and t == "A") else 0.1) for i, d in enumerate(days(40)) for t in "AB"]
    dataset = spark.createDataFrame(rows, "date date, ticker string, target double")
    signals = splits.expanding_signals(dataset, horizon=5, minimum_dates=16, step=10)
    kept = [r["signal_idx"] for r in splits.usable_signals(signals, dataset, 16).orderBy("signal_idx").collect()]
    assert kept == [20]


def test_pending_signals_resume(spark):
    signals = splits.expanding_signals(_dates(spark, 60), 10, 20, 7).withColumn("model_name", F.lit("m"))
    done = signals.limit(2).select(F.col("signal_date").alias("date"), "model_name")
    assert splits.pending_signals(signals, done).count() == signals.count() - 2


def test_features_exclude_labels_and_empty_columns(spark):
    frame = spark.createDataFrame(
        [(days(1)[0], "A", 1.0, 2.0, None, 0.1)],
        "date date, ticker string, close double, good double, empty double, target double",
    )
    assert splits.feature_columns(frame) == ["good"]
    with pytest.raises(ValueError, match="target"):
        splits.check_features(["good", "target"])
    with pytest.raises(ValueError, match="ticker"):
        splits.check_score_columns(["ticker"])


def test_ablation_sets_drop_their_group():
    columns = ["return_1d", "rolling_vol_20d", "drawdown", "volume_z_20"]
    sets = splits.ablation_feature_sets(columns)
    assert sets["all_features"] == columns
    assert sets["without_risk"] == ["return_1d", "volume_z_20"]
    assert {name: len(group) for name, group in splits.ABLATION_GROUPS.items()} == {
        "all_features": 0, "without_volume_liquidity": 11, "without_price_limit": 15, "without_herding": 10, "without_risk": 2,
    }


def test_window_rows_skip_unknown_labels(spark):
    rows = spark.createDataFrame(predictions(20, 3)).withColumn(
        "target", F.when(F.col("ticker") != "T00", F.col("actual_return"))
    )
    windows = splits.walk_forward_windows(rows)
    joined = splits.window_rows(rows, windows, ["train"], label="target")
    assert joined.where("ticker = 'T00'").count() == 0
    assert joined.select("role").distinct().collect()[0]["role"] == "train"


def test_top_quintile_takes_at_least_one(spark):
    rows = spark.createDataFrame(
        [(days(1)[0], t, v) for t, v in (("A", 0.3), ("B", 0.3), ("C", None), ("D", -0.1))],
        "date date, ticker string, target double",
    )
    got = {r["ticker"]: r["top_quintile_label"] for r in la.top_quintile_label(rows, "target").collect()}
    assert got == {"A": 1, "B": 0, "C": None, "D": 0}


def _members(spark, rows):
    return un.normalise_membership(
        spark.createDataFrame(rows, "ticker string, effective_from string, effective_to string")
    )


def test_membership_is_inclusive_and_open_ended(spark):
    members = _members(spark, [(" a ", "2020-01-02", "2020-01-03"), ("B", "2020-01-03", "")])
    market = spark.createDataFrame([(d, t) for d in days(4) for t in "AB"], "date date, ticker string")
    kept = sorted((r["date"].day, r["ticker"]) for r in un.point_in_time(market, members).collect())
    assert kept == [(2, "A"), (3, "A"), (3, "B"), (6, "B")]
    coverage = un.membership_coverage(members, market, 2).orderBy("date").toPandas()
    assert coverage["active_constituents"].tolist() == [0, 1, 2, 1]
    assert coverage["coverage_complete"].tolist() == [False, False, True, False]


@pytest.mark.parametrize(
    ("rows", "problem"),
    [
        ([("A", "2020-01-01", ""), ("A", "2020-06-01", "")], "overlap"),
        ([("A", "2020-01-01", "2020-02-01"), ("A", "2020-02-01", "")], "overlap"),
        ([("A", "2020-02-01", "2020-01-01")], "reversed_range"),
        ([(" ", "2020-02-01", "")], "blank_ticker"),
    ],
)
def test_membership_problems(spark, rows, problem):
    assert [r["problem"] for r in un.membership_problems(_members(spark, rows)).collect()] == [problem]


def test_overlapping_intervals_count_a_ticker_once(spark):
    members = _members(spark, [("A", "2020-01-01", "2020-01-10"), ("A", "2020-01-05", "2020-01-06")])
    dates = spark.createDataFrame([(dt.date(2020, 1, 6),), (dt.date(2020, 1, 9),)], "date date")
    got = un.membership_coverage(members, dates, 1).toPandas()
    assert got["active_constituents"].tolist() == [1, 1]


def test_holdout_split_marks_periods(spark):
    rows = spark.createDataFrame([(d,) for d in days(4)], "date date")
    got = splits.with_period(rows, "2020-01-03").orderBy("date").toPandas()["period"].tolist()
    assert got == ["training", "training", "holdout", "holdout"]
