from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import days, predictions
from tidepanel.operators import metrics as me
from tidepanel.operators import selection as se
from tidepanel.operators.models import rank_probabilities
from tidepanel.sources.tables import harmonise_predictions


def test_rank_ic_matches_pandas(spark):
    frame = predictions(6, 12)
    frame["predicted_return"] = frame["predicted_return"].round(2)
    got = me.rank_ic_by_date(spark.createDataFrame(frame), by=["model_name"]).toPandas()
    for row in got.itertuples():
        day = frame[(frame["model_name"] == row.model_name) & (frame["date"] == row.date)]
        want = day["predicted_return"].rank().corr(day["actual_return"].rank())
        assert row.rank_ic == pytest.approx(want) and row.stock_count == 12


def test_lenient_and_strict_rank_ic(spark):
    d = days(3)
    rows = [(d[0], "A", 0.1, 0.2), (d[0], "B", 0.1, 0.3), (d[1], "A", 0.1, 0.2), (d[2], "A", 0.1, 0.1), (d[2], "B", 0.2, 0.4)]
    frame = spark.createDataFrame(rows, "date date, ticker string, predicted_return double, actual_return double")
    lenient = {r["date"]: r["rank_ic"] for r in me.rank_ic_by_date(frame).collect()}
    assert lenient[d[0]] is None and lenient[d[1]] is None and lenient[d[2]] == pytest.approx(1.0)
    assert [r["date"] for r in me.rank_ic_by_date(frame, strict=True).collect()] == [d[2]]


def test_selection_turnover(spark):
    d = days(4)
    picks = {d[0]: "AB", d[1]: "AC", d[2]: "", d[3]: "ABC"}
    rows = [(date, t, t in names) for date, names in picks.items() for t in "ABC"]
    got = se.selection_turnover(spark.createDataFrame(rows, "date date, ticker string, selected boolean")).orderBy("date").toPandas()
    assert got["selected_count"].tolist() == [2, 2, 0, 3]
    np.testing.assert_allclose(got["turnover"].astype(float), [np.nan, 1.0, 1.0, 1.0])


def test_top_n_ties_go_to_the_smaller_ticker(spark):
    d = days(1)[0]
    rows = [(d, t, 0.5, r) for t, r in (("C", 0.1), ("A", -0.2), ("B", 0.3))]
    frame = spark.createDataFrame(rows, "date date, ticker string, predicted_return double, actual_return double")
    row = me.top_n_outcome(frame, n=2).first()
    assert row["hit_rate"] == 0.5 and row["average_selected_return"] == pytest.approx(0.05)
    spread = me.top_bottom_spread(frame, n=1).first()
    assert spread["top_minus_bottom_spread"] == pytest.approx(0.0)


def test_model_summary_matches_by_hand(spark):
    frame = predictions(15, 9)
    got = me.model_summary(spark.createDataFrame(frame), n=3).toPandas().set_index("model_name")
    for model, rows in frame.groupby("model_name"):
        previous, returns, ics = None, [], []
        for _, day in rows.groupby("date"):
            best = day.sort_values(["predicted_return", "ticker"], ascending=[False, True]).head(3)
            names = set(best["ticker"])
            moved = 0.0 if previous is None else len(names ^ previous) / 3
            returns.append(best["actual_return"].mean() - 0.001 * moved)
            ics.append(day["predicted_return"].rank().corr(day["actual_return"].rank()))
            previous = names
        series = pd.Series(returns)
        nav = (1 + series).cumprod()
        assert got.loc[model, "average_after_cost_return"] == pytest.approx(series.mean())
        assert got.loc[model, "sharpe_ratio"] == pytest.approx(series.mean() / series.std() * np.sqrt(252))
        assert got.loc[model, "max_drawdown"] == pytest.approx((nav / nav.cummax() - 1).min())
        assert got.loc[model, "average_rank_ic"] == pytest.approx(np.mean(ics))


def test_drawdown_peak_may_start_at_the_initial_capital(spark):
    rows = spark.createDataFrame([(days(1)[0], -0.1), (days(2)[1], 0.05)], "date date, r double")
    plain = [r["drawdown"] for r in me.with_compounded_drawdown(rows, "r").orderBy("date").collect()]
    floored = [r["drawdown"] for r in me.with_compounded_drawdown(rows, "r", floor_peak=1.0).orderBy("date").collect()]
    assert plain[0] == 0.0 and floored[0] == pytest.approx(-0.1)


def test_flat_series_has_no_sharpe(spark):
    rows = spark.createDataFrame([("a", 0.1), ("a", 0.1)], "s string, r double")
    row = rows.groupBy("s").agg(me.sharpe_of("r").alias("x"), me.diagnostic_sharpe("r").alias("y")).first()
    assert row["x"] is None and row["y"] is None


def test_classification_counts(spark):
    d = days(1)[0]
    rows = [(d, "A", 0.9, 1, 0.1), (d, "B", 0.8, 0, -0.1), (d, "C", 0.1, 1, 0.2)]
    frame = spark.createDataFrame(rows, "date date, ticker string, predicted_probability double, actual_label int, actual_return double")
    row = me.classification_by_date(rank_probabilities(frame, 2), selected="selected_top_2").first()
    assert (row["precision"], row["recall"], row["selected_count"]) == (0.5, 0.5, 2)


def test_missing_score_column_gives_null(spark):
    frame = spark.createDataFrame([(days(1)[0], "A", 0.1)], "date date, ticker string, return_10d double")
    row = se.add_portfolio_scores(frame).first()
    assert row["momentum_score"] == 0.1 and row["low_volatility_score"] is None and row["equal_score"] == 0.0


def test_training_choice_ignores_the_holdout(spark):
    rows = [("good_later", "training", 0.1), ("good_later", "holdout", 9.0), ("good_first", "training", 0.2), ("good_first", "holdout", -9.0), ("none", "training", None)]
    frame = spark.createDataFrame(rows, "policy_name string, period string, diagnostic_sharpe double")
    assert me.best_training_candidate(frame).first()["policy_name"] == "good_first"


def test_harmonise_prefers_the_first_candidate(spark):
    frame = spark.createDataFrame([(days(1)[0], "A", 0.1, 0.9, 0.3)], "date date, ticker string, predicted_return double, score double, target double")
    row = harmonise_predictions(frame, "tree").first()
    assert row["model_score"] == 0.1 and row["realized_forward_return"] == 0.3 and row["model_name"] == "tree"
    with pytest.raises(ValueError):
        harmonise_predictions(frame.drop("target"), "tree")


def test_rank_diagnostic_falls_back_to_all_models(spark):
    frame = spark.createDataFrame(predictions(2, 20, models=("a",)))
    weights = spark.createDataFrame([(days(2)[1], "T03", "normal", 0.2)], "date date, ticker string, optimization_mode string, weight double")
    got = me.rank_diagnostic(frame, weights, ["normal"]).toPandas()
    assert len(got) == 20 and got["in_normal_portfolio"].sum() == 1
    assert set(got["diagnostic_flag"]) <= {"normal", "top_ranked_miss", "top_ranked_hit", "top_ranked_negative_return"}
    assert (got["rank_gap"] == got["realized_rank"] - got["predicted_rank"]).all()


def test_horizon_disclosure_text(spark):
    frame = spark.createDataFrame([(5, 1599)], "forecast_horizon_days int, evaluated_dates bigint")
    row = me.horizon_disclosure(frame).first()
    assert row["approx_non_overlapping_periods"] == 319
    assert row["overlap_disclosure"] == "1,599 evaluated dates (~319 non-overlapping 5-day periods)."


def test_hit_rate_by_overlap_needs_enough_rows(spark):
    frame = predictions(2, 6, models=("a",)).rename(columns={"predicted_return": "model_score", "actual_return": "realized_forward_return"})
    frame = frame[~((frame["date"] == days(2)[1]) & (frame["ticker"] > "T03"))]
    got = me.hit_rate_by_overlap(spark.createDataFrame(frame).withColumn("model_family", F.lit("x")))
    assert [r["date"] for r in got.collect()] == [days(1)[0]]
