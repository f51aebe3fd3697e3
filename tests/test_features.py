from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import by_key, days, price_panel
from tidepanel.operators import features as fe
from tidepanel.operators import herding as he
from tidepanel.operators import labels as la
from tidepanel.operators import risk
from tidepanel.plans.features import combined_features, model_inputs, time_features


def _pandas(frame):
    return by_key(frame.toPandas(), "ticker", "date")


def test_time_features_match_pandas(spark):
    bars = by_key(price_panel(4, 90, gaps=0.1), "ticker", "date")
    got = _pandas(time_features(spark.createDataFrame(bars)))
    price = bars.groupby("ticker")["adjusted_close"]
    r1 = price.pct_change()
    np.testing.assert_allclose(got["return_1d"], r1)
    np.testing.assert_allclose(got["return_20d"], price.pct_change(20))
    vol = r1.groupby(bars["ticker"]).transform(lambda s: s.rolling(20, min_periods=20).std()) * np.sqrt(252)
    np.testing.assert_allclose(got["rolling_vol_20d"], vol, rtol=1e-9)
    np.testing.assert_allclose(got["drawdown"], bars["adjusted_close"] / price.cummax() - 1, atol=1e-12)
    high = price.transform(lambda s: s.rolling(20, min_periods=20).max())
    np.testing.assert_allclose(got["distance_from_20d_high"], bars["adjusted_close"] / high - 1, atol=1e-12)


def test_time_features_use_one_exchange_by_ticker(spark):
    bars = spark.createDataFrame(price_panel(2, 30))
    plan = time_features(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_beta_ignores_the_current_row(spark):
    bars = price_panel(3, 60)
    base = risk.rolling_beta(risk.with_market_return(fe.add_momentum(spark.createDataFrame(bars))))
    last = max(bars["date"])
    changed = bars.copy()
    changed.loc[changed["date"] == last, "adjusted_close"] *= 1.5
    other = risk.rolling_beta(risk.with_market_return(fe.add_momentum(spark.createDataFrame(changed))))
    a = base.where(F.col("date") == F.lit(last)).orderBy("ticker").toPandas()["rolling_beta_to_market"]
    b = other.where(F.col("date") == F.lit(last)).orderBy("ticker").toPandas()["rolling_beta_to_market"]
    np.testing.assert_allclose(a, b)


def test_pairwise_correlation_with_gaps_matches_pandas(spark):
    bars = price_panel(7, 60, seed=5, gaps=0.25)
    rows = fe.add_momentum(spark.createDataFrame(bars))
    got = by_key(he.average_pairwise_correlation(rows, pairs="available").toPandas(), "date")
    wide = rows.select("date", "ticker", "return_1d").toPandas().pivot(index="date", columns="ticker", values="return_1d").sort_index()
    expected = []
    for end in range(len(wide)):
        if end < 19:
            expected.append(np.nan)
            continue
        matrix = wide.iloc[end - 19 : end + 1].corr(min_periods=2).to_numpy()
        pairs = matrix[np.triu_indices(len(matrix), 1)]
        expected.append(np.nanmean(pairs) if np.isfinite(pairs).any() else np.nan)
    np.testing.assert_allclose(got["rolling_avg_pairwise_corr"].astype(float), expected, atol=1e-10)


def test_complete_windows_match_pandas_on_names_without_gaps(spark):
    bars = price_panel(9, 60, seed=6, gaps=0.03)
    rows = fe.add_momentum(spark.createDataFrame(bars))
    got = by_key(he.complete_window_correlation(rows).toPandas(), "date")
    wide = rows.select("date", "ticker", "return_1d").toPandas().pivot(index="date", columns="ticker", values="return_1d").sort_index()
    expected, shares = [], []
    for end in range(len(wide)):
        part = wide.iloc[max(0, end - 19) : end + 1]
        full = part.dropna(axis=1)
        pairs = full.corr().to_numpy()[np.triu_indices(full.shape[1], 1)]
        expected.append(pairs.mean() if end >= 19 and len(pairs) else np.nan)
        shares.append(full.shape[1] / part.dropna(axis=1, how="all").shape[1] if end >= 19 else np.nan)
    np.testing.assert_allclose(got["rolling_avg_pairwise_corr"].astype(float), expected, atol=1e-10)
    np.testing.assert_allclose(got["complete_share"].astype(float), shares, atol=1e-12)
    with pytest.raises(ValueError, match="pairs"):
        he.average_pairwise_correlation(rows, pairs="some")


def test_expanding_percentile_counts_only_the_past(spark):
    values = [3.0, 1.0, None, 2.0, 5.0]
    frame = spark.createDataFrame(list(zip(days(5), values)), "date date, v double")
    got = he.with_expanding_percentiles(frame, {"s": ("v", True)}).orderBy("date").toPandas()["s"]
    np.testing.assert_allclose(got.astype(float), [1.0, 0.5, np.nan, 2 / 3, 1.0])


@pytest.mark.parametrize("rows", [1, 2, 7, 64, 100])
def test_expanding_percentile_against_all_earlier_values(spark, rows):
    rng = np.random.default_rng(rows)
    values = [None if rng.random() < 0.1 else float(rng.integers(0, 12)) for _ in range(rows)]
    frame = spark.createDataFrame(list(zip(days(rows), values)), "date date, v double")
    got = he.with_expanding_percentiles(frame, {"up": ("v", True), "down": ("v", False)}).orderBy("date").collect()
    for k, row in enumerate(got):
        past = [v for v in values[: k + 1] if v is not None]
        for name, lesser in (("up", lambda x, y: x <= y), ("down", lambda x, y: x >= y)):
            want = None if values[k] is None else sum(lesser(v, values[k]) for v in past) / len(past)
            assert row[name] == want or abs(row[name] - want) < 1e-12


def test_combined_features_keep_every_row_once(spark):
    bars = spark.createDataFrame(price_panel(5, 40, gaps=0.05))
    got = combined_features(bars)
    assert got.count() == bars.count()
    assert la.key_violations(got).count() == 0
    assert {"herding_index", "amihud_illiquidity", "traded_value_rank_20d"} <= set(got.columns)


def test_turnover_z_uses_shares_when_present(spark):
    bars = price_panel(1, 30)
    bars["shares_outstanding"] = 1e6
    got = fe.add_liquidity(fe.add_momentum(spark.createDataFrame(bars))).orderBy("date").toPandas()
    np.testing.assert_allclose(got["turnover_z_20"].iloc[19:], got["volume_z_20"].iloc[19:], rtol=1e-9)


def test_volume_change_fills_gaps_forward(spark):
    bars = price_panel(1, 12)
    volumes = [float(v) for v in bars["volume"]]
    rows = [
        (*r[:7], None if i == 3 else int(volumes[i]), r[8]) for i, r in enumerate(bars.itertuples(index=False, name=None))
    ]
    schema = "date date, ticker string, open double, high double, low double, close double, adjusted_close double, volume bigint, value_traded double"
    got = fe.add_liquidity(fe.add_momentum(spark.createDataFrame(rows, schema))).orderBy("date").toPandas()
    filled = pd.Series(volumes)
    filled[3] = filled[2]
    np.testing.assert_allclose(got["volume_change_5d"], filled / filled.shift(5) - 1)


def test_leave_one_out_labels(spark):
    rows = spark.createDataFrame(
        [(days(1)[0], "A", 0.1), (days(1)[0], "B", 0.3), (days(1)[0], "C", None), (days(2)[1], "A", 0.2)],
        "date date, ticker string, forward_return_1d double",
    )
    got = {(r["date"], r["ticker"]): r["forward_relative_return_1d"] for r in la.leave_one_out_labels(rows, [1]).collect()}
    first, second = days(2)
    assert abs(got[first, "A"] + 0.2) < 1e-12 and abs(got[first, "B"] - 0.2) < 1e-12
    assert got[first, "C"] is None and got[second, "A"] is None


def test_labels_look_forward_only_inside_a_ticker(spark):
    bars = price_panel(2, 15)
    got = by_key(la.forward_labels(spark.createDataFrame(bars)).toPandas(), "ticker", "date")
    price = by_key(bars, "ticker", "date").groupby("ticker")["adjusted_close"]
    np.testing.assert_allclose(got["forward_return_5d"], price.shift(-5) / by_key(bars, "ticker", "date")["adjusted_close"] - 1)


def test_model_inputs_hold_the_target(spark):
    got = model_inputs(spark.createDataFrame(price_panel(4, 40)), 5)
    assert got.where("target IS NULL").groupBy("ticker").count().where("count <> 5").count() == 0


def test_winsorised_keeps_nulls(spark):
    rows = spark.createDataFrame([(days(1)[0], f"T{i}", float(i) if i else None) for i in range(101)], "date date, ticker string, v double")
    got = fe.winsorised(rows, "v", "w", 0.1, 0.9).toPandas()
    assert got["w"].isna().sum() == 1
    assert got["w"].min() == np.quantile(np.arange(1, 101), 0.1)
