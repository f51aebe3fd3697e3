from __future__ import annotations

import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import by_key, days
from tidepanel.operators import labels as la
from tidepanel.operators import models as mod
from tidepanel.operators import splits
from tidepanel.operators import trees as tr

FEATURES = ["f0", "f1", "f2", "flat"]


def _rows(dates=24, names=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for d in days(dates):
        x = rng.normal(0, 1, (names, 3)) * [1.0, 1000.0, 1e-6] + [0.0, 5000.0, 0.0]
        y = 0.02 * x[:, 0] - 1e-5 * (x[:, 1] - 5000) + rng.normal(0, 0.01, names)
        rows += [(d, f"T{k:02d}", *map(float, x[k]), 3.0, float(y[k])) for k in range(names)]
    return pd.DataFrame(rows, columns=["date", "ticker", *FEATURES, "target"])


def _standardised(train, test):
    x = train[FEATURES].fillna(0).to_numpy(float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    return (x - mean) / scale, (test[FEATURES].fillna(0).to_numpy(float) - mean) / scale


def _windows(spark, frame, **sizes):
    return splits.walk_forward_windows(spark.createDataFrame(frame), **{"train_size": 4, "purge_size": 2, **sizes})


def _check(spark, frame, model, solve):
    windows = _windows(spark, frame)
    got = mod.linear_predictions(spark.createDataFrame(frame), windows, FEATURES, models=[model]).toPandas()
    table = windows.toPandas()
    for window_id in (0, 5, int(table["window_id"].max())):
        role = table[table["window_id"] == window_id]
        train = frame[frame["date"].isin(role.loc[role["role"] == "train", "date"])]
        test = frame[frame["date"].isin(role.loc[role["role"] == "test", "date"])]
        z, zt = _standardised(train, test)
        y = train["target"].to_numpy()
        beta = solve(z, y - y.mean())
        want = pd.Series(y.mean() + zt @ beta, index=test["ticker"]).sort_index()
        have = got[got["window_id"] == window_id].set_index("ticker")["predicted_return"].sort_index()
        np.testing.assert_allclose(have, want, atol=1e-7)


def test_ridge_matches_the_closed_form(spark):
    _check(spark, _rows(), "ridge", lambda z, y: np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ y))


def test_missing_features_are_imputed_with_zero(spark):
    frame = _rows()
    rng = np.random.default_rng(1)
    frame.loc[rng.random(len(frame)) < 0.2, "f0"] = None
    rows = [tuple(None if v != v else v for v in r) for r in frame.itertuples(index=False)]
    schema = "date date, ticker string, f0 double, f1 double, f2 double, flat double, target double"
    windows = _windows(spark, _rows())
    got = mod.linear_predictions(spark.createDataFrame(rows, schema), windows, FEATURES, models=["ridge"])
    filled = mod.linear_predictions(spark.createDataFrame(frame.fillna(0.0)), windows, FEATURES, models=["ridge"])
    a = got.orderBy("window_id", "ticker").toPandas()["predicted_return"]
    b = filled.orderBy("window_id", "ticker").toPandas()["predicted_return"]
    np.testing.assert_allclose(a, b, atol=1e-10)


def test_elastic_net_satisfies_its_optimality_conditions(spark):
    def solve(z, y):
        n, k = z.shape
        beta = np.zeros(k)
        for _ in range(5000):
            for j in range(k):
                rest = y - z @ beta + z[:, j] * beta[j]
                rho = z[:, j] @ rest
                norm = z[:, j] @ z[:, j] + n * 0.0005
                beta[j] = 0.0 if norm == 0 else np.sign(rho) * max(abs(rho) - n * 0.0005, 0) / norm
        return beta

    _check(spark, _rows(), "elastic_net", solve)


def test_future_rows_do_not_change_a_window(spark):
    frame = _rows()
    changed = frame.copy()
    late = changed["date"] > days(24)[12]
    changed.loc[late, "target"] *= -5
    windows = _windows(spark, frame).where("window_id = 0")
    a, b = (
        mod.fit_linear_windows(spark.createDataFrame(f), windows, FEATURES, models=["ridge"],
                               scaled=[F.col(c) for c in FEATURES]).first()
        for f in (frame, changed)
    )
    np.testing.assert_allclose(a["slopes"], b["slopes"])


def test_logistic_matches_newton_on_each_window(spark):
    frame = _rows(dates=30, names=15)
    rows = la.top_quintile_label(spark.createDataFrame(frame), "target")
    windows = _windows(spark, frame, train_size=6, step_size=6)
    got = mod.logistic_predictions(rows, windows, FEATURES).toPandas()
    labelled = rows.toPandas()
    table = windows.toPandas()
    role = table[table["window_id"] == 0]
    train = labelled[labelled["date"].isin(role.loc[role["role"] == "train", "date"])]
    test = labelled[labelled["date"].isin(role.loc[role["role"] == "test", "date"])]
    z, zt = _standardised(train, test)
    y = train["top_quintile_label"].to_numpy(float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    z1, beta = np.column_stack([np.ones(len(z)), z]), np.zeros(z.shape[1] + 1)
    penalty = np.diag([0.0] + [1.0] * z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z1 @ beta))
        gradient = z1.T @ (weight * (y - p)) - penalty @ beta
        hessian = z1.T @ (z1 * (weight * p * (1 - p))[:, None]) + penalty
        beta = beta + np.linalg.solve(hessian, gradient)
    want = pd.Series(1 / (1 + np.exp(-(np.column_stack([np.ones(len(zt)), zt]) @ beta))), index=test["ticker"])
    have = got[got["window_id"] == 0].set_index("ticker")["predicted_probability"]
    np.testing.assert_allclose(have.sort_index(), want.sort_index(), atol=1e-6)


def test_logistic_fits_end_converged_where_full_steps_overshoot(spark):
    """Large, lopsided features: Newton's full step raises the loss and has to be halved."""
    rng = np.random.default_rng(3)
    dates = days(30)
    frame = pd.DataFrame([(d, f"T{k:02d}") for d in dates for k in range(15)], columns=["date", "ticker"])
    for name in FEATURES:
        frame[name] = np.exp(rng.normal(0, 3, len(frame)))
    frame["target"] = rng.normal(0, 1, len(frame))
    frame["top_quintile_label"] = (frame[FEATURES[0]] > np.quantile(frame[FEATURES[0]], 0.97)).astype(int)
    rows = spark.createDataFrame(frame)
    windows = _windows(spark, frame, train_size=8, step_size=6)
    scaled = mod.scaled_features(rows, FEATURES)
    fits = mod.fit_logistic_windows(rows, windows, FEATURES, "top_quintile_label", scaled).collect()
    assert fits and all(r["converged"] for r in fits)


def test_sums_of_many_features_match_numpy(spark):
    """51 features go through packed arrays; keys spread over tasks, one of them with most rows."""
    rng = np.random.default_rng(11)
    size, names = 51, 400
    x = rng.normal(0, 1, (names, size))
    key = np.where(rng.random(names) < 0.7, 0, rng.integers(1, 5, names))
    frame = pd.DataFrame(x, columns=[f"x{i}" for i in range(size)]).assign(
        k=key, w=rng.random(names), r=rng.normal(0, 1, names), e=rng.random(names)
    )
    got = mod.summed_moments(spark.createDataFrame(frame).repartition(7), "k", size, "w", "r", "e").collect()
    assert sorted(r["k"] for r in got) == sorted(set(key))
    for row in got:
        part = frame[frame["k"] == row["k"]]
        inside, w, r = part[[f"x{i}" for i in range(size)]].to_numpy(), part["w"].to_numpy(), part["r"].to_numpy()
        products = (inside.T @ (inside * w[:, None]))[np.triu_indices(size)]
        want = np.concatenate([[w.sum(), r.sum()], w @ inside, r @ inside, products])
        np.testing.assert_allclose(row["moments"], want, rtol=1e-9, atol=1e-12)
        assert row["missed"] == pytest.approx(part["e"].sum())


def test_fits_are_the_same_by_plain_and_by_packed_sums(spark, monkeypatch):
    frame = _rows(dates=24, names=12)
    rows = la.top_quintile_label(spark.createDataFrame(frame), "target").cache()
    windows = _windows(spark, frame, train_size=6, step_size=6).cache()

    def fitted() -> tuple[pd.DataFrame, pd.DataFrame]:
        linear = by_key(mod.linear_predictions(rows, windows, FEATURES).toPandas(), "window_id", "model_name", "date", "ticker")
        logistic = by_key(mod.logistic_predictions(rows, windows, FEATURES).toPandas(), "window_id", "date", "ticker")
        return linear, logistic

    plain = fitted()
    monkeypatch.setattr(mod, "PLAIN_SUM_FEATURES", 0)
    monkeypatch.setattr(mod, "HELD_KEYS", 2)
    packed = fitted()
    np.testing.assert_allclose(packed[0]["predicted_return"], plain[0]["predicted_return"], rtol=1e-8, atol=1e-11)
    np.testing.assert_allclose(packed[1]["predicted_probability"], plain[1]["predicted_probability"], atol=1e-7)


def test_one_class_windows_predict_their_class(spark):
    frame = _rows(dates=20, names=5)
    rows = spark.createDataFrame(frame).withColumn("top_quintile_label", F.lit(0))
    got = mod.logistic_predictions(rows, _windows(spark, frame), FEATURES)
    assert [r[0] for r in got.select("predicted_probability").distinct().collect()] == [0.0]


def test_expanding_predictions_match_a_refit(spark):
    frame = _rows(dates=30)
    signals = splits.expanding_signals(spark.createDataFrame(frame), horizon=3, minimum_dates=10, step=5)
    got = mod.expanding_predictions(spark.createDataFrame(frame), signals, FEATURES).toPandas()
    for row in signals.collect():
        train = frame[frame["date"] <= row["training_cutoff"]]
        test = frame[frame["date"] == row["signal_date"]]
        z, zt = _standardised(train, test)
        y = train["target"].to_numpy()
        beta = np.linalg.solve(z.T @ z + np.eye(4), z.T @ (y - y.mean()))
        want = pd.Series(y.mean() + zt @ beta, index=test["ticker"]).sort_index()
        have = got[got["date"] == row["signal_date"]].set_index("ticker")["predicted_return"].sort_index()
        np.testing.assert_allclose(have, want, atol=1e-7)


def _plain_tree(x, y, weight, depth, min_leaf, bins):
    """One tree by trying every cut at every node: a function from rows to leaf means."""
    cuts = [sorted(set(np.quantile(column, np.arange(1, bins) / bins))) for column in x.T]
    placed = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)

    def build(rows, level):
        n, s = weight[rows].sum(), (weight * y)[rows].sum()
        best = None
        for f in range(x.shape[1] if level < depth else 0):
            for cut in range(placed[:, f].max() + 1):
                left = rows & (placed[:, f] <= cut)
                nl, sl = weight[left].sum(), (weight * y)[left].sum()
                if nl >= min_leaf and n - nl >= min_leaf:
                    gain = sl**2 / nl + (s - sl) ** 2 / (n - nl) - s**2 / n
                    if gain > 1e-14 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, f, cut)
        if best is None:
            return lambda other: np.full(len(other), s / n)
        _, f, cut = best
        low = build(rows & (placed[:, f] <= cut), level + 1)
        high = build(rows & (placed[:, f] > cut), level + 1)
        return lambda other: np.where(np.searchsorted(cuts[f], other[:, f], side="left") <= cut, low(other), high(other))

    return build(np.ones(len(y), dtype=bool), 0)


@pytest.mark.parametrize("depth,trees", [(1, 1), (2, 4), (3, 2)])
def test_boosting_of_all_windows_matches_plain_trees(spark, depth, trees):
    frame = _rows(dates=26)
    windows = _windows(spark, frame, train_size=8, test_size=3, step_size=5)
    got, importance = tr.window_trees(
        spark.createDataFrame(frame), windows, FEATURES, trees=trees, depth=depth, step=0.3, bins=5
    )
    got, table = got.toPandas(), windows.toPandas()
    for window, part in table.groupby("window_id"):
        train = frame[frame["date"].isin(part.loc[part["role"] == "train", "date"])]
        test = frame[frame["date"].isin(part.loc[part["role"] == "test", "date"])]
        x, y, xt = (t.fillna(0.0).to_numpy(float) for t in (train[FEATURES], train["target"], test[FEATURES]))
        now, later = np.full(len(y), y.mean()), np.full(len(xt), y.mean())
        for _ in range(trees):
            tree = _plain_tree(x, y - now, np.ones(len(y)), depth, 2, 5)
            now, later = now + 0.3 * tree(x), later + 0.3 * tree(xt)
        want = pd.Series(later, index=pd.MultiIndex.from_frame(test[["date", "ticker"]])).sort_index()
        have = got[got["window_id"] == window].set_index(["date", "ticker"])["predicted_return"].sort_index()
        np.testing.assert_allclose(have, want, atol=1e-9)
    sums = importance.groupBy("window_id").agg(F.sum("importance").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == table["window_id"].nunique()
    assert all(r["s"] == pytest.approx(1.0) and r["n"] == len(FEATURES) for r in sums)


def test_forest_averages_bootstrapped_trees(spark):
    frame = _rows(dates=22)
    windows = _windows(spark, frame, train_size=10, test_size=3, step_size=5).where("window_id = 0")
    rows = spark.createDataFrame(frame)
    got, _ = tr.window_trees(rows, windows, FEATURES, model="random_forest", trees=3, depth=2, bins=4)
    table = windows.toPandas()
    train = frame[frame["date"].isin(table.loc[table["role"] == "train", "date"])]
    test = frame[frame["date"].isin(table.loc[table["role"] == "test", "date"])]
    drawn = spark.createDataFrame(train[["date", "ticker"]]).select(
        "date", "ticker", *[tr.drawn_count(tr.SEED, F.lit(k), F.lit(0), "date", "ticker").alias(f"w{k}") for k in range(3)]
    ).toPandas()
    keyed = train.merge(drawn, on=["date", "ticker"])
    assert 0.8 < drawn[["w0", "w1", "w2"]].to_numpy().mean() < 1.2
    x, y, xt = (t.fillna(0.0).to_numpy(float) for t in (keyed[FEATURES], keyed["target"], test[FEATURES]))
    want = np.mean([_plain_tree(x, y, keyed[f"w{k}"].to_numpy(float), 2, 2, 4)(xt) for k in range(3)], axis=0)
    have = got.toPandas().set_index(["date", "ticker"])["predicted_return"].sort_index()
    np.testing.assert_allclose(have, pd.Series(want, index=pd.MultiIndex.from_frame(test[["date", "ticker"]])).sort_index(), atol=1e-9)


@pytest.mark.parametrize("model,trees", [("gradient_boosting", 12), ("random_forest", 3)])
def test_windows_of_many_blocks_give_the_same_trees(spark, tmp_path, monkeypatch, model, trees):
    monkeypatch.setattr(tr, "REFRESH", 5)
    monkeypatch.setattr(tr, "FOREST_BATCH", 2)
    frame = _rows(dates=22)
    windows = _windows(spark, frame, train_size=10, test_size=3, step_size=5)
    rows = spark.createDataFrame(frame)
    settings = {"model": model, "trees": trees, "depth": 2, "bins": 5}
    keys = ["window_id", "date", "ticker"]

    def run(**more):
        found, importance = tr.window_trees(rows, windows, FEATURES, **settings | more)
        return found.orderBy(*keys).toPandas(), importance.orderBy("window_id", "feature").toPandas()

    whole, importance = run()
    log = str(tmp_path / "log")
    # A run that ended early left rounds behind; the next one goes on after them.
    if model == "gradient_boosting":
        run(block_rows=30, log=log, trees=7)
        first = sorted((tmp_path / "log" / "round=3").iterdir())
    cut, other = run(block_rows=30, log=log)
    pd.testing.assert_frame_equal(whole, cut, rtol=1e-9)
    pd.testing.assert_frame_equal(importance, other, rtol=1e-9)
    if model == "gradient_boosting":
        assert sorted((tmp_path / "log" / "round=3").iterdir()) == first


def test_tree_windows_stay_out_of_sample(spark):
    frame = _rows(dates=26)
    windows = _windows(spark, frame, train_size=8, test_size=3, step_size=5)
    found, importance = mod.tree_predictions(spark.createDataFrame(frame), windows, FEATURES, trees=2)
    assert found.count() == 2 * 36 * windows.select("window_id").distinct().count()
    changed = frame.copy()
    tests = windows.where("role = 'test'").select("date").distinct().toPandas()["date"]
    changed.loc[changed["date"] == tests.max(), "target"] *= 5
    other, _ = mod.tree_predictions(spark.createDataFrame(changed), windows, FEATURES, trees=2)
    a, b = (f.orderBy("window_id", "model_name", "date", "ticker").toPandas()["predicted_return"] for f in (found, other))
    np.testing.assert_allclose(a, b)
    assert set(importance.columns) >= {"window_id", "model_name", "feature", "importance", "test_start", "test_end"}


def test_latest_scores_need_unknown_targets(spark):
    frame = _rows(dates=30)
    names = spark.createDataFrame(sorted({(t,) for t in frame["ticker"]}), "ticker string")
    last = days(30)[-3:]
    dataset = spark.createDataFrame(frame).withColumn("target", F.when(~F.col("date").isin(last), F.col("target")))
    scored, importance = mod.score_latest(dataset, names, 3, "rank_ensemble", 20, trees=5)
    got = scored.toPandas().sort_values("predicted_rank")
    assert got["predicted_rank"].tolist() == list(range(1, 13)) and got["score"].is_monotonic_decreasing
    assert set(importance.toPandas()["model_name"]) == {"gradient_boosting", "random_forest"}
    with pytest.raises(ValueError, match="target_leak"):
        mod.score_latest(spark.createDataFrame(frame), names, 3, "random_forest", 20, trees=5)
    with pytest.raises(ValueError, match="missing_ticker"):
        mod.score_latest(dataset, names.unionByName(spark.createDataFrame([("ZZ",)], "ticker string")), 3, "random_forest", 20)
    with pytest.raises(ValueError, match="required"):
        mod.score_latest(dataset, names, 3, "random_forest", 200)


def test_signal_date_is_the_latest_with_all_names_and_known_labels(spark):
    frame = _rows(dates=30, names=4)
    dates = days(30)
    frame = frame[~((frame["date"] == dates[28]) & (frame["ticker"] == "T01"))]
    frame = frame[~((frame["date"] == dates[23]) & (frame["ticker"] == "T02"))]
    names = spark.createDataFrame([(f"T{k:02d}",) for k in range(4)], "ticker string")
    dataset = spark.createDataFrame(frame).withColumn("target", F.when(F.col("date") < dates[26], F.col("target")))
    # 29 and 28 fail: the cutoff 26 has no labels, 28 lacks a name; 27 has its cutoff on 24.
    signal = mod.covered_signal_date(dataset, names, 3)
    assert [tuple(r) for r in signal.collect()] == [(dates[27], dates[24])]
    known = mod.as_of(dataset, signal).toPandas()
    assert known["date"].max() == dates[27] and known.loc[known["target"].notna(), "date"].max() == dates[24]
    assert mod.scoring_problems(mod.as_of(dataset, signal), names, 3).count() == 0
    assert mod.covered_signal_date(dataset.where("ticker <> 'T00'"), names, 3).count() == 0


def test_ablation_scenarios_drop_their_features(spark):
    frame = _rows().rename(columns={"f0": "return_1d", "f1": "drawdown", "f2": "volume_z_20", "flat": "rolling_vol_20d"})
    columns = ["return_1d", "drawdown", "volume_z_20", "rolling_vol_20d"]
    rows = spark.createDataFrame(frame)
    windows = splits.walk_forward_windows(rows, train_size=4, purge_size=2)
    both = mod.ablation_predictions(rows, windows, columns, model="ridge")
    only = mod.linear_predictions(rows, windows, ["return_1d", "volume_z_20"], models=["ridge"])
    a = both.where("scenario = 'without_risk'").orderBy("window_id", "ticker").toPandas()["predicted_return"]
    b = only.orderBy("window_id", "ticker").toPandas()["predicted_return"]
    np.testing.assert_allclose(a, b, atol=1e-9)


@pytest.mark.parametrize(
    "name,operator",
    [
        ("k02_tree_predictions", "tree_predictions"), ("k02_tree_importance", "tree_predictions"),
        ("k05_ablation_predictions", "ablation_predictions"), ("k05_scenario_report", "ablation_predictions"),
        ("k05_horizon_predictions", "horizon_predictions"), ("k06_model_comparison", "tree_predictions"), ("k07_latest_scores", "score_latest"),
    ],
)
def test_registered_tree_queries_fit_all_trees(spark, monkeypatch, name, operator):
    from catalog import load

    real, seen = inspect.signature(getattr(mod, operator)), {}

    def stop(*args, **named):
        bound = real.bind(*args, **named)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise InterruptedError

    monkeypatch.setattr(mod, operator, stop)
    with pytest.raises(InterruptedError):
        # The smallest panel has no date with the whole universe, so nothing is scored there.
        load.QUERIES[name](spark, "/root/testdata/sf0.01" if name.startswith("k07") else "/root/testdata/sf0.001")
    assert seen["trees"] == tr.TREES == 100
    assert seen.get("model", "gradient_boosting") in (*tr.TREE_MODELS, "rank_ensemble")
