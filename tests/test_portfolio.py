from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import days, predictions, price_panel
from tidepanel.operators import backtest as bt
from tidepanel.operators import ensemble as en
from tidepanel.operators import monitor as mo
from tidepanel.operators import policy as pol
from tidepanel.operators import portfolio as po
from tidepanel.operators import regime as rg
from tidepanel.operators import targets as ta


def _context(frame, groups=4, sectors=3):
    frame = frame.copy()
    number = frame["ticker"].str[1:].astype(int)
    frame["issuer_group"] = "G" + (number % groups).astype(str)
    frame["sector"] = "S" + (number % sectors).astype(str)
    frame["high_herding_day"] = [d.day % 2 == 0 for d in frame["date"]]
    frame["herding_corr_score"] = 0.5
    return frame


def test_target_weights_respect_caps(spark):
    frame = _context(predictions(10, 12, models=("a",)), groups=2)
    got = po.target_weights(po.with_mode_parameters(spark.createDataFrame(frame))).toPandas()
    groups = got.groupby(["optimization_mode", "date", "issuer_group"])["target_weight"].sum()
    assert groups.max() <= 0.4 + 1e-12
    sectors = got[got["optimization_mode"] == "sector_aware"].groupby(["date", "sector"])["target_weight"].sum()
    assert sectors.max() <= 0.35 + 1e-12
    careful = got[(got["optimization_mode"] == "herding_aware") & np.array([d.day % 2 == 0 for d in got["date"]])]
    assert careful["target_weight"].max() <= 0.15 and (careful["predicted_return"] > 0).all()


def test_path_never_exceeds_the_turnover_limit(spark):
    frame = _context(predictions(25, 15, models=("a",)))
    weights = po.optimised_weights(spark.createDataFrame(frame), max_turnover=0.3).toPandas()
    assert weights["portfolio_turnover"].max() <= 0.3 + 1e-9
    assert weights.groupby(["optimization_mode", "date"])["weight"].sum().max() <= 1 + 1e-9
    assert (weights["weight"] > 0).all()


def test_path_recomputed_by_hand(spark):
    frame = _context(predictions(8, 10, models=("a",)))
    rows = po.with_mode_parameters(spark.createDataFrame(frame), ["normal"])
    targets = po.target_weights(rows)
    got = po.turnover_limited_path(targets, rows.select("optimization_mode", "date"), default_limit=0.25).toPandas()
    wanted = targets.toPandas()
    held: dict[str, float] = {}
    for date in sorted(set(wanted["date"])):
        day = wanted[wanted["date"] == date]
        target = dict(zip(day["ticker"], day["target_weight"]))
        names = set(held) | set(target)
        need = 0.5 * sum(abs(target.get(t, 0) - held.get(t, 0)) for t in names)
        scale = 1.0 if need <= 0.25 else (0.25 - 1e-6) / need
        held = {t: held.get(t, 0) + scale * (target.get(t, 0) - held.get(t, 0)) for t in names}
        held = {t: w for t, w in held.items() if w > 1e-8}
        rows_now = got[got["date"] == date].set_index("ticker")["weight"].to_dict()
        assert rows_now.keys() == held.keys()
        np.testing.assert_allclose([rows_now[t] for t in sorted(held)], [held[t] for t in sorted(held)], rtol=1e-12)


def test_dates_without_targets_move_to_cash(spark):
    d = days(3)
    targets = spark.createDataFrame([("m", d[0], "A", 0.5)], "optimization_mode string, date date, ticker string, target_weight double")
    dates = spark.createDataFrame([("m", x) for x in d], "optimization_mode string, date date")
    got = po.turnover_limited_path(targets, dates, default_limit=0.1).orderBy("date").toPandas()
    # Half of 0.5 is traded for 0.1 of turnover; 0.2 is then sold in one step.
    assert got["date"].tolist() == [d[0]] and got["weight"].iloc[0] == pytest.approx(0.2, abs=3e-6)


def test_turnover_between_dates_reports_true_sells(spark):
    d = days(2)
    rows = [("m", d[0], "A", 0.6), ("m", d[0], "B", 0.4), ("m", d[1], "A", 0.5)]
    frame = spark.createDataFrame(rows, "optimization_mode string, date date, ticker string, weight double")
    got = po.turnover_between_dates(frame).orderBy("date").collect()
    assert got[0]["buys"] == pytest.approx(1.0) and got[1]["sells"] == pytest.approx(0.5)
    assert got[1]["buys"] == pytest.approx(0.0) and got[1]["turnover"] == pytest.approx(0.25)


def _reference(spark, rows):
    schema = "date date, ticker string, close_at_ceiling_today boolean, close_at_floor_today boolean, actual_return double, is_low_liquidity boolean"
    return spark.createDataFrame(rows, schema)


def test_blocked_trades_keep_the_old_weight(spark):
    d = days(2)
    weights = spark.createDataFrame(
        [("m", d[0], "A", 0.2), ("m", d[0], "B", 0.2), ("m", d[1], "B", 0.2), ("m", d[1], "C", 0.2)],
        "optimization_mode string, date date, ticker string, weight double",
    )
    reference = _reference(
        spark,
        [(d[0], "A", False, False, 0.1, True), (d[0], "B", True, False, 0.1, None), (d[1], "A", None, True, 0.1, False), (d[1], "C", True, False, 0.1, False)],
    )
    got = bt.price_limit_execution(weights, reference).toPandas()
    first = got[got["date"] == d[0]].set_index("ticker")["weight"].to_dict()
    second = got[got["date"] == d[1]].set_index("ticker")["weight"].to_dict()
    assert first == {"A": 0.2}
    assert second == pytest.approx({"A": 0.2, "B": 0.2})
    returns = bt.backtest_returns(got.pipe(spark.createDataFrame)).orderBy("date").collect()
    assert returns[0]["low_liquidity_weight"] == pytest.approx(0.2)
    assert returns[0]["total_cost"] == pytest.approx(0.1 * 0.002 + 0.1 * 0.2 * 0.001)


def test_blocked_sales_shrink_purchases_to_the_budget():
    held = {"A": 0.8, "B": 0.2}
    after, moved = bt._execute(held, {"B": 0.2, "C": 0.8}, set(), {"A"})
    assert sum(after.values()) <= 1 + 1e-12 and after["A"] == 0.8 and moved <= 0.4


def test_constrained_targets_keep_every_cap(spark):
    frame = _context(predictions(12, 24, models=("a",)), groups=6, sectors=4)
    got = ta.constrained_targets(spark.createDataFrame(frame))
    assert got.where("status <> 'ok'").count() == 0
    assert ta.cap_violations(got).count() == 0
    totals = got.groupBy("date").agg(F.sum("target_weight").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["n"] == 8 and abs(float(r["t"]) - 0.97) <= 1e-11 for r in totals)


def test_constrained_targets_replace_crowded_names(spark):
    d = days(1)[0]
    rows = [(d, f"B{i}", "BANK", "Banks", 1.0 - i / 100) for i in range(8)]
    rows += [(d, f"X{i}", f"G{i}", f"S{i % 3}", 0.1 - i / 100) for i in range(8)]
    frame = spark.createDataFrame(rows, "date date, ticker string, issuer_group string, sector string, predicted_return double")
    got = ta.constrained_targets(frame).toPandas()
    assert (got["issuer_group"] == "BANK").sum() < 8 and got["status"].eq("ok").all()
    assert ta.cap_violations(ta.constrained_targets(frame)).count() == 0


def test_impossible_caps_are_reported(spark):
    d = days(1)[0]
    rows = [(d, f"B{i}", "BANK", "Banks", 1.0 - i / 100) for i in range(12)]
    frame = spark.createDataFrame(rows, "date date, ticker string, issuer_group string, sector string, predicted_return double")
    assert [r["status"] for r in ta.constrained_targets(frame).collect()] == ["caps_too_tight"]


def test_crossed_caps_need_reallocation():
    # B shares its group with A and its sector with C: filling A first would block the rest.
    names = [("A", "g1", "s1"), ("B", "g1", "s2"), ("C", "g2", "s1")]
    total, weights = ta._spread(names, 0.0, 1.0, 0.25, 0.25)
    assert total == pytest.approx(0.5) and weights[0] == pytest.approx(0.0)


def test_rank_ensemble_by_hand(spark):
    frame = predictions(3, 5)
    got = en.rank_ensemble(spark.createDataFrame(frame), ("a", "b")).toPandas()
    for date, day in frame.groupby("date"):
        ranks = day.pivot(index="ticker", columns="model_name", values="predicted_return").rank(ascending=False, method="first")
        want = 1 - ranks.mean(axis=1) / 6
        have = got[got["date"] == date].set_index("ticker")["predicted_return"]
        np.testing.assert_allclose(have.sort_index(), want.sort_index())


def test_rolling_ensemble_does_not_use_late_labels(spark):
    frame = predictions(30, 6)
    late = frame.copy()
    cutoff = days(30)[18]
    mask = late["date"] >= cutoff
    late.loc[mask, "actual_return"] = -late.loc[mask, "actual_return"]
    before = en.rolling_member_weights(spark.createDataFrame(frame), ("a", "b"), 10, 3)
    after = en.rolling_member_weights(spark.createDataFrame(late), ("a", "b"), 10, 3)
    horizon = days(30)[21]
    differing = before.exceptAll(after).agg(F.min("date")).first()[0]
    assert differing is None or differing > horizon


def test_incomplete_members_are_reported(spark):
    frame = predictions(2, 3).iloc[1:]
    problems = en.ensemble_problems(spark.createDataFrame(frame), ("a", "b")).collect()
    assert [r["problem"] for r in problems] == ["missing_member"]


def test_health_status(spark):
    rows = [(d, m, ic, 0.1) for m, level in (("bad", -0.1), ("weak", 0.001), ("fine", 0.2)) for d, ic in zip(days(5), [level] * 5)]
    rows += [(days(1)[0], "new", 0.5, 0.1)]
    daily = spark.createDataFrame(rows, "date date, model_name string, rank_ic double, top_n_actual_return double")
    got = {r["model_name"]: r["health_status"] for r in en.latest_health(en.health_history(daily, 4)).collect()}
    assert got == {"bad": "degraded", "weak": "weak", "fine": "positive", "new": "insufficient_history"}


def test_regimes_match_pandas(spark):
    bars = price_panel(4, 80)
    got = rg.market_regimes(spark.createDataFrame(bars), 5, 20).orderBy("date").toPandas()
    wide = bars.pivot(index="date", columns="ticker", values="adjusted_close")
    market = wide.pct_change().mean(axis=1)
    trailing = (1 + market).rolling(5, min_periods=5).apply(np.prod, raw=True) - 1
    volatility = market.rolling(5, min_periods=5).std()
    baseline = volatility.rolling(20, min_periods=20).median()
    ready = trailing.notna() & volatility.notna() & baseline.notna()
    want = np.where(volatility > baseline, "high_volatility", np.where(trailing >= 0, "trend_up", "trend_down"))[ready]
    assert got["market_regime"].tolist() == list(want)


def test_overlay_reduces_exposure_only_in_drawdown(spark):
    d = days(4)
    bars = spark.createDataFrame([(x, "A", p) for x, p in zip(d, (100.0, 85.0, 95.0, 120.0))], "date date, ticker string, adjusted_close double")
    got = rg.drawdown_overlay(bars).orderBy("date").toPandas()
    assert got["target_exposure"].tolist() == [0.97, 0.5, 0.97, 0.97]


def _policy_inputs(spark, rows, regimes):
    combined = spark.createDataFrame(rows, "date date, ticker string, model_name string, predicted_return double, actual_return double")
    schedule = spark.createDataFrame(regimes, "date date, market_regime string")
    return combined, schedule


def test_policy_charges_costs_and_forces_exits(spark):
    d = days(2)
    rows = [(d[0], "A", "m", 2.0, 0.10), (d[0], "B", "m", 1.0, 0.0), (d[1], "B", "m", 2.0, 0.05), (d[1], "C", "m", 1.0, 0.02)]
    combined, schedule = _policy_inputs(spark, rows, [(x, "trend_up") for x in d])
    policy = {"p": {r: "m" for r in rg.REGIMES}}
    first, second = pol.policy_history(combined, schedule, policy, n=1, exposure=0.9, max_turnover=0.8).orderBy("date").collect()
    assert first["before_cost_return"] == pytest.approx(0.09)
    assert first["total_cost"] == pytest.approx(0.9 * 0.002)
    assert second["forced_exit_weight"] == pytest.approx(0.9)
    assert second["total_cost"] == pytest.approx((0.7 + 0.9) * 0.002 + 0.9 * 0.001)
    assert second["total_weight"] == pytest.approx(0.7) and not second["turnover_cap_breached_by_forced_exit"]
    legacy = pol.policy_history(combined, schedule, policy, n=1, exposure=0.9, max_turnover=1.0, legacy_sells=True)
    assert legacy.orderBy("date").collect()[0]["total_cost"] == pytest.approx(0.9 * 0.005)


def test_cash_regime_earns_nothing_and_needs_no_predictions(spark):
    d = days(2)
    rows = [(d[0], "A", "m", 2.0, 0.10), (d[1], "A", "m", 2.0, 0.10)]
    combined, schedule = _policy_inputs(spark, rows, [(d[0], "trend_down"), (d[1], "trend_up")])
    policy = {"p": {"trend_up": "m", "high_volatility": "m", "trend_down": "cash"}}
    got = pol.policy_history(combined, schedule, policy, n=1, max_turnover=1.0).orderBy("date").collect()
    assert got[0]["before_cost_return"] == 0.0 and got[0]["selected_count"] == 0
    assert got[1]["before_cost_return"] == pytest.approx(0.097)
    with pytest.raises(ValueError, match="regimes"):
        rg.check_policy({"trend_up": "m"})


def test_policy_summary_counts_drawdown_from_capital(spark):
    d = days(2)
    rows = [("p", d[0], -0.2, 0.5, 0.9, 0.0, True, 0.0), ("p", d[1], 0.1, 0.1, 0.5, 0.1, True, 0.05)]
    history = spark.createDataFrame(
        rows,
        "policy_name string, date date, after_cost_return double, portfolio_turnover double, target_exposure double, "
        "forced_exit_weight double, settlement_compatible boolean, benchmark_return double",
    )
    row = pol.policy_summary(history).first()
    assert row["max_after_cost_drawdown"] == pytest.approx(-0.2)
    assert row["final_cumulative_after_cost_return"] == pytest.approx(0.8 * 1.1 - 1)
    assert row["final_cumulative_active_return"] == pytest.approx(0.88 / 1.05 - 1)
    assert row["forced_exit_dates"] == 1


def test_schedule_rejects_overlapping_signals(spark):
    calendar = spark.createDataFrame([(x, "trend_up") for x in days(10)], "date date, market_regime string")
    near = calendar.where(F.col("date").isin([days(10)[0], days(10)[2]])).select("date")
    with pytest.raises(ValueError, match="overlap"):
        pol.rebalance_schedule(calendar, near, holding=5, pre_spaced=True)
    far = calendar.where(F.col("date").isin([days(10)[0], days(10)[7]])).select("date")
    assert pol.rebalance_schedule(calendar, far, holding=5, pre_spaced=True).count() == 2
    assert pol.rebalance_schedule(calendar, calendar.select("date"), holding=5).count() == 2


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    rng = np.random.default_rng(0)
    rows = [(d, "s", float(v)) for d, v in zip(days(120), rng.normal(0.1, 1.0, 120))]
    frame = spark.createDataFrame(rows, "date date, s string, v double")
    a = pol.block_bootstrap(frame, "v", ["s"], block=10, samples=500).first()
    b = pol.block_bootstrap(frame.repartition(7), "v", ["s"], block=10, samples=500).first()
    assert tuple(a)[1:] == pytest.approx(tuple(b)[1:])
    assert a["bootstrap_95pct_lower"] < a["mean_value"] < a["bootstrap_95pct_upper"]
    one = pol.block_bootstrap(frame, "v", block=500, samples=20).first()
    assert one["bootstrap_95pct_lower"] == pytest.approx(one["mean_value"])


def test_drift_flags_a_shifted_feature(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i, d in enumerate(days(40)):
        for t in ("A", "B"):
            rows.append((d, t, float(rng.normal()), float(rng.normal(5.0 if i >= 30 else 0.0)), i % 2 == 0))
    frame = spark.createDataFrame(rows, "date date, ticker string, stable double, shifted double, flag boolean")
    got = mo.drift_report(frame, ["stable", "shifted", "flag"], 30, 10, bins=4).toPandas().set_index("feature")
    assert got.loc["shifted", "drift_status"] == "significant_shift"
    assert got.loc["flag", "drift_status"] == "stable"
    values = frame.toPandas()
    reference = values["stable"][:60].to_numpy()
    recent = values["stable"][60:].to_numpy()
    edges = np.unique(np.quantile(reference, np.linspace(0, 1, 5)))
    edges[0], edges[-1] = -np.inf, np.inf
    p = np.histogram(reference, edges)[0] + 1e-6
    q = np.histogram(recent, edges)[0] + 1e-6
    p, q = p / p.sum(), q / q.sum()
    assert got.loc["stable", "psi"] == pytest.approx(np.sum((q - p) * np.log(q / p)))
