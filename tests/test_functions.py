from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import by_key, days, price_panel
from tidepanel.functions import dates as da
from tidepanel.functions import ranking
from tidepanel.functions.numeric import ceil_to_tick, floor_to_tick, pearson, tick_size
from tidepanel.functions.ranking import group_quantiles, top_n, value_bucket, with_ranks
from tidepanel.functions.rolling import with_run_lengths


def _values(seed: int = 3) -> pd.DataFrame:
    """Two groups; one value holds most of the first group."""
    rng = np.random.default_rng(seed)
    values = np.concatenate(
        [np.zeros(60), [1.001] * 25, [1.002] * 3, [1.0015] * 22, rng.normal(0, 1, 30), rng.normal(0, 1e-6, 10), [np.nan] * 5]
    )
    first = pd.DataFrame({"g": "hot", "ticker": [f"NAME{i:06d}" for i in range(len(values))], "v": values})
    second = pd.DataFrame({"g": "small", "ticker": ["A", "B", "C", "D"], "v": [5.0, 5.0, -1.0, 2.0]})
    return pd.concat([first, second], ignore_index=True)


@pytest.mark.parametrize("block_rows", [1, 4, 25, 100_000])
@pytest.mark.parametrize("ascending", [True, False])
def test_ranks_match_pandas(spark, ascending, block_rows):
    frame = _values()
    rows = [(g, t, None if v != v else v) for g, t, v in frame.itertuples(index=False)]
    got = with_ranks(
        spark.createDataFrame(rows, "g string, ticker string, v double"), ["g"], "v",
        ascending=ascending, ordinal="o", minimum="m", average="a", percent="p", block_rows=block_rows,
    ).toPandas()
    got = by_key(got, "g", "ticker")
    want = by_key(frame, "g", "ticker")
    grouped = want.groupby("g")["v"]
    for column, method, pct in (("o", "first", False), ("m", "min", False), ("a", "average", False), ("p", "average", True)):
        expected = grouped.rank(method=method, ascending=ascending, pct=pct)
        np.testing.assert_allclose(got[column].astype(float), expected, rtol=1e-12)


def test_one_value_of_most_names_is_ordered_in_many_pieces(spark):
    """90% of a date share a value, the rest lies within a percent: no piece holds a large part of the date."""
    names, block = 40_000, 500
    frame = spark.range(names).select(
        F.lit("d").alias("g"),
        F.format_string("COMMONPREFIX%08d", "id").alias("ticker"),
        F.when(F.col("id") % 10 > 0, F.lit(7.0)).otherwise(7.0 + F.col("id") / (names * 100.0)).alias("v"),
    )
    ranked = with_ranks(frame, ["g"], "v", ordinal="o", minimum="m", block_rows=block)
    want = frame.toPandas().sort_values(["v", "ticker"], ignore_index=True)
    got = ranked.toPandas().sort_values(["v", "ticker"], ignore_index=True)
    assert (got["o"] == np.arange(1, names + 1)).all()
    assert (got["m"] == want["v"].rank(method="min")).all()
    # The windows sort what one (group, bucket, segment, slice) holds; the cuts bound it.
    rows = frame.withColumn("__bucket", value_bucket(F.col("v")))
    cuts = ranking._value_cuts(rows, ["g"], "v", "ticker", block).collect()
    drawn = {(c["value"], c["tie"]) for row in cuts for c in row["__cuts"]}
    marks = sorted(i for i, k in enumerate(zip(want["v"], want["ticker"])) if k in drawn)
    assert max(np.diff([0, *marks, names])) <= 12 * block
    assert names / block / 2 <= len(drawn) <= names / block * 2


def test_quantiles_match_numpy(spark):
    frame = _values().dropna()
    got = group_quantiles(spark.createDataFrame(frame), ["g"], "v", {"a": 0.0, "b": 0.13, "c": 0.5, "d": 1.0}).toPandas()
    for row in got.itertuples():
        values = frame.loc[frame["g"] == row.g, "v"]
        np.testing.assert_allclose([row.a, row.b, row.c, row.d], np.quantile(values, [0, 0.13, 0.5, 1.0]), rtol=1e-12, atol=1e-15)


def test_buckets_grow_with_the_value(spark):
    values = sorted([0.0, -0.0, 1e-300, -1e-300, 1e300, -5.0, 0.1, 0.1000001, 7.0, -1e-9, 3.0, 2.9999])
    frame = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", value_bucket(F.col("v")))
    got = frame.toPandas().sort_values("v")
    assert got["b"].is_monotonic_increasing


def test_top_n_prunes_before_the_shuffle(spark):
    frame = spark.createDataFrame(_values().dropna())
    plan = top_n(frame, ["g"], [F.col("v").desc(), F.col("ticker")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_tick_rounding_follows_floor_division(spark):
    prices = [round(0.01 * k, 2) for k in range(1, 7500, 7)]

    def tick(p: float) -> float:
        return 0.01 if p < 10 else 0.05 if p < 50 else 0.1

    got = spark.createDataFrame([(p,) for p in prices], "p double").select(
        "p", tick_size("p").alias("t"), floor_to_tick("p").alias("d"), ceil_to_tick("p").alias("u")
    ).toPandas()
    for row in got.itertuples():
        assert row.t == tick(row.p)
        assert row.d == row.p // tick(row.p) * tick(row.p)
        assert row.u == -(-row.p // tick(row.p)) * tick(row.p)


def test_correlation_of_a_constant_is_null(spark):
    frame = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", None, 9.0)], "g string, x double, y double")
    got = {r["g"]: r["c"] for r in frame.groupBy("g").agg(pearson("x", "y").alias("c")).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0)


def test_run_lengths(spark):
    flags = [False, True, True, False, True, True, True, False]
    frame = spark.createDataFrame([(d, "A", f) for d, f in zip(days(8), flags)], "date date, ticker string, f boolean")
    got = with_run_lengths(frame, {"f": "n"}, ["ticker"]).orderBy("date").toPandas()
    assert got["n"].tolist() == [0, 1, 2, 0, 1, 2, 3, 0]


def test_trading_calendar(spark):
    holiday = dt.date(2024, 1, 1)
    calendar = da.trading_calendar(spark, dt.date(2023, 12, 25), dt.date(2024, 1, 12), [holiday])
    frame = spark.createDataFrame([(dt.date(2023, 12, 29),), (holiday,), (dt.date(2024, 1, 6),)], "day date")
    got = da.nearest_trading_days(frame, calendar, "day").orderBy("day").collect()
    assert [r["is_trading_day"] for r in got] == [True, False, False]
    assert got[1]["on_or_before"] == dt.date(2023, 12, 29) and got[1]["on_or_after"] == dt.date(2024, 1, 2)
    assert got[2]["on_or_before"] == dt.date(2024, 1, 5)
    moved = da.shift_trading_days(frame, calendar, "day", 2, "later").where("day = DATE '2023-12-29'").first()
    assert moved["later"] == dt.date(2024, 1, 3)


@pytest.mark.parametrize(
    ("hour", "expected", "status"),
    [(9, dt.date(2024, 1, 5), "ok"), (8, dt.date(2024, 1, 4), "unexpected_data_date")],
)
def test_signal_timing_uses_the_local_cutoff(spark, hour, expected, status):
    calendar = da.trading_calendar(spark, dt.date(2023, 12, 25), dt.date(2024, 1, 19))
    run = dt.datetime(2024, 1, 5, hour, 0, tzinfo=dt.timezone.utc)
    row = da.signal_timing(calendar, dt.date(2024, 1, 5), run, "Asia/Bangkok", "15:15", "08:45").first()
    assert row["expected_data_date"] == expected and row["timing_status"] == status
    assert row["intended_execution_date"] == dt.date(2024, 1, 8)


def test_late_submission_is_stale(spark):
    calendar = da.trading_calendar(spark, dt.date(2023, 12, 25), dt.date(2024, 1, 19))
    run = dt.datetime(2024, 1, 8, 2, 0, tzinfo=dt.timezone.utc)
    row = da.signal_timing(calendar, dt.date(2024, 1, 5), run, "Asia/Bangkok", "15:15", "08:45").first()
    assert row["timing_status"] == "submission_cutoff_passed"
    with pytest.raises(ValueError, match="needs a time zone"):
        da.latest_completed_day(calendar, dt.datetime(2024, 1, 8), "UTC", "15:15")


def test_week_ending_friday(spark):
    frame = spark.createDataFrame([(d,) for d in days(10)], "date date")
    got = frame.select("date", da.week_ending_friday("date").alias("w")).toPandas()
    expected = pd.to_datetime(got["date"]).dt.to_period("W-FRI").dt.end_time.dt.date
    assert got["w"].tolist() == expected.tolist()


def test_panel_helper_has_gaps():
    assert len(price_panel(3, 50, gaps=0.3)) < 150
