"""Panel, feature, label, universe and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import panel
from catalog.panel import _W, lag_return, rolled, tick_down, tick_up
from catalog.registry import query, relation
from tidepanel.functions.dates import date_index, with_date_index
from tidepanel.functions.numeric import ceiling_price, floor_price, floor_to_tick, tick_size
from tidepanel.functions.ranking import group_quantiles, with_ranks
from tidepanel.functions.rolling import with_run_lengths
from tidepanel.operators import features as fe
from tidepanel.operators import herding as he
from tidepanel.operators import labels as la
from tidepanel.operators import risk, splits
from tidepanel.operators import universe as un
from tidepanel.plans.features import combined_features, time_features
from tidepanel.session import checkpoint

# --- panel --------------------------------------------------------------------------

BARS = "date ticker open:5s high:5s low:5s close:5s adjusted_close:5s volume:i value_traded:2"


@query("a01_bars", BARS, "SELECT * FROM bars")
def _bars(spark, folder):
    return panel.bars(spark, folder)


@query("a01_wide_bars", BARS, "SELECT * FROM wide_bars")
def _wide(spark, folder):
    return panel.wide(spark, folder)


@query("a11_universe", "ticker issuer_group sector", "SELECT * FROM names")
def _universe(spark, folder):
    return panel.universe(spark, folder)


@query("g01_date_index", "date date_idx:i", "SELECT * FROM date_list")
def _dates(spark, folder):
    return date_index(panel.bars(spark, folder))


# --- time features --------------------------------------------------------------------


@query(
    "e01_returns",
    "date ticker simple_return_1d:9 log_return_1d:9 rolling_return_5d:9 rolling_return_20d:9",
    f"""SELECT date, ticker, {lag_return(1)} AS simple_return_1d,
        ln(adjusted_close / lag(adjusted_close) OVER ({_W})) AS log_return_1d,
        {lag_return(5)} AS rolling_return_5d, {lag_return(20)} AS rolling_return_20d FROM bars""",
)
def _returns(spark, folder):
    return fe.add_returns(panel.bars(spark, folder))


@query("e01_returns_wide", "date ticker simple_return_1d:9 rolling_return_5d:9",
       f"SELECT date, ticker, {lag_return(1)} AS simple_return_1d, {lag_return(5)} AS rolling_return_5d FROM wide_bars")
def _returns_wide(spark, folder):
    return fe.add_returns(panel.wide(spark, folder))


@query("e02_rolling_volatility", "date ticker rolling_vol_20d:8", "SELECT * FROM vols")
def _volatility(spark, folder):
    return fe.add_volatility(fe.add_returns(panel.bars(spark, folder)))


@query("e03_drawdown", "date ticker drawdown:9", "SELECT date, ticker, drawdown FROM moves")
def _drawdown(spark, folder):
    return fe.add_drawdown(panel.bars(spark, folder))


relation(
    "value_ranks",
    """SELECT date, ticker, average_daily_value_20d, CASE WHEN average_daily_value_20d IS NOT NULL THEN
         (rank() OVER (PARTITION BY date ORDER BY average_daily_value_20d NULLS LAST)
          + (count(*) OVER (PARTITION BY date, average_daily_value_20d) - 1) / 2.0)
         / count(average_daily_value_20d) OVER (PARTITION BY date) END AS traded_value_rank_20d FROM moves""",
)


@query(
    "e04_volume_and_rank",
    "date ticker average_daily_volume_20d:4 average_daily_value_20d:5 traded_value_rank_20d:8",
    "SELECT moves.date, moves.ticker, average_daily_volume_20d, moves.average_daily_value_20d, traded_value_rank_20d "
    "FROM moves JOIN value_ranks USING (date, ticker)",
)
def _volume_rank(spark, folder):
    return fe.add_traded_value_rank(fe.add_average_volume(panel.bars(spark, folder)))


@query(
    "e04_volume_and_rank_wide",
    "date ticker average_daily_value_20d:5 traded_value_rank_20d:8",
    f"""SELECT date, ticker, v AS average_daily_value_20d, CASE WHEN v IS NOT NULL THEN
        (rank() OVER (PARTITION BY date ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0)
        / count(v) OVER (PARTITION BY date) END AS traded_value_rank_20d
        FROM (SELECT date, ticker, {rolled('avg', 'value_traded', 20)} AS v FROM wide_bars)""",
)
def _volume_rank_wide(spark, folder):
    return fe.add_traded_value_rank(fe.add_average_volume(panel.wide(spark, folder)))


MOMENTUM = " ".join(f"return_{k}d:8" for k in (1, 3, 5, 10, 20, 60))


@query(
    "e05_momentum",
    f"date ticker {MOMENTUM} distance_from_20d_high:8 distance_from_20d_low:8 negative_shock_1d:8 positive_shock_1d:8",
    """SELECT *, CASE WHEN return_1d < 0 THEN return_1d WHEN return_1d >= 0 THEN 0 END AS negative_shock_1d,
       CASE WHEN return_1d > 0 THEN return_1d WHEN return_1d <= 0 THEN 0 END AS positive_shock_1d FROM moves""",
)
def _momentum(spark, folder):
    return fe.add_momentum(panel.bars(spark, folder))


relation(
    "liquid",
    f"""SELECT *, (volume - ({rolled('avg', 'volume', 20)})) / nullif({rolled('stddev_samp', 'volume', 20)}, 0) AS volume_z_20,
        (value_traded - ({rolled('avg', 'value_traded', 20)})) / nullif({rolled('stddev_samp', 'value_traded', 20)}, 0) AS value_traded_z_20,
        volume / lag(CAST(volume AS DOUBLE), 5) OVER ({_W}) - 1 AS volume_change_5d,
        abs(return_1d) / nullif(value_traded, 0) AS amihud_illiquidity_raw FROM moves""",
)
relation(
    "amihud",
    """SELECT date, ticker, greatest(least(amihud_illiquidity_raw, hi), lo) AS amihud_illiquidity
       FROM liquid JOIN (SELECT date, quantile_cont(amihud_illiquidity_raw, 0.01) AS lo,
                                quantile_cont(amihud_illiquidity_raw, 0.99) AS hi FROM liquid GROUP BY date) USING (date)
       WHERE amihud_illiquidity_raw IS NOT NULL""",
)


@query(
    "e06_z_scores",
    "date ticker volume_z_20:7 value_traded_z_20:7",
    "SELECT date, ticker, volume_z_20, value_traded_z_20 FROM liquid",
)
def _z_scores(spark, folder):
    return fe.add_liquidity(fe.add_momentum(panel.bars(spark, folder)))


@query(
    "e07_liquidity",
    "date ticker volume_z_20:7 volume_change_5d:8 amihud_illiquidity_raw:14 amihud_illiquidity:14 abnormal_volume_flag",
    """SELECT liquid.*, amihud_illiquidity, coalesce(abs(volume_z_20) >= 2, false) AS abnormal_volume_flag
       FROM liquid LEFT JOIN amihud USING (date, ticker)""",
)
def _liquidity(spark, folder):
    return fe.add_liquidity(fe.add_momentum(panel.bars(spark, folder)))


@query(
    "d06_winsorised",
    "date ticker amihud_illiquidity:14",
    "SELECT * FROM amihud",
)
def _winsorised(spark, folder):
    rows = fe.add_momentum(panel.bars(spark, folder)).withColumn(
        "raw", F.try_divide(F.abs("return_1d"), F.col("value_traded"))
    )
    return fe.winsorised(rows, "raw", "amihud_illiquidity").where("raw IS NOT NULL")


@query(
    "d06_quantiles_wide",
    "date low:6 middle:6 high:6",
    """SELECT date, quantile_cont(value_traded, 0.01) AS low, quantile_cont(value_traded, 0.5) AS middle,
       quantile_cont(value_traded, 0.99) AS high FROM wide_bars GROUP BY date""",
)
def _quantiles_wide(spark, folder):
    return group_quantiles(
        panel.wide(spark, folder), ["date"], "value_traded", {"low": 0.01, "middle": 0.5, "high": 0.99}
    )


@query(
    "e08_liquidity_ranking",
    "date ticker value_traded_rank:i volume_rank:i amihud_rank:i liquidity_rank_score:i liquidity_rank:i",
    """SELECT *, rank() OVER (ORDER BY liquidity_rank_score) AS liquidity_rank FROM (
         SELECT *, value_traded_rank + volume_rank + amihud_rank AS liquidity_rank_score FROM (
           SELECT l.date, l.ticker, rank() OVER (ORDER BY value_traded DESC) AS value_traded_rank,
                  rank() OVER (ORDER BY volume DESC) AS volume_rank, rank() OVER (ORDER BY amihud_illiquidity) AS amihud_rank
           FROM liquid l JOIN amihud USING (date, ticker) WHERE l.date = (SELECT max(date) FROM bars)))""",
)
def _liquidity_ranking(spark, folder):
    return fe.rank_by_liquidity(fe.add_liquidity(fe.add_momentum(panel.bars(spark, folder))))


LIMITS = (
    "date ticker reference_price:5s estimated_ceiling_price:6 estimated_floor_price:6 distance_to_ceiling:8 "
    "distance_to_floor:8 hit_ceiling_today hit_floor_today close_at_ceiling_today close_at_floor_today"
)


@query("e09_price_limits", LIMITS, "SELECT * FROM limits")
def _limits(spark, folder):
    return fe.add_price_limits(panel.bars(spark, folder))


def _runs(flag: str, output: str, source: str, rest: str = "") -> str:
    return f"""SELECT date, ticker, CAST(sum(CAST({flag} AS INT)) OVER (PARTITION BY ticker, island ORDER BY date) AS BIGINT) AS {output}{rest}
       FROM (SELECT *, sum(CAST(NOT {flag} AS INT)) OVER (PARTITION BY ticker ORDER BY date) AS island FROM {source})"""


relation("ceiling_runs", _runs("hit_ceiling_today", "consecutive_ceiling_days", "limits"))
relation("floor_runs", _runs("hit_floor_today", "consecutive_floor_days", "limits"))


@query(
    "e10_limit_streaks",
    "date ticker consecutive_ceiling_days:i consecutive_floor_days:i",
    "SELECT * FROM ceiling_runs JOIN floor_runs USING (date, ticker)",
)
def _streaks(spark, folder):
    return fe.add_price_limits(panel.bars(spark, folder))


@query(
    "e10_up_streaks_wide",
    "date ticker streak:i",
    _runs("up", "streak", "(SELECT date, ticker, coalesce(adjusted_close > lag(adjusted_close) OVER (PARTITION BY ticker ORDER BY date), false) AS up FROM wide_bars)"),
)
def _up_streaks(spark, folder):
    rows = fe.add_returns(panel.wide(spark, folder)).withColumn(
        "up", F.coalesce(F.col("simple_return_1d") > 0, F.lit(False))
    )
    return with_run_lengths(rows, {"up": "streak"}, ["ticker"])


@query(
    "h01_tick_prices",
    "date ticker tick:4 down:6 ceiling:6 floor:6 wide_ceiling:6",
    f"""SELECT date, ticker, CASE WHEN p < 10 THEN 0.01 WHEN p < 50 THEN 0.05 ELSE 0.1 END AS tick,
        {tick_down('p')} AS down, {tick_down('(p * 1.07::DOUBLE)')} AS ceiling,
        {tick_up('(p * 0.9299999999999999::DOUBLE)')} AS floor, {tick_down('(p * 1.2::DOUBLE)')} AS wide_ceiling
        FROM (SELECT date, ticker, close / 100 AS p FROM bars)""",
)
def _ticks(spark, folder):
    rows = panel.bars(spark, folder).withColumn("p", F.col("close") / 100)
    return rows.select(
        "date", "ticker", tick_size("p").alias("tick"), floor_to_tick("p").alias("down"),
        ceiling_price("p").alias("ceiling"), floor_price("p").alias("floor"),
        ceiling_price("p", 0.20).alias("wide_ceiling"),
    )


@query(
    "e26_snapshot",
    "data_date ticker price:4 average_daily_value:0 at_ceiling at_floor",
    f"""SELECT * FROM (SELECT l.date AS data_date, l.ticker, l.close * 1000 AS price,
         avg(l.close * l.volume * 1000) OVER (PARTITION BY l.ticker ORDER BY l.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS average_daily_value,
         close_at_ceiling_today AS at_ceiling, close_at_floor_today AS at_floor FROM limits l)
       WHERE data_date = (SELECT max(date) FROM bars)""",
)
def _snapshot(spark, folder):
    return fe.snapshot_average_value(panel.bars(spark, folder))


# --- cross-sections and herding ---------------------------------------------------------

relation(
    "top_values",
    """SELECT date, CASE WHEN sum(value_traded) > 0 THEN sum(CASE WHEN place <= 5 THEN value_traded END) / sum(value_traded) END AS volume_concentration_top5
       FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value_traded DESC, ticker) AS place FROM bars) GROUP BY date""",
)
relation(
    "daily_state",
    """SELECT date, stddev_pop(return_1d) AS market_return_dispersion,
       avg(CASE WHEN return_1d > 0 THEN 1.0 ELSE 0.0 END) AS percent_stocks_up,
       avg(CASE WHEN return_1d < 0 THEN 1.0 ELSE 0.0 END) AS percent_stocks_down,
       avg(CASE WHEN hit_ceiling_today THEN 1.0 ELSE 0.0 END) AS percent_hitting_ceiling,
       avg(CASE WHEN hit_floor_today THEN 1.0 ELSE 0.0 END) AS percent_hitting_floor,
       any_value(volume_concentration_top5) AS volume_concentration_top5
       FROM limits JOIN top_values USING (date) GROUP BY date""",
)
STATE = (
    "date market_return_dispersion:8 percent_stocks_up:8 percent_stocks_down:8 percent_hitting_ceiling:8 "
    "percent_hitting_floor:8 volume_concentration_top5:8"
)


@query("d01_daily_state", STATE, "SELECT * FROM daily_state")
def _daily_state(spark, folder):
    return he.cross_sectional_state(panel.features(spark, folder))


@query("d02_value_concentration", "date volume_concentration_top5:8", "SELECT * FROM top_values")
def _concentration(spark, folder):
    return he.value_concentration(panel.bars(spark, folder))


@query(
    "d02_value_concentration_wide",
    "date volume_concentration_top5:8",
    """SELECT date, sum(CASE WHEN place <= 5 THEN value_traded END) / sum(value_traded) AS volume_concentration_top5
       FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value_traded DESC, ticker) AS place FROM wide_bars) GROUP BY date""",
)
def _concentration_wide(spark, folder):
    return he.value_concentration(panel.wide(spark, folder))


relation(
    "pair_corr",
    """SELECT date_idx, avg(c) AS rolling_avg_pairwise_corr FROM (
         SELECT e.date_idx, x.ticker AS t1, y.ticker AS t2,
                CASE WHEN var_pop(x.return_1d) > 0 AND var_pop(y.return_1d) > 0 THEN corr(x.return_1d, y.return_1d) END AS c
         FROM (SELECT * FROM moves JOIN date_list USING (date) WHERE return_1d IS NOT NULL) x
         JOIN (SELECT * FROM moves JOIN date_list USING (date) WHERE return_1d IS NOT NULL) y
           ON x.date_idx = y.date_idx AND x.ticker < y.ticker
         JOIN date_list e ON e.date_idx >= 19 AND x.date_idx BETWEEN e.date_idx - 19 AND e.date_idx
         GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY date_idx""",
)


@query(
    "e12_pairwise_correlation",
    "date rolling_avg_pairwise_corr:8",
    "SELECT date, rolling_avg_pairwise_corr FROM date_list LEFT JOIN pair_corr USING (date_idx)",
)
def _pairwise(spark, folder):
    return he.average_pairwise_correlation(fe.add_momentum(panel.bars(spark, folder)), pairs="available")


# Names with a value on each of the last 20 dates; a window sum of standard scores per date gives all pairs.
relation(
    "wide_runs",
    """SELECT *, count(*) OVER w AS n, avg(r) OVER w AS m, stddev_pop(r) OVER w * sqrt(20) AS s, list(r) OVER w AS rs FROM (
         SELECT date_idx, ticker, adjusted_close / lag(adjusted_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM wide_bars JOIN wide_dates USING (date)) WHERE r IS NOT NULL
       WINDOW w AS (PARTITION BY ticker ORDER BY date_idx RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
relation("wide_dates", "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS date_idx FROM (SELECT DISTINCT date FROM wide_bars)")
relation(
    "wide_pairs",
    """SELECT date_idx, any_value(k) AS names, sum(z * z) AS squares FROM (
         SELECT date_idx, day, count(*) AS k, sum(z) AS z FROM (
           SELECT date_idx, unnest(range(20)) AS day, unnest(list_transform(rs, lambda x: (x - m) / s)) AS z FROM wide_runs WHERE n = 20 AND list_max(rs) > list_min(rs)) GROUP BY 1, 2) GROUP BY 1""",
)
relation(
    "wide_seen",
    """SELECT e.date_idx, count(DISTINCT ticker) AS seen FROM wide_dates e JOIN wide_runs r ON r.date_idx BETWEEN e.date_idx - 19 AND e.date_idx WHERE e.date_idx >= 19 GROUP BY 1""",
)


@query(
    "e12_complete_correlation_wide",
    "date rolling_avg_pairwise_corr:7 complete_share:8",
    """SELECT date, CASE WHEN names > 1 THEN (squares - names) / (names * (names - 1)) END AS rolling_avg_pairwise_corr,
         CASE WHEN seen IS NOT NULL THEN coalesce(names, 0) / seen END AS complete_share
       FROM wide_dates LEFT JOIN wide_pairs USING (date_idx) LEFT JOIN wide_seen USING (date_idx)""",
)
def _complete_wide(spark, folder):
    return he.complete_window_correlation(fe.add_momentum(panel.wide(spark, folder)))


@query(
    "e13_correlation_attached",
    "date ticker rolling_avg_pairwise_corr:8",
    "SELECT date, ticker, rolling_avg_pairwise_corr FROM bars JOIN date_list USING (date) LEFT JOIN pair_corr USING (date_idx)",
)
def _pairwise_attached(spark, folder):
    rows = fe.add_momentum(panel.bars(spark, folder))
    return rows.join(F.broadcast(he.average_pairwise_correlation(rows, pairs="available")), "date", "left")


def _expanding(value: str, sign: str) -> str:
    return (
        f"(SELECT avg(CASE WHEN p.{value} {sign} s.{value} THEN 1.0 ELSE 0.0 END) FROM herd_input p "
        f"WHERE p.date <= s.date AND p.{value} IS NOT NULL)"
    )


relation(
    "herd_input",
    """SELECT daily_state.*, rolling_avg_pairwise_corr, greatest(percent_stocks_up, percent_stocks_down) AS market_direction_agreement,
       percent_hitting_ceiling + percent_hitting_floor AS price_limit_pressure
       FROM daily_state JOIN date_list USING (date) LEFT JOIN pair_corr USING (date_idx)""",
)
relation(
    "herd_scores",
    "SELECT s.*, "
    + ", ".join(
        f"CASE WHEN s.{value} IS NOT NULL THEN {_expanding(value, sign)} END AS {name}"
        for name, value, sign in (
            ("herding_corr_score", "rolling_avg_pairwise_corr", "<="),
            ("herding_low_dispersion_score", "market_return_dispersion", ">="),
            ("herding_direction_score", "market_direction_agreement", "<="),
            ("herding_price_limit_score", "price_limit_pressure", "<="),
            ("herding_volume_concentration_score", "volume_concentration_top5", "<="),
        )
    )
    + " FROM herd_input s",
)
relation(
    "herd",
    """SELECT *, list_avg([herding_corr_score, herding_low_dispersion_score, herding_direction_score,
       herding_price_limit_score, herding_volume_concentration_score]) AS herding_index FROM herd_scores""",
)


@query(
    "e14_expanding_percentile",
    "date market_return_dispersion:8 herding_low_dispersion_score:8",
    "SELECT * FROM herd_scores",
)
def _expanding_percentile(spark, folder):
    state = checkpoint(he.cross_sectional_state(panel.features(spark, folder)))
    return he.with_expanding_percentiles(state, {"herding_low_dispersion_score": ("market_return_dispersion", False)})


HERD = (
    "date market_direction_agreement:8 price_limit_pressure:8 herding_corr_score:8 herding_low_dispersion_score:8 "
    "herding_direction_score:8 herding_price_limit_score:8 herding_volume_concentration_score:8 herding_index:8"
)


@query("e15_herding_index", HERD, "SELECT * FROM herd")
def _herding(spark, folder):
    return he.daily_herding(panel.features(spark, folder), pairs="available")


@query(
    "f04_extreme_herding_dates",
    "date herding_index:8",
    "SELECT date, herding_index FROM herd ORDER BY herding_index DESC NULLS LAST, date LIMIT 5",
)
def _extreme(spark, folder):
    return he.extreme_herding_dates(he.daily_herding(panel.features(spark, folder), pairs="available"))


@query(
    "c02_herding_state",
    "date herding_corr_score:8 high_herding_day",
    "SELECT date, herding_corr_score, coalesce(herding_corr_score >= 0.8, false) AS high_herding_day FROM herd",
)
def _herding_state(spark, folder):
    return he.herding_state(he.daily_herding(panel.features(spark, folder), pairs="available"))


# --- risk ---------------------------------------------------------------------------------

relation(
    "market",
    """SELECT date, ticker, return_1d, avg(return_1d) OVER (PARTITION BY date) AS market_return_1d FROM moves""",
)


@query(
    "d05_market_return",
    "date ticker market_return_1d:8 stock_minus_market_return_1d:8",
    "SELECT *, return_1d - market_return_1d AS stock_minus_market_return_1d FROM market",
)
def _market(spark, folder):
    return risk.with_market_return(fe.add_momentum(panel.bars(spark, folder)))


_F60 = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query(
    "e16_rolling_beta",
    "date ticker rolling_covariance_with_market:8 rolling_market_variance:8 rolling_beta_to_market:6 residual_return_1d:6",
    f"""SELECT *, return_1d - rolling_beta_to_market * market_return_1d AS residual_return_1d FROM (
        SELECT *, rolling_covariance_with_market / nullif(rolling_market_variance, 0) AS rolling_beta_to_market FROM (
        SELECT *, CASE WHEN count(CASE WHEN s IS NOT NULL AND m IS NOT NULL THEN 1 END) OVER {_F60} >= 20 THEN covar_samp(s, m) OVER {_F60} END AS rolling_covariance_with_market,
               CASE WHEN count(m) OVER {_F60} >= 20 THEN var_samp(m) OVER {_F60} END AS rolling_market_variance
        FROM (SELECT *, lag(return_1d) OVER (PARTITION BY ticker ORDER BY date) AS s,
                     lag(market_return_1d) OVER (PARTITION BY ticker ORDER BY date) AS m FROM market)))""",
)
def _beta(spark, folder):
    """The market return and the names' own returns read one stored table, so the lines are scanned once."""
    return risk.rolling_beta(risk.with_market_return(checkpoint(fe.add_momentum(panel.bars(spark, folder)))))


# --- labels -------------------------------------------------------------------------------


@query(
    "e17_forward_labels",
    "date ticker forward_return_1d:8 forward_return_5d:8 forward_return_10d:8",
    "SELECT * FROM forwards",
)
def _forward(spark, folder):
    return la.forward_labels(panel.bars(spark, folder))


relation(
    "index_prices",
    "SELECT date, sum(value_traded) / CAST(sum(volume) AS DOUBLE) AS adjusted_close FROM bars GROUP BY date",
)
relation(
    "index_forwards",
    "SELECT date, "
    + ", ".join(
        f"lead(adjusted_close, {h}) OVER (ORDER BY date) / adjusted_close - 1 AS benchmark_forward_return_{h}d" for h in (1, 5, 10)
    )
    + " FROM index_prices",
)


def index_prices(spark, folder):
    """Index price per date: value over volume of the whole market."""
    return panel.bars(spark, folder).groupBy("date").agg(
        (F.sum("value_traded") / F.sum("volume").cast("double")).alias("adjusted_close")
    )


BENCH = "benchmark_forward_return_1d:8 benchmark_forward_return_5d:8 benchmark_forward_return_10d:8"
RELATIVE = "forward_relative_return_1d:8 forward_relative_return_5d:8 forward_relative_return_10d:8"


@query("e18_index_forward_returns", f"date {BENCH}", "SELECT * FROM index_forwards")
def _index_forward(spark, folder):
    return la.index_forward_returns(index_prices(spark, folder))


@query(
    "e19_relative_to_index",
    f"date ticker {RELATIVE}",
    "SELECT *, "
    + ", ".join(f"forward_return_{h}d - benchmark_forward_return_{h}d AS forward_relative_return_{h}d" for h in (1, 5, 10))
    + " FROM forwards LEFT JOIN index_forwards USING (date)",
)
def _relative_index(spark, folder):
    return la.relative_to_benchmark(
        la.forward_labels(panel.bars(spark, folder)), la.index_forward_returns(index_prices(spark, folder))
    )


@query(
    "d03_equal_weight_benchmark",
    f"date {BENCH}",
    "SELECT date, " + ", ".join(f"avg(forward_return_{h}d) AS benchmark_forward_return_{h}d" for h in (1, 5, 10)) + " FROM forwards GROUP BY date",
)
def _equal_benchmark(spark, folder):
    return la.equal_weight_forward_returns(la.forward_labels(panel.bars(spark, folder)))


@query("d04_leave_one_out", f"date ticker {BENCH} {RELATIVE}", "SELECT * FROM loo")
def _leave_one_out(spark, folder):
    return panel.labels(spark, folder)


relation(
    "quintiles",
    """SELECT *, CASE WHEN target IS NOT NULL THEN CAST(place <= greatest(1, ceil(0.2 * known)) AS INT) END AS top_quintile_label
       FROM (SELECT date, ticker, forward_relative_return_5d AS target,
             row_number() OVER (PARTITION BY date ORDER BY forward_relative_return_5d DESC NULLS LAST, ticker) AS place,
             count(forward_relative_return_5d) OVER (PARTITION BY date) AS known FROM loo)""",
)


@query("g05_top_quintile", "date ticker target:8 top_quintile_label:1", "SELECT * FROM quintiles")
def _quintile(spark, folder):
    rows = panel.labels(spark, folder).withColumn("target", F.col("forward_relative_return_5d"))
    return la.top_quintile_label(rows, "target")


@query(
    "c01_modelling_dataset",
    "date ticker return_10d:8 drawdown:8 rolling_vol_20d:8 target:8",
    """SELECT moves.date, moves.ticker, return_10d, drawdown, rolling_vol_20d, forward_relative_return_5d AS target
       FROM moves JOIN vols USING (date, ticker) LEFT JOIN loo USING (date, ticker)""",
)
def _dataset(spark, folder):
    return la.modelling_dataset(panel.features(spark, folder), panel.labels(spark, folder), "forward_relative_return_5d")


@query(
    "c01_key_violations",
    "date ticker copies:i",
    "SELECT date, ticker, count(*) AS copies FROM (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS ticker FROM lineitem) GROUP BY 1, 2 HAVING count(*) > 1",
)
def _key_violations(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").cast("string").alias("ticker")
    )
    return la.key_violations(lines)


@query(
    "b03_target_split",
    "part row_count:i date_count:i",
    """SELECT CASE WHEN forward_relative_return_5d IS NULL THEN 'prediction' ELSE 'historical' END AS part,
       count(*) AS row_count, count(DISTINCT date) AS date_count FROM loo GROUP BY 1""",
)
def _target_split(spark, folder):
    rows = panel.labels(spark, folder).withColumn("target", F.col("forward_relative_return_5d"))
    parts = la.known_targets(rows).withColumn("part", F.lit("historical")).unionByName(
        la.unknown_targets(rows).withColumn("part", F.lit("prediction"))
    )
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("date").alias("date_count")
    )


# --- universe ------------------------------------------------------------------------------


@query(
    "c03_point_in_time",
    "date ticker close:5s",
    """SELECT date, bars.ticker, close FROM bars JOIN members ON bars.ticker = members.ticker
       AND date >= effective_from AND date <= coalesce(effective_to, DATE '9999-12-31')""",
)
def _point_in_time(spark, folder):
    return un.point_in_time(panel.bars(spark, folder), panel.membership(spark, folder))


@query(
    "c04_membership_problems",
    "ticker effective_from problem",
    """SELECT upper(ticker) AS ticker, effective_from, 'overlap' AS problem FROM (
         SELECT *, max(coalesce(effective_to, DATE '9999-12-31')) OVER (PARTITION BY ticker ORDER BY effective_from
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
         FROM (SELECT * FROM members UNION ALL SELECT ticker, effective_from + 700, NULL FROM members))
       WHERE effective_from <= earlier""",
)
def _membership_problems(spark, folder):
    first = panel.membership(spark, folder)
    second = first.select(
        "ticker", F.date_add("effective_from", 700).alias("effective_from"), F.lit(None).cast("date").alias("effective_to")
    )
    return un.membership_problems(un.normalise_membership(first.unionByName(second)))


relation(
    "coverage",
    """SELECT d.date, count(DISTINCT m.ticker) AS active_constituents, 25 AS expected_constituents,
       count(DISTINCT m.ticker) = 25 AS coverage_complete
       FROM date_list d LEFT JOIN members m ON d.date >= m.effective_from AND d.date <= coalesce(m.effective_to, DATE '9999-12-31')
       GROUP BY d.date""",
)


@query(
    "c05_membership_coverage",
    "date active_constituents:i expected_constituents:i coverage_complete",
    "SELECT * FROM coverage",
)
def _coverage(spark, folder):
    return un.membership_coverage(panel.membership(spark, folder), panel.bars(spark, folder), 25)


@query(
    "j07_coverage_audit",
    "date active_constituents:i coverage_complete member_rows:i",
    """SELECT c.*, coalesce(n, 0) AS member_rows FROM coverage c LEFT JOIN (
         SELECT date, count(*) AS n FROM bars JOIN members ON bars.ticker = members.ticker AND date >= effective_from
           AND date <= coalesce(effective_to, DATE '9999-12-31') GROUP BY date) p ON c.date = p.date""",
)
def _coverage_audit(spark, folder):
    return un.coverage_audit(panel.bars(spark, folder), panel.membership(spark, folder), 25)


# --- splits -----------------------------------------------------------------------------------

relation("span", "SELECT CAST(count(*) AS INT) AS dates FROM date_list")
relation(
    "windows",
    """SELECT CAST(s.start AS INT) AS window_id, o.role, CAST(s.start + o.k AS INT) AS date_idx
       FROM (SELECT unnest(range(0, (SELECT dates FROM span) - 15 + 1)) AS start) s,
            (SELECT 'train' AS role, unnest([0, 1, 2]) AS k UNION ALL SELECT 'validation', 8 UNION ALL SELECT 'test', 14) o""",
)


@query(
    "g02_walk_forward_windows",
    "window_id:i role date_idx:i date",
    "SELECT windows.*, date FROM windows JOIN date_list USING (date_idx)",
)
def _windows(spark, folder):
    return splits.walk_forward_windows(panel.bars(spark, folder))


@query(
    "b06_window_rows",
    "window_id:i role date ticker close:5s",
    """SELECT window_id, role, date, ticker, close FROM windows JOIN date_list USING (date_idx) JOIN bars USING (date)
       JOIN loo USING (date, ticker) WHERE forward_relative_return_5d IS NOT NULL""",
)
def _window_rows(spark, folder):
    rows = panel.bars(spark, folder)
    labelled = la.modelling_dataset(rows, panel.labels(spark, folder), "forward_relative_return_5d")
    return splits.window_rows(labelled, splits.walk_forward_windows(rows), label="target")


@query(
    "g04_expanding_signals",
    "signal_date training_cutoff signal_idx:i cutoff_idx:i training_date_count:i",
    """SELECT s.date AS signal_date, c.date AS training_cutoff, s.date_idx AS signal_idx, c.date_idx AS cutoff_idx, n AS training_date_count
       FROM date_list s JOIN date_list c ON s.date_idx = c.date_idx + 10
       JOIN (SELECT date, count(*) = count(forward_return_10d) AS complete,
                    sum(CASE WHEN count(forward_return_10d) > 0 THEN 1 ELSE 0 END) OVER (ORDER BY date) AS n FROM forwards GROUP BY date) k ON k.date = c.date
       JOIN (SELECT date, count(*) = count(forward_return_10d) AS complete FROM forwards GROUP BY date) t ON t.date = s.date
       WHERE s.date_idx >= 109 AND (s.date_idx - 109) % 10 = 0 AND t.complete AND n >= 100""",
)
def _expanding_signals(spark, folder):
    rows = panel.bars(spark, folder)
    signals = splits.expanding_signals(rows, horizon=10, minimum_dates=100)
    dataset = la.modelling_dataset(rows, la.forward_labels(rows), "forward_return_10d")
    return splits.usable_signals(signals, dataset, 100)


@query(
    "b02_feature_coverage",
    "feature known:i",
    """SELECT unnest(['return_1d', 'return_60d', 'drawdown', 'average_daily_value_20d']) AS feature,
       unnest([count(return_1d), count(return_60d), count(drawdown), count(average_daily_value_20d)]) AS known FROM moves""",
)
def _feature_coverage(spark, folder):
    rows = panel.features(spark, folder).select(
        "date", "ticker", "close", "return_1d", "return_60d", "drawdown", "average_daily_value_20d",
        F.lit(None).cast("double").alias("turnover_z_20"),
    )
    chosen = splits.feature_columns(rows)
    counts = rows.agg(*[F.count(c).alias(c) for c in chosen])
    return counts.withColumn("all", F.lit(1)).unpivot(["all"], chosen, "feature", "known")


@query(
    "f03_ordinal_ranks_wide",
    "date ticker place:i lowest:i middle:2",
    """SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY volume DESC, ticker) AS place,
       rank() OVER (PARTITION BY date ORDER BY volume DESC) AS lowest,
       rank() OVER (PARTITION BY date ORDER BY volume DESC) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0 AS middle FROM wide_bars""",
)
def _ordinal_wide(spark, folder):
    return with_ranks(
        panel.wide(spark, folder), ["date"], "volume", ascending=False, ordinal="place", minimum="lowest", average="middle"
    )


@query(
    "o01_combined_features",
    "date ticker return_20d:8 rolling_vol_20d:8 traded_value_rank_20d:8 consecutive_ceiling_days:i amihud_illiquidity:14 herding_index:8 market_return_dispersion:8",
    """SELECT moves.date, moves.ticker, return_20d, rolling_vol_20d, traded_value_rank_20d, consecutive_ceiling_days, amihud_illiquidity, herding_index, market_return_dispersion
       FROM moves JOIN vols USING (date, ticker) JOIN value_ranks USING (date, ticker) JOIN ceiling_runs USING (date, ticker)
       LEFT JOIN amihud USING (date, ticker) JOIN herd USING (date)""",
)
def _combined(spark, folder):
    return combined_features(panel.bars(spark, folder), pairs="available")


@query(
    "o01_time_features_wide",
    "date ticker return_20d:8 drawdown:8 rolling_vol_20d:8 average_daily_value_20d:5 hit_ceiling_today",
    f"""SELECT date, ticker, return_20d, drawdown, {rolled('stddev_samp', 'r', 20)} * sqrt(252) AS rolling_vol_20d,
        average_daily_value_20d, coalesce(high >= {tick_down('(ref * 1.07::DOUBLE)')}, false) AS hit_ceiling_today
        FROM (SELECT *, {lag_return(1)} AS r, {lag_return(20)} AS return_20d, lag(close) OVER ({_W}) AS ref,
              adjusted_close / max(adjusted_close) OVER ({_W}) - 1 AS drawdown,
              {rolled('avg', 'value_traded', 20)} AS average_daily_value_20d FROM wide_bars)""",
)
def _time_wide(spark, folder):
    return time_features(panel.wide(spark, folder))


@query(
    "j02_indexed_rows",
    "date ticker date_idx:i",
    "SELECT date, ticker, date_idx FROM wide_bars JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS date_idx FROM (SELECT DISTINCT date FROM wide_bars)) USING (date)",
)
def _indexed(spark, folder):
    return with_date_index(panel.wide(spark, folder))
