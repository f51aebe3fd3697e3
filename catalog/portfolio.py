"""Portfolio construction and backtest queries on the momentum predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import panel
from catalog.evaluation import _score_panel
from catalog.registry import query, relation
from tidepanel.operators import backtest as bt
from tidepanel.operators import herding as he
from tidepanel.operators import metrics as me
from tidepanel.operators import portfolio as po
from tidepanel.operators import selection as se
from tidepanel.operators import targets as ta
from tidepanel.plans import reports
from tidepanel.session import checkpoint

# --- SQL ------------------------------------------------------------------------------

relation(
    "chosen_preds",
    """SELECT p.date, p.ticker, predicted_return, actual_return, issuer_group, sector, coalesce(herding_corr_score >= 0.8, false) AS high_herding_day
       FROM preds p JOIN names USING (ticker) LEFT JOIN herd USING (date) WHERE model_name = 'momentum'""",
)
relation(
    "mode_rows",
    """SELECT m.mode AS optimization_mode, c.*, (m.mode = 'herding_aware' AND high_herding_day) AS careful FROM chosen_preds c,
       (SELECT unnest(['normal', 'herding_aware', 'sector_aware']) AS mode) m""",
)
relation(
    "mode_targets",
    """SELECT optimization_mode, date, ticker, issuer_group, sector, predicted_return,
         CASE WHEN optimization_mode = 'sector_aware' THEN wg * least(0.35 / sum(wg) OVER (PARTITION BY optimization_mode, date, sector), 1) ELSE wg END AS target_weight
       FROM (SELECT *, w0 * least(0.4 / sum(w0) OVER (PARTITION BY optimization_mode, date, issuer_group), 1) AS wg FROM (
         SELECT *, least(CASE WHEN careful THEN 0.75::DOUBLE ELSE 1 END / count(*) OVER (PARTITION BY optimization_mode, date), CASE WHEN careful THEN 0.15::DOUBLE ELSE 0.2::DOUBLE END) AS w0
         FROM (SELECT *, row_number() OVER (PARTITION BY optimization_mode, date ORDER BY predicted_return DESC, ticker) AS place
               FROM mode_rows WHERE NOT careful OR predicted_return > 0) WHERE place <= 5))""",
)
relation(
    "mode_steps",
    """SELECT optimization_mode, date, row_number() OVER (PARTITION BY optimization_mode ORDER BY date) AS step, wanted FROM (
         SELECT d.optimization_mode, d.date,
                map(coalesce(list(ticker ORDER BY ticker) FILTER (ticker IS NOT NULL), []),
                    coalesce(list(target_weight ORDER BY ticker) FILTER (ticker IS NOT NULL), [])) AS wanted
         FROM (SELECT DISTINCT optimization_mode, date FROM mode_rows) d LEFT JOIN mode_targets t
           ON d.optimization_mode = t.optimization_mode AND d.date = t.date GROUP BY 1, 2)""",
)


def _names(held: str, wanted: str) -> str:
    return f"list_sort(list_distinct(list_concat(map_keys({held}), map_keys({wanted}))))"


def _filtered(names: str, values: str, smallest: str) -> str:
    keep = f"list_filter(range(1, len({names}) + 1), lambda i: {values}[i] > {smallest})"
    return (
        f"map(list_transform({keep}, lambda i: {names}[i]), list_transform({keep}, lambda i: {values}[i]))"
    )


def _turnover_walk(name: str, limit: float) -> None:
    """Weights held date after date by every mode, with ``limit`` of turnover a date."""
    relation(
        name,
        f"""SELECT DISTINCT optimization_mode, CAST(0 AS BIGINT) AS step, CAST(NULL AS DATE) AS date,
               CAST(map([], []) AS MAP(VARCHAR, DOUBLE)) AS held, CAST(0 AS DOUBLE) AS portfolio_turnover FROM mode_steps
       UNION ALL
       SELECT optimization_mode, step, date, following,
              0.5 * coalesce(list_sum(list_transform({_names('held', 'following')}, lambda t: abs(coalesce(following[t], 0) - coalesce(held[t], 0)))), 0)
       FROM (SELECT *, {_filtered('names_now', 'moved', '1e-8')} AS following FROM (
         SELECT *, list_transform(names_now, lambda t: CASE WHEN needed <= {limit} + 1e-12 THEN coalesce(wanted[t], 0)
                   ELSE coalesce(held[t], 0) + ({limit} - 1e-6) / needed * (coalesce(wanted[t], 0) - coalesce(held[t], 0)) END) AS moved
         FROM (SELECT *, 0.5 * coalesce(list_sum(list_transform(names_now, lambda t: abs(coalesce(wanted[t], 0) - coalesce(held[t], 0)))), 0) AS needed
           FROM (SELECT s.optimization_mode, s.step, s.date, s.wanted, w.held, {_names('w.held', 's.wanted')} AS names_now
                 FROM {name} w JOIN mode_steps s ON s.optimization_mode = w.optimization_mode AND s.step = w.step + 1))))""",
    )


_turnover_walk("mode_walk", 0.4)
_turnover_walk("diversified_walk", 0.25)
relation(
    "mode_weights",
    """SELECT p.*, issuer_group, sector, predicted_return, actual_return, high_herding_day FROM (
         SELECT optimization_mode, date, portfolio_turnover, unnest(map_keys(held)) AS ticker, unnest(map_values(held)) AS weight
         FROM mode_walk WHERE step > 0) p JOIN names USING (ticker)
       LEFT JOIN (SELECT date, ticker, predicted_return, actual_return, high_herding_day FROM chosen_preds) c USING (date, ticker)""",
)
relation(
    "liquidity_rows",
    """SELECT date, ticker, close_at_ceiling_today, close_at_floor_today, coalesce(average_daily_value_20d <= cut, false) AS is_low_liquidity
       FROM limits JOIN (SELECT date, quantile_cont(average_daily_value_20d, 0.2) AS cut FROM limits GROUP BY date) USING (date)""",
)
relation(
    "execution_rows",
    """SELECT c.date, c.ticker, actual_return, close_at_ceiling_today, close_at_floor_today, is_low_liquidity
       FROM chosen_preds c LEFT JOIN liquidity_rows l ON c.date = l.date AND c.ticker = l.ticker""",
)
relation(
    "limit_steps",
    """SELECT w.optimization_mode, w.date, row_number() OVER (PARTITION BY w.optimization_mode ORDER BY w.date) AS step, wanted, ceilings, floors FROM (
         SELECT optimization_mode, date, map(list(ticker ORDER BY ticker), list(weight ORDER BY ticker)) AS wanted FROM mode_weights GROUP BY 1, 2) w
       LEFT JOIN (SELECT date, coalesce(list(ticker) FILTER (close_at_ceiling_today), []) AS ceilings,
                         coalesce(list(ticker) FILTER (close_at_floor_today), []) AS floors FROM execution_rows GROUP BY date) e ON w.date = e.date""",
)
_CHANGE = "list_sum(list_transform(range(1, len(names_now) + 1), lambda i: abs({a}[i] - old[i])))"
relation(
    "limit_walk",
    f"""SELECT DISTINCT optimization_mode, CAST(0 AS BIGINT) AS step, CAST(NULL AS DATE) AS date,
               CAST(map([], []) AS MAP(VARCHAR, DOUBLE)) AS held, CAST(0 AS DOUBLE) AS portfolio_turnover FROM limit_steps
       UNION ALL
       SELECT optimization_mode, step, date, {_filtered('names_now', 'a2', '1e-8')}, 0.5 * {_CHANGE.format(a='a2')}
       FROM (SELECT *, list_transform(range(1, len(names_now) + 1), lambda i: CASE WHEN moved > 0.4 + 1e-12 THEN old[i] + (0.4 - 1e-6) / moved * (a1[i] - old[i]) ELSE a1[i] END) AS a2
       FROM (SELECT *, 0.5 * {_CHANGE.format(a='a1')} AS moved
       FROM (SELECT *, list_transform(range(1, len(names_now) + 1), lambda i: CASE WHEN total > 1 AND bought > 0
                  THEN old[i] + greatest(a0[i] - old[i], 0) * greatest(1 - (total - 1) / bought, 0) + least(a0[i] - old[i], 0) ELSE a0[i] END) AS a1
       FROM (SELECT *, list_sum(a0) AS total, list_sum(list_transform(range(1, len(names_now) + 1), lambda i: greatest(a0[i] - old[i], 0))) AS bought
       FROM (SELECT *, list_transform(range(1, len(names_now) + 1), lambda i: CASE WHEN want[i] > old[i] AND list_contains(ceilings, names_now[i]) THEN old[i]
                  WHEN want[i] < old[i] AND list_contains(floors, names_now[i]) THEN old[i] ELSE want[i] END) AS a0
       FROM (SELECT *, list_transform(names_now, lambda t: coalesce(held[t], 0)) AS old, list_transform(names_now, lambda t: coalesce(wanted[t], 0)) AS want
       FROM (SELECT s.*, w.held, {_names('w.held', 's.wanted')} AS names_now
             FROM limit_walk w JOIN limit_steps s ON s.optimization_mode = w.optimization_mode AND s.step = w.step + 1)))))))""",
)
relation(
    "limit_weights",
    """SELECT optimization_mode, date, portfolio_turnover, unnest(map_keys(held)) AS ticker, unnest(map_values(held)) AS weight FROM limit_walk WHERE step > 0""",
)


def _returns_sql(weights: str) -> str:
    return f"""SELECT *, sum(before_cost_return) OVER (PARTITION BY optimization_mode ORDER BY date) AS cumulative_before_cost_active_return,
            sum(after_cost_return) OVER (PARTITION BY optimization_mode ORDER BY date) AS cumulative_after_cost_active_return FROM (
        SELECT *, before_cost_return - total_cost AS after_cost_return FROM (
        SELECT *, portfolio_turnover * 0.002 + portfolio_turnover * low_liquidity_weight * 0.001 AS total_cost FROM (
        SELECT optimization_mode, w.date, coalesce(sum(weight * actual_return), 0) AS before_cost_return, max(portfolio_turnover) AS portfolio_turnover,
               count(*) AS selected_count, sum(weight) AS total_weight, sum(CASE WHEN is_low_liquidity THEN weight ELSE 0 END) AS low_liquidity_weight
        FROM {weights} GROUP BY 1, 2)))"""


relation(
    "normal_returns",
    _returns_sql("mode_weights w LEFT JOIN (SELECT date, ticker, is_low_liquidity FROM liquidity_rows) l ON w.date = l.date AND w.ticker = l.ticker"),
)
relation(
    "limited_returns",
    _returns_sql("limit_weights w LEFT JOIN (SELECT date, ticker, actual_return, is_low_liquidity FROM execution_rows) l ON w.date = l.date AND w.ticker = l.ticker"),
)
relation(
    "all_returns",
    "SELECT *, 'normal' AS execution_mode FROM normal_returns UNION ALL SELECT *, 'price_limit_aware' FROM limited_returns",
)
relation(
    "concentration",
    """SELECT g.*, n AS holding_count, w AS total_weight, largest AS max_single_name_weight, capped AS positions_at_cap, hhi,
         CAST(capped AS DOUBLE) / n AS single_name_cap_hit_share, capped = n AS all_positions_at_cap, 1 / hhi AS effective_position_count
       FROM (SELECT optimization_mode, date, arg_min(issuer_group, (-gw, issuer_group)) AS top_issuer_group, max(gw) AS top_issuer_group_weight,
                    count(*) FILTER (gw >= 0.4 - 1e-8) AS issuer_groups_at_cap
             FROM (SELECT optimization_mode, date, issuer_group, round(sum(weight), 12) AS gw FROM mode_weights GROUP BY 1, 2, 3) GROUP BY 1, 2) g
       JOIN (SELECT optimization_mode, date, count(*) AS n, sum(weight) AS w, max(weight) AS largest,
                    count(*) FILTER (weight >= 0.2 - 1e-8) AS capped, sum(weight * weight) AS hhi FROM mode_weights GROUP BY 1, 2) USING (optimization_mode, date)""",
)

# --- frames -----------------------------------------------------------------------------


def _context(spark, folder):
    """Momentum predictions with group, sector and the herding state of the date."""
    rows = panel.predictions(spark, folder).where("model_name = 'momentum'")
    state = he.herding_state(he.daily_herding(panel.features(spark, folder), pairs="available"))
    return po.attach_context(rows, panel.universe(spark, folder), state)


def _weights(spark, folder):
    return po.optimised_weights(checkpoint(_context(spark, folder)))


def _liquidity(spark, folder):
    """Written once: its quantile, its rows and both execution modes read it."""
    return checkpoint(bt.liquidity_reference(checkpoint(panel.features(spark, folder))))


def _both(spark, folder):
    context = checkpoint(_context(spark, folder))
    weights = checkpoint(po.optimised_weights(context))
    liquidity = _liquidity(spark, folder)
    return bt.both_execution_modes(weights, bt.execution_reference(context, liquidity), liquidity)


@query(
    "c02_prediction_context",
    "date ticker predicted_return:8 issuer_group sector high_herding_day",
    "SELECT * FROM chosen_preds",
)
def _prediction_context(spark, folder):
    return _context(spark, folder)


@query(
    "l01_target_weights",
    "optimization_mode date ticker target_weight:8",
    "SELECT * FROM mode_targets WHERE optimization_mode = 'normal'",
)
def _targets(spark, folder):
    rows = panel.predictions(spark, folder).where("model_name = 'momentum'").join(panel.universe(spark, folder), "ticker")
    return po.target_weights(po.with_mode_parameters(rows, ["normal"]))


@query("l02_mode_targets", "optimization_mode date ticker issuer_group sector target_weight:8", "SELECT * FROM mode_targets")
def _mode_targets(spark, folder):
    return po.target_weights(po.with_mode_parameters(_context(spark, folder)))


@query(
    "h04_group_and_sector_caps",
    "date ticker weight:8",
    """SELECT date, ticker, wg * least(0.05 / sum(wg) OVER (PARTITION BY date, sector), 1) AS weight FROM (
         SELECT *, w * least(0.04 / sum(w) OVER (PARTITION BY date, issuer_group), 1) AS wg FROM (
           SELECT date, ticker, issuer_group, sector, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM bars JOIN names USING (ticker)))""",
)
def _caps(spark, folder):
    rows = se.select_all(panel.bars(spark, folder), "close").join(panel.universe(spark, folder), "ticker")
    grouped = po.cap_groups(rows, "issuer_group", 0.04, "weight", ["date"])
    return po.cap_groups(grouped, "sector", 0.05, "weight", ["date"])


WEIGHTS = "optimization_mode date ticker issuer_group sector weight:7 portfolio_turnover:7 predicted_return:7 actual_return:7"


@query("l03_turnover_limited_path", "optimization_mode date ticker weight:7 portfolio_turnover:7", "SELECT * FROM mode_weights WHERE optimization_mode = 'normal'")
def _path(spark, folder):
    rows = panel.predictions(spark, folder).where("model_name = 'momentum'").join(panel.universe(spark, folder), "ticker")
    expanded = po.with_mode_parameters(rows, ["normal"])
    return po.turnover_limited_path(po.target_weights(expanded), expanded.select("optimization_mode", "date"))


@query("l04_optimised_weights", WEIGHTS, "SELECT * FROM mode_weights")
def _optimised(spark, folder):
    return _weights(spark, folder)


relation(
    "weight_changes",
    """SELECT optimization_mode, date, sum(abs(c)) * 0.5 AS turnover, sum(greatest(c, 0)) AS buys, sum(greatest(-c, 0)) AS sells FROM (
         SELECT optimization_mode, date, ticker, sum(w) AS c FROM (
           SELECT optimization_mode, date, ticker, target_weight AS w FROM mode_targets
           UNION ALL
           SELECT t.optimization_mode, following, ticker, -target_weight FROM mode_targets t JOIN (
             SELECT optimization_mode, date, lead(date) OVER (PARTITION BY optimization_mode ORDER BY date) AS following
             FROM (SELECT DISTINCT optimization_mode, date FROM mode_targets)) n
             ON t.optimization_mode = n.optimization_mode AND t.date = n.date WHERE following IS NOT NULL) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)


@query(
    "c10_turnover_between_dates",
    "optimization_mode date turnover:8 buys:8 sells:8",
    "SELECT * FROM weight_changes WHERE optimization_mode = 'normal'",
)
def _between(spark, folder):
    targets = _targets(spark, folder).withColumnRenamed("target_weight", "weight")
    return po.turnover_between_dates(targets)


@query(
    "b07_liquidity_reference",
    "date ticker close_at_ceiling_today close_at_floor_today is_low_liquidity",
    "SELECT * FROM liquidity_rows",
)
def _liquidity_reference(spark, folder):
    return _liquidity(spark, folder)


@query(
    "l06_price_limit_execution",
    "optimization_mode date ticker weight:7 portfolio_turnover:7",
    "SELECT * FROM limit_weights",
)
def _limited(spark, folder):
    context = checkpoint(_context(spark, folder))
    weights = checkpoint(po.optimised_weights(context))
    return bt.price_limit_execution(weights, bt.execution_reference(context, _liquidity(spark, folder)))


BACKTEST = (
    "optimization_mode date before_cost_return:7 portfolio_turnover:7 selected_count:i total_weight:7 low_liquidity_weight:7 "
    "total_cost:8 after_cost_return:7 cumulative_before_cost_active_return:6 cumulative_after_cost_active_return:6"
)


@query("d09_backtest_returns", BACKTEST + " execution_mode", "SELECT * FROM all_returns")
def _backtest(spark, folder):
    return _both(spark, folder)


@query(
    "i13_performance_summary",
    "optimization_mode execution_mode average_after_cost_return:7 return_volatility:7 diagnostic_sharpe:6 max_active_drawdown:6 average_turnover:7 maximum_turnover:7 final_cumulative_after_cost_active_return:6",
    """SELECT optimization_mode, execution_mode, avg(after_cost_return) AS average_after_cost_return, stddev_samp(after_cost_return) AS return_volatility,
       avg(after_cost_return) / stddev_samp(after_cost_return) AS diagnostic_sharpe, min(s - peak) AS max_active_drawdown,
       avg(portfolio_turnover) AS average_turnover, max(portfolio_turnover) AS maximum_turnover, arg_max(s, date) AS final_cumulative_after_cost_active_return
       FROM (SELECT *, cumulative_after_cost_active_return AS s, max(cumulative_after_cost_active_return) OVER (PARTITION BY optimization_mode, execution_mode ORDER BY date) AS peak FROM all_returns) GROUP BY 1, 2""",
)
def _performance(spark, folder):
    return bt.performance_summary(_both(spark, folder))


@query(
    "i13_comparison_summary",
    "optimization_mode execution_mode date_count:i average_before_cost_return:7 average_total_cost:8 maximum_turnover:7 maximum_total_weight:7",
    """SELECT optimization_mode, execution_mode, count(*) AS date_count, avg(before_cost_return) AS average_before_cost_return, avg(total_cost) AS average_total_cost,
       max(portfolio_turnover) AS maximum_turnover, max(total_weight) AS maximum_total_weight FROM all_returns GROUP BY 1, 2""",
)
def _comparison(spark, folder):
    return bt.comparison_summary(_both(spark, folder))


CONCENTRATION = (
    "optimization_mode date holding_count:i total_weight:7 max_single_name_weight:7 positions_at_cap:i single_name_cap_hit_share:7 "
    "all_positions_at_cap hhi:7 effective_position_count:6 top_issuer_group top_issuer_group_weight:7 issuer_groups_at_cap:i"
)


@query("d12_daily_concentration", CONCENTRATION, "SELECT * FROM concentration")
def _concentration(spark, folder):
    return po.daily_concentration(_weights(spark, folder))


relation("last_weights", "SELECT * FROM mode_weights WHERE date = (SELECT max(date) FROM mode_weights)")
_FLAG = """CASE WHEN all_positions_at_cap OR top_issuer_group_weight >= 0.4 - 1e-8 OR effective_position_count <= 5 + 1e-8 THEN
    concat_ws('; ', CASE WHEN all_positions_at_cap THEN 'all_positions_at_20pct_cap' END,
      CASE WHEN top_issuer_group_weight >= 0.4 - 1e-8 THEN 'issuer_group_at_40pct_cap' END,
      CASE WHEN effective_position_count <= 5 + 1e-8 THEN 'low_effective_position_count' END) ELSE 'normal' END"""


@query(
    "h06_concentration_flag",
    "optimization_mode date concentration_flag",
    f"SELECT optimization_mode, date, {_FLAG} AS concentration_flag FROM concentration",
)
def _flag(spark, folder):
    return po.daily_concentration(_weights(spark, folder)).withColumn("concentration_flag", po.concentration_flag())


@query(
    "o03_concentration_summary",
    "signal_date optimization_mode holding_count:i total_weight:7 hhi:7 top_issuer_group top_issuer_group_weight:7 top_issuer_group_tickers concentration_flag",
    f"""SELECT c.date AS signal_date, c.*, {_FLAG} AS concentration_flag, names_text AS top_issuer_group_tickers FROM concentration c
        JOIN (SELECT optimization_mode, issuer_group, string_agg(ticker, ', ' ORDER BY ticker) AS names_text FROM last_weights GROUP BY 1, 2) t
          ON t.optimization_mode = c.optimization_mode AND t.issuer_group = c.top_issuer_group
        WHERE c.date = (SELECT max(date) FROM mode_weights)""",
)
def _concentration_summary(spark, folder):
    return reports.concentration_summary(checkpoint(_weights(spark, folder)))


@query(
    "o04_bound_diagnostic",
    "optimization_mode latest_holding_count:i latest_positions_at_cap:i mean_single_name_cap_hit_share:7 share_of_dates_all_positions_at_cap:7 max_single_name_cap_hit_share:7 mean_hhi:7 latest_hhi:7 mean_effective_position_count:6",
    """SELECT optimization_mode, arg_max(holding_count, date) AS latest_holding_count, arg_max(positions_at_cap, date) AS latest_positions_at_cap,
       avg(single_name_cap_hit_share) AS mean_single_name_cap_hit_share, avg(CASE WHEN all_positions_at_cap THEN 1.0 ELSE 0 END) AS share_of_dates_all_positions_at_cap,
       max(single_name_cap_hit_share) AS max_single_name_cap_hit_share, avg(hhi) AS mean_hhi, arg_max(hhi, date) AS latest_hhi, avg(effective_position_count) AS mean_effective_position_count
       FROM concentration GROUP BY 1""",
)
def _bound(spark, folder):
    return reports.bound_diagnostic(_weights(spark, folder))


@query(
    "o05_issuer_exposure",
    "signal_date optimization_mode issuer_group issuer_group_weight:7 position_count:i tickers max_single_name_weight_in_group:7 weighted_realized_forward_return:6 exposure_flag",
    """SELECT date AS signal_date, optimization_mode, issuer_group, sum(weight) AS issuer_group_weight, count(*) AS position_count,
       string_agg(ticker, ', ' ORDER BY round(weight, 9) DESC, ticker) AS tickers, max(weight) AS max_single_name_weight_in_group,
       sum(weight * actual_return) / sum(weight) AS weighted_realized_forward_return,
       CASE WHEN sum(weight) >= 0.4 - 1e-8 THEN 'issuer_group_at_40pct_cap' ELSE 'normal' END AS exposure_flag FROM last_weights GROUP BY 1, 2, 3""",
)
def _exposure(spark, folder):
    return reports.issuer_exposure(checkpoint(_weights(spark, folder)))


_TABLE = """count(*) AS evaluated_dates, avg(v) AS average_period_active_return, stddev_samp(v) AS return_volatility,
    CASE WHEN stddev_samp(v) > 1e-12 THEN avg(v) / stddev_samp(v) END AS diagnostic_sharpe, min(s - peak) AS max_active_drawdown,
    sum(v) AS final_cumulative_active_return_sum, avg(selected_count) AS average_selected_count"""


@query(
    "o02_benchmark_table",
    "comparison_type strategy evaluated_dates:i average_period_active_return:7 return_volatility:7 max_active_drawdown:6 final_cumulative_active_return_sum:6 average_selected_count:6",
    f"""SELECT comparison_type, strategy, {_TABLE} FROM (SELECT *, max(s) OVER (PARTITION BY comparison_type, strategy ORDER BY date) AS peak FROM (
        SELECT *, sum(v) OVER (PARTITION BY comparison_type, strategy ORDER BY date) AS s FROM (
          SELECT 'ml_strategy' AS comparison_type, 'ml_' || optimization_mode || '_' || execution_mode AS strategy, date, after_cost_return AS v, selected_count FROM all_returns
          UNION ALL SELECT 'naive_baseline', strategy, date, active_return, selected_count FROM strategy_returns
          WHERE date IN (SELECT date FROM all_returns) AND strategy <> 'equal_weight_all'))) GROUP BY 1, 2""",
)
def _benchmark(spark, folder):
    # Equal-weight leave-one-out excess is zero up to rounding noise, so it is left out here.
    baseline = se.portfolio_returns(se.baseline_positions(_score_panel(spark, folder)))
    return reports.benchmark_table(
        checkpoint(_both(spark, folder)), baseline.where("strategy <> 'equal_weight_all'")
    )


@query(
    "c09_common_dates",
    "date strategy portfolio_return:8",
    "SELECT * FROM strategy_returns WHERE date IN (SELECT date FROM preds WHERE model_name = 'reversal')",
)
def _common(spark, folder):
    baseline = se.portfolio_returns(se.baseline_positions(_score_panel(spark, folder)))
    dates = panel.predictions(spark, folder).where("model_name = 'reversal'").select("date").distinct()
    return reports.on_common_dates(baseline, dates)


@query(
    "f08_rank_diagnostic",
    "signal_date ticker predicted_rank:i realized_rank:i rank_gap:i absolute_rank_gap:i model_score:8 realized_forward_return:8 diagnostic_flag in_normal_portfolio",
    """SELECT r.date AS signal_date, r.ticker, place AS predicted_rank, realised_place AS realized_rank, realised_place - place AS rank_gap, abs(realised_place - place) AS absolute_rank_gap,
       predicted_return AS model_score, actual_return AS realized_forward_return,
       CASE WHEN place <= 5 AND actual_return < 0 THEN 'top_ranked_negative_return' WHEN place <= 5 AND realised_place <= 5 THEN 'top_ranked_hit'
            WHEN place <= 5 AND realised_place > 15 THEN 'top_ranked_miss' ELSE 'normal' END AS diagnostic_flag,
       t.ticker IS NOT NULL AS in_normal_portfolio
       FROM (SELECT * FROM ranked WHERE model_name = 'momentum' AND date = (SELECT max(date) FROM preds)) r
       LEFT JOIN (SELECT ticker FROM mode_targets WHERE optimization_mode = 'normal' AND date = (SELECT max(date) FROM mode_targets)) t ON r.ticker = t.ticker""",
)
def _diagnostic(spark, folder):
    rows = panel.predictions(spark, folder)
    targets = _targets(spark, folder).withColumnRenamed("target_weight", "weight")
    return me.rank_diagnostic(rows, targets, ["normal"], "momentum")


@query(
    "f09_latest_weights",
    "date ticker optimization_mode target_weight:8",
    "SELECT * FROM mode_targets WHERE optimization_mode = 'normal' AND date = (SELECT max(date) FROM mode_targets)",
)
def _latest_weights(spark, folder):
    return se.latest_weights(_mode_targets(spark, folder))


def _constrained(spark, folder):
    rows = panel.predictions(spark, folder).where("model_name = 'momentum'").join(panel.universe(spark, folder), "ticker")
    return ta.constrained_targets(rows)


@query("l05_constrained_targets", "date ticker issuer_group sector score:8 target_weight:9 status")
def _constrained_targets(spark, folder):
    return _constrained(spark, folder)


# Names are bits of a mask by rank; caps are whole percent, so capacities are exact.  What a set of names can carry is
# the smallest cut: sectors given up at 35 each, and per group the smaller of 25 and 15 for each name outside them.
relation(
    "cap_names",
    """SELECT date, ticker, issuer_group, sector, predicted_return, CAST(1 AS BIGINT) << CAST(place - 1 AS INT) AS bit
       FROM ranked JOIN names USING (ticker) WHERE model_name = 'momentum'""",
)
relation(
    "cap_dates",
    """SELECT date, n, group_masks, list_transform(range(0, 1 << len(sector_masks)), lambda t: {'cost': 35 * CAST(bit_count(t) AS BIGINT), 'mask':
              coalesce(list_sum(list_transform(range(0, len(sector_masks)), lambda k: CASE WHEN (t >> k) & 1 = 1 THEN sector_masks[k + 1] ELSE 0 END)), 0)::BIGINT}) AS cuts
       FROM (SELECT date, count(*) AS n FROM cap_names GROUP BY 1)
       JOIN (SELECT date, list(m) AS group_masks FROM (SELECT date, sum(bit)::BIGINT AS m FROM cap_names GROUP BY date, issuer_group) GROUP BY 1) USING (date)
       JOIN (SELECT date, list(m) AS sector_masks FROM (SELECT date, sum(bit)::BIGINT AS m FROM cap_names GROUP BY date, sector) GROUP BY 1) USING (date)""",
)


def _capacity(mask: str) -> str:
    kept = f"list_sum(list_transform(group_masks, lambda g: least(25, 15 * CAST(bit_count({mask} & g & ~c.mask) AS BIGINT))))"
    return f"list_min(list_transform(cuts, lambda c: c.cost + {kept}))"


relation(
    "cap_walk",
    f"""SELECT date, n, group_masks, cuts, CAST(255 AS BIGINT) AS mask, {_capacity('255::BIGINT')} AS capacity, 0 AS step
       FROM cap_dates WHERE n >= 8
       UNION ALL
       SELECT date, any_value(n), any_value(group_masks), any_value(cuts), arg_min(trial, turn), arg_min(reached, turn), step + 1
       FROM (SELECT *, {_capacity('trial')} AS reached FROM (
         SELECT w.*, (w.mask | (1::BIGINT << c.i)) & ~(1::BIGINT << r.i) AS trial, c.i * 64 - r.i AS turn
         FROM cap_walk w, (SELECT CAST(unnest(range(0, 62)) AS INT) AS i) c, (SELECT CAST(unnest(range(0, 62)) AS INT) AS i) r
         WHERE w.capacity < 97 AND c.i < w.n AND r.i < w.n AND (w.mask >> c.i) & 1 = 0 AND (w.mask >> r.i) & 1 = 1))
       WHERE reached > capacity GROUP BY date, step""",
)
relation(
    "cap_results",
    """SELECT date, n, mask, CASE WHEN mask IS NULL THEN 'too_few_names' WHEN capacity < 97 THEN 'caps_too_tight' ELSE 'ok' END AS status
       FROM (SELECT date, n FROM cap_dates) LEFT JOIN
            (SELECT date, arg_max(mask, step) AS mask, max(capacity) AS capacity FROM cap_walk GROUP BY 1) USING (date)""",
)
relation(
    "cap_chosen",
    """SELECT date, ticker, issuer_group, sector, predicted_return FROM cap_results JOIN cap_names USING (date)
       WHERE status = 'ok' AND mask & bit <> 0""",
)
# The largest least weight, from cuts again: with L for every name a cut holds its cost less L for each name whose
# group and sector both lie in it, so each cut with such names bounds L, as do the caps by themselves.
relation(
    "cap_least",
    """SELECT date, min(bound) AS least FROM (
         SELECT date, (35 * CAST(bit_count(t) AS BIGINT) + 25 * CAST(bit_count(a) AS BIGINT) + 15 * sum(CASE WHEN in_sector + in_group = 0 THEN 1 ELSE 0 END) - 97)
                      / sum(CASE WHEN in_sector + in_group = 2 THEN 1 ELSE 0 END) / 100 AS bound
         FROM (SELECT date, t, a, (t >> s) & 1 AS in_sector, (a >> g) & 1 AS in_group
               FROM (SELECT *, max(s) OVER (PARTITION BY date) AS last_s, max(g) OVER (PARTITION BY date) AS last_g FROM (
                      SELECT *, CAST(dense_rank() OVER (PARTITION BY date ORDER BY sector) - 1 AS INT) AS s,
                             CAST(dense_rank() OVER (PARTITION BY date ORDER BY issuer_group) - 1 AS INT) AS g FROM cap_chosen)),
                    (SELECT CAST(unnest(range(0, 256)) AS INT) AS t), (SELECT CAST(unnest(range(0, 256)) AS INT) AS a)
               WHERE t < 2 << last_s AND a < 2 << last_g)
         GROUP BY date, t, a HAVING sum(CASE WHEN in_sector + in_group = 2 THEN 1 ELSE 0 END) > 0
         UNION ALL SELECT DISTINCT date, 0.97 / 8 FROM cap_chosen
         UNION ALL SELECT date, 0.25 / count(*) FROM cap_chosen GROUP BY date, issuer_group
         UNION ALL SELECT date, 0.35 / count(*) FROM cap_chosen GROUP BY date, sector) GROUP BY 1""",
)


@query("l05_constrained_names", "date ticker issuer_group sector predicted_return:8", "SELECT * FROM cap_chosen")
def _constrained_names(spark, folder):
    """Names held on every date on which the caps can hold the weight."""
    return _constrained(spark, folder).where("status = 'ok'").withColumnRenamed("score", "predicted_return")


@query(
    "l05_constrained_totals",
    "date status names:i total:7 least:7 violations:i",
    """SELECT date, status, CASE WHEN status = 'ok' THEN 8 ELSE 0 END AS names, CASE WHEN status = 'ok' THEN 0.97 ELSE 0 END AS total, least, 0 AS violations
       FROM cap_results LEFT JOIN cap_least USING (date)""",
)
def _constrained_totals(spark, folder):
    """Every date: why it holds nothing, or names, weight, the smallest weight and broken caps."""
    rows = checkpoint(_constrained(spark, folder))
    broken = ta.cap_violations(rows).groupBy("date").agg(F.count(F.lit(1)).alias("violations"))
    totals = rows.groupBy("date", "status").agg(
        F.count("ticker").alias("names"),
        F.sum("target_weight").cast("double").alias("total"),
        F.min("target_weight").cast("double").alias("least"),
    )
    return totals.join(broken, "date", "left").na.fill(0, ["violations", "total"])


@query(
    "l04_diversified_weights",
    "optimization_mode date ticker weight:7 portfolio_turnover:7",
    """SELECT optimization_mode, date, portfolio_turnover, unnest(map_keys(held)) AS ticker, unnest(map_values(held)) AS weight
       FROM diversified_walk WHERE step > 0""",
)
def _diversified_weights(spark, folder):
    """The three modes under the turnover limit of the diversified portfolio."""
    return po.optimised_weights(checkpoint(_context(spark, folder)), max_turnover=ta.DIVERSIFIED_TURNOVER)


@query("l04_diversified_path", "optimization_mode date ticker weight:7 portfolio_turnover:7")
def _diversified(spark, folder):
    targets = _constrained(spark, folder).where("status = 'ok'").withColumns(
        {"optimization_mode": F.lit("sector_diversified"), "target_weight": F.col("target_weight").cast("double")}
    )
    return po.turnover_limited_path(
        targets, targets.select("optimization_mode", "date"), limits={"sector_diversified": ta.DIVERSIFIED_TURNOVER}
    )


@query(
    "l05_rank_problems",
    "date ticker problem",
    """SELECT date, ticker, 'rank_mismatch' AS problem FROM ranked WHERE model_name = 'momentum'
       AND place <> CASE WHEN place % 7 = 0 THEN place + 1 ELSE place END""",
)
def _rank_problems(spark, folder):
    rows = se.top_n_flags(panel.predictions(spark, folder).where("model_name = 'momentum'"))
    shifted = rows.select(
        "date", "ticker", F.col("predicted_return").alias("score"),
        F.when(F.col("prediction_rank") % 7 == 0, F.col("prediction_rank") + 1)
        .otherwise(F.col("prediction_rank")).alias("predicted_rank"),
    )
    return ta.prediction_rank_problems(shifted)
