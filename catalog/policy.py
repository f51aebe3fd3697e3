"""Ensembles, regimes, policy backtests and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import panel
from catalog.registry import query, relation
from tidepanel.functions.dates import date_index
from tidepanel.operators import ensemble as en
from tidepanel.operators import labels as la
from tidepanel.operators import metrics as me
from tidepanel.operators import monitor as mo
from tidepanel.operators import policy as pol
from tidepanel.operators import regime as rg
from tidepanel.operators import splits
from tidepanel.plans import reports
from tidepanel.plans.features import score_predictions
from tidepanel.session import checkpoint

MEMBERS = ("momentum", "reversal")
MEMBER_WINDOW, MEMBER_LAG = 60, 10
HEALTH_WINDOW = 60
POLICIES = {
    "mixed": {"trend_up": "momentum", "high_volatility": "reversal", "trend_down": "cash"},
    "momentum": {r: "momentum" for r in rg.REGIMES},
    "ensemble": {r: "rank_ensemble" for r in rg.REGIMES},
}
HOLDOUT = "2000-01-01"

# --- SQL: ensembles ------------------------------------------------------------------

relation(
    "pairs",
    "SELECT preds.* FROM preds SEMI JOIN (SELECT date, ticker FROM preds WHERE model_name = 'reversal') k USING (date, ticker)",
)
relation(
    "pair_scores",
    """SELECT *, 1 - CAST(place AS DOUBLE) / (n + 1) AS rank_score FROM (
         SELECT *, row_number() OVER (PARTITION BY model_name, date ORDER BY predicted_return DESC, ticker) AS place,
                count(*) OVER (PARTITION BY model_name, date) AS n FROM pairs)""",
)
relation(
    "static_ensemble",
    """SELECT date, ticker, 'rank_ensemble' AS model_name, 1 - avg(place) / (max(n) + 1) AS predicted_return, min(actual_return) AS actual_return
       FROM pair_scores GROUP BY 1, 2""",
)


def ic_sql(source: str) -> str:
    return f"""SELECT model_name, date, CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS rank_ic FROM (
        SELECT model_name, date, rank() OVER (PARTITION BY model_name, date ORDER BY predicted_return) + (count(*) OVER (PARTITION BY model_name, date, predicted_return) - 1) / 2.0 AS a,
               rank() OVER (PARTITION BY model_name, date ORDER BY actual_return) + (count(*) OVER (PARTITION BY model_name, date, actual_return) - 1) / 2.0 AS b
        FROM {source}) GROUP BY 1, 2"""


relation("pair_ic", ic_sql("pairs"))
relation(
    "member_weights",
    f"""SELECT date, model_name, CASE WHEN total > 0 THEN skill / total ELSE 0.5 END AS weight FROM (
         SELECT *, sum(skill) OVER (PARTITION BY date) AS total FROM (
           SELECT date, model_name, greatest(coalesce(avg(rank_ic) OVER (PARTITION BY model_name ORDER BY date
                  ROWS BETWEEN {MEMBER_LAG + MEMBER_WINDOW} PRECEDING AND {MEMBER_LAG + 1} PRECEDING), 0), 0) AS skill FROM pair_ic))""",
)
relation(
    "rolling_ensemble",
    """SELECT date, ticker, 'rolling_rank_ensemble' AS model_name, sum(rank_score * weight) AS predicted_return, min(actual_return) AS actual_return,
       max(CASE WHEN model_name = 'momentum' THEN weight END) AS weight_momentum, max(CASE WHEN model_name = 'reversal' THEN weight END) AS weight_reversal
       FROM pair_scores JOIN member_weights USING (date, model_name) GROUP BY 1, 2""",
)
relation(
    "candidates",
    """SELECT date, ticker, model_name, predicted_return, actual_return FROM pairs
       UNION ALL SELECT date, ticker, model_name, predicted_return, actual_return FROM static_ensemble
       UNION ALL SELECT date, ticker, model_name, round(predicted_return, 12), actual_return FROM rolling_ensemble""",
)
relation("candidate_ic", ic_sql("candidates"))
relation(
    "candidate_daily",
    """SELECT c.model_name, c.date, rank_ic, top_n_actual_return FROM candidate_ic c
       JOIN (SELECT model_name, date FROM candidates GROUP BY 1, 2 HAVING count(DISTINCT actual_return) > 1) USING (model_name, date)
       JOIN (SELECT model_name, date, avg(actual_return) AS top_n_actual_return FROM (
               SELECT *, row_number() OVER (PARTITION BY model_name, date ORDER BY predicted_return DESC, ticker) AS place FROM candidates)
             WHERE place <= 8 GROUP BY 1, 2) USING (model_name, date)""",
)

# --- SQL: regimes and policies ---------------------------------------------------------

relation("market_days", "SELECT date, avg(return_1d) AS market_return FROM moves GROUP BY date")
relation(
    "overlay_days",
    """SELECT date, nav / max(nav) OVER (ORDER BY date) - 1 AS market_drawdown FROM (
         SELECT date, product(1 + coalesce(market_return, 0)) OVER (ORDER BY date) AS nav FROM market_days)""",
)
relation(
    "regimes",
    """SELECT *, CASE WHEN trailing_volatility > volatility_baseline THEN 'high_volatility' WHEN trailing_return >= 0 THEN 'trend_up' ELSE 'trend_down' END AS market_regime FROM (
         SELECT *, CASE WHEN count(trailing_volatility) OVER w >= 126 THEN median(trailing_volatility) OVER w END AS volatility_baseline FROM (
           SELECT date, CASE WHEN count(market_return) OVER v >= 20 THEN product(1 + market_return) OVER v - 1 END AS trailing_return,
                  CASE WHEN count(market_return) OVER v >= 20 THEN stddev_samp(market_return) OVER v END AS trailing_volatility
           FROM market_days WINDOW v AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
         WINDOW w AS (ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW))
       WHERE trailing_return IS NOT NULL AND trailing_volatility IS NOT NULL AND volatility_baseline IS NOT NULL""",
)
relation(
    "schedule",
    """SELECT date, market_regime FROM (SELECT date, market_regime, row_number() OVER (ORDER BY date) - 1 AS k
         FROM regimes WHERE date IN (SELECT date FROM pairs WHERE model_name = 'momentum' GROUP BY date HAVING count(*) >= 8)) WHERE k % 5 = 0""",
)
_CASES = " UNION ALL ".join(
    f"SELECT '{name}' AS policy_name, '{regime}' AS market_regime, '{model}' AS selected_model"
    for name, rules in POLICIES.items()
    for regime, model in rules.items()
)
relation("policy_rules", _CASES)
def _steps_sql(rules: str, source: str, exposure: str, schedule: str = "schedule", outcomes: str = "pairs", value: str = "actual_return") -> str:
    """(policy_name, step, names, outcomes, exposure) for each scheduled date."""
    return f"""SELECT s.*, row_number() OVER (PARTITION BY policy_name ORDER BY s.date) AS step, coalesce(w.names, []) AS names, o.outcomes, {exposure} AS exposure FROM (
         SELECT policy_name, date, market_regime, selected_model FROM {schedule} JOIN {rules} USING (market_regime)) s
       LEFT JOIN overlay_days v ON v.date = s.date
       LEFT JOIN (SELECT model_name, date, list(ticker ORDER BY ticker) AS names FROM (
           SELECT *, row_number() OVER (PARTITION BY model_name, date ORDER BY predicted_return DESC, ticker) AS place FROM {source}) WHERE place <= 8 GROUP BY 1, 2) w
         ON w.model_name = s.selected_model AND w.date = s.date
       LEFT JOIN (SELECT date, map(list(ticker), list({value})) AS outcomes FROM {outcomes} WHERE model_name = 'momentum' GROUP BY 1) o ON o.date = s.date"""


_ALL = "list_sort(list_distinct(list_concat(map_keys({a}), map_keys({b}))))"
_SUM = "coalesce(list_sum(list_transform({names}, lambda t: {value})), 0)"
_HELD = _ALL.format(a="held", b="following")


def _walk_sql(walk: str, steps: str) -> str:
    """Recursive walk over the steps that carries the held weights as a map."""
    return f"""SELECT DISTINCT policy_name, CAST(0 AS BIGINT) AS step, CAST(NULL AS DATE) AS date, '' AS market_regime, '' AS selected_model, 0::DOUBLE AS target_exposure,
               CAST(map([], []) AS MAP(VARCHAR, DOUBLE)) AS held, 0::DOUBLE AS forced_exit_weight, 0::DOUBLE AS portfolio_turnover,
               0::DOUBLE AS before_cost_return, 0::DOUBLE AS total_cost FROM {steps}
       UNION ALL
       SELECT policy_name, step, date, market_regime, selected_model, exposure, following, forced, portfolio_turnover, gross, (buys + sells) * 0.002 + sells * 0.001 FROM (
       SELECT *, 0.5 * {_SUM.format(names=_HELD, value="abs(coalesce(following[t], 0) - coalesce(held[t], 0))")} AS portfolio_turnover,
              {_SUM.format(names=_HELD, value="greatest(coalesce(following[t], 0) - coalesce(held[t], 0), 0)")} AS buys,
              {_SUM.format(names=_HELD, value="greatest(coalesce(held[t], 0) - coalesce(following[t], 0), 0)")} AS sells,
              {_SUM.format(names="map_keys(following)", value="following[t] * outcomes[t]")} AS gross FROM (
       SELECT *, map(list_transform(list_filter(range(1, len(all_names) + 1), lambda i: moved[i] > 1e-12), lambda i: all_names[i]),
                     list_transform(list_filter(range(1, len(all_names) + 1), lambda i: moved[i] > 1e-12), lambda i: moved[i])) AS following FROM (
       SELECT *, list_transform(all_names, lambda t: CASE WHEN room <= 0 THEN coalesce(carried[t], 0) WHEN needed <= room + 1e-12 THEN coalesce(wanted[t], 0)
                     ELSE coalesce(carried[t], 0) + room / needed * (coalesce(wanted[t], 0) - coalesce(carried[t], 0)) END) AS moved FROM (
       SELECT *, {_ALL.format(a='carried', b='wanted')} AS all_names,
              0.5 * {_SUM.format(names=_ALL.format(a='carried', b='wanted'), value="abs(coalesce(wanted[t], 0) - coalesce(carried[t], 0))")} AS needed FROM (
       SELECT *, greatest(0.25 - 0.5 * forced, 0) AS room FROM (
       SELECT s.policy_name, s.step, s.date, s.market_regime, s.selected_model, s.outcomes, p.held, s.exposure,
              map(s.names, list_transform(s.names, lambda t: s.exposure / 8)) AS wanted,
              coalesce(list_sum(list_transform(list_filter(map_keys(p.held), lambda t: s.outcomes[t] IS NULL), lambda t: p.held[t])), 0) AS forced,
              map(list_filter(map_keys(p.held), lambda t: s.outcomes[t] IS NOT NULL),
                  list_transform(list_filter(map_keys(p.held), lambda t: s.outcomes[t] IS NOT NULL), lambda t: p.held[t])) AS carried
       FROM {walk} p JOIN {steps} s ON s.policy_name = p.policy_name AND s.step = p.step + 1))))))"""


relation("policy_steps", _steps_sql("policy_rules", "candidates", "0.97::DOUBLE"))
relation("policy_walk", _walk_sql("policy_walk", "policy_steps"))
relation(
    "policy_days",
    """SELECT *, before_cost_return - total_cost AS after_cost_return, coalesce(list_sum(map_values(held)), 0) AS total_weight, len(map_keys(held)) AS selected_count
       FROM policy_walk WHERE step > 0""",
)
relation(
    "overlay_rules",
    """SELECT p AS policy_name, r AS market_regime, 'momentum' AS selected_model FROM (SELECT unnest(['baseline', 'drawdown_10', 'drawdown_15']) AS p),
       (SELECT unnest(['trend_up', 'trend_down', 'high_volatility']) AS r)""",
)
relation(
    "overlay_steps",
    _steps_sql(
        "overlay_rules",
        "pairs",
        "CASE WHEN policy_name = 'drawdown_10' AND market_drawdown <= -0.1 THEN 0.5::DOUBLE "
        "WHEN policy_name = 'drawdown_15' AND market_drawdown <= -0.15 THEN 0.5::DOUBLE ELSE 0.97::DOUBLE END",
    ),
)
relation("overlay_walk", _walk_sql("overlay_walk", "overlay_steps"))


def _summary_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS rebalance_dates, avg(after_cost_return) AS average_after_cost_return, stddev_samp(after_cost_return) AS return_volatility,
        avg(portfolio_turnover) AS average_turnover, max(portfolio_turnover) AS maximum_turnover, count(*) FILTER (forced_exit_weight > 0) AS forced_exit_dates,
        max(forced_exit_weight) AS maximum_forced_exit_weight, arg_max(nav, date) - 1 AS final_cumulative_after_cost_return, min(nav / greatest(peak, 1) - 1) AS max_after_cost_drawdown
        FROM (SELECT *, max(nav) OVER (PARTITION BY {by} ORDER BY date) AS peak FROM (
          SELECT *, product(1 + after_cost_return) OVER (PARTITION BY {by} ORDER BY date) AS nav FROM {source})) GROUP BY {by}"""


def bootstrap_sql(source: str, value: str, by: str, block: int, samples: int) -> str:
    """Mean and interval per series; the start positions use the integer hash of the library."""
    mixed = "k0"
    steps = "SELECT *, 42 * 1000003::BIGINT + sample * 10007 + slot // width AS k0 FROM slots"
    for i in (1, 2):
        steps = f"SELECT *, (xor(k{i - 1}, k{i - 1} >> 16) * 73244475) & 4294967295 AS k{i} FROM ({steps})"
    mixed = f"SELECT *, xor(k2, k2 >> 16) AS h FROM ({steps})"
    return f"""SELECT s.{by}, s.n AS sample_size, s.mean_value, i.lo AS bootstrap_95pct_lower, i.hi AS bootstrap_95pct_upper FROM (
        SELECT {by}, count(*) AS n, avg({value}) AS mean_value FROM {source} WHERE {value} IS NOT NULL GROUP BY 1) s
      JOIN (SELECT {by}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (
        SELECT d.{by}, d.sample, avg(p.v) AS m FROM (
          WITH sized AS (SELECT {by}, count(*) AS n, least({block}, count(*)) AS width FROM {source} WHERE {value} IS NOT NULL GROUP BY 1),
               slots AS (SELECT {by}, n, width, CAST(sample AS BIGINT) AS sample, CAST(unnest(range(0, n)) AS BIGINT) AS slot FROM sized, range(0, {samples}) g(sample))
          SELECT *, h % (n - width + 1) + slot % width AS position FROM ({mixed})) d
        JOIN (SELECT {by}, {value} AS v, row_number() OVER (PARTITION BY {by} ORDER BY date) - 1 AS position FROM {source} WHERE {value} IS NOT NULL) p
          ON p.{by} = d.{by} AND p.position = d.position GROUP BY 1, 2) GROUP BY 1) i ON i.{by} = s.{by}"""


# --- frames ----------------------------------------------------------------------------


def _pairs(spark, folder):
    rows = panel.predictions(spark, folder)
    keys = rows.where("model_name = 'reversal'").select("date", "ticker")
    return rows.join(keys, ["date", "ticker"], "left_semi")


def _combined(spark, folder):
    """Members and both ensembles; blended scores lose their last digits so that ties stay ties."""
    rows = checkpoint(_pairs(spark, folder))
    return en.with_ensembles(rows, MEMBERS, MEMBER_WINDOW, MEMBER_LAG).withColumn(
        "predicted_return",
        F.when(F.col("model_name") == en.ROLLING, F.round("predicted_return", 12)).otherwise(F.col("predicted_return")),
    )


def _daily(spark, folder):
    return en.daily_candidate_metrics(checkpoint(_combined(spark, folder)))


@query(
    "k08_ensemble_problems",
    "date ticker problem",
    """SELECT date, ticker, 'missing_member' AS problem FROM preds GROUP BY 1, 2 HAVING count(DISTINCT model_name) <> 2""",
)
def _problems(spark, folder):
    return en.ensemble_problems(panel.predictions(spark, folder), MEMBERS)


ENSEMBLE = "date ticker predicted_return:8 actual_return:8"


@query("k08_rank_ensemble", ENSEMBLE, "SELECT * FROM static_ensemble")
def _static(spark, folder):
    return en.rank_ensemble(_pairs(spark, folder), MEMBERS)


@query("k09_rolling_ensemble", ENSEMBLE + " weight_momentum:8 weight_reversal:8", "SELECT * FROM rolling_ensemble")
def _rolling(spark, folder):
    return en.rolling_rank_ensemble(checkpoint(_pairs(spark, folder)), MEMBERS, MEMBER_WINDOW, MEMBER_LAG)


@query("k09_member_weights", "date model_name weight:8", "SELECT * FROM member_weights")
def _weights(spark, folder):
    return en.rolling_member_weights(_pairs(spark, folder), MEMBERS, MEMBER_WINDOW, MEMBER_LAG)


DAILY = "model_name date rank_ic:8 top_n_actual_return:8"


@query("i18_daily_candidate_metrics", DAILY, "SELECT * FROM candidate_daily")
def _daily_metrics(spark, folder):
    return _daily(spark, folder)


@query(
    "i18_candidate_summary",
    "model_name evaluated_dates:i average_rank_ic:8 average_top_n_actual_return:8",
    "SELECT model_name, count(*) AS evaluated_dates, avg(rank_ic) AS average_rank_ic, avg(top_n_actual_return) AS average_top_n_actual_return FROM candidate_daily GROUP BY 1",
)
def _candidate_summary(spark, folder):
    return en.candidate_summary(_daily(spark, folder))


relation(
    "health",
    f"""SELECT *, CASE WHEN count(rank_ic) OVER w >= {HEALTH_WINDOW} THEN avg(rank_ic) OVER w END AS rolling_rank_ic,
        CASE WHEN count(top_n_actual_return) OVER w >= {HEALTH_WINDOW} THEN avg(top_n_actual_return) OVER w END AS rolling_top_n_actual_return,
        CASE WHEN count(rank_ic) OVER w >= {HEALTH_WINDOW} THEN stddev_samp(rank_ic) OVER w END AS rolling_rank_ic_volatility
        FROM candidate_daily WINDOW w AS (PARTITION BY model_name ORDER BY date ROWS BETWEEN {HEALTH_WINDOW - 1} PRECEDING AND CURRENT ROW)""",
)


@query(
    "e21_health_history",
    "model_name date rolling_rank_ic:7 rolling_top_n_actual_return:7 rolling_rank_ic_volatility:7",
    "SELECT * FROM health",
)
def _health(spark, folder):
    return en.health_history(_daily(spark, folder), HEALTH_WINDOW)


@query(
    "j06_latest_health",
    "model_name health_status latest_health_date latest_rolling_rank_ic:7",
    """SELECT *, CASE WHEN latest_health_date IS NULL THEN 'insufficient_history' WHEN latest_rolling_rank_ic <= 0 THEN 'degraded'
         WHEN latest_rolling_rank_ic < 0.005 THEN 'weak' ELSE 'positive' END AS health_status FROM (
       SELECT model_name, max(date) FILTER (rolling_rank_ic IS NOT NULL) AS latest_health_date,
              arg_max(rolling_rank_ic, date) FILTER (rolling_rank_ic IS NOT NULL) AS latest_rolling_rank_ic FROM health GROUP BY 1)""",
)
def _latest_health(spark, folder):
    return en.latest_health(en.health_history(_daily(spark, folder), HEALTH_WINDOW))


# --- regimes --------------------------------------------------------------------------------


@query(
    "e22_drawdown_overlay",
    "date market_drawdown:7 risk_off target_exposure:2",
    "SELECT date, market_drawdown, market_drawdown <= -0.1 AS risk_off, CASE WHEN market_drawdown <= -0.1 THEN 0.5 ELSE 0.97 END AS target_exposure FROM overlay_days",
)
def _overlay(spark, folder):
    return rg.drawdown_overlay(panel.bars(spark, folder))


@query(
    "e23_market_regimes",
    "date market_regime trailing_return:6l trailing_volatility:7 volatility_baseline:7",
    "SELECT * FROM regimes",
)
def _regimes(spark, folder):
    return rg.market_regimes(panel.bars(spark, folder))


@query(
    "l09_candidates_by_regime",
    "market_regime model_name evaluated_dates:i average_rank_ic:8 average_top_n_actual_return:8",
    """SELECT market_regime, model_name, count(*) AS evaluated_dates, avg(rank_ic) AS average_rank_ic, avg(top_n_actual_return) AS average_top_n_actual_return
       FROM candidate_daily JOIN regimes USING (date) GROUP BY 1, 2""",
)
def _by_regime(spark, folder):
    return rg.candidates_by_regime(_daily(spark, folder), rg.market_regimes(panel.bars(spark, folder)))


relation(
    "regime_choice",
    """SELECT r.date, r.market_regime, r.selected_model, rank_ic, CASE WHEN r.selected_model = 'cash' THEN 0 ELSE top_n_actual_return END AS top_n_actual_return FROM (
         SELECT date, market_regime, selected_model FROM regimes JOIN policy_rules USING (market_regime) WHERE policy_name = 'mixed'
           AND date IN (SELECT date FROM candidate_daily)) r
       LEFT JOIN candidate_daily c ON c.date = r.date AND c.model_name = r.selected_model""",
)


@query(
    "l09_regime_policy",
    "date market_regime selected_model rank_ic:8 top_n_actual_return:8",
    "SELECT * FROM regime_choice",
)
def _regime_policy(spark, folder):
    return rg.regime_policy_history(_daily(spark, folder), rg.market_regimes(panel.bars(spark, folder)), POLICIES["mixed"])


@query(
    "l09_regime_policy_summary",
    "evaluated_dates:i invested_dates:i cash_dates:i average_top_n_actual_return:8 top_n_return_volatility:8 cumulative_top_n_actual_return:6l",
    """SELECT count(*) AS evaluated_dates, count(*) FILTER (selected_model <> 'cash') AS invested_dates, count(*) FILTER (selected_model = 'cash') AS cash_dates,
       avg(top_n_actual_return) AS average_top_n_actual_return, stddev_samp(top_n_actual_return) AS top_n_return_volatility, product(1 + top_n_actual_return) - 1 AS cumulative_top_n_actual_return FROM regime_choice""",
)
def _regime_policy_summary(spark, folder):
    return rg.regime_policy_summary(_regime_policy(spark, folder))


@query("c11_rebalance_schedule", "date market_regime", "SELECT * FROM schedule")
def _schedule(spark, folder):
    return pol.rebalance_schedule(
        rg.market_regimes(panel.bars(spark, folder)), pol.complete_dates(_pairs(spark, folder).where("model_name = 'momentum'"), at_least=8)
    )


@query(
    "c11_spacing_problems",
    "date gap:i",
    """SELECT date, gap FROM (SELECT date, date_idx - lag(date_idx) OVER (ORDER BY date) AS gap FROM schedule JOIN date_list USING (date)) WHERE gap < 6""",
)
def _spacing(spark, folder):
    return pol.spacing_problems(_schedule(spark, folder), date_index(panel.bars(spark, folder)), 6)


def _histories(spark, folder):
    combined = checkpoint(_combined(spark, folder))
    pairs = combined.where(F.col("model_name") == "momentum")
    schedule = checkpoint(
        pol.rebalance_schedule(rg.market_regimes(panel.bars(spark, folder)), pol.complete_dates(pairs, at_least=8))
    )
    return pol.policy_history(combined, schedule, POLICIES)


HISTORY = (
    "policy_name date market_regime selected_model before_cost_return:7 total_cost:8 after_cost_return:7 portfolio_turnover:7 "
    "total_weight:7 selected_count:i forced_exit_weight:7"
)


@query("l07_policy_history", HISTORY, "SELECT * FROM policy_days")
def _policy_history(spark, folder):
    return _histories(spark, folder)


POLICY_SUMMARY = (
    "rebalance_dates:i average_after_cost_return:7 return_volatility:7 average_turnover:7 maximum_turnover:7 forced_exit_dates:i "
    "maximum_forced_exit_weight:7 final_cumulative_after_cost_return:6l max_after_cost_drawdown:6l"
)


@query("i14_policy_summary", "policy_name " + POLICY_SUMMARY, _summary_sql("policy_days", "policy_name"))
def _policy_summary(spark, folder):
    return pol.policy_summary(_histories(spark, folder))


relation(
    "policy_periods",
    f"SELECT *, CASE WHEN date < DATE '{HOLDOUT}' THEN 'training' ELSE 'holdout' END AS period FROM policy_days",
)


@query(
    "g03_holdout_split",
    "policy_name period " + POLICY_SUMMARY,
    _summary_sql("policy_periods", "policy_name, period"),
)
def _holdout(spark, folder):
    marked = splits.with_period(_histories(spark, folder), HOLDOUT)
    return pol.policy_summary(marked, ["policy_name", "period"])


@query(
    "f06_training_choice",
    "policy_name average_after_cost_return:7",
    f"""SELECT policy_name, average_after_cost_return FROM ({_summary_sql("policy_periods", "policy_name, period")}) WHERE period = 'training'
        ORDER BY average_after_cost_return / return_volatility DESC, policy_name LIMIT 1""",
)
def _choice(spark, folder):
    marked = splits.with_period(_histories(spark, folder), HOLDOUT)
    return me.best_training_candidate(pol.policy_summary(marked, ["policy_name", "period"]))


relation(
    "paired_days",
    """SELECT date, a.after_cost_return AS baseline_after_cost_return, b.after_cost_return AS overlay_after_cost_return,
       b.after_cost_return - a.after_cost_return AS after_cost_return_difference, 1 AS one FROM policy_days a JOIN policy_days b USING (date)
       WHERE a.policy_name = 'momentum' AND b.policy_name = 'mixed'""",
)


@query(
    "c08_paired_difference",
    "date baseline_after_cost_return:7 overlay_after_cost_return:7 after_cost_return_difference:7",
    "SELECT * FROM paired_days",
)
def _paired(spark, folder):
    rows = checkpoint(_histories(spark, folder))
    return pol.paired_difference(rows.where("policy_name = 'momentum'"), rows.where("policy_name = 'mixed'"))


@query(
    "i19_block_bootstrap",
    "model_name sample_size:i mean_value:8 bootstrap_95pct_lower:8 bootstrap_95pct_upper:8",
    bootstrap_sql("pair_ic", "rank_ic", "model_name", 10, 2000),
)
def _bootstrap(spark, folder):
    ic = me.rank_ic_by_date(_pairs(spark, folder), by=["model_name"])
    return pol.block_bootstrap(ic, "rank_ic", ["model_name"])


@query(
    "i20_overlay_stability",
    "paired_rebalance_dates:i mean_after_cost_return_difference:8 bootstrap_95pct_lower:8 bootstrap_95pct_upper:8 positive_rebalance_dates:i positive_years:i available_years:i",
    f"""SELECT sample_size AS paired_rebalance_dates, mean_value AS mean_after_cost_return_difference, bootstrap_95pct_lower, bootstrap_95pct_upper, y.*
        FROM ({bootstrap_sql('paired_days', 'after_cost_return_difference', 'one', 5, 2000)}),
        (SELECT sum(p) AS positive_rebalance_dates, count(*) FILTER (m > 0) AS positive_years, count(*) AS available_years FROM (
           SELECT year(date) AS y, avg(after_cost_return_difference) AS m, count(*) FILTER (after_cost_return_difference > 0) AS p FROM paired_days GROUP BY 1)) y""",
)
def _overlay_stability(spark, folder):
    return reports.overlay_comparison(checkpoint(_histories(spark, folder)), "momentum", "mixed")


relation(
    "challenges",
    """SELECT b.model_name AS baseline_model, date, a.rank_ic - b.rank_ic AS difference FROM candidate_daily a JOIN candidate_daily b USING (date)
       WHERE a.model_name = 'rank_ensemble' AND b.model_name <> 'rank_ensemble'""",
)


@query(
    "i20_candidate_stability",
    "challenger_model baseline_model paired_dates:i mean_rank_ic_difference:8 bootstrap_95pct_lower:8 bootstrap_95pct_upper:8 positive_rolling_windows:i available_rolling_windows:i",
    f"""SELECT 'rank_ensemble' AS challenger_model, b.baseline_model, r.paired_dates, b.mean_value AS mean_rank_ic_difference, bootstrap_95pct_lower, bootstrap_95pct_upper,
        positive_rolling_windows, available_rolling_windows
        FROM ({bootstrap_sql('challenges', 'difference', 'baseline_model', 10, 2000)}) b
        JOIN (SELECT baseline_model, count(*) AS paired_dates, count(*) FILTER (m > 0) AS positive_rolling_windows, count(m) AS available_rolling_windows FROM (
          SELECT *, CASE WHEN count(difference) OVER w >= 60 THEN avg(difference) OVER w END AS m FROM challenges
          WINDOW w AS (PARTITION BY baseline_model ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) GROUP BY 1) r ON r.baseline_model = b.baseline_model""",
)
def _candidate_stability(spark, folder):
    return pol.candidate_stability(checkpoint(_daily(spark, folder)), window=60)


def _with_benchmark(spark, folder):
    """Policy histories next to the mean outcome of all names of the date."""
    rows = checkpoint(_histories(spark, folder))
    mean = _pairs(spark, folder).where("model_name = 'momentum'").groupBy("date").agg(
        F.avg("actual_return").alias("__mean")
    )
    market = la.forward_labels(panel.bars(spark, folder)).groupBy("date").agg(
        (F.avg("forward_return_5d") / 10).alias("benchmark_return")
    )
    return rows.join(F.broadcast(market), "date").join(F.broadcast(mean), "date").drop("__mean")


relation(
    "benched",
    """SELECT p.*, benchmark_return, after_cost_return - benchmark_return AS active_return FROM policy_days p
       JOIN (SELECT date, avg(forward_return_5d) / 10 AS benchmark_return FROM forwards GROUP BY date) b USING (date)""",
)


@query(
    "i21_yearly_summary",
    "policy_name year:i rebalance_dates:i cumulative_portfolio_return:6l cumulative_benchmark_return:6l cumulative_active_return:6l max_portfolio_drawdown:6l",
    """SELECT policy_name, year(date) AS year, count(*) AS rebalance_dates, arg_max(nav, date) - 1 AS cumulative_portfolio_return, arg_max(bench, date) - 1 AS cumulative_benchmark_return,
       arg_max(nav / bench, date) - 1 AS cumulative_active_return, min(nav / greatest(peak, 1) - 1) AS max_portfolio_drawdown
       FROM (SELECT *, max(nav) OVER (PARTITION BY policy_name, year(date) ORDER BY date) AS peak FROM (
         SELECT *, product(1 + after_cost_return) OVER (PARTITION BY policy_name, year(date) ORDER BY date) AS nav,
                product(1 + benchmark_return) OVER (PARTITION BY policy_name, year(date) ORDER BY date) AS bench FROM benched)) GROUP BY 1, 2""",
)
def _yearly(spark, folder):
    return pol.yearly_summary(_with_benchmark(spark, folder))


@query(
    "i21_holdout_stability",
    "policy_name holdout_dates:i mean_active_return:8 bootstrap_95pct_lower:8 bootstrap_95pct_upper:8 positive_active_dates:i",
    f"""SELECT b.policy_name, sample_size AS holdout_dates, mean_value AS mean_active_return, bootstrap_95pct_lower, bootstrap_95pct_upper, positive_active_dates
        FROM ({bootstrap_sql(f"(SELECT * FROM benched WHERE date >= DATE '{HOLDOUT}')", 'active_return', 'policy_name', 3, 2000)}) b
        JOIN (SELECT policy_name, count(*) FILTER (active_return > 0) AS positive_active_dates FROM benched WHERE date >= DATE '{HOLDOUT}' GROUP BY 1) p ON p.policy_name = b.policy_name""",
)
def _holdout_stability(spark, folder):
    return pol.holdout_stability(_with_benchmark(spark, folder), HOLDOUT)


@query(
    "o08_walk_forward_choice",
    "policy_name period rebalance_dates:i average_after_cost_return:7",
    f"""SELECT s.* FROM ({_summary_sql("policy_periods", "policy_name, period")}) s WHERE period = 'holdout' AND policy_name = (
          SELECT policy_name FROM ({_summary_sql("policy_periods", "policy_name, period")}) WHERE period = 'training'
          ORDER BY average_after_cost_return / return_volatility DESC, policy_name LIMIT 1)""",
)
def _walk_forward(spark, folder):
    return reports.walk_forward_choice(checkpoint(_histories(spark, folder)), HOLDOUT)["holdout"]


@query(
    "l07_overlay_history",
    "policy_name date target_exposure:2 after_cost_return:7 portfolio_turnover:7",
    "SELECT *, before_cost_return - total_cost AS after_cost_return FROM overlay_walk WHERE step > 0",
)
def _overlay_history(spark, folder):
    """Baseline, overlay at -10% and overlay at -15%, each a policy of the same model."""
    combined = checkpoint(_pairs(spark, folder))
    bars = panel.bars(spark, folder)
    schedule = checkpoint(pol.rebalance_schedule(rg.market_regimes(bars), pol.complete_dates(combined.where("model_name = 'momentum'"), at_least=8)))
    policies = {name: POLICIES["momentum"] for name in ("baseline", "drawdown_10", "drawdown_15")}
    exposures = {
        "drawdown_10": rg.drawdown_overlay(bars, -0.10),
        "drawdown_15": rg.drawdown_overlay(bars, -0.15),
    }
    return pol.policy_history(combined, schedule, policies, exposure_by_date=exposures)


# --- spaced signals with a ten-row horizon --------------------------------------------------

PAPER_POLICIES = {"momentum": POLICIES["momentum"], "ensemble": POLICIES["ensemble"]}

relation(
    "spaced",
    """SELECT * FROM (
         SELECT m.date, m.ticker, x.model_name, CASE WHEN x.model_name = 'momentum' THEN return_10d ELSE -distance_from_20d_high END AS predicted_return,
                forward_relative_return_10d AS actual_return, forward_return_10d AS portfolio_return
         FROM moves m JOIN loo USING (date, ticker) JOIN date_list USING (date), (SELECT unnest(['momentum', 'reversal']) AS model_name) x
         WHERE date_idx % 10 = 0 AND distance_from_20d_high IS NOT NULL)
       WHERE predicted_return IS NOT NULL AND actual_return IS NOT NULL""",
)
relation(
    "spaced_candidates",
    """SELECT date, ticker, model_name, predicted_return FROM spaced UNION ALL
       SELECT date, ticker, 'rank_ensemble', 1 - avg(place) / (max(n) + 1) FROM (
         SELECT *, row_number() OVER (PARTITION BY model_name, date ORDER BY predicted_return DESC, ticker) AS place,
                count(*) OVER (PARTITION BY model_name, date) AS n FROM spaced) GROUP BY 1, 2""",
)
relation(
    "spaced_schedule",
    """SELECT date, market_regime FROM regimes WHERE date IN (SELECT date FROM spaced WHERE model_name = 'momentum' GROUP BY date HAVING count(*) >= 8)""",
)
relation(
    "spaced_rules",
    "SELECT * FROM policy_rules WHERE policy_name IN ('momentum', 'ensemble')",
)
relation(
    "spaced_steps",
    _steps_sql("spaced_rules", "spaced_candidates", "0.97::DOUBLE", "spaced_schedule", "spaced", "portfolio_return"),
)
relation("spaced_walk", _walk_sql("spaced_walk", "spaced_steps"))
relation(
    "spaced_periods",
    f"""SELECT w.*, before_cost_return - total_cost AS after_cost_return, benchmark_return, CASE WHEN w.date < DATE '{HOLDOUT}' THEN 'training' ELSE 'holdout' END AS period
        FROM spaced_walk w JOIN (SELECT date, avg(forward_return_10d) AS benchmark_return FROM forwards GROUP BY date) b ON b.date = w.date WHERE step > 0""",
)


@query(
    "i21_paper_periods",
    "policy_name period rebalance_dates:i average_after_cost_return:7 average_turnover:7 mean_benchmark:7",
    """SELECT policy_name, period, count(*) AS rebalance_dates, avg(after_cost_return) AS average_after_cost_return, avg(portfolio_turnover) AS average_turnover,
       avg(benchmark_return) AS mean_benchmark FROM spaced_periods GROUP BY 1, 2""",
)
def _paper_periods(spark, folder):
    bars = panel.bars(spark, folder)
    rows = score_predictions(bars, horizon=10)
    spaced = rows.join(F.broadcast(date_index(bars).where("date_idx % 10 = 0").select("date")), "date", "left_semi")
    keys = spaced.where("model_name = 'reversal'").select("date", "ticker")
    pairs = spaced.join(keys, ["date", "ticker"], "left_semi")
    prepared, benchmark = reports.paper_inputs(checkpoint(pairs), bars, 10)
    histories = checkpoint(
        reports.paper_histories(checkpoint(prepared), benchmark, bars, PAPER_POLICIES, MEMBERS)
    )
    means = splits.with_period(histories, HOLDOUT).groupBy("policy_name", "period").agg(
        F.avg("benchmark_return").alias("mean_benchmark")
    )
    return reports.paper_periods(histories, HOLDOUT).join(means, ["policy_name", "period"])


# --- drift ---------------------------------------------------------------------------------

DRIFT = ["return_1d", "return_20d", "distance_from_20d_high", "hit_ceiling_today", "consecutive_ceiling_days", "average_daily_volume_20d"]
_LONG = " UNION ALL ".join(
    f"SELECT l.date, l.ticker, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM limits l JOIN ceiling_runs r ON r.date = l.date AND r.ticker = l.ticker" for f in DRIFT
)
relation(
    "drift_rows",
    f"""SELECT x.*, CASE WHEN k <= 80 THEN 'recent' ELSE 'reference' END AS period FROM ({_LONG}) x
        JOIN (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM date_list) USING (date) WHERE k <= 280""",
)
relation(
    "drift_edges",
    """SELECT feature, CASE WHEN len(q) < 3 THEN [c - greatest(abs(c) * 1e-6, 1e-6), c + greatest(abs(c) * 1e-6, 1e-6)] ELSE q[2:-2] END AS inside FROM (
         SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q, arg_min(value, (date, ticker)) AS c
         FROM drift_rows WHERE period = 'reference' AND value IS NOT NULL GROUP BY 1)""",
)
relation(
    "drift_bins",
    """SELECT s.feature, s.bin, coalesce(p, 0) AS p, coalesce(r, 0) AS r FROM (SELECT feature, unnest(range(0, len(inside) + 1)) AS bin FROM drift_edges) s
       LEFT JOIN (SELECT d.feature, len(list_filter(inside, lambda e: e <= value)) AS bin, count(*) FILTER (period = 'reference') AS p, count(*) FILTER (period = 'recent') AS r
         FROM drift_rows d JOIN drift_edges e ON e.feature = d.feature WHERE value IS NOT NULL GROUP BY 1, 2) c ON c.feature = s.feature AND c.bin = s.bin""",
)
relation(
    "psi",
    """SELECT feature, sum((r - p) * ln(r / p)) AS psi FROM (
         SELECT feature, (p + 1e-6) / (sum(p) OVER (PARTITION BY feature) + 1e-6 * count(*) OVER (PARTITION BY feature)) AS p,
                (r + 1e-6) / (sum(r) OVER (PARTITION BY feature) + 1e-6 * count(*) OVER (PARTITION BY feature)) AS r FROM drift_bins) GROUP BY 1""",
)


def _drift_features(spark, folder):
    return panel.features(spark, folder).select("date", "ticker", *DRIFT)


@query("j04_stability_index", "feature psi:7", "SELECT * FROM psi")
def _psi(spark, folder):
    rows = mo.split_windows(checkpoint(_drift_features(spark, folder)), 200, 80)
    return mo.stability_index(mo.long_features(rows, DRIFT))


@query(
    "j05_drift_report",
    "feature psi:7 drift_status reference_mean:5 recent_mean:5 reference_missing_rate:7 recent_missing_rate:7",
    """SELECT feature, psi, CASE WHEN psi >= 0.25 THEN 'significant_shift' WHEN psi >= 0.1 THEN 'moderate_shift' ELSE 'stable' END AS drift_status, f.* EXCLUDE (feature)
       FROM psi JOIN (SELECT feature, avg(value) FILTER (period = 'reference') AS reference_mean, avg(value) FILTER (period = 'recent') AS recent_mean,
         avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) FILTER (period = 'reference') AS reference_missing_rate,
         avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) FILTER (period = 'recent') AS recent_missing_rate FROM drift_rows GROUP BY 1) f USING (feature)""",
)
def _drift(spark, folder):
    return mo.drift_report(checkpoint(_drift_features(spark, folder)), DRIFT, 200, 80)
