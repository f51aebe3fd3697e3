"""Scores, selections and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import panel
from catalog.features import index_prices
from catalog.registry import query, relation
from tidepanel.operators import features as fe
from tidepanel.operators import metrics as me
from tidepanel.operators import selection as se
from tidepanel.operators import splits
from tidepanel.operators.labels import index_forward_returns, top_quintile_label
from tidepanel.operators.models import rank_probabilities
from tidepanel.plans import reports
from tidepanel.session import checkpoint
from tidepanel.sources.tables import harmonise_predictions

# --- scores and baselines -------------------------------------------------------------

relation(
    "score_panel",
    """SELECT m.date, m.ticker, return_10d AS momentum_score, -distance_from_20d_high AS reversal_score,
       -rolling_vol_20d AS low_volatility_score, forward_return_5d, benchmark_forward_return_5d, forward_relative_return_5d
       FROM moves m JOIN vols USING (date, ticker) JOIN loo USING (date, ticker)""",
)


def _score_panel(spark, folder):
    bars = panel.bars(spark, folder)
    moved = fe.add_momentum(fe.add_volatility(fe.add_returns(bars)))
    chosen = moved.select("date", "ticker", "return_10d", "distance_from_20d_high", "rolling_vol_20d")
    # Four strategies read this table.
    return checkpoint(chosen.join(panel.labels(spark, folder), ["date", "ticker"]))


@query(
    "h02_scores",
    "date ticker momentum_score:8 reversal_score:8 low_volatility_score:8 equal_score:8",
    "SELECT *, 0.0 AS equal_score FROM score_panel",
)
def _scores(spark, folder):
    return se.add_portfolio_scores(_score_panel(spark, folder))


def _chosen(score: str, n: int) -> str:
    return f"""SELECT date, ticker, {score} AS score, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM (
        SELECT *, row_number() OVER (PARTITION BY date ORDER BY {score} DESC, ticker) AS place FROM score_panel
        WHERE {score} IS NOT NULL AND forward_return_5d IS NOT NULL) WHERE place <= {n}"""


@query("f01_top_momentum", "date ticker momentum_score:8 weight:8", _chosen("momentum_score", 5).replace("AS score", "AS momentum_score"))
def _top_momentum(spark, folder):
    scored = se.add_portfolio_scores(_score_panel(spark, folder))
    return se.select_top_n(scored, "momentum_score", 5, "top5_momentum", "forward_return_5d")


@query(
    "f02_equal_weight_all",
    "date ticker weight:8",
    "SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM score_panel WHERE forward_return_5d IS NOT NULL",
)
def _equal_all(spark, folder):
    return se.select_all(_score_panel(spark, folder), "forward_return_5d")


_STRATEGIES = " UNION ALL ".join(
    f"SELECT date, ticker, '{name}' AS strategy, weight FROM ({_chosen(score, n)})"
    for name, score, n in (
        ("top5_momentum", "momentum_score", 5),
        ("top5_reversal", "reversal_score", 5),
        ("low_volatility_top10", "low_volatility_score", 10),
    )
)
relation(
    "positions_all",
    "SELECT date, ticker, 'equal_weight_all' AS strategy, 1.0 / count(*) OVER (PARTITION BY date) AS weight "
    "FROM score_panel WHERE forward_return_5d IS NOT NULL UNION ALL " + _STRATEGIES,
)
relation(
    "strategy_returns",
    """SELECT p.date, strategy, coalesce(sum(weight * forward_return_5d), 0) AS portfolio_return,
       coalesce(sum(weight * benchmark_forward_return_5d), 0) AS benchmark_return,
       coalesce(sum(weight * forward_relative_return_5d), 0) AS active_return, count(*) AS selected_count
       FROM positions_all p JOIN score_panel USING (date, ticker) GROUP BY 1, 2""",
)


@query("f05_baseline_positions", "date ticker strategy weight:8", "SELECT * FROM positions_all")
def _positions(spark, folder):
    return se.baseline_positions(_score_panel(spark, folder))


RETURNS = "date strategy portfolio_return:8 benchmark_return:8 active_return:8 selected_count:i"


@query("d08_portfolio_returns", RETURNS, "SELECT * FROM strategy_returns")
def _returns(spark, folder):
    return se.portfolio_returns(se.baseline_positions(_score_panel(spark, folder)))


@query(
    "f05_returns_versus_index",
    "date strategy portfolio_return:8 active_return_vs_index:8",
    "SELECT date, strategy, portfolio_return, portfolio_return - benchmark_forward_return_5d AS active_return_vs_index "
    "FROM strategy_returns LEFT JOIN index_forwards USING (date)",
)
def _versus_index(spark, folder):
    returns = se.portfolio_returns(se.baseline_positions(_score_panel(spark, folder)))
    index = index_forward_returns(index_prices(spark, folder))
    return se.returns_versus_index(returns, index, "benchmark_forward_return_5d")


# --- ranks of predictions ------------------------------------------------------------------

relation(
    "ranked",
    """SELECT *, row_number() OVER (PARTITION BY model_name, date ORDER BY predicted_return DESC, ticker) AS place,
       row_number() OVER (PARTITION BY model_name, date ORDER BY predicted_return, ticker) AS place_from_bottom,
       row_number() OVER (PARTITION BY model_name, date ORDER BY actual_return DESC, ticker) AS realised_place,
       rank() OVER (PARTITION BY model_name, date ORDER BY predicted_return)
         + (count(*) OVER (PARTITION BY model_name, date, predicted_return) - 1) / 2.0 AS score_rank,
       rank() OVER (PARTITION BY model_name, date ORDER BY actual_return)
         + (count(*) OVER (PARTITION BY model_name, date, actual_return) - 1) / 2.0 AS actual_rank
       FROM preds""",
)
relation(
    "ic",
    """SELECT model_name, date, CASE WHEN var_pop(score_rank) > 0 AND var_pop(actual_rank) > 0 THEN corr(score_rank, actual_rank) END AS rank_ic,
       count(*) AS stock_count FROM ranked GROUP BY 1, 2""",
)
relation(
    "tops",
    """SELECT model_name, date, count(*) AS selected_count, avg(CASE WHEN actual_return > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
       avg(actual_return) AS average_selected_return FROM ranked WHERE place <= 5 GROUP BY 1, 2""",
)
relation(
    "spreads",
    """SELECT model_name, date, avg(CASE WHEN place <= 5 THEN actual_return END) AS top_return,
       avg(CASE WHEN place_from_bottom <= 5 THEN actual_return END) AS bottom_return,
       avg(CASE WHEN place <= 5 THEN actual_return END) - avg(CASE WHEN place_from_bottom <= 5 THEN actual_return END) AS top_minus_bottom_spread
       FROM ranked GROUP BY 1, 2""",
)
relation(
    "selected_lists",
    """SELECT *, lag(names) OVER (PARTITION BY model_name ORDER BY date) AS previous FROM (
         SELECT model_name, date, list(ticker) AS names, avg(actual_return) AS gross FROM ranked WHERE place <= 5 GROUP BY 1, 2)""",
)
relation(
    "turnovers",
    """SELECT model_name, date, len(names) AS selected_count,
       CASE WHEN previous IS NOT NULL THEN (len(names) + len(previous) - 2 * len(list_intersect(names, previous)))
         / CAST(greatest(len(names), len(previous), 1) AS DOUBLE) END AS turnover, gross FROM selected_lists""",
)
relation(
    "model_returns",
    """SELECT model_name, date, gross AS gross_top_n_return, selected_count, turnover, coalesce(turnover, 0) * 0.001 AS transaction_cost,
       gross - coalesce(turnover, 0) * 0.001 AS after_cost_return FROM turnovers""",
)


@query("i01_rank_ic", "model_name date rank_ic:8 stock_count:i", "SELECT * FROM ic")
def _ic(spark, folder):
    return me.rank_ic_by_date(panel.predictions(spark, folder), by=["model_name"])


@query("i02_rank_ic_strict", "model_name date rank_ic:8 stock_count:i", "SELECT * FROM ic WHERE stock_count >= 2 AND rank_ic IS NOT NULL")
def _ic_strict(spark, folder):
    return me.rank_ic_by_date(panel.predictions(spark, folder), by=["model_name"], strict=True)


def _spearman(score: str, actual: str, source: str) -> str:
    return f"""SELECT '{score}' AS score, count(*) AS evaluated_dates, avg(c) AS average_rank_ic FROM (
        SELECT date, corr(a, b) AS c FROM (SELECT date,
          rank() OVER (PARTITION BY date ORDER BY {score}) + (count(*) OVER (PARTITION BY date, {score}) - 1) / 2.0 AS a,
          rank() OVER (PARTITION BY date ORDER BY {actual}) + (count(*) OVER (PARTITION BY date, {actual}) - 1) / 2.0 AS b
          FROM {source} WHERE {score} IS NOT NULL AND {actual} IS NOT NULL)
        GROUP BY date HAVING count(*) >= 2 AND var_pop(a) > 0 AND var_pop(b) > 0)"""


@query(
    "i03_rank_ic_summary",
    "score evaluated_dates:i average_rank_ic:8",
    " UNION ALL ".join(
        _spearman(s, "forward_relative_return_5d", "score_panel") for s in ("momentum_score", "reversal_score", "low_volatility_score")
    ),
)
def _ic_summary(spark, folder):
    scores = ["momentum_score", "reversal_score", "low_volatility_score"]
    splits.check_score_columns(scores)
    scored = se.add_portfolio_scores(_score_panel(spark, folder))
    return me.rank_ic_summary(scored, scores, "forward_relative_return_5d")


@query("i04_hit_rate", "model_name date selected_count:i hit_rate:8 average_selected_return:8", "SELECT * FROM tops")
def _hit_rate(spark, folder):
    return me.top_n_outcome(panel.predictions(spark, folder), by=["model_name"])


@query("i05_top_bottom_spread", "model_name date top_return:8 bottom_return:8 top_minus_bottom_spread:8", "SELECT * FROM spreads")
def _spread(spark, folder):
    return me.top_bottom_spread(panel.predictions(spark, folder), by=["model_name"])


@query(
    "f03_top_n_flags",
    "model_name date ticker prediction_rank:i selected",
    "SELECT model_name, date, ticker, place AS prediction_rank, place <= 5 AS selected FROM ranked",
)
def _flags(spark, folder):
    return se.top_n_flags(panel.predictions(spark, folder), by=["model_name", "date"])


@query("e20_selection_turnover", "model_name date selected_count:i turnover:8", "SELECT * FROM turnovers")
def _turnover(spark, folder):
    flags = se.top_n_flags(panel.predictions(spark, folder), by=["model_name", "date"])
    return se.selection_turnover(flags, ["model_name"])


MODEL_RETURNS = "model_name date gross_top_n_return:8 selected_count:i turnover:8 transaction_cost:8 after_cost_return:8"


@query("i06_top_n_portfolio", MODEL_RETURNS, "SELECT * FROM model_returns")
def _portfolio(spark, folder):
    return me.top_n_portfolio(panel.predictions(spark, folder), by=["model_name"])


def drawdown_sql(source: str, value: str, by: str, floor: str = "") -> str:
    """Rows of source with nav and drawdown of a compounded series."""
    peak = f"max(nav) OVER (PARTITION BY {by} ORDER BY date)"
    peak = f"greatest({peak}, {floor})" if floor else peak
    return f"""SELECT *, nav / {peak} - 1 AS drawdown FROM (
        SELECT *, product(1 + coalesce({value}, 0)) OVER (PARTITION BY {by} ORDER BY date) AS nav FROM {source})"""


def stats_sql(source: str, value: str, by: str, extra: str = "") -> str:
    return f"""SELECT {by}, count(*) AS evaluated_dates, avg({value}) AS average_return,
        avg({value}) / nullif(stddev_samp({value}), 0) * sqrt(252) AS sharpe_ratio, min(drawdown) AS max_drawdown{extra}
        FROM ({drawdown_sql(source, value, by)}) GROUP BY {by}"""


STATS = "evaluated_dates:i average_return:8 sharpe_ratio:7 max_drawdown:6l"


@query("i07_sharpe_ratio", "strategy sharpe_ratio:7", "SELECT strategy, avg(portfolio_return) / nullif(stddev_samp(portfolio_return), 0) * sqrt(252) AS sharpe_ratio FROM strategy_returns GROUP BY 1")
def _sharpe(spark, folder):
    returns = se.portfolio_returns(se.baseline_positions(_score_panel(spark, folder)))
    return returns.groupBy("strategy").agg(me.sharpe_of("portfolio_return").alias("sharpe_ratio"))


@query(
    "i08_compounded_drawdown",
    "strategy date drawdown:6l",
    drawdown_sql("strategy_returns", "active_return / 10", "strategy"),
)
def _drawdown(spark, folder):
    returns = se.portfolio_returns(se.baseline_positions(_score_panel(spark, folder)))
    tenth = returns.withColumn("tenth", F.col("active_return") / 10)
    return me.with_compounded_drawdown(tenth, "tenth", ["strategy"])


@query(
    "i09_portfolio_summary",
    f"model_name {STATS} average_turnover:8 average_transaction_cost:8",
    stats_sql("model_returns", "after_cost_return", "model_name", ", avg(turnover) AS average_turnover, avg(transaction_cost) AS average_transaction_cost"),
)
def _summary(spark, folder):
    return me.portfolio_summary(me.top_n_portfolio(panel.predictions(spark, folder), by=["model_name"]))


relation(
    "model_table",
    f"""SELECT * FROM (SELECT model_name, count(*) AS dates, avg(rank_ic) AS average_rank_ic FROM ic GROUP BY 1)
       JOIN (SELECT model_name, avg(hit_rate) AS average_hit_rate FROM tops GROUP BY 1) USING (model_name)
       JOIN (SELECT model_name, avg(top_minus_bottom_spread) AS average_top_minus_bottom_spread FROM spreads GROUP BY 1) USING (model_name)
       JOIN (SELECT model_name, avg(gross_top_n_return) AS average_gross_top_n_return, avg(turnover) AS average_turnover,
                    avg(transaction_cost) AS average_transaction_cost FROM model_returns GROUP BY 1) USING (model_name)
       JOIN ({stats_sql('model_returns', 'after_cost_return', 'model_name')}) USING (model_name)""",
)
MODEL = (
    "model_name evaluated_dates:i average_rank_ic:8 average_hit_rate:8 average_top_minus_bottom_spread:8 "
    "average_gross_top_n_return:8 average_after_cost_return:8 sharpe_ratio:7 max_drawdown:6l average_turnover:8 average_transaction_cost:8"
)


@query("i10_model_summary", MODEL, "SELECT *, average_return AS average_after_cost_return FROM model_table")
def _model_summary(spark, folder):
    return me.model_summary(panel.predictions(spark, folder))


@query(
    "o07_model_report",
    "model_name evaluated_dates:i average_rank_ic:8 average_hit_rate:8 sharpe_ratio:7",
    "SELECT *, dates AS date_count FROM model_table",
)
def _model_report(spark, folder):
    tables = reports.model_report(
        panel.predictions(spark, folder),
        baselines=se.portfolio_returns(se.baseline_positions(_score_panel(spark, folder))),
    )
    return tables["regression"]


@query(
    "f06_best_model",
    "model_name average_rank_ic:8",
    "SELECT * FROM model_table ORDER BY average_rank_ic DESC NULLS LAST, average_return DESC, average_top_minus_bottom_spread DESC, model_name LIMIT 1",
)
def _best_model(spark, folder):
    return me.best_model(me.model_summary(panel.predictions(spark, folder)))


@query(
    "c07_performance_summary",
    "model_name evaluated_dates:i average_rank_ic:8 average_top_n_actual_return:8 average_selected_count:8",
    """SELECT * FROM (SELECT model_name, count(*) AS evaluated_dates, avg(rank_ic) AS average_rank_ic FROM ic WHERE rank_ic IS NOT NULL GROUP BY 1)
       FULL JOIN (SELECT model_name, avg(average_selected_return) AS average_top_n_actual_return, avg(selected_count) AS average_selected_count FROM tops GROUP BY 1)
       USING (model_name)""",
)
def _performance(spark, folder):
    return me.performance_summary(panel.predictions(spark, folder))


@query(
    "f04_top_n_average",
    "model_name date average_selected_return:8 selected_count:i",
    "SELECT * FROM tops",
)
def _top_average(spark, folder):
    return me.top_n_outcome(panel.predictions(spark, folder), by=["model_name"])


# --- classification -------------------------------------------------------------------------

relation(
    "classified",
    """SELECT date, ticker, target AS actual_return, top_quintile_label AS actual_label, place <= 5 AS selected_top_5 FROM (
         SELECT q.date, q.ticker, target, top_quintile_label, row_number() OVER (PARTITION BY q.date ORDER BY return_10d DESC, q.ticker) AS place
         FROM quintiles q JOIN moves m ON q.date = m.date AND q.ticker = m.ticker
         WHERE top_quintile_label IS NOT NULL AND return_10d IS NOT NULL)""",
)
relation(
    "classified_daily",
    """SELECT date, sum(CASE WHEN selected_top_5 THEN actual_label ELSE 0 END) / CAST(nullif(count(CASE WHEN selected_top_5 THEN 1 END), 0) AS DOUBLE) AS precision,
       sum(CASE WHEN selected_top_5 THEN actual_label ELSE 0 END) / CAST(nullif(sum(actual_label), 0) AS DOUBLE) AS recall,
       count(CASE WHEN selected_top_5 THEN 1 END) AS selected_count,
       avg(CASE WHEN selected_top_5 THEN actual_return END) AS average_selected_return, 'logistic_regression' AS model_name
       FROM classified GROUP BY date""",
)


def _classified(spark, folder):
    """Momentum stands in for a probability, so the result does not depend on a fit."""
    rows = panel.labels(spark, folder).withColumn("target", F.col("forward_relative_return_5d"))
    labelled = top_quintile_label(rows, "target").where("top_quintile_label IS NOT NULL")
    scored = fe.add_momentum(panel.bars(spark, folder)).select(
        "date", "ticker", F.col("return_10d").alias("predicted_probability")
    ).where("predicted_probability IS NOT NULL")
    joined = labelled.join(scored, ["date", "ticker"]).select(
        "date", "ticker", "predicted_probability", F.col("top_quintile_label").alias("actual_label"),
        F.col("target").alias("actual_return"),
    )
    return checkpoint(rank_probabilities(checkpoint(joined)))


@query(
    "i11_classification_by_date",
    "date precision:8 recall:8 selected_count:i average_selected_return:8",
    "SELECT * FROM classified_daily",
)
def _classification(spark, folder):
    return me.classification_by_date(_classified(spark, folder))


@query(
    "i11_classification_summary",
    "model_name evaluated_dates:i average_precision:8 average_recall:8 average_selected_return:8 sharpe_ratio:7",
    """SELECT model_name, count(*) AS evaluated_dates, avg(precision) AS average_precision, avg(recall) AS average_recall,
       avg(average_selected_return) AS average_selected_return,
       avg(average_selected_return) / stddev_samp(average_selected_return) * sqrt(252) AS sharpe_ratio FROM classified_daily GROUP BY 1""",
)
def _classification_summary(spark, folder):
    return me.classification_summary(_classified(spark, folder))


# --- strategy and scenario tables ---------------------------------------------------------------


@query(
    "i12_baseline_summary",
    "strategy evaluated_dates:i average_portfolio_return:8 average_active_return:8 sharpe_ratio:7 max_drawdown:6l average_selected_count:8",
    "SELECT *, average_return AS average_portfolio_return FROM ("
    + stats_sql("strategy_returns", "portfolio_return", "strategy", ", avg(active_return) AS average_active_return, avg(selected_count) AS average_selected_count")
    + ")",
)
def _baseline(spark, folder):
    return me.baseline_summary(se.portfolio_returns(se.baseline_positions(_score_panel(spark, folder))))


relation(
    "scenario_dates",
    """SELECT ic.model_name, ic.date, rank_ic, hit_rate, average_selected_return FROM ic JOIN tops USING (model_name, date)
       JOIN (SELECT model_name, date FROM preds GROUP BY 1, 2 HAVING count(DISTINCT actual_return) > 1) v USING (model_name, date)""",
)


@query(
    "i15_scenario_summary",
    "model_name evaluated_dates:i average_rank_ic:8 average_hit_rate:8 average_top_n_return:8",
    """SELECT model_name, count(*) AS evaluated_dates, avg(rank_ic) AS average_rank_ic, avg(hit_rate) AS average_hit_rate,
       avg(average_selected_return) AS average_top_n_return FROM scenario_dates GROUP BY 1""",
)
def _scenario(spark, folder):
    return me.scenario_summary(panel.predictions(spark, folder), "model_name")


relation(
    "overlap_daily",
    """SELECT model_name, date, avg(CASE WHEN realised_place <= 5 THEN 1.0 ELSE 0.0 END) AS top5_hit_rate,
       avg(actual_return) AS top5_return, count(*) AS selected_count
       FROM ranked JOIN (SELECT model_name, date FROM ranked GROUP BY 1, 2 HAVING count(*) >= 5) USING (model_name, date)
       WHERE place <= 5 GROUP BY 1, 2""",
)


@query(
    "i16_model_comparison",
    "model_family model_name evaluated_dates:i average_rank_ic:8 average_top5_hit_rate:8 average_top5_return:8 return_volatility:8 diagnostic_sharpe:8 max_drawdown_of_sum:7 final_cumulative_sum:7",
    """SELECT 'score' AS model_family, model_name, count(*) AS evaluated_dates, avg(rank_ic) AS average_rank_ic, avg(top5_hit_rate) AS average_top5_hit_rate,
       avg(top5_return) AS average_top5_return, stddev_samp(top5_return) AS return_volatility,
       avg(top5_return) / stddev_samp(top5_return) AS diagnostic_sharpe, min(s - peak) AS max_drawdown_of_sum, sum(top5_return) AS final_cumulative_sum
       FROM (SELECT *, max(s) OVER (PARTITION BY model_name ORDER BY date) AS peak FROM (
         SELECT *, sum(top5_return) OVER (PARTITION BY model_name ORDER BY date) AS s FROM overlap_daily JOIN ic USING (model_name, date)))
       GROUP BY 2""",
)
def _comparison(spark, folder):
    return me.model_comparison(harmonise_predictions(panel.predictions(spark, folder), "score"))


@query(
    "i17_summed_drawdown",
    "strategy date cumulative_sum:7 sum_drawdown:7",
    """SELECT strategy, date, s AS cumulative_sum, s - max(s) OVER (PARTITION BY strategy ORDER BY date) AS sum_drawdown
       FROM (SELECT *, sum(active_return) OVER (PARTITION BY strategy ORDER BY date) AS s FROM strategy_returns)""",
)
def _summed(spark, folder):
    returns = se.portfolio_returns(se.baseline_positions(_score_panel(spark, folder)))
    return me.with_summed_drawdown(returns, "active_return", ["strategy"])


@query(
    "e24_rolling_sharpe",
    "strategy date rolling_sharpe:6 band:6 band_lower:6 band_upper:6",
    """SELECT strategy, date, q * sqrt(252) AS rolling_sharpe, b AS band, q * sqrt(252) - b AS band_lower, q * sqrt(252) + b AS band_upper
       FROM (SELECT *, sqrt((1 + 0.5 * q * q) / 60.0) * sqrt(252) AS b FROM (
         SELECT strategy, date, CASE WHEN count(*) OVER w >= 60 THEN avg(portfolio_return) OVER w / stddev_samp(portfolio_return) OVER w END AS q
         FROM strategy_returns WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)))""",
)
def _rolling_sharpe(spark, folder):
    returns = se.portfolio_returns(se.baseline_positions(_score_panel(spark, folder)))
    return me.rolling_sharpe(returns, "portfolio_return", ["strategy"])


@query(
    "e25_weekly_extremes",
    "user_id:i week_end worst_drawdown:4 mean_turnover:6",
    """SELECT user_id, date + CAST((5 - isodow(date) + 7) % 7 AS INT) AS week_end, min(value) AS worst_drawdown, avg(value) AS mean_turnover
       FROM (SELECT user_id, CAST(ts AS DATE) AS date, value FROM events WHERE value IS NOT NULL) GROUP BY 1, 2""",
)
def _weekly(spark, folder):
    rows = spark.read.parquet(f"{folder}/events.parquet").where("value IS NOT NULL")
    daily = rows.select("user_id", F.to_date("ts").alias("date"), "value")
    return me.weekly_extremes(daily, "value", "value", ["user_id"])


@query(
    "f09_latest_ranking",
    "date ticker model_name predicted_return:8 predicted_rank:i",
    "SELECT *, place AS predicted_rank FROM ranked WHERE model_name = 'momentum' AND date = (SELECT max(date) FROM preds)",
)
def _latest(spark, folder):
    return se.latest_ranking(panel.predictions(spark, folder).where("model_name = 'momentum'"))


@query(
    "h06_horizon_disclosure",
    "forecast_horizon_days:i period_label evaluated_dates:i approx_non_overlapping_periods:i overlap_share_estimate:8 overlap_disclosure",
    """SELECT h AS forecast_horizon_days, h || 'd forecast period' AS period_label, n AS evaluated_dates, n // h AS approx_non_overlapping_periods,
       1 - CAST(n // h AS DOUBLE) / n AS overlap_share_estimate,
       format('{:,} evaluated dates (~{:,} non-overlapping {}-day periods).', n, n // h, h) AS overlap_disclosure
       FROM (SELECT 1 AS h, count(DISTINCT CASE WHEN forward_return_1d IS NOT NULL THEN date END) AS n FROM forwards
             UNION ALL SELECT 5, count(DISTINCT CASE WHEN forward_return_5d IS NOT NULL THEN date END) FROM forwards
             UNION ALL SELECT 10, count(DISTINCT CASE WHEN forward_return_10d IS NOT NULL THEN date END) FROM forwards)""",
)
def _disclosure(spark, folder):
    rows = panel.labels(spark, folder)
    long = rows.select(
        "date", *[F.col(f"forward_return_{h}d").alias(str(h)) for h in (1, 5, 10)]
    ).unpivot(["date"], ["1", "5", "10"], "horizon", "value")
    counts = long.where("value IS NOT NULL").groupBy(
        F.col("horizon").cast("int").alias("forecast_horizon_days")
    ).agg(F.countDistinct("date").alias("evaluated_dates"))
    return me.horizon_disclosure(counts)


@query(
    "a10_harmonised_predictions",
    "model_family model_name date ticker model_score:8 realized_forward_return:8",
    """SELECT 'tree' AS model_family, model_name, date, ticker, predicted_return AS model_score, actual_return AS realized_forward_return FROM preds
       WHERE model_name = 'momentum'
       UNION ALL SELECT 'linear', 'linear', date, ticker, predicted_return, actual_return FROM preds WHERE model_name = 'reversal'""",
)
def _harmonised(spark, folder):
    rows = panel.predictions(spark, folder)
    tree = rows.where("model_name = 'momentum'")
    linear = rows.where("model_name = 'reversal'").select(
        "date", "ticker", F.col("predicted_return").alias("score"), F.col("actual_return").alias("target")
    )
    return harmonise_predictions(tree, "tree").unionByName(harmonise_predictions(linear, "linear"))
