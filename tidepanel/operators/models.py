"""Walk-forward models as Spark jobs.

Linear and logistic fits need the data only through sums of products.  Those are plain
aggregates per date (or per window), so any number of names per date adds nothing to the
size of a fit: every window is solved from a few thousand numbers.  Trees need sums per node
and bin, see ``trees``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.dates import date_index
from tidepanel.functions.ranking import with_ranks
from tidepanel.operators.labels import forward_labels, leave_one_out_labels, modelling_dataset, relative_return
from tidepanel.operators.splits import (
    ablation_feature_sets,
    check_features,
    feature_columns,
    walk_forward_windows,
    window_rows,
)
from tidepanel.operators.trees import TREE_MODELS, TREES, binned_rows, scenario_trees, tree_scores, window_trees
from tidepanel.session import checkpoint

# Model settings.
RIDGE_ALPHA = 1.0
ELASTIC_ALPHA = 0.001
ELASTIC_L1_RATIO = 0.5
LOGISTIC_TOLERANCE = 1e-9

LINEAR_MODELS = ("ridge", "elastic_net")
PREDICTIONS = ["date", "ticker", "model_name", "predicted_return", "actual_return"]
_FLAT = 1e-12
# Up to this many features (169 sums) products are summed as plain columns; beyond, the code generated for them
# is too long to be compiled, and Arrow batches are multiplied as matrices instead.  Both give the same sums.
PLAIN_SUM_FEATURES = 16
# Keys whose sums a task holds before it hands them on.
HELD_KEYS = 2_000


# --- moments ----------------------------------------------------------------------


def _imputed(feature: str) -> Column:
    """Feature as double; missing values become zero before scaling."""
    return F.coalesce(F.col(feature).cast("double"), F.lit(0.0))


def scaled_features(rows: DataFrame, features: Sequence[str]) -> list[Column]:
    """Features centred and scaled by the whole table, which keeps sums of products well
    conditioned.  Reads two numbers per feature back to the driver."""
    facts = rows.agg(
        *[F.avg(_imputed(f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(_imputed(f)).alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    columns = []
    for i, feature in enumerate(features):
        mean, scale = facts[f"m{i}"] or 0.0, facts[f"s{i}"] or 0.0
        scale = scale if scale > _FLAT * (1 + abs(mean)) else 1.0
        columns.append((_imputed(feature) - F.lit(float(mean))) / F.lit(float(scale)))
    return columns


def _upper_triangle(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def _moment_sums(size: int, weight: str, response: str) -> Column:
    """Array of weighted sums: 1, response, x, x*response, and x*x above the diagonal."""
    sums = [F.expr(f"sum({weight})"), F.expr(f"sum({response})")]
    sums += [F.expr(f"sum({weight} * x{i})") for i in range(size)]
    sums += [F.expr(f"sum({response} * x{i})") for i in range(size)]
    sums += [F.expr(f"sum({weight} * x{i} * x{j})") for i, j in _upper_triangle(size)]
    return F.array(*sums).alias("moments")


def summed_moments(
    rows: DataFrame, key: str, size: int, weight: str, response: str, extra: str = "0.0D"
) -> DataFrame:
    """(key, moments, missed): the sums of ``_moment_sums`` over x0, x1, ... and the sum of ``extra``.

    With many features a task multiplies its batches and hands on one packed array per key, whose places
    are then summed; no row of the input is shuffled, and a place holds a number per task.
    """
    if size <= PLAIN_SUM_FEATURES:
        return rows.groupBy(key).agg(_moment_sums(size, weight, response), F.expr(f"sum({extra})").alias("missed"))
    inputs = [f"x{i}" for i in range(size)]
    upper = np.triu_indices(size)

    def packed(part: pd.DataFrame) -> np.ndarray:
        x, w, r = part[inputs].to_numpy(float), part["__w"].to_numpy(float), part["__r"].to_numpy(float)
        weighted = x * w[:, None]
        products = (x.T @ weighted)[upper]
        return np.concatenate([[w.sum(), r.sum()], weighted.sum(axis=0), r @ x, products, [part["__e"].sum()]])

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[object, np.ndarray] = {}

        def held() -> pd.DataFrame:
            return pd.DataFrame({key: list(totals), "packed": [t.tolist() for t in totals.values()]})

        for batch in batches:
            for value, part in batch.groupby(key, sort=False):
                totals[value] = packed(part) + totals.get(value, 0.0)
            if len(totals) > HELD_KEYS:
                yield held()
                totals.clear()
        if totals:
            yield held()

    narrow = rows.select(
        key, F.expr(weight).alias("__w"), F.expr(response).alias("__r"), F.expr(extra).alias("__e"), *inputs
    )
    schema = f"{key} {narrow.schema[key].dataType.simpleString()}, packed array<double>"
    places = (
        narrow.mapInPandas(multiply, schema)
        .select(key, F.posexplode("packed").alias("place", "value"))
        .groupBy(key, "place")
        .agg(F.sum("value").alias("value"))
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda p: p["value"])
    return places.groupBy(key).agg(ordered.alias("packed")).select(
        key,
        F.slice("packed", 1, F.size("packed") - 1).alias("moments"),
        F.element_at("packed", -1).alias("missed"),
    )


class _Moments:
    """Moment array of one window unpacked into means, scales and centred products."""

    def __init__(self, packed: np.ndarray, size: int):
        self.weight, self.response = packed[0], packed[1]
        self.x = packed[2 : 2 + size]
        self.xy = packed[2 + size : 2 + 2 * size]
        self.xx = np.zeros((size, size))
        rows, cols = np.triu_indices(size)
        self.xx[rows, cols] = packed[2 + 2 * size :]
        self.xx = self.xx + np.triu(self.xx, 1).T

    def scaling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean = self.x / self.weight
        variance = np.diag(self.xx) / self.weight - mean**2
        flat = variance <= _FLAT * (1 + mean**2)
        return mean, np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, variance))), flat


def _elastic_net(gram: np.ndarray, target: np.ndarray, rows: float) -> np.ndarray:
    """Coordinate descent on sums of products, until no coefficient moves.

    The penalty makes the objective strictly convex, so the descent always ends; how fast
    depends on the data, therefore no number of rounds is given.
    """
    size = len(target)
    beta = np.zeros(size)
    l1 = rows * ELASTIC_ALPHA * ELASTIC_L1_RATIO
    l2 = rows * ELASTIC_ALPHA * (1 - ELASTIC_L1_RATIO)
    largest = np.inf
    while largest >= 1e-10 * (1 + np.abs(beta).max(initial=0.0)):
        largest = 0.0
        for j in range(size):
            if gram[j, j] == 0:
                continue
            rho = target[j] - gram[j] @ beta + gram[j, j] * beta[j]
            updated = np.sign(rho) * max(abs(rho) - l1, 0.0) / (gram[j, j] + l2)
            largest = max(largest, abs(updated - beta[j]))
            beta[j] = updated
    return beta


def _solve_linear(moments: _Moments, model: str, subset: Sequence[int]) -> tuple[float, np.ndarray]:
    """Intercept and coefficients on the table-scaled features; zero outside the subset."""
    size = len(moments.x)
    mean, scale, flat = moments.scaling()
    mean_y = moments.response / moments.weight
    centred = (moments.xx - moments.weight * np.outer(mean, mean)) / np.outer(scale, scale)
    target = (moments.xy - mean * moments.response) / scale
    use = np.array([i for i in subset if not flat[i]], dtype=int)
    beta = np.zeros(size)
    if len(use):
        gram, right = centred[np.ix_(use, use)], target[use]
        if model == "ridge":
            beta[use] = np.linalg.solve(gram + RIDGE_ALPHA * np.eye(len(use)), right)
        else:
            beta[use] = _elastic_net(gram, right, moments.weight)
    slope = beta / scale
    return float(mean_y - slope @ mean), slope


def date_moments(rows: DataFrame, scaled: Sequence[Column], target: str) -> DataFrame:
    """One row per date with the sums of products of all features and the target."""
    named = rows.select(
        "date", F.col(target).alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(scaled)]
    )
    return summed_moments(named, "date", len(scaled), "1.0D", "y").drop("missed")


def fit_linear_windows(
    rows: DataFrame,
    windows: DataFrame,
    features: Sequence[str],
    target: str = "target",
    models: Sequence[str] = LINEAR_MODELS,
    feature_sets: Mapping[str, Sequence[str]] | None = None,
    scaled: Sequence[Column] | None = None,
) -> DataFrame:
    """(window_id, scenario, model_name, intercept, slopes) for every window at once.

    Feature sets share the same sums: a scenario only solves a smaller system.
    """
    check_features(features)
    sets = feature_sets or {"all_features": list(features)}
    positions = {name: [list(features).index(f) for f in chosen] for name, chosen in sets.items()}
    known = rows.where(F.col(target).isNotNull())
    moments = date_moments(known, scaled or scaled_features(known, features), target)
    train = windows.where("role = 'train'").select("window_id", "date")
    per_window = moments.join(F.broadcast(train), "date").select("window_id", "moments")
    size = len(features)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        # One row per training date.
        packed = np.sum(np.stack(group["moments"].to_numpy()), axis=0)
        total = _Moments(packed, size)
        out = []
        for scenario, subset in positions.items():
            for model in models:
                intercept, slopes = _solve_linear(total, model, subset)
                out.append((int(group["window_id"].iloc[0]), scenario, model, intercept, slopes.tolist()))
        return pd.DataFrame(out, columns=["window_id", "scenario", "model_name", "intercept", "slopes"])

    schema = "window_id int, scenario string, model_name string, intercept double, slopes array<double>"
    return per_window.groupBy("window_id").applyInPandas(solve, schema)


def _linear_score(scaled: Sequence[Column]) -> Column:
    terms = [F.col("slopes")[i] * c for i, c in enumerate(scaled)]
    return reduce(lambda a, b: a + b, terms, F.col("intercept"))


def linear_predictions(
    rows: DataFrame,
    windows: DataFrame,
    features: Sequence[str],
    target: str = "target",
    models: Sequence[str] = LINEAR_MODELS,
    feature_sets: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Out-of-sample predictions of every window's test dates."""
    known = rows.where(F.col(target).isNotNull())
    scaled = scaled_features(known, features)
    fits = fit_linear_windows(known, windows, features, target, models, feature_sets, scaled)
    tested = windows.where("role = 'test'").select("window_id", "date")
    # One row per window, scenario and model; no hint, since scenarios are the caller's.
    plan = tested.join(fits, "window_id")
    scored = known.join(plan, "date").withColumn("predicted_return", _linear_score(scaled))
    return scored.select(
        "window_id", "scenario", "date", "ticker", "model_name", "predicted_return",
        F.col(target).alias("actual_return"),
    )


# --- logistic -----------------------------------------------------------------------


def fit_logistic_windows(
    rows: DataFrame,
    windows: DataFrame,
    features: Sequence[str],
    label: str,
    scaled: Sequence[Column],
    tolerance: float = LOGISTIC_TOLERANCE,
) -> DataFrame:
    """Class-balanced logistic fits with unit L2 penalty for every window at once.

    (window_id, rows, positives, intercept, slopes, converged).  Each Newton step is one
    aggregate over the training rows of the windows that still move; a window whose gradient per
    row is within ``tolerance`` is finished and takes no further part.  A step that would
    raise the loss is halved until it lowers it, so the steps go on until all windows
    are finished.  ``converged`` is false only where rounding leaves no step that helps.  One-class
    windows need no fit.  The table of window parameters is checkpointed between steps.
    """
    check_features(features)
    size = len(features)
    named = window_rows(
        rows.select(
            "date",
            F.col(label).cast("double").alias("y"),
            *[c.alias(f"x{i}") for i, c in enumerate(scaled)],
        ).where("y IS NOT NULL"),
        windows,
        ["train"],
    )
    state_schema = (
        "window_id int, rows double, positives double, mean array<double>, scale array<double>, "
        "intercept double, slopes array<double>, beta0 double, beta array<double>, "
        "origin0 double, origin array<double>, step0 double, step array<double>, share double, loss double, status string"
    )
    names = [p.split()[0] for p in state_schema.split(", ")]

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for window_id, packed in zip(batch["window_id"], batch["moments"]):
                total = _Moments(np.asarray(packed), size)
                mean, scale, flat = total.scaling()
                scale = np.where(flat, np.inf, scale)
                zeros = [0.0] * size
                one_class = not 0 < total.response < total.weight
                out.append(
                    (
                        window_id, total.weight, total.response, mean.tolist(), scale.tolist(), 0.0, zeros, 0.0, zeros,
                        0.0, zeros, 0.0, zeros, 1.0, np.inf, "converged" if one_class else "open",
                    )
                )
            yield pd.DataFrame(out, columns=names)

    first = summed_moments(named, "window_id", size, "1.0D", "y").drop("missed")
    state = checkpoint(first.mapInPandas(start, state_schema))

    def newton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [_newton_step(row, size, tolerance) for row in batch.itertuples(index=False)]
            yield pd.DataFrame(out, columns=names)

    inputs = [F.col(f"x{i}") for i in range(size)]
    margin = _linear_score(inputs)
    while state.where("status = 'open'").limit(1).count():
        moving = state.where("status = 'open'")
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__margin")))
        negatives = F.col("rows") - F.col("positives")
        weight = F.col("rows") / (2 * F.when(F.col("y") == 1, F.col("positives")).otherwise(negatives))
        # log(1 + exp(-m)) for the own class, without overflow
        signed = F.when(F.col("y") == 1, F.col("__margin")).otherwise(-F.col("__margin"))
        miss = F.greatest(-signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed)))
        worked = (
            named.join(moving.select("window_id", "rows", "positives", "intercept", "slopes"), "window_id")
            .withColumns({"__margin": margin, "__class": weight})
            .withColumn("__chance", chance)
            .withColumn("__curvature", F.col("__class") * F.col("__chance") * (1 - F.col("__chance")))
            .withColumn("__residual", F.col("__class") * (F.col("y") - F.col("__chance")))
            .withColumn("__miss", F.col("__class") * miss)
        )
        sums = summed_moments(worked, "window_id", size, "__curvature", "__residual", "__miss")
        finished = state.where("status <> 'open'")
        state = checkpoint(moving.join(sums, "window_id").mapInPandas(newton, state_schema).unionByName(finished))
    return state.select(
        "window_id", "rows", "positives", "intercept", "slopes", (F.col("status") == "converged").alias("converged")
    )


def _newton_step(row: tuple, size: int, tolerance: float) -> tuple:
    """State of one window after looking at its loss, gradient and curvature at the present point."""
    total = _Moments(np.asarray(row.moments), size)
    mean, scale = np.asarray(row.mean), np.asarray(row.scale)
    beta = np.concatenate([[row.beta0], row.beta])
    loss = row.missed + 0.5 * float(beta[1:] @ beta[1:])
    share = 1.0
    if loss > row.loss + 1e-12 * (1 + abs(row.loss)):
        # The last step went too far: try half of it from where it began.
        step = np.concatenate([[row.step0], row.step])
        base, share, best = np.concatenate([[row.origin0], row.origin]), row.share / 2, row.loss
        status = "open" if share > 1e-9 else "stuck"
    else:
        cross = total.xx - np.outer(total.x, mean) - np.outer(mean, total.x)
        cross = (cross + total.weight * np.outer(mean, mean)) / np.outer(scale, scale)
        edge = (total.x - total.weight * mean) / scale
        hessian = np.zeros((size + 1, size + 1))
        hessian[0, 0] = total.weight
        hessian[0, 1:] = hessian[1:, 0] = edge
        hessian[1:, 1:] = cross + np.eye(size)
        gradient = np.concatenate([[total.response], (total.xy - mean * total.response) / scale - beta[1:]])
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        base, best = beta, loss
        status = "converged" if np.abs(gradient).max() <= tolerance * row.rows else "open"
    point = base if status != "open" else base + share * step
    slopes = point[1:] / scale
    return (
        row.window_id, row.rows, row.positives, row.mean, row.scale,
        point[0] - slopes @ mean, slopes.tolist(), point[0], point[1:].tolist(),
        base[0], base[1:].tolist(), step[0], step[1:].tolist(), share, best, status,
    )


def logistic_predictions(
    rows: DataFrame,
    windows: DataFrame,
    features: Sequence[str],
    label: str = "top_quintile_label",
    target: str = "target",
    tolerance: float = LOGISTIC_TOLERANCE,
) -> DataFrame:
    """Out-of-sample probability of the positive class; a one-class window predicts its class."""
    known = rows.where(F.col(label).isNotNull())
    scaled = scaled_features(known, features)
    fits = fit_logistic_windows(known, windows, features, label, scaled, tolerance)
    tested = windows.where("role = 'test'").select("window_id", "date")
    scored = known.join(tested.join(fits, "window_id"), "date")
    chance = (
        F.when(F.col("positives") == 0, F.lit(0.0))
        .when(F.col("positives") == F.col("rows"), F.lit(1.0))
        .otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-_linear_score(scaled))))
    )
    return scored.select(
        "window_id",
        "date",
        "ticker",
        F.lit("logistic_regression").alias("model_name"),
        chance.alias("predicted_probability"),
        F.col(label).alias("actual_label"),
        F.col(target).alias("actual_return"),
        "converged",
    )


def rank_probabilities(predictions: DataFrame, n: int = 5) -> DataFrame:
    ranked = with_ranks(
        predictions, ["date"], "predicted_probability", ascending=False, ordinal="probability_rank"
    )
    return ranked.withColumn(f"selected_top_{n}", F.coalesce(F.col("probability_rank") <= n, F.lit(False)))


# --- trees --------------------------------------------------------------------------


def tree_predictions(
    rows: DataFrame,
    windows: DataFrame,
    features: Sequence[str],
    target: str = "target",
    models: Sequence[str] = TREE_MODELS,
    trees: int = TREES,
) -> tuple[DataFrame, DataFrame]:
    """Predictions of every window's test dates and feature importances, all windows at once.

    Importances carry the first and last test date of their window.
    """
    known = rows.where(F.col(target).isNotNull())
    spans = windows.where("role = 'test'").groupBy("window_id").agg(
        F.min("date").alias("test_start"), F.max("date").alias("test_end")
    )
    fitted = [window_trees(known, windows, features, target, model, trees) for model in models]
    predictions = reduce(DataFrame.unionByName, [p for p, _ in fitted])
    importances = reduce(DataFrame.unionByName, [i for _, i in fitted])
    return predictions, importances.join(spans, "window_id")


# --- scenario grids and scoring -----------------------------------------------------


def ablation_predictions(
    rows: DataFrame,
    windows: DataFrame,
    features: Sequence[str],
    target: str = "target",
    model: str = "gradient_boosting",
    trees: int = TREES,
) -> DataFrame:
    """Predictions per feature set; the removed group is the scenario.

    Linear scenarios share their sums; trees of all scenarios and windows grow in the same passes.
    """
    sets = ablation_feature_sets(features)
    if model in LINEAR_MODELS:
        return linear_predictions(rows, windows, features, target, [model], sets)
    return scenario_trees(rows.where(F.col(target).isNotNull()), windows, features, sets, target, model, trees)


def horizon_predictions(
    features: DataFrame,
    bars: DataFrame,
    columns: Sequence[str],
    horizons: Sequence[int] = (1, 5, 10),
    model: str = "gradient_boosting",
    train_size: int = 3,
    trees: int = TREES,
) -> DataFrame:
    """Predictions per forecast horizon with a purge as long as the horizon."""
    labels = leave_one_out_labels(forward_labels(bars, horizons), horizons)
    frames = []
    for horizon in horizons:
        dataset = modelling_dataset(features, labels, relative_return(horizon))
        known = checkpoint(dataset.where("target IS NOT NULL").select("date", "ticker", "target", *columns))
        windows = walk_forward_windows(known, train_size=train_size, purge_size=horizon)
        if model in LINEAR_MODELS:
            frame = linear_predictions(known, windows, columns, models=[model]).drop("scenario")
        else:
            frame = binned_rows(known, windows, columns, "target")
        frames.append(frame.withColumn("scenario", F.lit(str(horizon))))
    found = reduce(DataFrame.unionByName, frames)
    if model not in LINEAR_MODELS:
        found, _ = tree_scores(checkpoint(found), columns, model, trees)
    return found.withColumn("forecast_horizon_days", F.col("scenario").cast("int")).drop("scenario")


def scoring_problems(dataset: DataFrame, universe: DataFrame, horizon: int, target: str = "target") -> DataFrame:
    """Reasons not to score the latest date, one row each.

    Signal and cutoff dates must cover the universe exactly, signal targets must be
    unknown, and cutoff targets known.
    """
    index = date_index(dataset)
    last = F.max("date_idx").over(Window.partitionBy())
    roles = index.select(
        "date",
        F.when(F.col("date_idx") == last, "signal")
        .when(F.col("date_idx") == last - horizon, "cutoff")
        .alias("role"),
    ).where("role IS NOT NULL")
    rows = dataset.join(F.broadcast(roles), "date").select("role", "ticker", target)
    expected = universe.select("ticker").distinct().withColumn(
        "role", F.explode(F.array(F.lit("signal"), F.lit("cutoff")))
    ).withColumn("__expected", F.lit(True))
    joined = rows.withColumn("__observed", F.lit(True)).join(expected, ["role", "ticker"], "full_outer")
    problem = (
        F.when(F.col("__observed").isNull(), "missing_ticker")
        .when(F.col("__expected").isNull(), "unexpected_ticker")
        .when((F.col("role") == "signal") & F.col(target).isNotNull(), "target_leak")
        .when((F.col("role") == "cutoff") & F.col(target).isNull(), "unknown_cutoff_target")
    )
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select("role", "ticker", "problem")


def covered_signal_date(dataset: DataFrame, universe: DataFrame, horizon: int, target: str = "target") -> DataFrame:
    """(signal_date, cutoff_date) of the latest date that can be scored, or no row.

    The date and the one ``horizon`` dates before it have exactly the names of the universe, and all
    targets of the earlier one are known.
    """
    names = universe.select("ticker").distinct().withColumn("__expected", F.lit(1))
    expected = names.agg(F.count(F.lit(1)).alias("__names"))
    daily = (
        dataset.select("date", "ticker", target).join(names, "ticker", "left").groupBy("date")
        .agg(F.count(F.lit(1)).alias("__rows"), F.count("__expected").alias("__found"), F.count(target).alias("__known"))
        .join(F.broadcast(expected))
        .withColumn("__full", (F.col("__rows") == F.col("__names")) & (F.col("__found") == F.col("__names")))
    )
    index = date_index(dataset).join(daily, "date")
    past = index.where("__full AND __known = __names").select(
        (F.col("date_idx") + horizon).alias("date_idx"), F.col("date").alias("cutoff_date")
    )
    usable = index.where("__full").join(past, "date_idx")
    best = usable.agg(F.max(F.struct("date", "cutoff_date")).alias("best")).where("best IS NOT NULL")
    return best.select(F.col("best.date").alias("signal_date"), "best.cutoff_date")


def as_of(dataset: DataFrame, signal: DataFrame, target: str = "target") -> DataFrame:
    """What was known on a signal date: rows up to it, targets up to its cutoff.

    ``signal`` is one row of ``covered_signal_date``.
    """
    seen = dataset.join(F.broadcast(signal), F.col("date") <= F.col("signal_date"))
    known = F.when(F.col("date") <= F.col("cutoff_date"), F.col(target))
    return seen.withColumn(target, known).drop("signal_date", "cutoff_date")


def score_latest(
    dataset: DataFrame,
    universe: DataFrame,
    horizon: int,
    model: str = "gradient_boosting",
    minimum_dates: int = 60,
    target: str = "target",
    trees: int = TREES,
    features: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ranked scores of the latest date from a fit on every known label before the cutoff."""
    problems = scoring_problems(dataset, universe, horizon, target).limit(5).collect()
    if problems:
        raise ValueError(f"Latest date cannot be scored, for example {[tuple(r) for r in problems]}")
    index = date_index(dataset)
    ends = index.agg(F.max("date_idx").alias("last")).first()["last"]
    marks = {
        r["date_idx"]: r["date"]
        for r in index.where(F.col("date_idx").isin([ends, ends - horizon])).collect()
    }
    signal_date, cutoff = marks[ends], marks.get(ends - horizon)
    if cutoff is None:
        raise ValueError("Not enough dates for the forecast horizon")
    train = dataset.where((F.col("date") <= F.lit(cutoff)) & F.col(target).isNotNull())
    facts = train.agg(
        F.countDistinct("date").alias("dates"), F.min(target).alias("low"), F.max(target).alias("high")
    ).first()
    if facts["dates"] < minimum_dates:
        raise ValueError(f"{facts['dates']} training dates; {minimum_dates} are required")
    if facts["low"] == facts["high"]:
        raise ValueError("Training targets are constant")
    columns = list(features) if features is not None else feature_columns(train)
    signal = dataset.where(F.col("date") == F.lit(signal_date))
    members = ["gradient_boosting", "random_forest"] if model == "rank_ensemble" else [model]
    # One window: every labelled date up to the cutoff trains, the signal date is scored.
    dates = train.select("date").distinct().withColumn("role", F.lit("train"))
    window = dates.unionByName(signal.select("date").distinct().withColumn("role", F.lit("test"))).withColumn(
        "window_id", F.lit(0)
    )
    both = train.unionByName(signal)
    scores, importances = [], []
    for member in members:
        predicted, importance = window_trees(both, window, columns, target, member, trees)
        importances.append(importance.select("model_name", "feature", "importance"))
        scores.append(predicted.select("date", "ticker", F.col("predicted_return").alias("score")))
    if model == "rank_ensemble":
        result = rank_ensemble_scores(dict(zip(members, scores)))
    else:
        result = scores[0]
    ranked = with_ranks(result, ["date"], "score", ascending=False, ordinal="predicted_rank")
    return (
        ranked.select(
            "date", "ticker", F.lit(model).alias("model_name"), F.lit(horizon).alias("horizon_days"),
            "score", "predicted_rank",
        ),
        reduce(DataFrame.unionByName, importances),
    )


def rank_ensemble_scores(member_scores: Mapping[str, DataFrame]) -> DataFrame:
    """One minus mean rank over names plus one, from (date, ticker, score) per member."""
    if not member_scores:
        raise ValueError("A rank ensemble needs members")
    frames = [f.withColumn("member", F.lit(name)) for name, f in member_scores.items()]
    stacked = reduce(DataFrame.unionByName, frames)
    ranked = with_ranks(stacked, ["date", "member"], "score", ascending=False, ordinal="place")
    counts = ranked.groupBy("date", "member").agg(F.count(F.lit(1)).alias("names"))
    joined = ranked.join(counts, ["date", "member"])
    return joined.groupBy("date", "ticker").agg(
        (F.lit(1.0) - F.avg("place") / (F.max("names") + 1)).alias("score")
    )


def expanding_predictions(
    dataset: DataFrame,
    signals: DataFrame,
    features: Sequence[str],
    target: str = "target",
    model: str = "ridge",
) -> DataFrame:
    """Predictions at each signal from all labels up to its cutoff, for every signal at once.

    Sums of products up to a cutoff are the sums of the dates before it, so one pass over
    the rows serves all expanding windows.
    """
    windows_train = signals.select(
        F.col("signal_idx").alias("window_id"), F.col("training_cutoff").alias("date"), F.lit("train").alias("role")
    )
    known = dataset.where(F.col(target).isNotNull())
    scaled = scaled_features(known, features)
    size = len(features)
    per_date = date_moments(known, scaled, target)
    cumulative = running_moments(per_date)
    stops = windows_train.select("window_id", "date")
    cuts = cumulative.join(F.broadcast(stops), "date").select("window_id", "moments")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for window_id, packed in zip(batch["window_id"], batch["moments"]):
                intercept, slopes = _solve_linear(_Moments(np.asarray(packed), size), model, range(size))
                out.append((window_id, intercept, slopes.tolist()))
            yield pd.DataFrame(out, columns=["window_id", "intercept", "slopes"])

    fits = cuts.mapInPandas(solve, "window_id int, intercept double, slopes array<double>")
    tests = signals.join(fits, signals["signal_idx"] == fits["window_id"]).select(
        F.col("signal_date").alias("date"), "training_cutoff", "intercept", "slopes"
    )
    return known.join(tests, "date").select(
        "date",
        "ticker",
        F.lit(model).alias("model_name"),
        _linear_score(scaled).alias("predicted_return"),
        F.col(target).alias("actual_return"),
        "training_cutoff",
    )


def running_moments(per_date: DataFrame) -> DataFrame:
    """Sums of products of all dates up to each date; one row per date throughout.

    Every place of the moment array is summed along the calendar by itself, so the dates
    never meet in one task with all their moments.
    """
    places = per_date.select("date", F.posexplode("moments").alias("place", "moment"))
    along = Window.partitionBy("place").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = places.select("date", "place", F.sum("moment").over(along).alias("moment"))
    listed = F.array_sort(F.collect_list(F.struct("place", "moment")))
    return summed.groupBy("date").agg(F.transform(listed, lambda m: m["moment"]).alias("moments"))
