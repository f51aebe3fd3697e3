"""Fully invested targets under single-name, issuer-group and sector caps."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_FLOOR, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.ranking import top_n, with_ranks
from tidepanel.operators.selection import best_first
from tidepanel.schemas import MONEY

# Limits of the diversified portfolio.
HOLDINGS = 8
INVESTED = 0.97
NAME_CAP = 0.15
GROUP_CAP = 0.25
SECTOR_CAP = 0.35
DIVERSIFIED_TURNOVER = 0.25

QUANTUM = Decimal("1e-12")
TOLERANCE = 1e-10
# Room below this is float noise when weight is pushed along a path.
NOISE = 1e-14


def prediction_rank_problems(predictions: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """Rows whose stated rank is not the rank by score and ticker, and repeated tickers."""
    ranked = with_ranks(predictions, by, "score", ascending=False, ordinal="__rank")
    wrong = ranked.where(~F.col("predicted_rank").eqNullSafe(F.col("__rank"))).select(
        *by, "ticker", F.lit("rank_mismatch").alias("problem")
    )
    repeated = (
        predictions.groupBy(*by, "ticker").count().where("count > 1")
        .select(*by, "ticker", F.lit("duplicate_ticker").alias("problem"))
    )
    return wrong.unionByName(repeated)


def _spread(
    names: list[tuple[str, str, str]], least: float, name_cap: float, group_cap: float, sector_cap: float
) -> tuple[float, list[float]]:
    """Largest total weight with at least ``least`` per name, and weights reaching it.

    Money flows group -> name -> sector.  Weight is pushed along augmenting paths, which
    may take weight back from one name to give it to another.
    """
    groups = {g: group_cap for _, g, _ in names}
    sectors = {s: sector_cap for _, _, s in names}
    weights = [least] * len(names)
    for _, g, s in names:
        groups[g] -= least
        sectors[s] -= least
    if min([*groups.values(), *sectors.values()], default=0.0) < -TOLERANCE or least > name_cap + TOLERANCE:
        return -1.0, weights

    def path() -> list[tuple[int, int]] | None:
        """Alternating adds (+1) and takes (-1) from a group with room to a sector with room."""
        reached = {("g", g): None for g in groups if groups[g] > NOISE}
        queue = list(reached)
        while queue:
            kind, key = node = queue.pop(0)
            if kind == "s" and sectors[key] > NOISE:
                steps = []
                while reached[node] is not None:
                    node, step = reached[node]
                    steps.append(step)
                return steps[::-1]
            for i, (_, g, s) in enumerate(names):
                if kind == "g" and g == key and weights[i] < name_cap - NOISE and ("s", s) not in reached:
                    reached[("s", s)] = (node, (i, 1))
                    queue.append(("s", s))
                if kind == "s" and s == key and weights[i] > least + NOISE and ("g", g) not in reached:
                    reached[("g", g)] = (node, (i, -1))
                    queue.append(("g", g))
        return None

    while (steps := path()) is not None:
        first, last = names[steps[0][0]], names[steps[-1][0]]
        room = [name_cap - weights[i] if sign > 0 else weights[i] - least for i, sign in steps]
        amount = min(*room, groups[first[1]], sectors[last[2]])
        for i, sign in steps:
            weights[i] += sign * amount
        groups[first[1]] -= amount
        sectors[last[2]] -= amount
    return sum(weights), weights


def _choose(names: list[tuple[str, str, str]], holdings: int, invested: float, caps: tuple[float, float, float]):
    """Best-ranked names that can carry the invested weight, swapping in later ranks."""
    selected = names[:holdings]
    capacity = _spread(selected, 0.0, *caps)[0]
    while capacity + TOLERANCE < invested:
        order = {name: i for i, name in enumerate(names)}
        swap = None
        for candidate in names:
            if candidate in selected:
                continue
            for removed in sorted(selected, key=order.get, reverse=True):
                trial = [n for n in selected if n != removed] + [candidate]
                reached = _spread(trial, 0.0, *caps)[0]
                if reached > capacity + TOLERANCE:
                    swap = trial, reached
                    break
            if swap:
                break
        if swap is None:
            return None
        selected, capacity = swap
    order = {name: i for i, name in enumerate(names)}
    return sorted(selected, key=order.get)


def _allocate(selected: list[tuple[str, str, str]], invested: float, caps: tuple[float, float, float]) -> list[Decimal]:
    """Weights that sum to the invested weight and make the smallest weight as large as possible."""
    low, high = 0.0, min(caps[0], invested / len(selected))
    if _spread(selected, high, *caps)[0] + 10 * NOISE >= invested:
        low = high
    else:
        for _ in range(60):
            middle = (low + high) / 2
            if _spread(selected, middle, *caps)[0] + 10 * NOISE >= invested:
                low = middle
            else:
                high = middle
    total, full = _spread(selected, low, *caps)
    # Between the floor and the fullest allocation every mixture is feasible.
    base = low * len(selected)
    part = 0.0 if total <= base else min(1.0, (invested - base) / (total - base))
    weights = [
        Decimal(str(max(0.0, low + (w - low) * part))).quantize(QUANTUM, rounding=ROUND_FLOOR) for w in full
    ]
    cap_name, cap_group, cap_sector = (Decimal(str(c)) for c in caps)
    rest = Decimal(str(invested)) - sum(weights, Decimal(0))
    for i, (_, g, s) in enumerate(selected):
        in_group = sum((w for w, n in zip(weights, selected) if n[1] == g), Decimal(0))
        in_sector = sum((w for w, n in zip(weights, selected) if n[2] == s), Decimal(0))
        room = min(cap_name - weights[i], cap_group - in_group, cap_sector - in_sector)
        change = min(rest, max(room, Decimal(0))) if rest > 0 else max(rest, -weights[i])
        weights[i] += change
        rest -= change
    return weights


def constrained_targets(
    predictions: DataFrame,
    by: Sequence[str] = ("date",),
    score: str = "predicted_return",
    holdings: int = HOLDINGS,
    invested: float = INVESTED,
    name_cap: float = NAME_CAP,
    group_cap: float = GROUP_CAP,
    sector_cap: float = SECTOR_CAP,
) -> DataFrame:
    """Targets per date whose weights sum to ``invested`` with every cap kept.

    Starts from the best ``holdings`` names; while the caps leave too little room, the
    next-ranked name that adds room replaces the worst-ranked name it can.  Whether a name
    adds room depends only on its issuer group and sector.  At most ``holdings`` names of
    one such cell are ever held, and in one sector all groups not held are alike, so the
    ``holdings + 1`` best names of the ``holdings + 1`` best groups of each sector decide,
    and no whole cross-section reaches a task.

    A date on which the caps cannot hold the weight gives one row with the reason.
    """
    by = list(by)
    if holdings <= 0 or holdings * name_cap < invested - TOLERANCE:
        raise ValueError("The name cap cannot reach the invested weight")
    known = predictions.where(F.col(score).isNotNull()).select(
        *by, "ticker", "issuer_group", "sector", F.col(score).cast("double").alias("score")
    )
    cells = top_n(known, [*by, "issuer_group", "sector"], best_first("score"), holdings + 1, "__place")
    leaders = top_n(
        cells.where(F.col("__place") == 1).select(*by, "issuer_group", "sector", "ticker", "score"),
        [*by, "sector"],
        best_first("score"),
        holdings + 1,
        "__group_place",
    ).select(*by, "issuer_group", "sector")
    cells = cells.join(leaders, [*by, "issuer_group", "sector"], "left_semi")
    caps = (name_cap, group_cap, sector_cap)
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in known.schema if f.name in by]
        + ["ticker string", "issuer_group string", "sector string", "score double", "weight_text string", "status string"]
    )

    def build(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["score", "ticker"], ascending=[False, True])
        key = tuple(ordered[c].iloc[0] for c in by)
        names = list(zip(ordered["ticker"], ordered["issuer_group"], ordered["sector"]))
        scores = dict(zip(ordered["ticker"], ordered["score"]))
        columns = [*by, "ticker", "issuer_group", "sector", "score", "weight_text", "status"]
        chosen = _choose(names, holdings, invested, caps) if len(names) >= holdings else None
        if chosen is None:
            reason = "too_few_names" if len(names) < holdings else "caps_too_tight"
            return pd.DataFrame([(*key, None, None, None, None, None, reason)], columns=columns)
        weights = _allocate(chosen, invested, caps)
        rows = [(*key, t, g, s, scores[t], str(w), "ok") for (t, g, s), w in zip(chosen, weights)]
        return pd.DataFrame(rows, columns=columns)

    built = cells.drop("__place").groupBy(*by).applyInPandas(build, schema)
    return built.withColumn("target_weight", F.col("weight_text").cast(MONEY)).drop("weight_text")


def cap_violations(targets: DataFrame, by: Sequence[str] = ("date",), invested: float = INVESTED) -> DataFrame:
    """Groups of weights above a cap and dates that miss the invested weight."""
    ok = targets.where("status = 'ok'")
    small = F.lit(1e-9)

    def over(column: str, cap: float) -> DataFrame:
        return (
            ok.groupBy(*by, column)
            .agg(F.sum("target_weight").cast("double").alias("total"))
            .where(F.col("total") > F.lit(cap) + small)
            .select(*by, F.lit(column).alias("rule"), "total")
        )

    total = (
        ok.groupBy(*by)
        .agg(F.sum("target_weight").cast("double").alias("total"))
        .where(F.abs(F.col("total") - F.lit(invested)) > small)
        .select(*by, F.lit("invested").alias("rule"), "total")
    )
    return over("ticker", NAME_CAP).unionByName(over("issuer_group", GROUP_CAP)).unionByName(
        over("sector", SECTOR_CAP)
    ).unionByName(total)
