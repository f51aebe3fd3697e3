"""Regression trees for all walk-forward windows at once.

Candidate splits are exact quantiles of each feature over the training rows of a window, so a row
is a few small numbers: the bin of each feature.  Rows are packed into blocks, each row of
the block table holding at most about ``BLOCK_ROWS`` of one window.

A window of one block is fitted where its block lies, all windows and scenarios side by side in one
pass.  A longer one is never gathered: a level of a tree needs the data only through sums per
(node, feature, bin), so tasks add up their blocks and a level is decided from a few thousand
numbers however many rows there are.  Both ways share the sums and the rule of the split.  Fitted trees
are a table; predictions and importances are read from it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.ranking import group_quantiles
from tidepanel.operators.splits import check_features
from tidepanel.session import checkpoint, working_folder

# Model settings.
TREES = 100
FOREST_DEPTH = 3
BOOSTING_DEPTH = 2
BOOSTING_STEP = 0.05
MIN_LEAF = 2
BINS = 32
SEED = 42
TREE_MODELS = ("random_forest", "gradient_boosting")
# P(n <= 0), P(n <= 1), ... of a count with mean one: how often a bootstrap draws a row.
DRAWS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
# Training rows a task fits at once; windows with more are fitted by sums over blocks.
BLOCK_ROWS = 1 << 16
# Trees of a forest grown in one pass over blocks, and rounds after which scores are written.
FOREST_BATCH = 20
REFRESH = 10
# Numbers a task adds up before it sends them.
HELD_SUMS = 1 << 22


def binned_rows(
    rows: DataFrame, windows: DataFrame, features: Sequence[str], target: str, bins: int = BINS
) -> DataFrame:
    """(window_id, role, date, ticker, y, bins): training and test rows of every window.

    Missing feature values count as zero.  ``bins`` holds, per feature, how many of the window's
    split points lie below the value.
    """
    check_features(features)
    named = rows.select(
        "date", "ticker", F.col(target).cast("double").alias("y"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, f in enumerate(features)],
    )
    chosen = windows.where(F.col("role").isin("train", "test")).select("window_id", "role", "date")
    placed = named.join(chosen, "date").where("role = 'test' OR y IS NOT NULL")
    columns = [f"x{k}" for k in range(len(features))]
    values = placed.where("role = 'train'").unpivot(["window_id"], columns, "feature", "value")
    points = {f"q{k}": k / bins for k in range(1, bins)}
    found = group_quantiles(values, ["window_id", "feature"], "value", points)
    cuts = found.select("window_id", "feature", F.array_sort(F.array_distinct(F.array(*points))).alias("cuts"))
    per_window = checkpoint(
        cuts.groupBy("window_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "cuts"))).alias("cuts"))
    )

    def below(name: str) -> Column:
        return F.size(F.filter(F.col("cuts")[name], lambda cut: cut < F.col(name)))

    return placed.join(per_window, "window_id").select(
        "window_id", "role", "date", "ticker", "y", F.array(*[below(c) for c in columns]).alias("bins")
    )


KEYS = ["scenario", "window_id"]


# --- one tree on the rows of a block ------------------------------------------------


def _leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node each row reaches; the children of node n are 2n (bin up to the cut) and 2n + 1."""
    node = np.ones(bins.shape[1], dtype=np.int64)
    rows = np.arange(bins.shape[1])
    for _ in range(levels):
        used = feature[node]
        right = bins[np.maximum(used, 0), rows] > cut[node]
        node = np.where(used < 0, node, 2 * node + right)
    return node


def _sums(bins: np.ndarray, node: np.ndarray, level: int, weight: np.ndarray | None, goal: np.ndarray, width: int) -> np.ndarray:
    """(2, nodes, features, bins): weights and weighted goals of the rows that stand at a level."""
    at = node - (1 << level)
    if (at < 0).any():
        keep = at >= 0
        bins, at, goal = bins[:, keep], at[keep], goal[keep]
        weight = None if weight is None else weight[keep]
    features = len(bins)
    place = ((at * features + np.arange(features)[:, None]) * width + bins).ravel()
    shape = (1 << level, features, width)
    size = int(np.prod(shape))

    def added(values: np.ndarray) -> np.ndarray:
        return np.bincount(place, weights=np.broadcast_to(values, bins.shape).ravel(), minlength=size)

    counts = np.bincount(place, minlength=size).astype(float) if weight is None else added(weight)
    return np.stack([counts, added(goal if weight is None else weight * goal)]).reshape(2, *shape)


class _Tree:
    """Splits, leaf values and gains by node; a node without a split has feature -1."""

    def __init__(self, depth: int):
        self.feature = np.full(1 << depth, -1, dtype=np.int64)
        self.cut = np.zeros(1 << depth, dtype=np.int64)
        self.value = np.full(2 << depth, np.nan)
        self.gain = np.zeros(1 << depth)

    def split(self, level: int, sums: np.ndarray, usable: np.ndarray, min_leaf: int) -> None:
        """The split of every node of a level from its sums.

        It lowers the squared error most; equal gains go to the first feature and the lowest cut.
        """
        n, s = sums[0], sums[1]
        left_n, left_s = n.cumsum(axis=2), s.cumsum(axis=2)
        first = int(np.argmax(usable))
        all_n, all_s = left_n[:, first, -1], left_s[:, first, -1]
        right_n, right_s = left_n[..., -1:] - left_n, left_s[..., -1:] - left_s
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = all_s / all_n
            low, high = left_s / left_n, right_s / right_n
            gain = low * left_s + high * right_s - (all_s * mean)[:, None, None]
        allowed = (left_n >= min_leaf) & (right_n >= min_leaf) & usable[:, None]
        # Rounded, so that the order of summation does not decide between equal gains.
        gain = np.where(allowed, np.round(gain, 14), -np.inf).reshape(len(n), -1)
        best = gain.argmax(axis=1)
        for k in range(len(n)):
            node = (1 << level) + k
            self.value[node] = mean[k]
            if gain[k, best[k]] > 1e-14:
                f, b = divmod(int(best[k]), n.shape[2])
                self.feature[node], self.cut[node], self.gain[node] = f, b, gain[k, best[k]]
                self.value[2 * node], self.value[2 * node + 1] = low[k, f, b], high[k, f, b]


def _grown(bins: np.ndarray, weight: np.ndarray | None, goal: np.ndarray, plan: _Plan, usable: np.ndarray) -> tuple[_Tree, np.ndarray]:
    tree = _Tree(plan.depth)
    node = np.ones(bins.shape[1], dtype=np.int64)
    for level in range(plan.depth):
        tree.split(level, _sums(bins, node, level, weight, goal, plan.bins), usable, plan.min_leaf)
        node = _leaves(bins, tree.feature, tree.cut, level + 1)
    return tree, node


@dataclass(frozen=True)
class _Plan:
    """What a fit is asked for."""

    model: str
    trees: int
    depth: int
    step: float
    min_leaf: int
    bins: int
    features: int
    allowed: dict[str, list[int]] | None

    def usable(self, scenario: str) -> np.ndarray:
        mask = np.ones(self.features, dtype=bool)
        if self.allowed is not None:
            mask[:] = False
            mask[self.allowed[scenario]] = True
        return mask

    @property
    def boosts(self) -> bool:
        return self.model == "gradient_boosting"


def _columns(rows: pa.StructArray, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Goal, bins (features x rows) and draws (trees x rows) of a block."""
    y = rows.field("y").to_numpy(zero_copy_only=False).astype(float)
    bins = np.ascontiguousarray(rows.field("bins").flatten().to_numpy().reshape(-1, features).T).astype(np.int64)
    names = [f.name for f in rows.type]
    if "draws" not in names:
        return y, bins, None
    return y, bins, np.ascontiguousarray(rows.field("draws").flatten().to_numpy().reshape(len(y), -1).T).astype(float)


def _key(part: pa.RecordBatch, k: int) -> tuple:
    return tuple(part.column(c)[k].as_py() for c in KEYS)


_TREES = "tree int, feature array<int>, cut array<int>, value array<double>, gain array<double>"


def _tree_rows(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.string(), key_type, pa.float64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    names = [*KEYS, "base", "tree", "feature", "cut", "value", "gain"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _row(key: tuple, base: float, number: int, tree: _Tree) -> tuple:
    return (*key, base, number, tree.feature.tolist(), tree.cut.tolist(), tree.value.tolist(), tree.gain.tolist())


# --- blocks -------------------------------------------------------------------------


def _blocks(state: DataFrame, columns: Sequence[str | Column], sizes: DataFrame) -> DataFrame:
    """One row per (window, block) with the rows of the block in ``rows``; no block is much above BLOCK_ROWS."""
    spark = state.sparkSession
    keys = [k for k in KEYS if k in state.columns]
    dealt = state.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("date", "ticker"), F.col("blocks")))
    # Fits take long for few bytes, so partitions are not merged by size.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *keys, "block").groupBy(*keys, "blocks", "block").agg(F.collect_list(F.struct(*columns)).alias("rows"))


def _block_counts(state: DataFrame, block_rows: int) -> DataFrame:
    keys = [k for k in KEYS if k in state.columns]
    return state.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).alias("blocks"))


def _fits_in_place(blocks: DataFrame, plan: _Plan) -> DataFrame:
    """Trees of windows whose training rows are one block: each is fitted where its block lies."""
    key_type = blocks.schema["window_id"].dataType.simpleString()

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                y, bins, draws = _columns(part.column("rows")[k].values, plan.features)
                key, usable = _key(part, k), plan.usable(part.column("scenario")[k].as_py())
                score = np.full(len(y), y.mean())
                out = []
                for number in range(plan.trees):
                    tree, node = _grown(bins, None if draws is None else draws[number], y - score if plan.boosts else y, plan, usable)
                    out.append(_row(key, float(y.mean()), number, tree))
                    if plan.boosts:
                        score = score + plan.step * tree.value[node]
                yield _tree_rows(out, part.schema.field("window_id").type)

    return blocks.select(*KEYS, "rows").mapInArrow(work, f"scenario string, window_id {key_type}, base double, {_TREES}")


def _scores(rows: tuple, trees: list[dict], base: float, plan: _Plan, done: np.ndarray | None = None) -> np.ndarray:
    """Boosted score of every row after the given trees."""
    y, bins, _ = rows
    score = np.full(len(y), base) if done is None else done
    for tree in trees:
        feature, cut, value = (np.array(tree[c]) for c in ("feature", "cut", "value"))
        score = score + plan.step * value[_leaves(bins, feature, cut, plan.depth)]
    return score


def _fits_by_sums(blocks: DataFrame, plan: _Plan, log: str) -> DataFrame:
    """Trees of windows of several blocks: a level at a time, from sums per node, feature and bin.

    A task adds up its blocks and sends at most one sum per window, node, feature and bin.  Finished rounds lie
    in the folder ``log`` as small tables of trees; a run that finds rounds there goes on after them.
    Scores are rebuilt from the trees and written beside the blocks every REFRESH rounds.
    """
    spark = blocks.sparkSession
    key_type = blocks.schema["window_id"].dataType.simpleString()
    held = blocks.select(*KEYS, "rows", F.lit(None).cast("array<double>").alias("score"))
    bases = checkpoint(
        blocks.groupBy(*KEYS).agg(F.sum(F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["y"])).alias("s"), F.sum(F.size("rows")).alias("n"))
        .select(*KEYS, (F.col("s") / F.col("n")).alias("base"))
    )
    windows = bases.count()
    schema = f"scenario string, window_id {key_type}, base double, {_TREES}"
    tree_type = "struct<" + ", ".join(":".join(c.split(" ", 1)) for c in _TREES.split(", ")) + ">"

    def written(number: int) -> DataFrame | None:
        try:
            found = spark.read.schema(schema).parquet(f"{log}/round={number}")
            return found if found.count() == windows * _batch(plan, number) else None
        except AnalysisException:
            return None

    def joined(frame: DataFrame, recent: list[DataFrame], partial: DataFrame | None) -> DataFrame:
        """Blocks with their base, the trees since the last refresh, and the trees being grown."""
        out = frame.join(bases, KEYS)
        for name, tables in (("trees", recent if plan.boosts else []), ("open", [partial] if partial is not None else [])):
            if not tables:
                out = out.withColumn(name, F.array().cast(f"array<{tree_type}>"))
                continue
            listed = reduce(DataFrame.unionByName, tables).groupBy(*KEYS).agg(
                F.sort_array(F.collect_list(F.struct("tree", "feature", "cut", "value", "gain"))).alias(name)
            )
            out = out.join(listed, KEYS)
        return out

    def level_sums(level: int, numbers: range):  # noqa: ANN202
        def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[tuple, np.ndarray] = {}

            def flushed() -> Iterator[pa.RecordBatch]:
                for key, sums in totals.items():
                    flat = sums.reshape(len(numbers), 2, -1).transpose(1, 0, 2).reshape(2, -1)
                    place = np.flatnonzero(flat[0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key[0]] * len(place), pa.string()), pa.array([key[1]] * len(place), kind), pa.array(place), pa.array(flat[0, place]), pa.array(flat[1, place])],
                        names=[*KEYS, "place", "n", "s"],
                    )
                totals.clear()

            for part in parts:
                kind = part.schema.field("window_id").type
                for k in range(part.num_rows):
                    rows = _columns(part.column("rows")[k].values, plan.features)
                    y, bins, draws = rows
                    goal = y
                    if plan.boosts:
                        score = part.column("score")[k]
                        done = score.values.to_numpy() if score.is_valid else None
                        goal = y - _scores(rows, part.column("trees")[k].as_py(), part.column("base")[k].as_py(), plan, done)
                    found = []
                    open_ = part.column("open")[k].as_py()
                    for place, number in enumerate(numbers):
                        tree = open_[place] if open_ else None
                        node = np.ones(len(y), np.int64) if tree is None else _leaves(bins, np.array(tree["feature"]), np.array(tree["cut"]), level)
                        found.append(_sums(bins, node, level, None if draws is None else draws[number], goal, plan.bins))
                    key = _key(part, k)
                    sums = np.stack(found)
                    totals[key] = totals[key] + sums if key in totals else sums
                    if len(totals) * sums.size > HELD_SUMS:
                        yield from flushed()
            if totals:
                yield from flushed()

        return work

    def chosen(level: int, numbers: range):  # noqa: ANN202
        def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for k in range(part.num_rows):
                    key = _key(part, k)
                    cells = part.column("cells")[k].values
                    sums = np.zeros((2, len(numbers), 1 << level, plan.features, plan.bins))
                    place = cells.field("place").to_numpy()
                    for row, name in enumerate(("n", "s")):
                        sums[row].ravel()[place] = cells.field(name).to_numpy()
                    open_ = part.column("open")[k].as_py()
                    out = []
                    for at, number in enumerate(numbers):
                        tree = _Tree(plan.depth)
                        if open_:
                            for name in ("feature", "cut", "value", "gain"):
                                setattr(tree, name, np.array(open_[at][name]))
                        # Nodes that hold no row have zero sums and get no split.
                        kept = tree.value.copy()
                        tree.split(level, sums[:, at], plan.usable(key[0]), plan.min_leaf)
                        if level:
                            tree.value[1 << level : 2 << level] = kept[1 << level : 2 << level]
                        out.append(_row(key, part.column("base")[k].as_py(), number, tree))
                    yield _tree_rows(out, part.schema.field("window_id").type)

        return work

    rounds: list[DataFrame] = []
    since = 0
    start = 0
    while start < plan.trees:
        numbers = range(start, start + _batch(plan, start))
        grown = written(start)
        if grown is None:
            partial = None
            for level in range(plan.depth):
                ready = joined(held, rounds[since:], partial)
                sums = ready.mapInArrow(level_sums(level, numbers), f"scenario string, window_id {key_type}, place bigint, n double, s double")
                cells = sums.groupBy(*KEYS, "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
                cells = cells.groupBy(*KEYS).agg(F.collect_list(F.struct("place", "n", "s")).alias("cells"))
                found = joined(cells, [], partial).mapInArrow(chosen(level, numbers), schema)
                if level < plan.depth - 1:
                    partial = checkpoint(found)
                else:
                    found.write.mode("overwrite").parquet(f"{log}/round={start}")
            grown = spark.read.schema(schema).parquet(f"{log}/round={start}")
        rounds.append(grown)
        start = numbers.stop
        if plan.boosts and len(rounds) - since == REFRESH and start < plan.trees:

            def refreshed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in parts:
                    scores = []
                    for k in range(part.num_rows):
                        score = part.column("score")[k]
                        rows = _columns(part.column("rows")[k].values, plan.features)
                        done = score.values.to_numpy() if score.is_valid else None
                        scores.append(_scores(rows, part.column("trees")[k].as_py(), part.column("base")[k].as_py(), plan, done))
                    kept = [part.column(c) for c in (*KEYS, "rows")]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.list_(pa.float64()))], names=[*KEYS, "rows", "score"])

            ready = joined(held, rounds[since:], None)
            held = checkpoint(ready.mapInArrow(refreshed, held.schema))
            since = len(rounds)
    return reduce(DataFrame.unionByName, rounds)


def _batch(plan: _Plan, start: int) -> int:
    """Trees grown in one pass: one round of boosting, or several trees of a forest."""
    return 1 if plan.boosts else min(FOREST_BATCH, plan.trees - start)


def fit_trees(
    state: DataFrame,
    features: Sequence[str],
    model: str = "gradient_boosting",
    trees: int = TREES,
    depth: int | None = None,
    step: float = BOOSTING_STEP,
    min_leaf: int = MIN_LEAF,
    bins: int = BINS,
    seed: int = SEED,
    allowed: Mapping[str, Sequence[int]] | None = None,
    block_rows: int = BLOCK_ROWS,
    log: str | None = None,
) -> DataFrame:
    """(scenario, window_id, base, tree, feature, cut, value, gain): a row per tree, checkpointed.

    ``state`` has the columns of ``binned_rows`` and, without ``allowed``, a scenario.  ``allowed`` names, per
    scenario, the features its splits may use; all scenarios then share the rows.  ``base`` is the mean of
    a window's training rows, where boosting starts.  ``log`` names a folder of rounds for windows
    of several blocks; by default a new one beside the checkpoints.
    """
    if model not in TREE_MODELS:
        raise ValueError(f"model must be one of {TREE_MODELS}")
    boosts = model == "gradient_boosting"
    plan = _Plan(
        model, trees, depth or (BOOSTING_DEPTH if boosts else FOREST_DEPTH), step, min_leaf, bins, len(features),
        None if allowed is None else {name: list(use) for name, use in allowed.items()},
    )
    train = state.where("role = 'train'")
    columns: list[str | Column] = ["y", F.col("bins").cast("array<tinyint>").alias("bins")]
    if not boosts:
        drawn = F.transform(
            F.sequence(F.lit(0), F.lit(trees - 1)), lambda k: drawn_count(seed, k, "window_id", "date", "ticker").cast("tinyint")
        )
        columns.append(drawn.alias("draws"))
    blocks = _blocks(train, columns, checkpoint(_block_counts(train, block_rows)))
    blocks = checkpoint(blocks)
    if allowed is not None:
        blocks = blocks.withColumn("scenario", F.explode(F.array(*[F.lit(name) for name in allowed])))
    small, large = blocks.where("blocks = 1"), blocks.where("blocks > 1")
    found = checkpoint(_fits_in_place(small, plan))
    if large.limit(1).count():
        folder = log or working_folder(state.sparkSession, "rounds")
        found = found.unionByName(_fits_by_sums(large.select(*KEYS, "rows"), plan, folder))
    return found


def predicted(state: DataFrame, fitted: DataFrame, features: Sequence[str], model: str, depth: int, step: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(scenario, window_id, date, ticker, y, prediction) of the test rows, from the trees of ``fit_trees``."""
    test = state.where("role = 'test'")
    blocks = _blocks(test, ["date", "ticker", "y", F.col("bins").cast("array<tinyint>").alias("bins")], _block_counts(test, block_rows))
    listed = fitted.groupBy(*KEYS).agg(
        F.first("base").alias("base"), F.sort_array(F.collect_list(F.struct("tree", "feature", "cut", "value", "gain"))).alias("trees")
    )
    ready = blocks.join(listed, [k for k in KEYS if k in blocks.columns])
    key_type = state.schema["window_id"].dataType.simpleString()
    kinds = {c: state.schema[c].dataType.simpleString() for c in ("date", "ticker")}
    boosts = model == "gradient_boosting"

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                rows = part.column("rows")[k].values
                bins = np.ascontiguousarray(rows.field("bins").flatten().to_numpy().reshape(-1, len(features)).T)
                sums, used = np.zeros(len(rows)), 0
                for tree in part.column("trees")[k].as_py():
                    value = np.array(tree["value"])
                    # A bootstrap that drew no row has no value and does not count.
                    if not np.isnan(value[1]):
                        sums += value[_leaves(bins, np.array(tree["feature"]), np.array(tree["cut"]), depth)]
                        used += 1
                base = part.column("base")[k].as_py()
                prediction = base + step * sums if boosts else (sums / used if used else np.full(len(rows), base))
                same = [pa.array([v] * len(rows), part.schema.field(c).type) for c, v in zip(KEYS, _key(part, k), strict=True)]
                yield pa.RecordBatch.from_arrays([*same, rows.field("date"), rows.field("ticker"), rows.field("y"), pa.array(prediction)], names=[*KEYS, "date", "ticker", "y", "prediction"])

    schema = f"scenario string, window_id {key_type}, date {kinds['date']}, ticker {kinds['ticker']}, y double, prediction double"
    return ready.select(*KEYS, "rows", "base", "trees").mapInArrow(work, schema)


def drawn_count(seed: int, tree: Column, *row: Column | str) -> Column:
    """How often a bootstrap sample of a tree holds a row, from a hash: repeatable, whatever the partitions."""
    chance = F.pmod(F.xxhash64(F.lit(seed), tree, *row), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return reduce(lambda a, b: a + b, [(chance >= p).cast("int") for p in DRAWS])


def tree_importance(fitted: DataFrame, features: Sequence[str], model: str) -> DataFrame:
    """(scenario, window_id, model_name, feature, importance) of every feature.

    Importance is a feature's part of all error the splits took away, zero for all where no split helped.
    """
    split = fitted.select(*KEYS, F.explode(F.arrays_zip("feature", "gain")).alias("split")).where("split.feature >= 0")
    won = split.groupBy(*KEYS, F.col("split.feature").alias("place")).agg(F.sum("split.gain").alias("won"))
    names = F.create_map(*[c for k, f in enumerate(features) for c in (F.lit(k), F.lit(f))])
    every = (
        fitted.select(*KEYS).distinct()
        .withColumn("place", F.explode(F.array(*[F.lit(k) for k in range(len(features))])))
        .join(won, [*KEYS, "place"], "left")
    )
    total = F.sum("won").over(Window.partitionBy(*KEYS))
    return every.select(
        *KEYS, F.lit(model).alias("model_name"), names[F.col("place")].alias("feature"),
        F.coalesce(F.try_divide(F.col("won"), total), F.lit(0.0)).alias("importance"),
    )


def tree_scores(
    state: DataFrame,
    features: Sequence[str],
    model: str = "gradient_boosting",
    trees: int = TREES,
    depth: int | None = None,
    step: float = BOOSTING_STEP,
    min_leaf: int = MIN_LEAF,
    seed: int = SEED,
    allowed: Mapping[str, Sequence[int]] | None = None,
    bins: int = BINS,
    block_rows: int = BLOCK_ROWS,
    log: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Test predictions and importances of one model, see ``fit_trees``."""
    fitted = fit_trees(state, features, model, trees, depth, step, min_leaf, bins, seed, allowed, block_rows, log)
    levels = depth or (BOOSTING_DEPTH if model == "gradient_boosting" else FOREST_DEPTH)
    scored = predicted(state, fitted, features, model, levels, step, block_rows)
    predictions = scored.select(
        *KEYS, "date", "ticker", F.lit(model).alias("model_name"),
        F.col("prediction").alias("predicted_return"), F.col("y").alias("actual_return"),
    )
    return predictions, tree_importance(fitted, features, model)


def window_trees(
    rows: DataFrame,
    windows: DataFrame,
    features: Sequence[str],
    target: str = "target",
    model: str = "gradient_boosting",
    trees: int = TREES,
    depth: int | None = None,
    step: float = BOOSTING_STEP,
    min_leaf: int = MIN_LEAF,
    bins: int = BINS,
    seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
    log: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Test predictions and feature importances of one model in every window.

    (window_id, date, ticker, model_name, predicted_return, actual_return) and (window_id,
    model_name, feature, importance).
    """
    state = checkpoint(binned_rows(rows, windows, features, target, bins).withColumn("scenario", F.lit("all_features")))
    predictions, importance = tree_scores(
        state, features, model, trees, depth, step, min_leaf, seed, bins=bins, block_rows=block_rows, log=log
    )
    return predictions.drop("scenario"), importance.drop("scenario")


def scenario_trees(
    rows: DataFrame,
    windows: DataFrame,
    features: Sequence[str],
    feature_sets: Mapping[str, Sequence[str]],
    target: str = "target",
    model: str = "gradient_boosting",
    trees: int = TREES,
    bins: int = BINS,
) -> DataFrame:
    """Test predictions per feature set (the scenario); all sets share one table of blocks."""
    allowed = {name: [list(features).index(f) for f in chosen] for name, chosen in feature_sets.items()}
    state = checkpoint(binned_rows(rows, windows, features, target, bins))
    return tree_scores(state, features, model, trees, allowed=allowed, bins=bins)[0]
