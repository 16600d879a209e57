"""Boosted trees over binned features: one summed histogram of two statistics for each level, missing values sent to the better side.

Rows are kept as one byte a feature: the number of cut points up to the value, or ``MISSING``.  For a level, every task
routes its rows through the tree so far and adds up both statistics by (node, feature, bin).  While all tasks' cells are few, the driver adds them up;
beyond ``DRIVER_CELLS`` one shuffle sums them, windows over the bins try every cut with the missing values left and right, and the best split
of each node comes to the driver.  So the driver never sees rows, and a tree costs as many jobs as it has levels.

The statistics are whole multiples of a small unit, so sums don't depend on how rows are dealt, and equal inputs give equal trees.

Two losses: ``logistic`` (gradient and hessian, second-order gains and leaf values, as gradient boosting does) and
``exponential`` (weighted hits and weights, Gini gains and votes of +1 or -1, as discrete AdaBoost does).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.storage import settle

MISSING, MOST_CUTS = 255, 254
#: Trees whose scores are worked out anew for each level before they are stored with the rows.
STORED_EVERY = 25
#: Cells of a histogram that a task keeps in memory at once; beyond that it passes on what each batch has.
DENSE_CELLS = 1 << 22
#: Cells from all tasks that the driver adds up itself; beyond that they are summed and searched by a shuffle.
DRIVER_CELLS = 1 << 22
#: Rows of a task.
ROWS_PER_TASK = 100_000
_UNIT = {"logistic": 2.0**32, "exponential": 2.0**24}
_MOST_WEIGHT = 2.0**16


@dataclass
class Tree:
    """Nodes as columns; a leaf has the feature -1.  Rows with a bin up to ``bin`` go left, missing ones where ``missing_left`` says."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, v in zip(asdict(self), (-1, 0, False, -1, -1, 0.0, 0.0, 0.0), strict=True):
            getattr(self, column).append(v)
        return len(self.feature) - 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        feature, cut, missing, left, right = (np.array(x) for x in (self.feature, self.bin, self.missing_left, self.left, self.right))
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        live = rows[feature[at] >= 0]
        while len(live):
            node = at[live]
            b = bins[live, feature[node]]
            at[live] = np.where(np.where(b == MISSING, missing[node], b <= cut[node]), left[node], right[node])
            live = live[feature[at[live]] >= 0]
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Ensemble:
    """Trees with the features and cut points that they were grown on."""

    loss: str
    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree]

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        """One byte for each value; NaN is missing."""
        made = [np.where(np.isnan(x), MISSING, np.searchsorted(np.array(c, float), x, "right")) for x, c in zip(columns, self.cuts, strict=True)]
        return np.stack(made, axis=1).astype(np.uint8) if made else np.zeros((0, 0), np.uint8)

    def probability(self, bins: np.ndarray, first: int | None) -> np.ndarray:
        """The probability of class 1 by the first trees."""
        margin = np.zeros(len(bins))
        for tree in self.trees[:first]:
            margin += tree.scores(bins)
        return 1 / (1 + np.exp(-margin * (1 if self.loss == "logistic" else 2)))

    def importance(self) -> list[tuple[str, float, int, float, float, float]]:
        """Feature, mean gain, splits, mean cover, total gain and total cover, for the features that are used."""
        total: dict[int, list[float]] = {}
        for tree in self.trees:
            for f, g, c in zip(tree.feature, tree.gain, tree.cover, strict=True):
                if f >= 0:
                    at = total.setdefault(f, [0.0, 0, 0.0])
                    total[f] = [at[0] + g, at[1] + 1, at[2] + c]
        return sorted((self.features[f], g / n, n, c / n, g, c) for f, (g, n, c) in total.items())

    def to_json(self) -> str:
        return json.dumps({"loss": self.loss, "features": self.features, "cuts": self.cuts, "trees": [asdict(t) for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Ensemble:
        read = json.loads(text)
        return cls(read["loss"], read["features"], read["cuts"], [Tree(**t) for t in read["trees"]])


def doubles(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    """Columns as doubles, null as NaN."""
    return [batch.column(batch.schema.get_field_index(n)).cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False) for n in names]


def cut_points(rows: DataFrame, names: list[str], most: int = MOST_CUTS) -> list[list[float]]:
    """Cut points of each column: all its values but the first where they are few, else ``most`` quantiles.

    A task passes on a column's distinct values while they are few; columns with many are then ranked by mergeable sketches.
    """
    few, columns = most * 3 // 4, [f"f{i}" for i in range(len(names))]
    table = rows.select(*[F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None)).alias(c) for n, c in zip(names, columns, strict=True)])

    def values(batches: Iterable[pa.RecordBatch]):
        held: list[np.ndarray | None] = [np.zeros(0)] * len(columns)
        for batch in batches:
            for i, x in enumerate(doubles(batch, columns)):
                if held[i] is not None:
                    both = np.unique(np.concatenate([held[i], x[~np.isnan(x)]]))
                    held[i] = both if len(both) <= few else None
        for i, x in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array([i] * max(len(x), 1) if x is not None else [i]), pa.array(x if x is not None and len(x) else [None], pa.float64()), pa.array([x is None] * (1 if x is None else max(len(x), 1)))], ["i", "v", "many"])

    parts = settle(table.mapInArrow(values, "i long, v double, many boolean").distinct()) if names else None
    if parts is None:
        return []
    many = {r["i"] for r in parts.groupBy("i").agg(F.max("many").alias("many"), F.count("v").alias("n")).where(F.col("many") | (F.col("n") > few)).collect()}
    out: list[list[float]] = [[] for _ in names]
    for r in parts.where(~F.col("i").isin(*many, -1) & F.col("v").isNotNull()).collect():
        out[r["i"]].append(r["v"])
    out = [sorted(v)[1:] for v in out]
    if many:
        steps = [k / (most + 1) for k in range(1, most + 1)]
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(columns[i]).alias("v")) for i in sorted(many)]))
        for r in table.select(each.alias("x")).groupBy("x.i").agg(F.percentile_approx("x.v", steps, 10 * most).alias("v")).collect():
            out[r["i"]] = sorted(set(r["v"] or []))
    return out


def _statistics(loss: str, label: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == "logistic":
        p = 1 / (1 + np.exp(-margin))
        a, b = p - label, np.maximum(p * (1 - p), 1e-16)
    else:
        b = np.minimum(np.exp(-margin * (2 * label - 1)), _MOST_WEIGHT)
        a = b * label
    return np.rint(a * _UNIT[loss]), np.rint(b * _UNIT[loss])


def _rows(batch: pa.RecordBatch, n_features: int, since: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels and margins, with the scores of the trees since the margins were stored."""
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, n_features)
    margin = batch.column("margin").to_numpy(zero_copy_only=False).copy()
    for tree in since:
        margin += tree.scores(bins)
    return bins, batch.column("label").to_numpy(zero_copy_only=False), margin


def _histograms(table: DataFrame, n_features: int, loss: str, since: list[Tree], tree: Tree, level: list[int]) -> DataFrame:
    """Both statistics of the nodes ``level`` by node, feature and bin, from each task."""
    place = {n: i for i, n in enumerate(level)}
    slots = np.array([place.get(n, -1) for n in range(len(tree.feature))])
    cells = len(level) * n_features * 256

    def add(batches: Iterable[pa.RecordBatch]):
        held = np.zeros((2, cells), np.int64) if cells <= DENSE_CELLS else None

        def given(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            node = np.array(level, np.int64)[keys // (n_features * 256)]
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys // 256 % n_features), pa.array(keys % 256), pa.array(sums[0]), pa.array(sums[1])], ["node", "feature", "bin", "a", "b"])

        for batch in batches:
            bins, label, margin = _rows(batch, n_features, since)
            slot = slots[tree.leaves(bins)]
            use = slot >= 0
            if not use.any():
                continue
            stats = _statistics(loss, label[use], margin[use])
            key = ((slot[use][:, None] * n_features + np.arange(n_features)) * 256 + bins[use]).ravel()
            if held is not None:
                for k in range(2):
                    held[k] += np.bincount(key, np.repeat(stats[k], n_features), cells).astype(np.int64)
            else:
                some, at = np.unique(key, return_inverse=True)
                yield given(some, np.stack([np.bincount(at, np.repeat(s, n_features)).astype(np.int64) for s in stats]))
        if held is not None and held[1].any():
            some = np.flatnonzero(held.any(axis=0))
            yield given(some, held[:, some])

    return table.mapInArrow(add, "node long, feature long, bin long, a long, b long")


@dataclass
class Split:
    """A node's best split and its sums, with those of the left side; without a gain there is none."""

    node: int
    gain: float | None
    feature: int
    bin: int
    missing_left: bool
    all_a: float
    all_b: float
    a: float
    b: float


def _best_here(parts: pa.Table, loss: str, regular: float, least: float) -> list[Split]:
    """``_best`` for a histogram of few cells."""
    unit = _UNIT[loss]
    node, feature, bin_, a, b = (parts.column(c).to_numpy() for c in ("node", "feature", "bin", "a", "b"))
    out = []
    for n in np.unique(node):
        own = node == n
        size = int(feature[own].max()) + 1
        cells = np.zeros((2, size, 256), np.int64)
        for k, x in enumerate((a, b)):
            np.add.at(cells[k], (feature[own], bin_[own]), x[own])
        all_a, all_b = cells[:, 0].sum(axis=1) / unit
        gone, left = cells[:, :, MISSING, None], np.cumsum(cells[:, :, :MISSING], axis=2)
        sides = np.stack([left, left + gone], axis=-1) / unit
        ra, rb = all_a - sides[0], all_b - sides[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            if loss == "logistic":
                gain = sides[0] ** 2 / (sides[1] + regular) + ra**2 / (rb + regular) - all_a**2 / (all_b + regular)
            else:
                part = lambda x, y: 2 * x * (y - x) / y
                gain = part(all_a, all_b) - part(*sides) - part(ra, rb)
        fair = (sides[1] >= least) & (rb >= least) & (sides[1] > 0) & (rb > 0) & (cells[1, :, :MISSING, None] > 0)
        gain = np.where(fair, gain, -1.0)
        f, k, side = np.unravel_index(int(np.argmax(gain)), gain.shape)
        top = float(gain[f, k, side])
        out.append(Split(int(n), top if top >= 0 else None, int(f), int(k), bool(side), float(all_a), float(all_b), float(sides[0, f, k, side]), float(sides[1, f, k, side])))
    return out


def _best(parts: DataFrame, loss: str, regular: float, least: float) -> list[Split]:
    """Each node's best split, by windows over the bins of the summed histogram."""
    unit = _UNIT[loss]
    histograms = parts.groupBy("node", "feature", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    of = Window.partitionBy("node", "feature")
    missing = F.col("bin") == MISSING
    present = lambda c: F.when(missing, 0).otherwise(F.col(c))
    line = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = histograms.select(
        "node", "feature", "bin", *[(F.sum(c).over(of) / unit).alias(f"all_{c}") for c in "ab"], *[(F.sum(F.when(missing, F.col(c)).otherwise(0)).over(of) / unit).alias(f"{c}_missing") for c in "ab"],
        *[(F.sum(present(c)).over(line) / unit).alias(f"{c}_left") for c in "ab"],
    )
    sides = F.array(*[F.struct((F.col("a_left") + F.col("a_missing") * k).alias("a"), (F.col("b_left") + F.col("b_missing") * k).alias("b"), F.lit(bool(k)).alias("missing_left")) for k in (0, 1)])
    rows = rows.withColumn("s", F.explode(sides)).select("node", "feature", "bin", "all_a", "all_b", "s.*").withColumns({"ra": F.col("all_a") - F.col("a"), "rb": F.col("all_b") - F.col("b")})
    if loss == "logistic":
        part = lambda a, b: F.col(a) * F.col(a) / (F.col(b) + regular)
        gain = part("a", "b") + part("ra", "rb") - part("all_a", "all_b")
    else:
        part = lambda a, b: 2 * F.col(a) * (F.col(b) - F.col(a)) / F.col(b)
        gain = part("all_a", "all_b") - part("a", "b") - part("ra", "rb")
    rows = rows.where(F.col("bin") != MISSING)
    fair = (F.col("b") >= least) & (F.col("rb") >= least) & (F.col("b") > 0) & (F.col("rb") > 0)
    rows = rows.withColumn("gain", F.when(fair, gain))
    order = F.struct(F.coalesce("gain", F.lit(-1.0)), -F.col("feature"), -F.col("bin"), ~F.col("missing_left"))
    best = rows.groupBy("node").agg(F.max_by(F.struct("gain", "feature", "bin", "missing_left", "all_a", "all_b", "a", "b"), order).alias("x"))
    return [Split(**r.asDict()) for r in best.select("node", "x.*").collect()]


def grow(rows: DataFrame, names: list[str], label: str, loss: str = "logistic", rounds: int = 500, depth: int = 8, rate: float | None = None, regular: float = 1.0, least: float | None = None) -> Ensemble:
    """Trees of up to ``depth`` levels for rows with a 0/1 ``label``; null and NaN are missing.

    ``rate``: how much of each tree counts (0.3, or 0.1 for the exponential loss).  ``least``: hessians, or weights, that a side of a split has at least.
    """
    rate = (0.3 if loss == "logistic" else 0.1) if rate is None else rate
    least = (1.0 if loss == "logistic" else 0.0) if least is None else least
    made = Ensemble(loss, names, cut_points(rows, names), [])
    wanted = rows.select(*[F.col(f"`{n}`").cast("double").alias(f"f{i}") for i, n in enumerate(names)], F.col(label).cast("double").alias("label"))

    def to_bins(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            bins = made.binned(doubles(batch, [f"f{i}" for i in range(len(names))]))
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), batch.column("label"), pa.array(np.zeros(len(bins)))], ["bins", "label", "margin"])

    schema = "bins binary, label double, margin double"
    table = settle(wanted.mapInArrow(to_bins, schema))
    n = table.count()
    tasks = max(1, math.ceil(n / ROWS_PER_TASK))
    table = table.coalesce(tasks)
    since: list[Tree] = []
    for turn in range(rounds):
        tree, level, wrong, whole = Tree(), [0], 0.0, 1.0
        tree.add()
        for deep in range(depth):
            parts = _histograms(table, len(names), loss, since, tree, level)
            small = tasks * len(level) * len(names) * 256 <= DRIVER_CELLS
            found = _best_here(parts.toArrow(), loss, regular, least) if small else _best(parts, loss, regular, least)
            level = []
            for s in sorted(found, key=lambda s: s.node):
                node = s.node
                if deep == 0:
                    whole = s.all_b
                    tree.value[0], tree.cover[0] = _leaf(loss, s.all_a, s.all_b, regular, rate), s.all_b
                    wrong = min(s.all_a, s.all_b - s.all_a)
                if s.gain is None or s.gain <= 1e-6:
                    continue
                sides = []
                for a, b in ((s.a, s.b), (s.all_a - s.a, s.all_b - s.b)):
                    side = tree.add()
                    tree.value[side], tree.cover[side] = _leaf(loss, a, b, regular, rate), b
                    sides.append(side)
                    wrong += min(a, b - a)
                wrong -= min(s.all_a, s.all_b - s.all_a)
                tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = s.feature, s.bin, s.missing_left, s.gain
                tree.left[node], tree.right[node] = sides
                level += sides
            if not level:
                break
        if loss == "exponential":
            error = min(max(wrong / whole, 1e-10), 1 - 1e-10) if n else 0.5
            if error >= 0.5:
                break
            vote = rate * math.log((1 - error) / error) / 2
            tree.value = [v * vote for v in tree.value]
        made.trees.append(tree)
        since.append(tree)
        if len(since) == STORED_EVERY and turn + 1 < rounds:
            table = settle(_stored(table, len(names), since, schema)).coalesce(tasks)
            since = []
    return made


def _leaf(loss: str, a: float, b: float, regular: float, rate: float) -> float:
    return -rate * a / (b + regular) if loss == "logistic" else 1.0 if 2 * a > b else -1.0


def _stored(table: DataFrame, n_features: int, since: list[Tree], schema: str) -> DataFrame:
    def add(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("label"), pa.array(_rows(batch, n_features, since)[2])], ["bins", "label", "margin"])

    return table.mapInArrow(add, schema)
