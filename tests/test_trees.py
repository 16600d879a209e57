"""Histogram trees against a plain loop over rows and cuts; missing values; AdaBoost by hand; importances."""

import math
import random

import pytest

from callweave.operators import models as M
from callweave.operators import trees as T

COLUMNS = "CHROM string, POS long, REF string, ALT string, x double, y double, z double, TrueVariant_or_False int"


def data(n=120, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = float(r.randrange(12)), r.choice([None, math.nan, *map(float, range(6))])
        z = float(r.randrange(3))
        label = int((x > 5) != (y is None or y != y or y > 3)) if r.random() < 0.9 else r.randrange(2)
        rows.append(("1", i, "A", r.choice("CGT"), x, y, z, label))
    return rows


def plain(rows, labels, margins, depth, regular=1.0, rate=0.3, least=1.0):
    """One tree by brute force over rows: nested dicts of feature, cut, side of missing values, or a leaf's value."""
    p = [1 / (1 + math.exp(-m)) for m in margins]
    g, h = [a - b for a, b in zip(p, labels, strict=True)], [max(a * (1 - a), 1e-16) for a in p]

    def build(own, levels):
        a, b = sum(g[i] for i in own), sum(h[i] for i in own)
        best = (1e-6, None)
        for f in range(len(rows[0])) if levels else ():
            values = sorted({rows[i][f] for i in range(len(rows)) if rows[i][f] is not None})
            for cut in [*values[1:], math.inf]:
                for missing_left in (False, True):
                    left = [i for i in own if (missing_left if rows[i][f] is None else rows[i][f] < cut)]
                    c, d = sum(g[i] for i in left), sum(h[i] for i in left)
                    if d >= least and b - d >= least:
                        gain = c * c / (d + regular) + (a - c) ** 2 / (b - d + regular) - a * a / (b + regular)
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, f))
        if best[1] is None:
            return {i: -rate * a / (b + regular) for i in own}
        left = best[1][0]
        return build(left, levels - 1) | build([i for i in own if i not in set(left)], levels - 1)

    return build(list(range(len(rows))), depth)


def test_against_plain_loops(spark):
    rows = data()
    table = spark.createDataFrame(rows, COLUMNS)
    model = M.train_classifier([table.repartition(3)], rounds=5, depth=3)
    kinds = {"C": (1, 0, 0), "G": (0, 1, 0), "T": (0, 0, 1)}
    flat = [[x, None if y is None or y != y else y, z, *map(float, kinds[alt])] for _, _, _, alt, x, y, z, _ in rows]
    labels, margins = [r[-1] for r in rows], [0.0] * len(rows)
    for turn in range(5):
        added = plain(flat, labels, margins, 3)
        margins = [m + added[i] for i, m in enumerate(margins)]
        got = {r["POS"]: r["SCORE"] for r in model.predict(table, turn + 1).collect()}
        assert got == pytest.approx({i: 1 / (1 + math.exp(-m)) for i, m in enumerate(margins)}, abs=1e-6)


def test_missing_side_and_importance(spark, tmp_path):
    rows = [("1", i, "A", "C", 1.0 if i % 2 else None, None, math.nan, i % 2) for i in range(40)] + [("1", 99, "A", "C", 0.0, None, None, 0)]
    table = spark.createDataFrame(rows, COLUMNS)
    model = M.train_classifier([table], rounds=1, depth=2)
    tree = model.model.trees[0]
    assert tree.feature[0] == 0 and tree.missing_left[0] and len(tree.feature) == 3
    assert tree.cover == pytest.approx([41 / 4, 21 / 4, 20 / 4], abs=1e-6)
    (row,) = model.importance().collect()
    gain = (10.5**2) / 6.25 + 100 / 6 - 0.25 / 11.25
    assert tuple(row) == ("x", pytest.approx(gain), 1, pytest.approx(10.25), pytest.approx(gain), pytest.approx(10.25))
    model.save(str(tmp_path / "m"))
    again = M.TreeClassifier.load(str(tmp_path / "m"))
    assert again.model == model.model and again.columns == ["x", "y", "z"]
    assert again.predict(table.select("z", *table.drop("z").columns)).columns == ["z", *table.drop("z").columns, "SCORE"]


def test_rows_dealt_anyhow(spark, monkeypatch):
    """The same trees from one task or many, with margins stored in between, dense or sparse histograms."""
    table = spark.createDataFrame(data(), COLUMNS)
    want = M.train_classifier([table], rounds=6, depth=3).model
    monkeypatch.setattr(T, "STORED_EVERY", 2)
    monkeypatch.setattr(T, "ROWS_PER_TASK", 20)
    monkeypatch.setattr(T, "DENSE_CELLS", 0)
    monkeypatch.setattr(T, "DRIVER_CELLS", 0)
    assert M.train_classifier([table.repartition(7)], rounds=6, depth=3).model == want


def test_quantile_cuts(spark):
    table = spark.range(5000).selectExpr("cast(id * 7 % 5000 as double) as v", "cast(id % 5 as double) as w", "cast(null as double) as n")
    v, w, n = T.cut_points(table, ["v", "w", "n"], 50)
    assert len(v) == 50 and max(abs(x - (k + 1) * 5000 / 51) for k, x in enumerate(v)) < 15
    assert w == [1.0, 2.0, 3.0, 4.0] and n == []


def test_adaboost_by_hand(spark):
    """Stumps on ten points: the classic example, whose votes and weights are known."""
    labels = [1, 1, 1, 0, 0, 0, 1, 1, 1, 0]
    rows = [("1", i, "A", "A", float(i), None, None, y) for i, y in enumerate(labels)]
    table = spark.createDataFrame(rows, COLUMNS)
    model = M.train_classifier([table], rounds=3, depth=1, loss="exponential", rate=1.0)
    weights, score = [0.1] * 10, [0.0] * 10
    for tree in model.model.trees:
        sign = 1 if tree.value[tree.left[0]] > 0 else -1
        vote = abs(tree.value[tree.left[0]])
        said = [sign if i < model.model.cuts[0][tree.bin[0]] else (1 if tree.value[tree.right[0]] > 0 else -1) for i in range(10)]
        error = sum(w for w, s, y in zip(weights, said, labels, strict=True) if s != 2 * y - 1) / sum(weights)
        assert vote == pytest.approx(0.5 * math.log((1 - error) / error), abs=1e-6)
        weights = [w * math.exp(-vote * s * (2 * y - 1)) for w, s, y in zip(weights, said, labels, strict=True)]
        weights = [w / sum(weights) for w in weights]
        score = [a + vote * s for a, s in zip(score, said, strict=True)]
    assert abs(model.model.trees[0].value[model.model.trees[0].left[0]]) == pytest.approx(0.5 * math.log(0.7 / 0.3), abs=1e-6)
    got = {r["POS"]: r["SCORE"] for r in model.predict(table).collect()}
    assert got == pytest.approx({i: 1 / (1 + math.exp(-2 * s)) for i, s in enumerate(score)}, abs=1e-6)
    assert M.DEPTHS["exponential"] == 16 and M.SCORING_TREES["exponential"] == 300
    with pytest.raises(ValueError):
        M.train_classifier([table.where("TrueVariant_or_False = 0")], loss="exponential")
