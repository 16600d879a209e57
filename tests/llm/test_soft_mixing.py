"""The mixing rates reach their targets, or the optimum where the targets can't be reached."""

import numpy as np
import pytest

from callweave.llm import soft_mixing

DOMAINS = ("low", "good", "toxic")


def rows_of(spark, posteriors, tokens):
    return spark.createDataFrame([(i, int(t), [float(x) for x in p]) for i, (p, t) in enumerate(zip(posteriors, tokens, strict=True))], "id long, tokens long, p array<double>")


def solved(spark, posteriors, tokens, weights, **options):
    rated, report = soft_mixing.solve(rows_of(spark, posteriors, tokens), DOMAINS, weights, **options)
    rate = np.array([r.rate for r in rated.orderBy("id").collect()])
    reached = (rate * tokens) @ posteriors
    assert (rate >= 0).all() and np.allclose(reached, [report[d][1] for d in DOMAINS])
    return rate, reached, np.array([report[d][0] for d in DOMAINS])


def test_rare_domain(spark):
    """1 % of the tokens to be 5 %: a rate above 4, which was the bound."""
    p = np.array([[0.99, 0.005, 0.005]] * 6 + [[0.005, 0.99, 0.005]] * 186 + [[0.002, 0.008, 0.99]] * 1)
    rate, reached, target = solved(spark, p, np.full(len(p), 100), soft_mixing.WEIGHTS)
    assert np.all(np.abs(reached - target) <= 0.002 * target)
    assert rate.max() > 4


def test_overlapping_posteriors(spark):
    """Slow progress of plain steps is no reason to stop."""
    rng = np.random.default_rng(3)
    p = np.array([[0.3, 0.36, 0.34], [0.31, 0.33, 0.36], [0.36, 0.33, 0.31]])[rng.integers(0, 3, 200)] + rng.uniform(0, 0.02, (200, 3))
    p /= p.sum(1, keepdims=True)
    _, reached, target = solved(spark, p, rng.integers(50, 400, 200), {"low": 0.325, "good": 0.34, "toxic": 0.335})
    assert np.all(np.abs(reached - target) <= 0.002 * target)


@pytest.mark.parametrize("max_rate", [None, 3.0])
def test_optimum_of_unreachable_targets(spark, max_rate):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([4.0, 5.0, 3.0], 60)
    p = 0.5 * p + 0.5 / 3  # no document is purer than 2/3
    tokens = rng.integers(50, 400, 60)
    rate, reached, target = solved(spark, p, tokens, {"low": 0.0, "good": 0.9, "toxic": 0.1}, max_rate=max_rate)
    have = tokens @ p
    best = np.ones(60)
    for _ in range(200_000):  # plain projected gradient
        best = np.clip(best - p @ (((best * tokens) @ p - target) / have), 0, max_rate)

    def loss(totals):
        return float(((totals - target) ** 2 / have).sum())

    assert loss(reached) <= loss((best * tokens) @ p) * 1.001
    assert max_rate is None or rate.max() <= max_rate


def test_targets_are_told(spark, caplog):
    p = np.array([[0.0, 0.6, 0.4]] * 20)
    with caplog.at_level("INFO", logger=soft_mixing.__name__):
        solved(spark, p, np.full(20, 100), {"low": 0.0, "good": 0.5, "toxic": 0.5})
    told = {r.getMessage().split(":")[0]: r.levelname for r in caplog.records}
    assert told["domain low"] == "INFO" and "WARNING" in (told["domain good"], told["domain toxic"])
