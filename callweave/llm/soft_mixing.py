"""Mixing to target weights by soft membership, in DataFrame operations only.

Domains are named by a labelled table.  A naive Bayes classifier over binned character and word shares and over
the presence of telling words is fitted on ``MAX_TRAIN_DOCS`` labelled documents at most (smallest hash of the
id); it gives every document a posterior for each domain.  Nonnegative rates of the documents are then those of least
squared differences between the expected tokens of each domain, sum(rate * tokens * posterior), and its target,
scaled by the domains' token totals: an implicit projected gradient step of length 1 / ``NEARNESS`` from rates of 1,
so of all rates that meet the targets those nearest to 1.  At its end every rate is 1 less the posterior-weighted
gradient, projected to [0, infinity); the one number for each domain in it is found by Newton steps, each a pass that sums up
``TRIALS`` step lengths at once.

The steps end when every domain is within ``TOLERANCE`` of its target, or at the optimum: when rates and gradient agree to
``OPTIMAL`` of the targets' tokens.  Rates have no upper bound unless the caller gives ``max_rate``.  Targets and
reached totals are logged for each domain, unmet ones as warnings.

Targets are the weights times a total, by default the total at which the heaviest domain is used as it is.
A document is repeated floor(rate) times, and once more with probability frac(rate), by a hash of its id and text.

Edge cases: a null text counts as empty and has no tokens; null ids are hashed as such; null labels are left
out and of several labels of an id the largest counts; without labels posteriors are the weights;
a domain without tokens keeps its target unmet; repeated rows are rated alike; an empty table gives an
empty table; other columns are ignored by ``soft_mixture`` and kept by ``mix``.
"""

from __future__ import annotations

import logging
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import bounded, cut_lineage, fresh

MAX_TRAIN_DOCS = 6000
TELLING_WORDS = 48
#: Share of a domain's target by which its total may differ; of all targets, where the domain's own is 0.
TOLERANCE = 0.002
#: Weight of the rates' squared distance from 1, beside the squared differences from the targets.
NEARNESS = 1e-6
#: Tokens by which rates and gradient may disagree at the optimum, as a share of all targets.
OPTIMAL = 1e-6
#: Lengths of a Newton step that are tried in one pass.
TRIALS = (1.0, 0.5, 0.25, 1 / 16, 1 / 256, 1 / 65536)
#: Against steps without end only; ending by it is a warning.
MAX_STEPS = 200
#: Where the bins of the shares begin.
UPPER_BINS = (0.0, 0.02, 0.04, 0.07, 0.12, 0.25, 0.5)
SYMBOL_BINS = (0.0, 0.001, 0.005, 0.02, 0.05, 0.1)
DISTINCT_BINS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8)

DOMAINS = ("low", "good", "toxic")
WEIGHTS = {"low": 0.02, "good": 0.93, "toxic": 0.05}


def domain_of() -> Column:
    """The domain that ``labels`` names: low quality, else toxic, else good."""
    return F.when(F.col("quality") == 0, F.lit("low")).when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("quality") == 1, F.lit("good"))


def _bin(value: Column, edges: tuple[float, ...]) -> Column:
    """Which of the edges is the last that the value exceeds."""
    return reduce(lambda a, e: a + (value > e).cast("int"), edges[1:], F.lit(0))


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __words (lower case, split at blanks and stops), __tokens and the bins __upper, __symbol, __distinct."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    docs = docs.withColumn("__words", F.filter(F.split(F.translate(F.lower(text), "\n\t\r.,;:!?", " " * 9), " "), lambda w: w != ""))
    docs = docs.withColumn("__tokens", F.size("__words").cast("long"))
    docs = docs.withColumn("__kinds", F.array_distinct("__words"))
    upper = (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÇÈÉÊÄÖÜÁÍÓÚÑ", ""))) / chars
    symbol = (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))) / chars
    distinct = F.size("__kinds") / F.greatest(F.col("__tokens"), F.lit(1))
    return docs.withColumns({"__upper": _bin(upper, UPPER_BINS), "__symbol": _bin(symbol, SYMBOL_BINS), "__distinct": _bin(distinct, DISTINCT_BINS)})


def _sum_of(gain: Column) -> Column:
    """The gains of the telling words that a document has."""
    return F.aggregate("__hits", F.lit(0.0), lambda a, w: a + F.element_at(gain, w))


class DomainClassifier:
    """Naive Bayes over the bins and the telling words."""

    BINS = {"__upper": len(UPPER_BINS), "__symbol": len(SYMBOL_BINS), "__distinct": len(DISTINCT_BINS)}

    def __init__(self, docs: DataFrame, labels: DataFrame, domain: Column | None = None, domains: tuple[str, ...] = DOMAINS, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_TRAIN_DOCS):
        self.domains, self.text_col = domains, text_col
        known = labels.select(F.col(id_col).alias("__id"), (domain if domain is not None else domain_of()).alias("__domain")).where(F.col("__id").isNotNull() & F.col("__domain").isin(*domains))
        sample = known.groupBy("__id").agg(F.max("__domain").alias("__domain")).orderBy(F.xxhash64("__id"), "__id").limit(max_docs)
        chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col)).join(F.broadcast(sample), "__id")
        rows = cut_lineage(with_features(chosen, text_col).select("__domain", "__kinds", *self.BINS))
        self.totals = {r["__domain"]: r.n for r in rows.groupBy("__domain").agg(F.count("*").alias("n")).collect()}
        self.bins = {}
        for name in self.BINS:
            for r in rows.groupBy(name, "__domain").agg(F.count("*").alias("n")).collect():
                self.bins[name, r[0], r[1]] = r.n
        by_word = rows.select("__domain", F.explode("__kinds").alias("w")).groupBy("w").pivot("__domain", list(domains)).agg(F.count("w")).na.fill(0)
        every = sum(self.totals.values())
        share = reduce(lambda a, b: a + b, [F.col(d) for d in domains]) / max(every, 1)
        lift = F.greatest(*[F.abs(F.col(d) / max(self.totals.get(d, 0), 1) - share) / F.sqrt(share + 0.001) for d in domains])
        self.words = {r.w: {d: r[d] for d in domains} for r in by_word.where(F.length("w") <= 64).withColumn("lift", lift).orderBy(F.desc("lift"), "w").limit(TELLING_WORDS).collect()}

    def with_posteriors(self, rows: DataFrame, weights: dict[str, float]) -> DataFrame:
        """Rows of ``with_features`` with the array __p of the domains' posteriors.

        Each step is a column of its own, so that it is computed once.
        """
        if not self.totals:
            return rows.withColumn("__p", F.array(*[F.lit(float(weights.get(d, 0))) for d in self.domains]))
        every, k = sum(self.totals.values()), len(self.domains)
        words = sorted(self.words)
        logs = []
        for d in self.domains:
            n = self.totals.get(d, 0)
            score = F.lit(math.log((n + 1) / (every + k)))
            for name, size in self.BINS.items():
                values = [F.lit(math.log((self.bins.get((name, b, d), 0) + 1) / (n + size))) for b in range(size)]
                score = score + F.element_at(F.array(*values), F.col(name) + 1)
            present = {w: (self.words[w][d] + 0.5) / (n + 1) for w in words}
            score = score + F.lit(sum(math.log(1 - p) for p in present.values()))
            if words:
                gain = F.map_from_arrays(F.array(*[F.lit(w) for w in words]), F.array(*[F.lit(math.log(p / (1 - p))) for p in present.values()]))
                score = score + _sum_of(gain)
            logs.append(score)
        told = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
        rows = rows.withColumn("__hits", F.array_intersect("__kinds", told)).withColumn("__joint", F.array(*logs))
        rows = rows.withColumn("__top", F.array_max("__joint")).withColumn("__raised", F.transform("__joint", lambda x: F.exp(x - F.col("__top"))))
        rows = rows.withColumn("__sum", F.aggregate("__raised", F.lit(0.0), lambda a, y: a + y))
        return rows.withColumn("__p", F.transform("__raised", lambda x: x / F.col("__sum")))


log = logging.getLogger(__name__)


def _less(posteriors: Column, by: list[float]) -> Column:
    """1 less the posterior-weighted sum of ``by``."""
    return F.lit(1.0) - F.aggregate(F.zip_with(posteriors, F.array(*[F.lit(float(x)) for x in by]), lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)


def _projected(rate: Column, max_rate: float | None) -> Column:
    rate = F.greatest(F.lit(0.0), rate)
    return rate if max_rate is None else F.least(F.lit(float(max_rate)), rate)


def solve(rows: DataFrame, domains: tuple[str, ...], weights: dict[str, float], total: float | None = None, max_rate: float | None = None) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Rows with ``tokens`` and ``p``: with the rate of each; target and reached total by domain."""
    k, mass = range(len(domains)), F.col("tokens")

    def measured(points: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """At each point: the totals by domain, second moments of rows within the bounds, and the integral of the rates."""
        tried = rows.withColumns({f"x{t}": _less(F.col("p"), point.tolist()) for t, point in enumerate(points)})
        each = []
        for t in range(len(points)):
            x, rate = F.col(f"x{t}"), _projected(F.col(f"x{t}"), max_rate)
            free = (x > 0) if max_rate is None else (x > 0) & (x < max_rate)
            each += [F.sum(rate * mass * F.col("p")[i]).alias(f"s{t}_{i}") for i in k]
            each += [F.sum(F.when(free, mass * F.col("p")[i] * F.col("p")[j])).alias(f"m{t}_{i}_{j}") for i in k for j in k if i <= j]
            each.append(F.sum(mass * (rate * x - rate * rate / 2)).alias(f"g{t}"))
        got = {n: float(v or 0) for n, v in tried.agg(*each).first().asDict().items()}
        return [(np.array([got[f"s{t}_{i}"] for i in k]), np.array([[got[f"m{t}_{min(i, j)}_{max(i, j)}"] for j in k] for i in k]), got[f"g{t}"]) for t in range(len(points))]

    at = np.zeros(len(domains))
    have = np.array([float(x or 0) for x in rows.agg(*[F.sum(mass * F.col("p")[i]) for i in k]).first()])
    scale = sum(weights.get(d, 0) for d in domains) or 1.0
    share = [weights.get(d, 0) / scale for d in domains]
    heavy = max(k, key=lambda i: share[i])
    target = np.array([s * (total if total is not None else have[heavy] / share[heavy] if share[heavy] else 0) for s in share])
    near = TOLERANCE * np.where(target > 0, target, target.sum())
    there = have > 0
    pull = NEARNESS * np.where(there, have, 1.0)

    def height(point: np.ndarray, integral: float) -> float:
        return float((pull * point**2).sum() / 2 + np.where(there, target, 0) @ point + integral)

    (now, moments, integral), optimal = measured([at])[0], False
    length = 1.0
    for n in range(MAX_STEPS + 1):
        slope = np.where(there, pull * at + target - now, 0.0)
        optimal = bool(np.all(np.abs(now - target)[there] <= near[there]) or np.abs(slope).max() <= OPTIMAL * target.sum())
        if optimal or n == MAX_STEPS:
            break
        step = np.linalg.solve(moments + np.diag(pull), slope)
        points = [at - length * t * step for t in TRIALS]
        got = measured(points)
        heights = [height(x, g[2]) for x, g in zip(points, got, strict=True)]
        best = int(np.argmin(heights))
        if heights[best] >= height(at, integral):
            if np.abs(length * TRIALS[-1] * step).max() <= 1e-14 * max(1.0, np.abs(at).max()):  # as near as numbers tell
                optimal = True
                break
            length *= TRIALS[-1]
            continue
        length = 1.0
        at, (now, moments, integral) = points[best], got[best]
    for i, d in enumerate(domains):
        log.log(logging.INFO if abs(now[i] - target[i]) <= near[i] else logging.WARNING, "domain %s: target %.0f tokens, reached %.0f", d, target[i], now[i])
    if not optimal:
        log.warning("rates are those after %d steps, before their optimum", MAX_STEPS)
    return rows.withColumn("rate", _projected(_less(F.col("p"), at.tolist()), max_rate)), {d: (float(target[i]), float(now[i])) for i, d in enumerate(domains)}


def _rated(docs: DataFrame, labels: DataFrame, weights: dict[str, float], total: float | None, id_col: str, text_col: str, max_rate: float | None) -> tuple[DataFrame, tuple[str, ...]]:
    """id, key (a hash of the text), tokens, p, rate and copies of every document, from a checkpoint; the domains."""
    classifier = DomainClassifier(docs, labels, id_col=id_col, text_col=text_col)
    rows = with_features(docs.select(F.col(id_col).alias("id"), F.col(text_col)), text_col)
    key = F.xxhash64("id", text_col).alias("key")
    rows = classifier.with_posteriors(rows, weights)
    rows = cut_lineage(rows.select("id", key, F.col("__tokens").alias("tokens"), F.col("__p").alias("p")))
    rated, _ = solve(rows, classifier.domains, weights, total, max_rate)
    chance = F.pmod("key", F.lit(1 << 20)) / (1 << 20)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return rated.withColumn("copies", copies), classifier.domains


def soft_mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, id_col: str = "doc_id", text_col: str = "text", max_rate: float | None = None) -> DataFrame:
    """``id_col``, n_tokens, the posteriors p_<domain>, rate and copies for every document."""
    rated, domains = _rated(docs, labels, weights or WEIGHTS, total, id_col, text_col, max_rate)
    return rated.select(F.col("id").alias(id_col), F.col("tokens").alias("n_tokens"), *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate", "copies")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, id_col: str = "doc_id", text_col: str = "text", max_rate: float | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says, and its columns only."""
    rated, _ = _rated(docs, labels, weights or WEIGHTS, total, id_col, text_col, max_rate)
    key, copies, turn = fresh(docs.columns, "__key", "__copies", "__k")
    wanted = rated.select(F.col("key").alias(key), F.col("copies").alias(copies)).where(F.col(copies) > 0).dropDuplicates([key])
    wanted = cut_lineage(wanted)
    repeated = docs.withColumn(key, F.xxhash64(id_col, text_col)).join(bounded(wanted), key).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
