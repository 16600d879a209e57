"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is labelled good or bad.  A line's features describe itself and its two neighbours; the
chain adds weights for the pairs of labels of adjacent lines.  Labels come by document, so a training
document's lines all carry its label.  Forward-backward gives each line's marginal of being good; the
document's score is their mean, weighted by line length (characters plus one).

The model is fitted on ``MAX_TRAIN_DOCS`` labelled documents at most, those with the smallest hash of
their id, and of these only documents of up to ``MAX_TRAIN_LINES`` lines, so that the driver gets 32 MB of
features at most; every document is scored over its whole text.

Edge cases: a null or empty text is one empty line and gets that line's marginal; null labels are left
out, and of several labels of one id the largest counts; if the labels hold one class or none, the score
is that class or 0.5; null and repeated ids and repeated rows are scored row by row; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import slices, tidy
from callweave.llm.text_arrays import DIGIT, STOP, SYMBOL, TextArrays, table

BATCH_BYTES = 1 << 20
MAX_TRAIN_DOCS = 4000
MAX_TRAIN_LINES = 200
OWN = ("upper", "symbol", "pipe", "digit", "stop", "same_as_before", "repeated", "short", "long_words", "earlier_line")
K = len(OWN)
#: Weights of a line: of a constant, of its own features, and of those of the line before and after.
WIDTH = 1 + 3 * K
PIPE, BANG = table(b"|"), table(b"!")


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines, the lines' weights, and each text's first line (one more entry than texts)."""
    t = TextArrays(texts)
    ends = t.line_ends
    chars = t.per_line(t.first_bytes)
    size = np.maximum(chars, 1)
    word_line = np.searchsorted(ends, t.word_starts, "right")
    n_words = np.bincount(word_line, minlength=len(ends))
    same = np.zeros(len(t.codes), bool)
    same[1:] = (t.codes[1:] == t.codes[:-1]) & (word_line[1:] == word_line[:-1])
    distinct = np.unique(word_line * (int(t.codes.max(initial=0)) + 1) + t.codes)
    n_distinct = np.bincount(distinct // (int(t.codes.max(initial=0)) + 1), minlength=len(ends))
    words = np.maximum(n_words, 1)
    letters = np.maximum(chars - t.per_line(~t.visible), 1)
    at = np.concatenate([[0], np.cumsum(t.n_lines)])
    columns = (
        t.per_line(t.upper) / letters,
        np.sqrt(t.per_line(SYMBOL[t.data]) / size),
        np.sqrt(t.per_line(PIPE[t.data]) / size),
        np.sqrt(t.per_line(DIGIT[t.data]) / size),
        np.sqrt(t.per_line(STOP[t.data] | BANG[t.data]) / size),
        np.bincount(word_line[same], minlength=len(ends)) / words,
        np.maximum(0.0, 1 - n_distinct / np.maximum(np.minimum(words, 40 + words * 0.3), 1)),
        1 / np.sqrt(1.0 + n_words),
        np.minimum(2.0, t.per_line(t.visible & t.first_bytes) / words / 10),
        t.repeated_line,
    )
    own = np.empty((len(ends), K), np.float32)
    for k, column in enumerate(columns):
        own[:, k] = column
    return own, chars + 1.0, at


def _inner(n: int, at: np.ndarray) -> np.ndarray:
    """Which lines follow another line of their text."""
    inner = np.ones(n, bool)
    inner[at[:-1]] = False
    return inner


def emissions(own: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log weight of good over bad of each line, out of its features and its neighbours'."""
    e = weights[0] + own @ weights[1 : 1 + K]
    if len(e) > 1:
        inner = _inner(len(e), at)[1:]
        e[1:] += np.where(inner, own[:-1] @ weights[1 + K : 1 + 2 * K], 0)
        e[:-1] += np.where(inner, own[1:] @ weights[1 + 2 * K :], 0)
    return e


def emission_gradient(own: np.ndarray, at: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The gradient of the weights where ``residual`` is that of each line's emission."""
    inner = _inner(len(own), at)[1:]
    before, after = np.where(inner, residual[1:], 0), np.where(inner, residual[:-1], 0)
    return np.concatenate([[residual.sum()], residual @ own, before @ own[:-1], after @ own[1:]])


def marginals(emission: np.ndarray, pairs: np.ndarray, at: np.ndarray, chain_weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    ``emission`` is the log weight of good over bad of each line, ``pairs`` the log weights of adjacent
    labels.  Returns each line's probability of good, the expected pair counts (by ``chain_weight``), and each
    chain's log partition.
    """
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    first, n = at[:-1][order], n[order]
    steps = int(n.max(initial=0))
    live = [int(np.searchsorted(-n, -s, "left")) for s in range(steps)]  # chains longer than s
    weight = np.exp(pairs - pairs.max())
    alpha, scale = np.zeros((len(emission), 2)), np.zeros(len(emission))
    good, bad = 1 / (1 + np.exp(-emission)), 1 / (1 + np.exp(emission))
    local = np.stack([bad, good], axis=1)
    total = np.zeros(len(n))
    base = np.logaddexp(0, emission)
    for s in range(steps):
        i = first[: live[s]] + s
        a = local[i] if s == 0 else (alpha[i - 1] @ weight) * local[i]
        scale[i] = a.sum(axis=1)
        alpha[i] = a / scale[i][:, None]
        total[: live[s]] += np.log(scale[i]) + base[i] + (pairs.max() if s else 0)
    beta, expected = np.ones((len(emission), 2)), np.zeros((2, 2))
    share = np.ones(len(n)) if chain_weight is None else chain_weight[order]
    for s in range(steps - 1, 0, -1):
        i = first[: live[s]] + s
        after = local[i] * beta[i] / scale[i][:, None]
        beta[i - 1] = after @ weight.T
        expected += weight * (alpha[i - 1].T @ (after * share[: live[s], None]))
    partition = np.zeros(len(n))
    partition[order] = total
    return (alpha * beta)[:, 1], expected, partition


@dataclass
class LineCrf:
    weights: np.ndarray
    pairs: np.ndarray
    constant: float | None = None

    @classmethod
    def fit(cls, own: np.ndarray, at: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.3, ridge: float = 1e-4) -> LineCrf:
        """Maximum conditional likelihood by Adam over all chains; each class has the same total weight."""
        if len(set(labels.tolist())) < 2:
            return cls(np.zeros(WIDTH), np.zeros((2, 2)), float(labels[0]) if len(labels) else 0.5)
        n = np.diff(at)
        y = np.repeat(labels, n).astype(float)
        share = 0.5 / np.where(labels == 1, n[labels == 1].sum(), n[labels == 0].sum())
        line_share = np.repeat(share, n)
        inside = (n - 1) * share
        counted = np.diag([float(inside[labels == 0].sum()), float(inside[labels == 1].sum())])
        theta = np.zeros(WIDTH + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, rounds + 1):
            w, pairs = theta[:-4], theta[-4:].reshape(2, 2)
            p, expected, _ = marginals(emissions(own, at, w), pairs, at, share)
            grad = np.concatenate([emission_gradient(own, at, (y - p) * line_share), (counted - expected).ravel()]) - ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return cls(theta[:-4], theta[-4:].reshape(2, 2))

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        own, size, at = line_features(texts)
        p, _, _ = marginals(emissions(own, at, self.weights), self.pairs, at)
        return np.clip(np.add.reduceat(p * size, at[:-1]) / np.add.reduceat(size, at[:-1]), 0.0, 1.0) if len(p) else np.zeros(0)


def fold(id_col: str | Column = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_TRAIN_DOCS) -> LineCrf:
    """Fit on a bounded sample of labelled documents outside fold 0."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold("id") != 0))
    sample = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_docs)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    schema = "y int, n int, x binary, k long, h long"

    def features(batches: Iterable[pa.RecordBatch]):
        for whole in batches:
            for part in slices(whole, "text", BATCH_BYTES):
                own, _, at = line_features(part.column("text"))
                keep = np.flatnonzero(np.diff(at) <= MAX_TRAIN_LINES)
                rows = [own[at[i] : at[i + 1]].astype("<f4").tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays([part.column("y").take(pa.array(keep)), pa.array(np.diff(at)[keep].astype(np.int32)), pa.array(rows, pa.binary()), part.column("k").take(pa.array(keep)), part.column("h").take(pa.array(keep))], ["y", "n", "x", "k", "h"])

    got = chosen.select("text", "y", F.xxhash64("id").alias("k"), F.xxhash64("text").alias("h")).mapInArrow(tidy(features), schema)
    rows = got.orderBy("k", "h").limit(max_docs).collect()
    if not rows:
        return LineCrf.fit(np.zeros((0, K)), np.zeros(1, np.int64), np.zeros(0, int))
    own = np.frombuffer(b"".join(bytes(r.x) for r in rows), "<f4").reshape(-1, K).astype(float)
    return LineCrf.fit(own, np.concatenate([[0], np.cumsum([r.n for r in rows])]), np.array([r.y for r in rows]))


def score(docs: DataFrame, model: LineCrf, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` but the text are dropped: ``id_col``, score and predicted (1 from the threshold on)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scores(batches: Iterable[pa.RecordBatch]):
        for whole in batches:
            for part in slices(whole, "text", BATCH_BYTES):
                s = model.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(scores), f"id {id_type}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: LineCrf, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that the model accepts, with all their columns."""

    def good(batches: Iterable[pa.RecordBatch]):
        for whole in batches:
            at = whole.schema.get_field_index(text_col)
            for part in slices(whole, text_col, BATCH_BYTES):
                yield part.filter(pa.array(model.score(part.column(at)) >= threshold))

    return docs.mapInArrow(tidy(good), docs.schema)
