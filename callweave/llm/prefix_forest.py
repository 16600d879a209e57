"""Nearest neighbours by inner product with a hash-prefix forest.

A tree gives each vector a string of BITS sign bits of random projections and keeps the strings sorted, so that
all vectors sharing a prefix with a query lie in one range.  A query descends to its longest match in every tree
and then ascends all trees together, one bit and one tree after another, until its ranges hold the wanted share of
the vectors; those are scored exactly.  For inner products vectors get one more component that makes their
norms equal; queries have 0 there.

The forest is kept in blocks of about BLOCK vectors, and queries meet every block in chunks of about CHUNK, so no
task holds more.  The share to ascend to is fitted so that ``recall`` of the exact neighbours of at most PROBES
queries (those with the smallest hash of their id) would have been reached; all other queries only use it.

Edge cases: null, zero or non-finite vectors and null ids take no part; vectors of another length than the most
frequent one take no part; equal scores go by the smaller id; repeated rows of an id count once each as candidates and
once as a query; with fewer than k candidates all are returned; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.llm.common import cut_lineage

TREES = 24
BITS = 20
BLOCK = 4096
CHUNK = 2048
PROBES = 64


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


class Forest:
    """The sorted arrays of one block."""

    def __init__(self, vectors: np.ndarray, norm: float, seed: int = 7):
        self.vectors, (self.n, width) = vectors, vectors.shape
        self.planes = np.random.default_rng(seed).standard_normal((width + 1, TREES * BITS))
        extra = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
        self.strings = self._strings(np.column_stack([vectors, extra]))
        self.order = np.argsort(self.strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.strings, self.order, axis=0)

    def _strings(self, extended: np.ndarray) -> np.ndarray:
        bits = (extended @ self.planes > 0).reshape(len(extended), TREES, BITS)
        return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))

    def query_strings(self, queries: np.ndarray) -> np.ndarray:
        return self._strings(np.column_stack([queries, np.zeros(len(queries))]))

    def ranges(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of each query's prefix of every length in every tree: (query, length, tree)."""
        lo, hi = (np.empty((len(strings), BITS + 1, TREES), np.int32) for _ in range(2))
        for length in range(BITS + 1):
            shift = BITS - length
            for tree in range(TREES):
                prefix = strings[:, tree] >> shift
                lo[:, length, tree] = np.searchsorted(self.sorted[:, tree], prefix << shift, "left")
                hi[:, length, tree] = np.searchsorted(self.sorted[:, tree], (prefix + 1) << shift, "left")
        return lo, hi

    def ascend(self, lo: np.ndarray, hi: np.ndarray, share: float) -> np.ndarray:
        """How many steps each query ascends until its ranges should hold ``share`` of the block."""
        apart = np.log1p(-np.minimum((hi - lo) / max(self.n, 1), 1 - 1e-12))
        down = apart[:, ::-1, :]  # longest prefixes first
        base = down.sum(axis=2)[:, :-1, None]
        gain = np.cumsum(down[:, 1:, :] - down[:, :-1, :], axis=2)
        held = 1 - np.exp(base + gain).reshape(len(lo), -1)
        enough = held >= share
        return np.where(enough.any(axis=1), enough.argmax(axis=1), held.shape[1] - 1)

    def candidates(self, lo: np.ndarray, hi: np.ndarray, step: int) -> np.ndarray:
        length, trees = BITS - 1 - step // TREES, step % TREES + 1
        seen = np.zeros(self.n, bool)
        for tree in range(TREES):
            at = length if tree < trees else length + 1
            seen[self.order[lo[at, tree] : hi[at, tree], tree]] = True
        return np.flatnonzero(seen)

    def steps_to(self, string: np.ndarray) -> np.ndarray:
        """The step at which each vector of the block becomes a candidate of one query."""
        differ = self.strings ^ string
        matched = BITS - np.ceil(np.log2(differ + 1)).astype(int)
        return ((BITS - matched - 1) * TREES + np.arange(TREES)).min(axis=1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))


class PrefixForestIndex:
    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97):
        finite = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
        nonzero = F.exists(vector_col, lambda x: x != 0)
        rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite & nonzero)
        rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        self.width = (rows.select(F.size("v").alias("s")).agg(F.mode("s", True).alias("m")).first() or [None])[0] or 0
        self.rows = rows.where(F.size("v") == self.width)
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        self.norm, self.n = self.rows.agg(F.max(norm), F.count("*")).first()
        self.blocks, self.recall = max(1, -(-self.n // BLOCK)), recall

    def _met(self, queries: DataFrame, n_queries: int, run, schema: str) -> DataFrame:
        """``run`` over every block and every chunk of queries."""
        chunks = max(1, -(-n_queries // CHUNK))
        index = self.rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(self.blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
        asked = queries.select("id", "v", F.explode(F.expr(f"sequence(0L, {self.blocks - 1}L)")).alias("block"), F.pmod(F.xxhash64(F.lit("query"), "id"), F.lit(chunks)).cast("int").alias("chunk"))
        return index.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(run, schema)

    def _fit_share(self, queries: DataFrame, k: int) -> float:
        """The share of a block that must be looked at for the wanted recall of the probes."""
        width, norm, schema = self.width, self.norm, "query_id long, vec_id long, score double, share double"
        probes = queries.orderBy(F.xxhash64("id"), "id").limit(PROBES)

        def run(block: pa.Table, asked: pa.Table) -> pa.Table:
            made = {"query_id": [], "vec_id": [], "score": [], "share": []}
            if block.num_rows and asked.num_rows:
                ids, forest, q = block["id"].to_numpy(), Forest(_matrix(block["v"], width), norm), _matrix(asked["v"], width)
                for own, vector, string in zip(asked["id"].to_pylist(), q, forest.query_strings(q), strict=True):
                    scores = np.where(ids == own, -np.inf, forest.vectors @ vector)
                    best = _best(scores, ids, k)
                    best = best[ids[best] != own]
                    steps = forest.steps_to(string)
                    shares = np.searchsorted(np.sort(steps), steps[best], "right") / forest.n
                    for name, x in (("query_id", [own] * len(best)), ("vec_id", ids[best].tolist()), ("score", scores[best].tolist()), ("share", shares.tolist())):
                        made[name] += x
            return pa.table({"query_id": pa.array(made["query_id"], pa.int64()), "vec_id": pa.array(made["vec_id"], pa.int64()), "score": pa.array(made["score"], pa.float64()), "share": pa.array(made["share"], pa.float64())})

        near = _top(self._met(probes, PROBES, run, schema), k)
        return near.agg(F.percentile("share", F.lit(self.recall))).first()[0] or 1.0

    def search(self, queries: Column, k: int = 20) -> DataFrame:
        """query_id, rank, vec_id and score of the k nearest rows found for all rows where ``queries`` (over "id") holds."""
        asked = cut_lineage(self.rows.where(queries).groupBy("id").agg(F.min("v").alias("v")))
        n = asked.count()
        share = self._fit_share(asked, k) if n else 1.0
        width, norm = self.width, self.norm

        def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
            owners, found, scored = [], [], []
            if block.num_rows and chunk.num_rows:
                ids, forest, q = block["id"].to_numpy(), Forest(_matrix(block["v"], width), norm), _matrix(chunk["v"], width)
                for start in range(0, len(q), 256):
                    part = q[start : start + 256]
                    lo, hi = forest.ranges(forest.query_strings(part))
                    steps = forest.ascend(lo, hi, share)
                    for j, own in enumerate(chunk["id"].slice(start, len(part)).to_pylist()):
                        near = forest.candidates(lo[j], hi[j], int(steps[j]))
                        near = near[ids[near] != own]
                        scores = forest.vectors[near] @ part[j]
                        best = _best(scores, ids[near], k)
                        owners.append(np.full(len(best), own))
                        found.append(ids[near[best]])
                        scored.append(scores[best])
            join = lambda x, kind: pa.array(np.concatenate([*x, np.zeros(0)]).astype(kind))
            return pa.table({"query_id": join(owners, np.int64), "vec_id": join(found, np.int64), "score": join(scored, float)})

        met = self._met(asked, n, run, "query_id long, vec_id long, score double")
        return _top(met, k).select("query_id", "rank", "vec_id", "score")


def _top(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
