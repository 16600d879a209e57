"""Exact and rank tests as expressions and aggregations."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


#: Cells of tables that are weighed at once.
CELLS = 1 << 18


def table_tails(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, greater: bool) -> np.ndarray:
    """``fisher_exact`` of arrays: tables with about as many others of their margins are one matrix, a row for each."""
    row1, row2, col1 = a + b, c + d, a + c
    first, last = np.maximum(0, col1 - row2), np.minimum(row1, col1)
    n = last - first + 1
    out = np.full(len(a), np.nan)
    order = np.argsort(n, kind="stable")
    end = len(order)
    while end and n[order[end - 1]] > 0:
        wide = int(n[order[end - 1]])
        at = order[max(0, end - max(1, CELLS // wide)) : end]
        end -= len(at)
        k = first[at, None] + np.arange(wide)
        fits = k <= last[at, None]
        r, s, m = row1[at, None], row2[at, None], col1[at, None]
        steps = np.where(k < last[at, None], (r - k) * (m - k), 1) / np.where(k < last[at, None], (k + 1) * (s - m + k + 1), 1)
        weight = np.zeros(k.shape)
        np.cumsum(np.log(steps[:, :-1]), axis=1, out=weight[:, 1:])
        mass = np.where(fits, np.exp(weight - np.where(fits, weight, -np.inf).max(axis=1, keepdims=True)), 0.0)
        own = weight[np.arange(len(at)), a[at] - first[at]]
        counts = (k >= a[at, None]) if greater else (weight <= own[:, None] + 1e-7)
        out[at] = np.minimum(np.where(counts, mass, 0.0).sum(axis=1) / mass.sum(axis=1), 1.0)
    return out


@functools.cache
def _tails(greater: bool):
    @F.pandas_udf(DoubleType())
    def tails(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna() & c.notna() & d.notna()).to_numpy()
        made = table_tails(*(x.fillna(0).to_numpy(np.int64)[known] for x in (a, b, c, d)), greater)
        out = np.full(len(a), np.nan)
        out[known] = made
        return pd.Series(out).astype("Float64").where(~np.isnan(out))

    return tails


def fisher_exact(a: Column, b: Column, c: Column, d: Column, greater: bool = False) -> Column:
    """P of the table [[a, b], [c, d]] with its margins: of tables no likelier, or of tables with at least ``a``.

    There are as many tables as the smallest margin, which grows with the depth, so they are weighed by arrays.
    """
    return _tails(greater)(*(x.cast("long") for x in (a, b, c, d)))


def rank_sums(rows: DataFrame, keys: list[str], value: str, is_alt: str) -> DataFrame:
    """For each group: sizes of both sides, U of the alternative side, whether values repeat, and the normal score of U.

    Values are first counted, so that ranks are windows over distinct values; null values don't count.
    """
    counts = rows.where(F.col(value).isNotNull() & F.col(is_alt).isNotNull()).groupBy(*keys, value).agg(F.count_if(F.col(is_alt)).alias("x"), F.count_if(~F.col(is_alt)).alias("y"))
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = counts.withColumn("below", F.coalesce(F.sum("y").over(before), F.lit(0)))
    t = (F.col("x") + F.col("y")).cast("double")
    sums = below.groupBy(*keys).agg(F.sum("x").alias("n_alt"), F.sum("y").alias("n_ref"), F.sum(F.col("x") * (F.col("below") + F.col("y") / 2)).alias("u"), F.sum(t * t * t - t).alias("__ties"))
    n, m = F.col("n_alt").cast("double"), F.col("n_ref").cast("double")
    spread = F.sqrt(n * m / 12 * (n + m + 1 - F.try_divide(F.col("__ties"), (n + m) * (n + m - 1))))
    score = F.try_divide(n * m / 2 - F.col("u") - 0.5, spread)
    return sums.withColumns({"z": score, "tied": F.col("__ties") > 0}).drop("__ties")


@functools.lru_cache(maxsize=1024)
def _exact(n: int, m: int) -> np.ndarray:
    """P(U <= u) for every u, without ties: choices of n out of n + m by their sum, as products of Gaussian factors."""
    ways = np.zeros(n * m + 1)
    ways[0] = 1
    for i in range(1, n + 1):
        ways[m + i :] -= ways[: max(0, n * m + 1 - m - i)].copy()
        for r in range(i):
            ways[r::i] = np.cumsum(ways[r::i])
    return np.cumsum(ways) / math.comb(n + m, n)


#: Sides up to this size are compared exactly, if no value repeats.
EXACT = 8


@F.pandas_udf(DoubleType())
def _less(n: pd.Series, m: pd.Series, u: pd.Series, z: pd.Series, tied: pd.Series) -> pd.Series:
    n, m, tied = n.fillna(0).to_numpy(int), m.fillna(0).to_numpy(int), tied.fillna(False).to_numpy(bool)
    z = z.fillna(0).to_numpy(float)
    p = np.where(np.minimum(n, m) > 0, 0.5 * np.fromiter(map(math.erfc, z / math.sqrt(2)), float, len(z)), np.nan)
    for i in np.flatnonzero((np.minimum(n, m) > 0) & (np.minimum(n, m) <= EXACT) & ~tied):
        p[i] = _exact(*sorted((int(n[i]), int(m[i]))))[int(u.iloc[i])]
    return pd.Series(p).astype("Float64").where(np.minimum(n, m) > 0)


def p_less(n: Column, m: Column, u: Column, z: Column, tied: Column) -> Column:
    """The probability of an alternative side this low, from its size, the other's, U, its normal score and whether values repeat.

    Null if a side is empty, a half if all values are equal.
    """
    return _less(n, m, u, z, tied)


def mann_whitney_less(rows: DataFrame, keys: list[str], value: str, is_alt: str) -> DataFrame:
    """``rank_sums`` with p, the probability of an alternative side this low; null if a side is empty."""
    return rank_sums(rows, keys, value, is_alt).withColumn("p", p_less(F.col("n_alt"), F.col("n_ref"), F.col("u"), F.col("z"), F.col("tied")))
