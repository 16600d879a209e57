"""How many distinct substrings texts have, of all lengths or up to one, and their linguistic complexity."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Lengths up to which there may be fewer words over four letters than places; 4 ** SHORT exceeds any text's length.
SHORT = 20
#: Bits of a number that words are packed into, and how many letters are packed at once.
BITS = 63
PACKED = 1 << 20


def packed(codes: np.ndarray, longest: int, bits: int) -> np.ndarray:
    """For each place of rows of letters (1, 2, ...) the next ``longest`` letters as one number, zeros beyond the end."""
    out = np.zeros(codes.shape, np.int64)
    for i in range(min(longest, codes.shape[-1])):
        out[..., : codes.shape[-1] - i] |= codes[..., i:] << (bits * (longest - 1 - i))
    return out


def count_up_to(texts: list[str], longest: int) -> np.ndarray:
    """Distinct substrings of 1 to ``longest`` characters of each text.

    The places of a text are sorted by the letters that follow: each adds the words that begin there, less those that its
    neighbour begins with as well.  Texts of one length are counted together; those with more letters than fit into a number one by one.
    """
    out = np.zeros(len(texts), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    for n in np.unique(sizes[sizes > 0]):
        of = np.flatnonzero(sizes == n)
        step = max(1, PACKED // int(n))
        for rows in (of[k : k + step] for k in range(0, len(of), step)):
            points = np.frombuffer("".join([texts[i] for i in rows]).encode("utf-32-le", "surrogatepass"), np.uint32)
            held = np.zeros(int(points.max()) + 1, bool)
            held[points] = True
            letter = np.cumsum(held)
            bits = int(letter[-1]).bit_length()
            if bits * longest > BITS:
                out[rows] = [_count_one(texts[i], longest) for i in rows]
                continue
            words = np.sort(packed(letter[points].reshape(len(rows), n), longest, bits), axis=1)
            apart = words[:, 1:] ^ words[:, :-1]
            shared = sum((apart < (1 << bits * (longest - k))).sum(axis=1) for k in range(1, longest + 1))
            out[rows] = np.minimum(longest, np.arange(1, n + 1)).sum() - shared
    return out


def _count_one(text: str, longest: int) -> int:
    return sum(len({text[i : i + k] for i in range(len(text) - k + 1)}) for k in range(1, min(longest, len(text)) + 1))


@cache
def distinct_up_to(longest: int):
    """A function of a column: how many distinct substrings of 1 to ``longest`` characters there are; null for null."""

    @F.pandas_udf(LongType())
    def counted(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        out = pd.Series([None] * len(texts), texts.index, dtype="Int64")
        out[known] = count_up_to(texts[known].tolist(), longest)
        return out

    return counted


def count_distinct(text: str) -> int:
    """n (n + 1) / 2 substrings, less the common prefixes of neighbours in the suffix array.

    Ranks of as many characters as fit into a number are doubled until all suffixes differ; the common prefix of two suffixes is read off
    the same ranks from the longest down, and what is less than the shortest off the numbers.  Time grows with n log n for each doubling;
    memory by four bytes a character for each, and there are as many as the longest repeated substring asks for.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return 0
    held = np.zeros(int(points.max()) + 1, bool)
    held[points] = True
    letter = np.cumsum(held)
    bits = int(letter[-1]).bit_length()
    first = 1 << (BITS // bits).bit_length() - 1
    words = packed(letter[points].reshape(1, n), first, bits)[0]
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels = []
    while rank.max() < n - 1:
        levels.append(rank.astype(np.int32))
        width = first << (len(levels) - 1)
        then = np.zeros(n, np.int64)
        then[: n - width] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + then, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = 0
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(a, b) < n)
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        a[same] += first << k
        b[same] += first << k
        shared += len(same) * (first << k)
    inside = np.flatnonzero(np.maximum(a, b) < n)
    apart = words[a[inside]] ^ words[b[inside]]
    shared += sum(int((apart < (1 << bits * (first - k))).sum()) for k in range(1, first + 1))
    return n * (n + 1) // 2 - shared


@F.pandas_udf(LongType())
def _distinct(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else count_distinct(t) for t in texts], dtype="Int64")


def linguistic_complexity(seq: str, longest: int = 20) -> Column:
    """Distinct substrings of up to ``longest`` characters over the most there can be; null with an N."""
    n = F.length(seq).cast("long")
    most = F.aggregate(F.sequence(F.lit(1), F.lit(longest)), F.lit(0.0), lambda a, k: a + F.greatest(F.least(F.pow(F.lit(4.0), k), (n - k + 1).cast("double")), F.lit(0.0)))
    fair = F.when(~F.col(seq).contains("N") & (n > 0), F.col(seq))
    return distinct_up_to(longest)(fair).cast("double") / most


def full_complexity(seq: str) -> Column:
    """Distinct substrings of any length over the most there can be over four letters; null with an N, for null and for no text."""
    n = F.length(seq).cast("long")
    short = F.aggregate(F.sequence(F.lit(1), F.lit(SHORT)), F.lit(0.0), lambda s, k: s + F.greatest(F.least(F.pow(F.lit(4.0), k), (n - k + 1).cast("double")), F.lit(0.0)))
    rest = F.greatest(n - SHORT, F.lit(0)).cast("double")
    most = short + rest * (rest + 1) / 2
    fair = F.when(~F.col(seq).contains("N") & (n > 0), F.col(seq))
    return _distinct(fair).cast("double") / most
