"""Quantile sketches of batches, merged, against exact ranks."""

import bisect
import math
import random

from pyspark.sql import functions as F

from callweave.operators import summaries as M

DECILES = [k / 10 for k in range(11)]


def worst(values, quantiles):
    """How far the ranks of quantiles are from those asked for, as a share of all values; ties count for their whole range."""
    values = sorted(values)
    off = 0.0
    for p, q in zip(DECILES, quantiles, strict=True):
        lo, hi = bisect.bisect_left(values, q), bisect.bisect_right(values, q)
        off = max(off, (lo - p * len(values)) / len(values), (p * len(values) - hi) / len(values))
    return off


def test_merged_batches(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), i % 7, r.choice([r.gauss(0, 1), float(r.randrange(4))])) for i in range(60_000)]
    rows += [("a", 0, 2.0)] * 30_000 + [("a", 1, None), ("b", 2, math.nan), ("c", 1, None), ("d", 1, 5.0), (None, 3, 1.0)]
    table = spark.createDataFrame(rows, "g string, batch int, x double").repartition(9)
    kept = M.quantile_sketches(table, "x", ("g", "batch"))
    assert kept.select(F.max(F.length("sketch"))).first()[0] < 40_000
    got = {x.g: x for x in M.sketch_quantiles(M.merge_sketches(kept, ("g",)), DECILES).collect()}
    assert set(got) == {"a", "b", "d", None}
    for g in "ab":
        values = [x for h, _, x in rows if h == g and x is not None and x == x]
        assert got[g].n == len(values) and worst(values, got[g].quantiles) < 0.01
        assert got[g].quantiles[0] == min(values) and got[g].quantiles[-1] == max(values)
    assert got["d"].quantiles == [5.0] * 11 and got["d"].n == 1 and got[None].n == 1


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert M.sketch_quantiles(M.merge_sketches(M.quantile_sketches(none, "x")), [0.5]).count() == 0
    assert M.quantile_sketches(none, "x", ("g",)).count() == 0


def test_whole_numbers(spark):
    table = spark.range(5).select(F.col("id").cast("int").alias("x"))
    assert M.sketch_quantiles(M.quantile_sketches(table, "x"), [0.0, 0.5, 1.0]).first().quantiles == [0.0, 2.0, 4.0]
