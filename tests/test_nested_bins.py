"""Overlaps by nested bins against plain loops, and what wide intervals cost."""

import random

from pyspark.sql import functions as F

from callweave.operators import intervals as I

SPAN = "chrom string, start0 long, end0 long, n int"


def spans(r, n, k):
    out = []
    for i in range(n):
        width = r.choice([0, 1, 1, 5, 900, 1024, 5000, 70_000, 600_000, 5_000_000, 250_000_000])
        start = r.choice([0, 1023, 1024, 8191, 65_536, r.randrange(3000), r.randrange(1 << 20), r.randrange(240_000_000)])
        out.append((r.choice("12"), start, start + width, k + i))
    return out


def test_pairs(spark):
    r = random.Random(7)
    left, right = spans(r, 200, 0), spans(r, 150, 1000)
    a, b = spark.createDataFrame([*left, ("1", None, 5, -1)], SPAN), spark.createDataFrame([*right, (None, 1, 5, -2)], SPAN).withColumnRenamed("n", "m")
    got = sorted((x["n"], x["m"]) for x in I.overlap_join(a, b).collect())
    assert got == sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    full = [y for y in right if y[1] < y[2]]
    hit = {x[3] for x in left for y in full if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]}
    doubled = a.unionByName(a.where("n < 5"))
    semi, anti = (sorted(x["n"] for x in I.touching(doubled, b, how).collect()) for how in ("left_semi", "left_anti"))
    assert semi == sorted([*hit, *(n for n in hit if n < 5)])
    assert anti == sorted([-1, -1, *(x[3] for x in left if x[3] not in hit), *(x[3] for x in left if x[3] not in hit and x[3] < 5)])
    assert I.touching(a, b.limit(0), "left_semi").count() == 0 and I.touching(a, b.limit(0), "left_anti").count() == 201


def test_keys_of_wide_intervals(spark):
    rows = spark.createDataFrame([("1", 0, 250_000_000, 0), ("1", 123_456_789, 123_456_790, 1), ("1", 1_000, 70_000, 2)], SPAN)
    for up in (0, 1):
        n = {x["n"]: x["k"] for x in rows.select("n", F.size(I._keys(F.col("start0"), F.col("end0"), up)).alias("k")).collect()}
        assert n[0] <= 64 + len(I.LEVELS) and n[1] <= 1 + len(I.LEVELS) and n[2] <= 4 + len(I.LEVELS)


def test_keys_are_not_broadcast(spark):
    """A few wide regions are small before keys are made of them and not after."""
    rows = spark.range(1).selectExpr("cast(id as string) as chrom", "id + 5 as start0", "id + 6 as end0")
    regions = spark.range(1).selectExpr("cast(id as string) as chrom", "id as start0", "id + 250000000 as end0")
    for made in (I.touching(rows, regions, "left_semi"), I.overlap_join(rows, regions)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        bins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "bin" in x]
        assert made.count() == 1 and not bins and "SortMergeJoin" in plan
