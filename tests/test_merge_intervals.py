"""Merging in bins against plain Python, and what the second merge sees."""

import random

import pytest

from callweave.operators import intervals


@pytest.mark.parametrize("width", [8, 64, 1 << 16])
def test_bins(spark, width):
    r = random.Random(width)
    rows = []
    for chrom in ("a", "b", None):
        for _ in range(120):
            start = r.randrange(3000)
            rows.append((chrom, start, start + r.choice([0, 1, 3, 9, 9, 150 if r.random() < 0.05 else 2])))
    rows += [("c", 0, 5000), *[("c", k, k + 1) for k in range(1, 200, 3)], ("c", 5000, 5001), ("c", 5003, 5004)]
    want = []
    for chrom, start, end in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
        if want and want[-1][0] == chrom and start <= want[-1][2]:
            want[-1][2] = max(want[-1][2], end)
        else:
            want.append([chrom, start, end])
    got = intervals.merge_intervals(spark.createDataFrame(rows, "chrom string, start0 long, end0 long"), width=width).collect()
    assert sorted(map(str, map(list, got))) == sorted(map(str, want))
