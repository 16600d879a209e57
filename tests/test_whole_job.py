"""Whole inputs against plain Python: what a twin with the same cut could not show."""

import os
from collections import defaultdict

import pytest

from callweave.plans import registry
from callweave.plans.views import view

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def regions(spark):
    """A region for each order, from the table's columns alone."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus").collect()
    return [(f"chr{o.o_custkey % 5 + 1}", o.o_orderkey * 61, o.o_orderkey * 61 + 50 + o.o_custkey % 400, o.o_orderstatus) for o in orders]


def test_every_order_is_a_region(spark, regions):
    got = view(spark, SF, "regions_v").select("chrom", "start0", "end0", "label").collect()
    assert sorted(map(tuple, got)) == sorted(regions)


def test_regions_merge_into_islands(spark, regions):
    want = defaultdict(list)
    for chrom, start, end, _ in sorted(regions):
        if want[chrom] and start <= want[chrom][-1][1]:
            want[chrom][-1][1] = max(want[chrom][-1][1], end)
        else:
            want[chrom].append([start, end])
    got = registry.QUERIES["merge_intervals"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((c, s, e) for c, islands in want.items() for s, e in islands)
    assert all(len(islands) > 10 for islands in want.values())


@pytest.mark.parametrize("name, inside", [("include_regions", lambda f, o: f), ("exclude_regions", lambda f, o: not o), ("intersect_regions", lambda f, o: f and not o)])
def test_calls_in_regions(spark, regions, name, inside):
    def touched(c, label):
        return any(r[0] == c.chrom and r[3] == label and r[1] < c.pos - 1 + len(c.ref) and c.pos - 1 < r[2] for r in near[c.chrom, c.pos // 500])

    near = defaultdict(list)
    for r in regions:
        for b in range(r[1] // 500 - 1, r[2] // 500 + 2):
            near[r[0], b].append(r)
    calls = view(spark, SF, "calls_v").collect()
    want = [c for c in calls if inside(touched(c, "F"), touched(c, "O"))]
    assert 0 < len(want) < len(calls)
    assert sorted(map(tuple, registry.QUERIES[name](spark, SF).select(*calls[0].__fields__).collect())) == sorted(map(tuple, want))
