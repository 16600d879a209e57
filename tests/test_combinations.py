"""Sums over sets of callers, and labels of segments, against plain loops."""

import random

import pytest

from callweave.operators import ensemble as E
from callweave.operators import intervals as I

CALL = "chrom string, pos int, ref string, alt string, caller string, filter string"


@pytest.mark.parametrize("n", [1, 3, 18])
def test_combinations(spark, n):
    r = random.Random(n)
    callers = [f"c{i}" for i in range(n)]
    calls = [("1", r.randrange(40), "A", "C", r.choice([*callers, "other"]), r.choice(["PASS", "PASS", "LowQual", "REJECT"])) for _ in range(90)]
    truth = {(p,) for p in range(0, 40, 3)}
    masks = {}
    for _, pos, _, _, caller, said in calls:
        if said == "PASS" and caller in callers:
            masks[pos] = masks.get(pos, 0) | 1 << callers.index(caller)
    got = E.caller_combinations(spark.createDataFrame(calls, CALL), spark.createDataFrame([("1", p, "A", "C") for (p,) in truth], "chrom string, pos int, ref string, alt string"), callers).toPandas()
    got = {x.callers: (x.calls, x.true_calls) for x in got.itertuples()}
    for chosen in r.sample(range(1, 1 << n), min(500, (1 << n) - 1)):
        own = [p for p, m in masks.items() if m & chosen]
        assert got.get(chosen, (0, 0)) == (len(own), sum((p,) in truth for p in own))
    assert len(got) <= (1 << n) - 1 and E.caller_combinations(spark.createDataFrame([], CALL), spark.createDataFrame([], "chrom string, pos int, ref string, alt string"), callers).count() == 0


@pytest.mark.parametrize("order", [None, ["z", "l1", "l3", "l0"]])
def test_labels_of_segments(spark, monkeypatch, order):
    r = random.Random(9)
    regions = [(r.choice("12"), s, s + r.randrange(1, 60), f"l{r.randrange(5)}") for s in (r.randrange(300) for _ in range(60))]
    contigs = spark.createDataFrame([("1", 500), ("2", 200), ("3", 50)], "chrom string, size long")
    table = spark.createDataFrame(regions, "chrom string, start0 long, end0 long, label string")
    made = sorted(map(tuple, I.count_loci(table, contigs, order).collect()))
    for chrom, start, end, n, labels in made:
        on = {x for c, s, e, x in regions if c == chrom and s <= start and end <= e}
        merged = {x for x in {y[3] for y in regions} if all(any(c == chrom and s <= p < e and y == x for c, s, e, y in regions) for p in range(start, end))}
        assert on <= merged and n == len(merged)
        assert labels == (",".join(x for x in order if x in merged) if order else ",".join(sorted(merged)) or ".") if merged else labels == "."
    monkeypatch.setattr(I, "MOST_LABELS", 2)
    assert sorted(map(tuple, I.count_loci(table, contigs, order).collect())) == made
