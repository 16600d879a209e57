"""Depth over good bases: runs of them against plain loops, and no step for each base."""

import random

from callweave.operators import reads as R


def test_good_runs(spark):
    r = random.Random(5)
    rows = [(i, "c1", r.randrange(30), r.choice(["20M", "5S10M2D5M", "6M3I4M2N7M", "20="]), r.choice([5, 30]), 0, "".join(chr(33 + r.choice([2, 19, 20, 21, 40])) for _ in range(20))) for i in range(60)]
    rows += [(60, "c1", 3, "20M", 30, 0, None), (61, "c1", 3, "20M", 30, 0, "II"), (62, "c1", 3, "20M", 30, 0, "")]
    reads = spark.createDataFrame(rows, "read_id long, chrom string, start0 long, cigar string, mapq int, flag int, quals string")
    depth = {}
    import re

    for _, _, at, cigar, mapq, _, quals in rows:
        q = 0
        for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MIDNS=])", cigar)):
            for j in range(n if op in "M=" else 0):
                if mapq >= 10 and quals and q + j < len(quals) and ord(quals[q + j]) - 33 >= 20:
                    depth[at + j] = depth.get(at + j, 0) + 1
            q, at = q + n * (op in "MIS="), at + n * (op in "MDN=")
    got = R.coverage_depth(reads, 10, 20)
    assert {p: x.depth for x in got.collect() for p in range(x.start0, x.end0)} == depth
    assert "sequence(" not in got._jdf.queryExecution().analyzed().toString()
