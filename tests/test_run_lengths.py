"""Runs over whole sequences against plain Python."""

import os
from itertools import groupby

from pyspark.sql import functions as F

from callweave.functions import expressions as X
from callweave.plans import registry
from callweave.plans.views import view

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_whole_documents(spark):
    want = {}
    for r in view(spark, SF, "sequences_v").collect():
        runs = [len(list(g)) for _, g in groupby(r.seq0)]
        want[r.doc_id] = (max(runs, default=None), len(runs))
    assert {r.doc_id: (r.longest, r.runs) for r in registry.QUERIES["run_lengths"](spark, SF).collect()} == want


def test_runs_across_81_bases(spark):
    seqs = ["C" + "A" * 200 + "G", "A" * 300_000, "", "ABBCCCDDDDAAAAAAA"]
    df = spark.createDataFrame(list(enumerate(seqs)), "i int, s string").select("i", X.run_lengths("s").alias("r"))
    assert [r.r for r in df.orderBy("i").collect()] == [[1, 200, 1], [300_000], [], [1, 2, 3, 4, 7]]
