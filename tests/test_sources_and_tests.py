"""Text sources and sinks as round trips, and the small tests of counts against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from callweave.functions import count_tests as T
from callweave.operators import site_calls as S
from callweave.operators import verdicts as V
from callweave.sources import text


def test_vcf_round_trip(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\n2\t5\t.\tA\tC\t7.5\tPASS\tSOMATIC;DP=3\tGT:DP\t0/1:9\t0/0\n1\t9\trs1\tG\tT\t.\t.\t.\n")
    (tmp_path / "a.fai").write_text("1 x\t100\t3\t60\t61\n2\t200\t110\t60\t61\n")
    rows = text.scan_vcf(spark, str(tmp_path / "a.vcf"))
    got = {r.pos: r for r in rows.withColumns({"dp": text.sample_value("DP"), "dp2": text.sample_value("DP", 1)}).collect()}
    assert (got[5].chrom, got[5].qual, got[5].dp, got[5].dp2, got[5].id) == ("2", 7.5, "9", None, None)
    assert (got[9].id, got[9].filter, got[9].samples, got[9].dp) == ("rs1", None, [], None)
    contigs = text.scan_contigs(spark, str(tmp_path / "a.fai"))
    text.write_vcf(rows.select(*text.FIXED), str(tmp_path / "out"), contigs)
    again = text.scan_vcf(spark, str(tmp_path / "out")).select(*text.FIXED)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.select(*text.FIXED).collect()))


def test_regions_pileups_features(spark, tmp_path):
    (tmp_path / "r.bed").write_text("track x\n#c\n1\t5\n1\t7\t9\tq\n")
    assert {tuple(r) for r in text.scan_bed(spark, str(tmp_path / "r.bed")).collect()} == {("1", 5, 6, None), ("1", 7, 9, "q")}
    (tmp_path / "p.txt").write_text("1\t5\tA\t0\n1\t6\tC\t2\t.,\tII\n")
    assert [r.bases for r in text.scan_pileup(spark, str(tmp_path / "p.txt")).orderBy("pos").collect()] == [None, ".,"]
    (tmp_path / "s.txt").write_text("1\t5\n")
    assert [tuple(r) for r in text.scan_positions(spark, str(tmp_path / "s.txt")).collect()] == [("1", 5)]
    text.write_features(spark.createDataFrame([(1, 2.5), (2, None)], "a int, b double"), str(tmp_path / "f"))
    assert {tuple(r) for r in text.scan_features(spark, str(tmp_path / "f")).collect()} == {(1, 2.5), (2, None)}
    assert text.scan_bed(spark, str(tmp_path / "r.bed")).limit(0).count() == 0


def test_mann_whitney(spark):
    random.seed(3)
    small = [("a", float(i), i % 3 == 0) for i in random.sample(range(50), 9)]
    other = [("b", float(random.randrange(6)), random.random() < 0.5) for _ in range(60)] + [("c", 1.0, True), ("d", 2.0, True), ("d", 2.0, False), ("a", None, True)]
    got = {r.g: r for r in T.mann_whitney_less(spark.createDataFrame(small + other, "g string, v double, alt boolean"), ["g"], "v", "alt").collect()}
    values = [v for _, v, _ in small]
    n = sum(a for *_, a in small)
    u = lambda side: sum(x > y for x in side for y in set(values) - set(side))
    own = u([v for _, v, a in small if a])
    every = [u(c) for c in itertools.combinations(values, n)]
    assert got["a"].p == pytest.approx(sum(x <= own for x in every) / len(every))
    x, y = [v for g, v, a in other if g == "b" and a], [v for g, v, a in other if g == "b" and not a]
    ub = sum((p > q) + 0.5 * (p == q) for p in x for q in y)
    size = len(x) + len(y)
    ties = sum(c**3 - c for c in ((x + y).count(v) for v in set(x + y)))
    z = (len(x) * len(y) / 2 - ub - 0.5) / math.sqrt(len(x) * len(y) / 12 * (size + 1 - ties / (size * (size - 1))))
    assert got["b"].u == ub and got["b"].p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))
    assert got["c"].p is None and got["d"].p == 0.5


def test_site_call_distances(spark):
    reads = spark.createDataFrame([(c, "1", 10) for c in ("5M2D5M", "3S7M", "4M1I6M2D4M", "6M")], "cigar string, chrom string, start0 long")
    sites = spark.createDataFrame([("1", p) for p in range(11, 28)], "chrom string, pos long")
    got = {(r.cigar, r.pos): (r.kind, r.indel_length, r.read_offset, r.nearest) for r in S.site_calls(reads, sites).collect()}
    far = float("inf")
    assert got["5M2D5M", 15] == ("deletion", -2, 4, far) and got["5M2D5M", 16] == ("unknown", None, None, None)
    assert got["5M2D5M", 18] == ("match", 0, 5, 1.0) and got["3S7M", 11] == ("match", 0, 3, 1.0) and got["3S7M", 14] == ("match", 0, 6, far)
    assert got["4M1I6M2D4M", 14][:3] == ("insertion", 1, 3) and got["6M", 16] == ("match", None, 5, None)


def test_demotion_and_scores(spark):
    rows = spark.createDataFrame([("PASS", 50.0, 2.0), ("PASS", 30.0, None), ("REJECT", 1.0, 9.0), ("PASS", None, 9.0)], "filter string, refMQ double, refNM double")
    assert [r.filter for r in V.demote_pass(rows).collect()] == ["PASS", "LowQual", "REJECT", "LowQual"]
    made = spark.createDataFrame([(0.5,), (0.2,), (0.05,), (None,), (1.0,)], "s double").select(V.classify_score(F.col("s")).alias("c"), V.quality_of_score(F.col("s")).alias("q")).collect()
    assert [tuple(r) for r in made] == [("PASS", 3.0), ("LowQual", 1.0), ("REJECT", 0.2), ("REJECT", 0.0), ("PASS", 255.0)]
