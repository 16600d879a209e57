"""Cases with given results: calls of reads at sites, regions, splits, and what SQL twins can't show."""

import math

import pytest
from pyspark.sql import functions as F

from callweave.functions import count_tests as T
from callweave.functions import expressions as X
from callweave.operators import evidence as V
from callweave.operators import intervals as I
from callweave.operators import models as M
from callweave.operators import phasing as P
from callweave.operators import site_calls as S
from callweave.operators import summaries as G
from callweave.sources import text

FAR = float("inf")


def calls(spark, cigar, start0, first, last):
    reads = spark.createDataFrame([("1", start0, cigar)], "chrom string, start0 long, cigar string")
    sites = spark.createDataFrame([("1", c + 1) for c in range(first, last)], "chrom string, pos long")
    return {r.pos - 1: (r.kind, r.indel_length, r.nearest) for r in S.site_calls(reads, sites).collect()}


def test_a_long_alignment(spark):
    got = calls(spark, "100M10D10M10I10M5I5M5D5M5S", 100, 0, 300)
    want = {}
    for c in [*range(100, 196), *range(213, 216), *range(223, 226)]:
        want[c] = ("match", 0, FAR)
    want |= {c: ("match", 0, 199.0 - c) for c in range(196, 199)}
    want |= {c: ("unknown", None, None) for c in range(200, 210)}
    want |= {c: ("match", 0, c - 209.0) for c in range(210, 213)} | {c: ("match", 0, 219.0 - c) for c in range(216, 219)}
    assert {c: got[c] for c in want} == want
    assert (got[199][:2], got[219][:2], got[229][:2], got[234][:2]) == (("deletion", -10), ("insertion", 10), ("insertion", 5), ("deletion", -5))
    assert min(got) == 100 and max(got) == 244


@pytest.mark.parametrize("cigar", ["1I6M", "1S6M"])
def test_leading_insertion(spark, cigar):
    got = calls(spark, cigar, 1000, 1000, 1004)
    assert [got[c][2] for c in (1000, 1001, 1002)] == [1.0, 2.0, 3.0]


def test_padding(spark):
    got = calls(spark, "3M1P3M", 1000, 1000, 1006)
    assert all(v[0] == "match" for v in got.values()) and all(got[c][1] == 0 for c in range(1000, 1005)) and got[1005][1] is None


def test_include_and_exclude(spark):
    positions = spark.createDataFrame([("1", p, "A", "C") for p in range(1, 100)] + [("1", 25, "A", None), (None, 25, "A", "C")], "chrom string, pos long, ref string, alt string")
    region = lambda *rows: spark.createDataFrame([("1", *r) for r in rows], "chrom string, start0 long, end0 long")
    got = I.intersect_regions(positions, region((20, 40), (60, 80)), region((30, 70)))
    assert sorted(r.pos for r in got.collect()) == sorted([*range(21, 31), *range(71, 81), 25])
    assert I.include_regions(positions, region((0, 1 << 30))).count() == 100
    assert I.exclude_regions(positions, region((5, 5))).count() == 101


@pytest.mark.parametrize("regions, want", [
    ([("chr1", 0, 100)], {(1, "chr1", 0, 34), (2, "chr1", 34, 68), (3, "chr1", 68, 100)}),
    ([("chr1", 0, 90), ("chr2", 0, 10)], {(1, "chr1", 0, 34), (2, "chr1", 34, 68), (3, "chr1", 68, 90), (3, "chr2", 0, 10)}),
])
def test_equal_split(spark, regions, want):
    rows = spark.createDataFrame(regions, "chrom string, start0 long, end0 long")
    assert {tuple(r) for r in I.split_equal_bp(rows, 3).collect()} == want


def test_split_in_contig_order(spark):
    rows = spark.createDataFrame([("chr10", 0, 10), ("chr2", 0, 10)], "chrom string, start0 long, end0 long")
    contigs = spark.createDataFrame([("chr2", 0), ("chr10", 1)], "chrom string, offset long")
    assert {(r.shard, r.chrom) for r in I.split_equal_bp(rows, 2, contigs).collect()} == {(1, "chr2"), (2, "chr10")}
    assert {(r.shard, r.chrom) for r in I.split_equal_bp(rows, 2).collect()} == {(1, "chr10"), (2, "chr2")}


def test_complex_split(spark):
    rows = [(10, "A", "C"), (10, "ATGAG", "A"), (11, "T", "A,TC"), (12, "GAGGTCAGGA", "AAAA"), (14, "GGTC", "AAAAAA")]
    got = X.split_variants(spark.createDataFrame(rows, "pos long, ref string, alt string")).collect()
    snvs = {(10, "A", "C"), (11, "T", "A"), (12, "G", "A"), (14, "G", "A"), (15, "G", "A"), (16, "T", "A"), (17, "C", "A")}
    indels = {(10, "ATGAG", "A"), (11, "T", "TC"), (15, "GTCAGGA", "G"), (17, "C", "CAA")}
    assert {tuple(r)[:3] for r in got if r.kind == "snv"} == snvs and {tuple(r)[:3] for r in got if r.kind == "indel"} == indels


def test_run_lengths(spark):
    assert spark.createDataFrame([("ABBCCCDDDDAAAAAAA",)], "s string").select(X.run_lengths("s")).first()[0] == [1, 2, 3, 4, 7]


def test_general_numbers(spark):
    numbers = [0.0, 1.0, -2.5, 0.1 + 0.2, 1e-5, 123456.5, 999999.5, 1234567.0, 33.03125, 1 / 3, 1e15, 0.00012345678, None, 100.0]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").select("i", X.general(F.col("x")).alias("g"), X.general(F.col("x"), 3).alias("s")).orderBy("i").collect()
    assert [r.g for r in rows] == [None if x is None else "%g" % x for x in numbers]
    assert [r.s for r in rows] == [None if x is None else "%.3g" % x for x in numbers]


def test_rank_tests_of_sites(spark):
    """The tests over histograms give what the tests over rows give."""
    base = [("q%d" % i, "1", 90, "20M", "A" * 10 + ("C" if i % 3 else "A") + "A" * 9, "".join(chr(33 + (i * 7 + k) % 40) for k in range(20)), (i * 11) % 61, 0 if i % 4 else 16, 1) for i in range(40)]
    reads = spark.createDataFrame(base, "qname string, chrom string, start0 long, cigar string, seq string, quals string, mapq int, flag int, nm int")
    variants = spark.createDataFrame([("1", 101, "A", "C"), ("1", 500, "A", "C")], "chrom string, pos long, ref string, alt string")
    got = {r.pos: r for r in V.site_read_features(reads, variants).collect()}
    assert got[500].dp == 0 and got[500].p_mannwhitneyu_mq is None and got[500].strandbias_fet == 1.0 and got[101].dp == 40
    met = V.read_classes(reads, variants).withColumn("is_alt", F.col("cls") == 1)
    for value, name in (("mapq", "mq"), ("bq", "bq")):
        want = T.mann_whitney_less(met, ["pos"], value, "is_alt").first().p
        assert got[101][f"p_mannwhitneyu_{name}"] == pytest.approx(want) and 0 < want < 1
    assert got[101].p_mannwhitneyu_endpos == pytest.approx(0.5)
    assert got[101].alt_mq == pytest.approx(sum(r[6] for r in base if int(r[0][1:]) % 3) / sum(1 for r in base if int(r[0][1:]) % 3))
    assert math.isclose(got[101].edit_distance_difference, 0.0)


def test_phased_pair(spark):
    reads = spark.createDataFrame([(f"q{i}", "1", 0, "6M", s, 0) for i, s in enumerate(["AACGAA"] * 3 + ["AATTAA"] * 2 + ["AATGAA"])], "qname string, chrom string, start0 long, cigar string, seq string, flag int")
    rows = spark.createDataFrame([("1", 3, "C", "T", "PASS"), ("1", 4, "G", "T", "LowQual"), ("1", 9, "A", "C", "PASS")], "chrom string, pos long, ref string, alt string, filter string")
    got = P.phase_variants(rows, reads).collect()
    assert [tuple(r) for r in got] == [("1", 3, "CG", "TG,TT", "PASS", "3,1,2")]


def test_trees(spark, tmp_path):
    rows = [("1", i, "A", "C" if i % 2 else "G", float(i % 10), None if i % 7 == 0 else float(i), int(i % 10 > 4)) for i in range(200)]
    table = spark.createDataFrame(rows, "CHROM string, POS long, REF string, ALT string, x double, y double, TrueVariant_or_False int")
    model = M.train_classifier([table], rounds=4, depth=3)
    whole = {r.POS: r.SCORE for r in model.predict(table, None).collect()}
    assert all((s > 0.5) == (p % 10 > 4) for p, s in whole.items())
    assert {r.POS: r.SCORE for r in model.predict(table, 4).collect()} == pytest.approx(whole)
    fewer = {r.POS: r.SCORE for r in model.predict(table, 1).collect()}
    assert any(abs(fewer[p] - whole[p]) > 1e-3 for p in whole) and all((s > 0.5) == (p % 10 > 4) for p, s in fewer.items())
    assert model.importance().orderBy(F.desc("GAIN")).first().FEATURE == "x"
    model.save(str(tmp_path / "m"))
    again = M.TreeClassifier.load(str(tmp_path / "m"))
    assert {r.POS: r.SCORE for r in again.predict(table, 1).collect()} == pytest.approx(fewer)
    assert M.score_metrics(model.predict(table)).first().f1 == 1.0
    assert M.feature_columns(table, ("y",)) == ["x"]
    with pytest.raises(ValueError):
        M.train_classifier([table.where("TrueVariant_or_False = 1")])


def test_order_and_header(spark):
    contigs = spark.createDataFrame([("a", 0), ("b", 1)], "chrom string, offset long")
    rows = spark.createDataFrame([("a", 1, 0), ("a", 5, 1), ("b", 2, 2)], "chrom string, pos long, line long")
    G.assert_sorted(rows, contigs)
    with pytest.raises(ValueError):
        G.assert_sorted(rows.withColumn("pos", F.lit(9) - F.col("pos")), contigs)
    header = text.vcf_header({"INFO:X": ("INFO", "1", "Float", "x")}, {}, ["S"], ["##source=s", "##INFO=<ID=X,Number=0>"], ("X",))
    assert header == ["##fileformat=VCFv4.1", "##source=s", '##INFO=<ID=X,Number=1,Type=Float,Description="x">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS"]


def test_dictionary_of_contigs(spark, tmp_path):
    (tmp_path / "r.dict").write_text("@HD\tVN:1.6\n@SQ\tSN:2 x\tLN:100\tM5:q\n@SQ\tSN:1\tLN:50\n")
    assert [tuple(r) for r in text.scan_contigs(spark, str(tmp_path / "r.dict")).orderBy("offset").collect()] == [("2", 100, 0), ("1", 50, 100)]
