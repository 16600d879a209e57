"""Lines in file order, sequences cut into tiles over several splits, and the order of written records."""

import random

import pytest
from pyspark.sql import functions as F

from callweave.operators.reference import OVERLAP, STEP
from callweave.sources import text


@pytest.fixture
def small_splits(spark):
    named = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "8"}
    for k, x in named.items():
        spark.conf.set(k, x)
    yield spark
    for k in named:
        spark.conf.unset(k)


def wrapped(seq, width):
    return "\n".join(seq[i : i + width] for i in range(0, len(seq), width))


def brute(contigs):
    return sorted((c, t, t * STEP, s[t * STEP : t * STEP + STEP + OVERLAP]) for c, s in contigs if s for t in range((len(s) - 1) // STEP + 1))


@pytest.mark.parametrize("width", [1, 60, 256, 5000, 40_000])
def test_tiles_of_many_splits(small_splits, tmp_path, width):
    r = random.Random(width)
    size = (lambda n: n // 8) if width == 1 else (lambda n: n)
    seq = lambda n: "".join(r.choice("ACGTN") for _ in range(size(n)))
    one = [("c1", seq(30_000)), ("c2", ""), ("c3", seq(STEP * 8)), ("c4", seq(7))]
    two = [("c1", seq(9_000)), ("c5", seq(STEP + OVERLAP + 1))]
    for name, contigs, end in (("a.fa", one, "\n"), ("b.fa", two, "\r\n")):
        lines = "\n".join(f">{c} of a file\n{wrapped(s, width)}" for c, s in contigs)
        (tmp_path / name).write_bytes((("ACGT\n" if name == "b.fa" else "") + lines + "\n\n").replace("\n", end).encode())
    made = text.scan_fasta(small_splits, str(tmp_path))
    assert small_splits.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    assert sorted(map(tuple, made.select("chrom", "tile", "start0", "seq").collect())) == sorted(brute(one) + brute(two))


def test_one_contig_is_read_by_several_tasks(small_splits, tmp_path):
    (tmp_path / "a.fa").write_text(">c\n" + wrapped("ACGT" * 5000, 60))
    lines = text._split_lines(small_splits, str(tmp_path)).withColumn("task", F.spark_partition_id()).where("value not like '>%'")
    assert lines.select("task").distinct().count() > 4
    assert text.scan_fasta(small_splits, str(tmp_path)).count() == 5


def test_lines_are_numbered_over_splits_and_parts(small_splits, tmp_path):
    every = []
    for part in (2, 10, 100_000, 99_999):
        (tmp_path / f"part-{part:05d}-x.txt").write_text("".join(f"{part} {i}\n" for i in range(part % 991 + 700)))
    for part in (2, 10, 99_999, 100_000):
        every += [f"{part} {i}" for i in range(part % 991 + 700)]
    got = text.file_lines(small_splits, str(tmp_path)).collect()
    assert sorted((r.line, r.value) for r in got) == list(enumerate(every))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.txt").write_text("")
    assert text.file_lines(small_splits, str(tmp_path / "empty")).count() == 0
    assert text.scan_fasta(small_splits, str(tmp_path / "empty")).count() == 0


def test_written_records_stand_in_order(small_splits, tmp_path):
    spark = small_splits
    contigs = spark.createDataFrame([("b", 9, 1), ("a", 9, 2)], "chrom string, size long, offset long")
    r = random.Random(5)
    base = [(r.choice("ab"), 7 if r.random() < 0.3 else r.randrange(500), r.choice("ACGT"), r.choice("ACGT")) for _ in range(3000)] + [("z", 1, "A", "C")]
    rows = spark.createDataFrame(base + base[:900], "chrom string, pos long, ref string, alt string")
    text.write_vcf(rows, str(tmp_path / "out"), contigs, ["##fileformat=VCFv4.1", "#CHROM"])
    got = [(x.chrom, x.pos, x.ref, x.alt) for x in sorted(text.record_places(spark, str(tmp_path / "out")).collect(), key=lambda x: x.line)]
    assert got == sorted(set(base), key=lambda x: ({"b": 1, "a": 2}.get(x[0], 3), *x))
    assert text.written_disorder(spark, str(tmp_path / "out"), contigs).first().unknown_contigs == 1
    contigs = contigs.union(spark.createDataFrame([("z", 9, 3)]))
    assert tuple(text.written_disorder(spark, str(tmp_path / "out"), contigs).first()) == (0, 0)
    rows.orderBy(F.desc("pos")).select(text.record_lines(rows).alias("value")).coalesce(1).write.text(str(tmp_path / "bad"))
    assert text.written_disorder(spark, str(tmp_path / "bad"), contigs).first().unsorted > 100
