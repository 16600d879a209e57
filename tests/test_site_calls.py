"""Characters of views as compiled expressions; calls at sites without shuffled reads, by every path; phasing by one look at a read."""

from callweave.operators import phasing as P
from callweave.operators import site_calls as S
from callweave.plans import views

READS = "read_id long, qname string, chrom string, start0 long, cigar string, seq string, flag int"


def test_characters(spark):
    text = views._spark("select EACH(4, o -> chr(cast(65 + o * to + x as int))) as s from (select 2 as to, 1 as x)")
    assert "sequence(" not in text
    assert spark.sql(text).first()[0] == "BDFH"


def test_paths(spark):
    cigars = ["10M", "3M2I4D5M", "2S8M1S", "5M3N5M", "2H4M1P3I6M", "4S", None, "1M"]
    reads = spark.createDataFrame([(i, f"q{i}", "c1" if i % 3 else "c2", 120 + i % 5, c, "ACGT" * 4, 0) for i, c in enumerate(cigars * 3)], READS)
    sites = spark.createDataFrame([(c, p) for c in ("c1", "c2") for p in range(118, 145)], "chrom string, pos long")
    shown = lambda *limits: sorted((r.read_id, r.pos, r.kind, str(r.indel_length), str(r.read_offset), str(r.nearest)) for r in S.site_calls(reads, sites, *limits).collect())
    want = shown()
    assert len(want) > 100 and {k for _, _, k, *_ in want} == {"match", "insertion", "deletion", "unknown"}
    assert want == shown(0, 0) == shown(0) == shown(2_000_000, 0)
    plan = S.site_calls(reads, sites)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_phasing_counts_every_read(spark):
    """Reads that agree in name, flag, start and CIGAR are reads all the same."""
    calls = spark.createDataFrame([("c1", 3, "A", "C", "PASS"), ("c1", 4, "A", "G", "PASS")], "chrom string, pos long, ref string, alt string, filter string")
    rows = [(1, "q", "c1", 0, "6M", "AACGAA", 0), (2, "q", "c1", 0, "6M", "AACGAA", 0), (3, "r", "c1", 1, "5M", "AAAAA", 0), (4, "s", "c1", 3, "3M", "GAA", 0), (5, "t", "c1", 0, "3M", "AAC", 0), (6, "u", "c1", 0, "2M2D2M", "AAAA", 0)]
    got = P.phase_variants(calls, spark.createDataFrame(rows, READS)).collect()
    assert [(r.chrom, r.pos, r.ref, r.alt, r.depths) for r in got] == [("c1", 3, "AA", "CG", "1,2")]
