"""Tiles of sites against read-site pairs: small batches, dealt tiles, mates over batch edges, odd reads."""

import random
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from callweave.operators import evidence as V
from callweave.operators import site_tiles as S
from callweave.operators.ensemble import KEY

READ = "qname string, chrom string, start0 long, cigar string, seq string, quals string, mapq int, flag int, nm int, sample string"


def tables(spark):
    r = random.Random(6)
    reads = []
    for i in range(160):
        ops = [(r.randrange(1, 12), c) for c in r.choice(["M", "SM", "MIM", "MDM", "HMS", "M=XM", "MNM", "SMIDMS", "MIIM", "IM", "PMD", "M"])]
        n = sum(k for k, c in ops if c in "MIS=X")
        seq = "".join(r.choice("ACGT") for _ in range(n))
        quals = "".join(chr(33 + r.randrange(41)) for _ in range(n))
        name = r.choice([f"q{i // 2}", f"q{r.randrange(20)}", "same", None])
        reads.append((name, r.choice("12"), r.randrange(60), "".join(f"{k}{c}" for k, c in ops), r.choice([seq] * 9 + [None]), r.choice([quals] * 9 + [None]), r.choice([0, 1, 37, 60]), r.choice([0, 2, 16, 18, 4, 1024, 99]), r.choice([0, 3, None]), r.choice("tn")))
    reads.append(("none", "1", 5, None, "A", "I", 60, 0, 0, "t"))
    sites = [(r.choice("123"), r.randrange(1, 90), x, y) for _ in range(150) for x, y in [r.choice([("A", "C"), ("G", "T"), ("AT", "A"), ("C", "CGG"), ("ACG", "A"), ("AC", "GT"), ("T", "T")])]]
    return spark.createDataFrame(reads, READ), spark.createDataFrame([*sites, *sites[:5], ("1", None, "A", "C")], "chrom string, pos long, ref string, alt string")


@pytest.mark.parametrize(("tile", "part", "batch"), [(1 << 13, 10**6, 10_000), (16, 5, 3), (7, 2, 1), (64, 40, 9)])
def test_tiles(spark, monkeypatch, tile, part, batch):
    reads, variants = tables(spark)
    monkeypatch.setattr(V, "streams", partial(S.streams, tile=tile, reads_per_part=part))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = V.site_read_features(reads, variants).toPandas()
        shares = V.vaf_from_reads(reads, variants.distinct()).toPandas()
        by = V.vaf_by_sample(reads, variants).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    met = V.read_classes(reads, variants).toPandas()
    key = lambda f: f[KEY].apply(tuple, axis=1)
    found = {k: f for k, f in met.groupby(key(met))}
    assert len(got) == len(variants.distinct().collect()) == len(shares)
    for row in got.itertuples():
        f = found.get((row.chrom, row.pos, row.ref, row.alt), met.iloc[:0])
        ok = (f.mapq >= 1) & (f.bq >= 5)
        assert (row.dp, row.mq0_reads, row.noise_read_count) == (len(f), (f.mapq == 0).sum(), (f.cls == 2).sum())
        for side, k in (("ref", 0), ("alt", 1)):
            own = f[f.cls == k]
            assert getattr(row, f"{side}_call_reverse") == (ok & (f.cls == k) & (f.flag & 16 != 0)).sum()
            assert getattr(row, f"{side}_discordant_reads") == (ok & (f.cls == k) & (f.flag & 2 == 0)).sum()
            assert [getattr(row, f"{side}_indel_{d}bp") for d in (1, 2, 3)] == [(own.nearest <= d).sum() for d in (1, 2, 3)]
            for name, column in (("mq", "mapq"), ("bq", "bq"), ("edit_distance", "nm")):
                want, have = own[column].mean(), getattr(row, f"{side}_{name}")
                assert (pd.isna(want) and pd.isna(have)) or have == pytest.approx(want)
        mates = f.fillna({"qname": "?"}).groupby("qname").cls.apply(list)
        assert row.consistent_mates == sum(m == [1, 1] for m in mates)
        assert row.inconsistent_mates == sum(len(m) == 2 and m.count(1) == 1 for m in mates)
    met = met[met.mapq >= 1]
    counted = {k: (sum(f.cls == 1), len(f)) for k, f in met.groupby(key(met))}
    assert all((r.var_reads, r.depth) == counted.get((r.chrom, r.pos, r.ref, r.alt), (0, 0)) for r in shares.itertuples())
    assert sorted(((r.chrom, r.pos, r.ref, r.alt, r.sample), (r.var_reads, r.depth)) for r in by.itertuples()) == sorted((k, (sum(f.cls == 1), len(f))) for k, f in met.groupby(met[[*KEY, "sample"]].apply(tuple, axis=1)))


def test_rows_follow_reads(spark):
    """What is shuffled by tile are the reads and one row a tile, however many sites a read spans."""
    reads = spark.createDataFrame([(f"q{i}", "1", i, "50M", "A" * 50, "I" * 50, 60, 0, 0, "t") for i in range(100)], READ)
    variants = spark.createDataFrame([("1", p, "A", b) for p in range(1, 151) for b in "CGT"], "chrom string, pos long, ref string, alt string")
    assert S.streams(reads, variants).count() == 101
    partial_rows = S.by_site(S.streams(reads, variants), S.counts, "var_reads long, ref_reads long, other_reads long, depth long")
    assert partial_rows.count() == 149 * 3
    assert S.streams(reads, variants.limit(0)).count() == 0


def test_batches_of_a_tile_leave_it_merged(spark):
    """However many batches the reads of a tile come in, each site is one row, with the distinct values of all of them."""
    reads = spark.createDataFrame([(f"q{i}", "1", i % 7, "30M", "A" * 30, "I" * 30, i % 3, 0, 0, "t") for i in range(60)], READ)
    variants = spark.createDataFrame([("1", p, "A", "C") for p in (10, 11, 20)], "chrom string, pos long, ref string, alt string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = S.by_site(S.streams(reads, variants), V._site_sums(1, 5), V._SITE_ROW).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.pos, r.dp, [tuple(x) for x in r["__mq"]]) for r in got) == [(p, 60, [(k, 0, 20) for k in range(3)]) for p in (10, 11, 20)]


def test_merged_and_pieces(monkeypatch):
    r = random.Random(3)
    for wide in (4, 1 << 62):
        parts, want = [], {}
        for _ in range(5):
            sites = sorted(r.sample(range(6), r.randrange(1, 6)))
            lists = [[{"v": r.randrange(-wide, wide), "x": r.randrange(3), "y": 1} for _ in range(r.randrange(4))] for _ in sites]
            parts.append((np.array(sites), [pa.array([s + 1 for s in sites]), pa.array(lists, pa.list_(pa.struct([(c, pa.int64()) for c in "vxy"])))]))
            for s, entries in zip(sites, lists, strict=True):
                n, held = want.setdefault(s, [0, {}])
                want[s][0] = n + s + 1
                for e in entries:
                    x, y = held.get(e["v"], (0, 0))
                    held[e["v"]] = (x + e["x"], y + e["y"])
        sites, (n, lists) = S.merged(parts)
        assert {s: [k, {e["v"]: (e["x"], e["y"]) for e in x}] for s, k, x in zip(sites.tolist(), n.to_pylist(), lists.to_pylist(), strict=True)} == want
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 30), pa.array([r.randrange(40) for _ in range(30)])], ["start0", "end0"])
    tables = [("1", np.arange(1, n)) for n in (30, 2, 2, 3)]
    found = [(tables[0], 0, 12), (tables[1], 12, 14), (tables[2], 14, 16), (tables[3], 16, 30)]
    groups = S._pieces(batch, found)
    assert len(groups) > 4 and sorted((id(t), i) for g in groups for t, a, b in g for i in range(a, b)) == sorted((id(t), i) for t, a, b in found for i in range(a, b))
