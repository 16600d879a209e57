"""Steps whose work grows with the depth of reads: texts of reads, exact tests, reads of both kinds of variants."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from callweave.functions.count_tests import table_tails
from callweave.operators import features as W
from callweave.operators.evidence import _site_sums
from callweave.operators.site_tiles import Pairs, allele_numbers
from callweave.plans import registry
from callweave.plans.views import view

SF = "/root/testdata/sf0.001"


def test_texts_of_reads_are_cut_out_of_lines_and_equal_their_letters(spark, tmp_path):
    ids = [*range(0, 4000, 7), *range(10**9, 10**9 + 200), -3]
    pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64())}), tmp_path / "events.parquet")
    rows = view(spark, str(tmp_path), "reads_v")
    for r in rows.where("read_id >= 0").select("read_id", "start0", "chrom", "seq", "quals").collect():
        e, c = r.read_id, int(r.chrom[3:])
        letter = lambda o: "ACGT"[(((r.start0 + 1 + o) * 7919 + c * 104729) % 10007 % 4 + ((e + o) % 23 == 0)) % 4]  # noqa: B023, E731
        assert r.seq == "".join(letter(o) for o in range(100))
        assert r.quals == "".join(chr(35 + (e + o) % 40) for o in range(100))
    assert rows.where("read_id < 0").first().quals == "".join(chr(35 + int(math.fmod(o - 3, 40))) for o in range(100))


def test_deep_tables_are_weighed_as_arrays():
    rng = np.random.default_rng(1)
    tables = np.concatenate([rng.integers(0, 12, (200, 4)), rng.integers(0, 900, (40, 4)), np.zeros((1, 4), np.int64)])
    for greater in (False, True):
        got = table_tails(*tables.T, greater)
        for (a, b, c, d), p in zip(tables.tolist(), got, strict=True):
            row, col, first = a + b, a + c, max(0, a - d)
            weights = [0.0]
            for k in range(first, min(row, col)):
                weights.append(weights[-1] + math.log((row - k) * (col - k) / ((k + 1) * (d - a + k + 1))))
            mass = [math.exp(w - max(weights)) for w in weights]
            chosen = [m for k, (m, w) in enumerate(zip(mass, weights, strict=True), first) if (k >= a if greater else w <= weights[a - first] + 1e-7)]
            assert abs(p - min(1, sum(chosen) / sum(mass))) < 1e-12


def test_mates_of_a_name_are_met_where_both_lie():
    """Names with one, two and three reads, and open ones at the ends, against plain counting."""
    starts = [0, 3, 5, 0, 2, 4, 1, 0, 6, 2]
    names = [1, 2, 2, 3, 3, 3, 4, 5, 5, 6]
    n = len(names)
    rows = pa.RecordBatch.from_pydict({
        "name": pa.array(names, pa.int64()), "start0": pa.array(starts, pa.int64()), "end0": pa.array([s + 10 for s in starts], pa.int64()), "cigar": ["10M"] * n,
        "seq": ["ACGTACGTAC"[i % 3 :] + "ACG"[: i % 3] for i in range(n)], "quals": ["I" * 10] * n, "mapq": pa.array([30] * n, pa.int32()), "flag": pa.array([3] * n, pa.int32()), "nm": pa.array([0] * n, pa.int32()),
    })
    pos, ref, alt = np.arange(1, 17), pa.array(["A"] * 16), pa.array(["C"] * 16)
    pairs = Pairs(rows, [("chr1", pos, ref, alt, pa.int64(), allele_numbers(ref, alt))], np.array([0]))
    sites, made = _site_sums(1, 5)(pairs, rows)
    for k, site in enumerate(sites.tolist()):
        said = {}
        for r, s, cls in zip(pairs.read.tolist(), pairs.site.tolist(), pairs.cls.tolist(), strict=True):
            if s == site and names[r] not in (1, 6):
                said.setdefault(names[r], []).append(cls == 1)
        two = [sum(x) for x in said.values() if len(x) == 2]
        assert (made[-6][k].as_py(), made[-5][k].as_py()) == (two.count(2), two.count(1))


def test_reads_are_read_once_for_both_kinds(spark, monkeypatch):
    calls = []
    made = W.site_read_features
    monkeypatch.setattr(W, "site_read_features", lambda *a: calls.append(a) or made(*a))
    kinds = registry.QUERIES["run_single"](spark, SF).groupBy("kind").count().collect()
    assert {r.kind for r in kinds} == {"snv", "indel"} and len(calls) == 1
