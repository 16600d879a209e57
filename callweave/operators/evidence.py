"""What the reads of a sample say for and against variants: read classes, counts, quality tests, allele fractions.

Reads have chrom, start0, cigar, seq, quals (Phred + 33 text, or null), mapq, flag and nm; variants have chrom, pos, ref
and alt.  A read over a site is a reference read (class 0) if it matches the first reference base, an alternative read
(1) if it has the variant's base, its deletion's length or any insertion, and another one (2) otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.count_tests import fisher_exact, p_less
from callweave.operators.ensemble import KEY
from callweave.operators.reads import drop_duplicate_reads
from callweave.operators.site_calls import site_calls
from callweave.operators.site_tiles import Pairs, by_site, counts, streams
from callweave.storage import settle

#: Values of a read that the rank tests compare.
RANKED = ("mq", "bq", "endpos")


def read_classes(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """Mapped, not duplicate reads at the variants that they span, with ``cls`` 0, 1 or 2, ``base`` and ``bq`` at the site."""
    kept = drop_duplicate_reads(reads.where(F.col("flag").bitwiseAND(4) == 0))
    met = site_calls(kept, variants.select(*KEY).distinct())
    offset = F.col("read_offset").cast("int")
    met = met.withColumns({"base": F.substr(F.col("seq"), offset + 1, F.lit(1)), "bq": F.ascii(F.substr(F.col("quals"), offset + 1, F.lit(1))) - 33})
    size, match = F.length("alt") - F.length("ref"), F.col("kind") == "match"
    alt = ((size == 0) & match & (F.col("base") == F.col("alt"))) | ((size < 0) & (F.col("kind") == "deletion") & (F.col("indel_length") == size)) | ((size > 0) & (F.col("kind") == "insertion"))
    cls = F.when(match & (F.col("base") == F.left("ref", F.lit(1))), 0).when(alt, 1).otherwise(2)
    return met.withColumn("cls", cls)


#: Sums of one read at one site, by name; what a task adds up of them leaves it as one row a site.
_PAIRED = ("n", "nm_n", "bq_n", "mq", "bq", "nm", "unclipped")


def _read_sums(pairs: Pairs, rows: pa.RecordBatch, min_mq: int, min_bq: int) -> dict[str, np.ndarray]:
    """By site, what its reads add to the counts."""
    ok = pairs.has_mapq & (pairs.mapq >= min_mq) & pairs.has_bq & (pairs.bq >= min_bq)
    quals = rows.column("quals").cast(pa.large_string()).fill_null("")
    _, offsets, data = quals.buffers()
    at = np.frombuffer(offsets, np.int64)[quals.offset : quals.offset + len(quals) + 1]
    own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)  # the buffer may be that of the whole batch
    at = at - at[0]
    total = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
    n = np.diff(at)
    poor = (n > 0) & (total[at[1:]] - total[at[:-1]] - 33 * n < min_bq * n)
    has_flag = lambda bit: pairs.flag & bit != 0
    made = {"dp": np.ones(len(pairs.read), bool), "mq0_reads": pairs.has_mapq & (pairs.mapq == 0), "noise_read_count": pairs.cls == 2}
    made["poor_read_count"] = pairs.has_mapq & (pairs.mapq < min_mq) & poor[pairs.read]
    made = {k: pairs.sums(v) for k, v in made.items()}
    for side, k in (("ref", 0), ("alt", 1)):
        own = pairs.cls == k
        flags = {
            f"{side}_concordant_reads": ok & has_flag(2), f"{side}_discordant_reads": ok & ~has_flag(2), f"{side}_call_forward": ok & ~has_flag(16), f"{side}_call_reverse": ok & has_flag(16),
            f"{side}_soft_clipped_reads": pairs.clipped, f"__{side}_unclipped": ~pairs.clipped, **{f"{side}_indel_{d}bp": pairs.near <= d for d in (1, 2, 3)},
            f"__{side}_n": own, f"__{side}_nm_n": pairs.has_nm, f"__{side}_bq_n": pairs.has_bq,
        }
        made |= {name: pairs.sums(own & f) for name, f in flags.items()}
        made |= {f"__{side}_{name}": pairs.sums(own & known, x) for name, x, known in (("mq", pairs.mapq, pairs.has_mapq), ("bq", pairs.bq, pairs.has_bq), ("nm", pairs.nm, pairs.has_nm))}
    return made


def _mates(pairs: Pairs, rows: pa.RecordBatch, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """By site, pairs of reads of one name that agree on the variant or don't; names at the ends of the batch's tiles are left open.

    Reads come sorted by name, so all reads of another name are in the batch.
    """
    name = rows.column("name").to_numpy(zero_copy_only=False)
    new = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else np.zeros(0, bool)
    new[first[first < len(new)]] = True
    run = np.cumsum(new) - 1
    ends = np.append(first[1:], len(name))
    open_runs = np.unique(np.concatenate([run[first[first < ends]], run[ends[first < ends] - 1]]))
    # two reads of a name meet at the sites that both span, which lie side by side; only other names are looked up pair by pair
    of_run = np.bincount(run) if len(run) else np.zeros(0, np.int64)
    plain = of_run == 2
    plain[open_runs] = False
    one = np.flatnonzero(plain[run] & new)
    low, high = np.maximum(pairs.lo[one], pairs.lo[one + 1]), np.minimum(pairs.lo[one] + pairs.n_sites[one], pairs.lo[one + 1] + pairs.n_sites[one + 1])
    n = np.maximum(high - low, 0)
    met = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    x = sum((pairs.cls[np.repeat(pairs.pair_at[k] - pairs.lo[k], n) + met] == 1).astype(np.int64) for k in (one, one + 1))
    agree, differ = (np.bincount(met[x == k], minlength=pairs.site_n) for k in (2, 1))
    rest = np.flatnonzero(~plain[run][pairs.read])
    key, at = np.unique(pairs.site[rest] * (len(name) + 1) + run[pairs.read[rest]], return_inverse=True)
    n, x = np.bincount(at, minlength=len(key)), np.bincount(at, pairs.cls[rest] == 1, len(key)).astype(np.int64)
    site, of = key // (len(name) + 1), key % (len(name) + 1)
    is_open = np.isin(of, open_runs)
    agree, differ = (had + np.bincount(site[~is_open & (n == 2) & (x == k)], minlength=pairs.site_n) for had, k in ((agree, 2), (differ, 1)))
    named = name[np.flatnonzero(new)]
    left = pa.StructArray.from_arrays([pa.array(named[of[is_open]]), pa.array(n[is_open]), pa.array(x[is_open])], ["h", "n", "x"])
    return agree, differ, pa.ListArray.from_arrays(np.searchsorted(site[is_open], np.arange(pairs.site_n + 1)).astype(np.int32), left)


def _site_sums(min_mq: int, min_bq: int):
    def reduce(pairs: Pairs, rows: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        made = _read_sums(pairs, rows, min_mq, min_bq)
        sites = np.flatnonzero(made["dp"])
        agree, differ, left = _mates(pairs, rows, pairs.first_read)
        has_seq = rows.column("seq").is_valid().to_numpy(zero_copy_only=False)[pairs.read]
        from_end = np.where(has_seq, np.minimum(pairs.offset, pairs.seq_n[pairs.read] - pairs.offset), pairs.offset)
        values = [pairs.histogram(*x) for x in ((pairs.mapq, pairs.has_mapq), (pairs.bq, pairs.has_bq), (from_end, pairs.offset >= 0))]
        lists = [pa.ListArray.from_arrays(np.append(at[sites], at[-1]).astype(np.int32), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["v", "x", "y"])) for at, columns in values]
        return sites, [*(pa.array(made[c][sites]) for c in SUMMED), pa.array(agree[sites]), pa.array(differ[sites]), left.take(pa.array(sites)), *lists]

    return reduce


_SIDES = [n for s in ("ref", "alt") for n in (
    f"{s}_concordant_reads", f"{s}_discordant_reads", f"{s}_call_forward", f"{s}_call_reverse", f"{s}_soft_clipped_reads", *(f"{s}_indel_{d}bp" for d in (1, 2, 3)), *(f"__{s}_{p}" for p in _PAIRED),
)]
#: Counts that are summed over the reads of a site.
SUMMED = ["dp", "mq0_reads", "noise_read_count", "poor_read_count", *_SIDES]
_SITE_ROW = ", ".join([*(f"{c} long" for c in (*SUMMED, "consistent_mates", "inconsistent_mates")), "__open array<struct<h:long,n:long,x:long>>", *(f"__{m} array<struct<v:long,x:long,y:long>>" for m in RANKED)])

#: Reads of open names, gathered from batches: how many names have two reads that both, or one of them only, show the variant.
_OPEN = """aggregate(array_sort(__open), named_struct('h', cast(null as long), 'n', 0L, 'x', 0L, 'c', 0L, 'i', 0L),
  (a, e) -> if(a.h = e.h, named_struct('h', a.h, 'n', a.n + e.n, 'x', a.x + e.x, 'c', a.c, 'i', a.i),
   named_struct('h', e.h, 'n', e.n, 'x', e.x, 'c', a.c + if(a.n = 2 and a.x = 2, 1L, 0L), 'i', a.i + if(a.n = 2 and a.x = 1, 1L, 0L))),
  a -> named_struct('c', a.c + if(a.n = 2 and a.x = 2, 1L, 0L), 'i', a.i + if(a.n = 2 and a.x = 1, 1L, 0L)))"""


def _rank_statistics(histogram: str) -> Column:
    """Sizes, U and ties out of an array of (value, alternative reads, reference reads), where a value may come more than once."""
    closed = lambda a: (
        "'n', {a}.n + {a}.x, 'm', {a}.m + {a}.y, 'u', {a}.u + {a}.x * ({a}.m + {a}.y / 2), 'ties', {a}.ties + ({a}.x + {a}.y) * ({a}.x + {a}.y) * ({a}.x + {a}.y) - ({a}.x + {a}.y)".format(a=a)
    )
    kept = "'n', a.n, 'm', a.m, 'u', a.u, 'ties', a.ties"
    return F.expr(f"""aggregate(array_sort({histogram}), named_struct('v', cast(null as long), 'x', 0D, 'y', 0D, 'n', 0D, 'm', 0D, 'u', 0D, 'ties', 0D),
      (a, e) -> if(a.v = e.v, named_struct('v', a.v, 'x', a.x + e.x, 'y', a.y + e.y, {kept}), named_struct('v', e.v, 'x', cast(e.x as double), 'y', cast(e.y as double), {closed('a')})),
      a -> named_struct({closed('a')}))""")


def _p_less(histogram: str) -> Column:
    s = _rank_statistics(histogram)
    n, m = s["n"], s["m"]
    spread = F.sqrt(n * m / 12 * (n + m + 1 - F.try_divide(s["ties"], (n + m) * (n + m - 1))))
    return p_less(n.cast("long"), m.cast("long"), s["u"], F.try_divide(n * m / 2 - s["u"] - 0.5, spread), s["ties"] > 0)


def _fair(reads: DataFrame) -> DataFrame:
    return drop_duplicate_reads(reads.where(F.col("flag").bitwiseAND(4) == 0))


def site_read_features(reads: DataFrame, variants: DataFrame, min_mq: int = 1, min_bq: int = 5) -> DataFrame:
    """For each variant the counts, means and tests over the reads of a sample; zeros and nulls without reads.

    Reads stream past the sites of their tile; sums and value counts of a batch leave it as one row a site, and one aggregation
    by variant joins these.  What a site gathers is bounded by its distinct values, and by two open names for each batch.
    """
    keys = settle(variants.select(*KEY).distinct())
    partial = by_site(streams(_fair(reads), keys), _site_sums(min_mq, min_bq), _SITE_ROW)
    sums = [F.sum(c).alias(c) for c in (*SUMMED, "consistent_mates", "inconsistent_mates")]
    by = partial.groupBy(*KEY).agg(*sums, *[F.flatten(F.collect_list(c)).alias(c) for c in ("__open", *(f"__{m}" for m in RANKED))])
    by = by.withColumn("__open", F.expr(_OPEN)).withColumns({"consistent_mates": F.col("consistent_mates") + F.col("__open.c"), "inconsistent_mates": F.col("inconsistent_mates") + F.col("__open.i")})
    out = keys.join(by, KEY, "left").na.fill(0, [*SUMMED, "consistent_mates", "inconsistent_mates"])
    means = {f"{s}_{name}": F.try_divide(F.col(f"__{s}_{c}"), F.col(f"__{s}_{n}")) for s in ("ref", "alt") for name, c, n in (("mq", "mq", "n"), ("bq", "bq", "bq_n"), ("edit_distance", "nm", "nm_n"))}
    out = out.withColumns(means).withColumn("indel_length", F.length("alt") - F.length("ref"))
    test = lambda a, b, c, d: fisher_exact(F.col(a), F.col(b), F.col(c), F.col(d))
    out = out.withColumns({
        "edit_distance_difference": F.col("alt_edit_distance") - F.col("ref_edit_distance") - F.abs("indel_length"),
        "concordance_fet": test("ref_concordant_reads", "alt_concordant_reads", "ref_discordant_reads", "alt_discordant_reads"),
        "strandbias_fet": test("ref_call_forward", "alt_call_forward", "ref_call_reverse", "alt_call_reverse"),
        "clipping_fet": test("__ref_unclipped", "__alt_unclipped", "ref_soft_clipped_reads", "alt_soft_clipped_reads"),
        **{f"p_mannwhitneyu_{m}": _p_less(f"__{m}") for m in RANKED},
    })
    return out.select(*KEY, *[c for c in out.columns if not c.startswith("__") and c not in KEY])


def _counted(reads: DataFrame, variants: DataFrame, min_mq: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Variant, reference, other and all reads by variant and ``by``."""
    partial = by_site(streams(_fair(reads.where(F.col("mapq") >= min_mq)), settle(variants.select(*KEY).distinct()), by), counts, "var_reads long, ref_reads long, other_reads long, depth long", by)
    return partial.groupBy(*KEY, *by).agg(*[F.sum(c).alias(c) for c in ("var_reads", "ref_reads", "other_reads", "depth")])


def vaf_from_reads(reads: DataFrame, variants: DataFrame, min_mq: int = 1) -> DataFrame:
    """Reads for the variant, the reference and neither, their total and the variant's share (null without reads)."""
    out = variants.join(_counted(reads, variants, min_mq), KEY, "left").na.fill(0, ["var_reads", "ref_reads", "other_reads", "depth"])
    return out.withColumn("vaf", F.try_divide("var_reads", "depth"))


def vaf_by_sample(reads: DataFrame, calls: DataFrame, min_mq: int = 1) -> DataFrame:
    """Variant reads and depth of every variant in every sample of ``reads`` that covers it."""
    return _counted(reads, calls, min_mq, ("sample",)).select(*KEY, "sample", "var_reads", "depth")
