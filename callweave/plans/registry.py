"""Queries over call sets, regions and sequences, and their SQL twins; all queries of the library are in ``QUERIES``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import expressions as X
from callweave.functions import substrings as U
from callweave.operators import ensemble as E
from callweave.operators import intervals as I
from callweave.operators import pileup as P
from callweave.operators import verdicts as V
from callweave.plans.register import ORACLES, QUERIES, query

CALLERS = [f"c{i}" for i in range(1, 8)]


VOTES = """select chrom, pos, ref, alt, sum(v) as votes, sum(case when v = 1 then 1 else 0 end) as num_tools, count(*) as n_callers
 from (select chrom, pos, ref, alt, caller, max(case filter when 'REJECT' then 0.0 when 'LowQual' then 0.5 else 1.0 end) as v from calls_v group by all) group by chrom, pos, ref, alt"""
LABELLED = f"""select v.*, case when t.pos is null then 0 else 1 end as is_true,
 case when num_tools > 3.5 then 'PASS' when num_tools >= 1 and num_tools >= 2.31 then 'LowQual' else 'REJECT' end as consensus
 from ({VOTES}) v left join truth_v t on v.chrom = t.chrom and v.pos = t.pos and v.ref = t.ref and v.alt = t.alt"""
MERGED = """select {by}chrom, min(start0) as start0, max(end0) as end0 from (select *, sum(new) over (partition by {by}chrom order by start0, end0) as island from
 (select *, case when start0 > max(end0) over (partition by {by}chrom order by start0, end0 rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from regions_v))
 group by {by}chrom, island"""


def _labelled(v) -> DataFrame:
    return E.label_truth(E.count_votes(v("calls_v")), v("truth_v")).withColumn("consensus", E.consensus_label("num_tools", len(CALLERS)))


def _votes(df: DataFrame) -> DataFrame:
    return df.withColumn("votes", F.col("votes").cast("double"))


@query(LABELLED.replace("select v.*", "select v.chrom, v.pos, v.ref, v.alt, cast(votes as double) as votes, cast(num_tools as bigint) as num_tools, n_callers"))
def consensus_truth(v):
    return _votes(_labelled(v))


@query(f"""select tp, fp, n - tp as fn, tp / (tp + fp) as precision, tp / n as sensitivity, 2.0 * tp / (2.0 * tp + fp + n - tp) as f1
 from (select count(*) filter (where is_true = 1 and consensus <> 'REJECT') as tp, count(*) filter (where is_true = 0 and consensus <> 'REJECT') as fp, (select count(*) from truth_v) as n from ({LABELLED}))""")
def consensus_metrics(v):
    return E.metrics(_labelled(v), v("truth_v"), F.col("consensus") != "REJECT")


@query("select distinct chrom, pos, ref, alt from calls_v")
def union_variants(v):
    return E.union_variants(v("calls_v"))


@query(f"select chrom, pos, ref, alt, cast(votes as double) as votes, cast(num_tools as bigint) as num_tools, n_callers from ({VOTES}) where votes >= 1.5")
def min_callers(v):
    return _votes(E.min_callers(E.count_votes(v("calls_v")), 1.5))


@query("""select cast(s as int) as callers, count(*) as calls, cast(sum(t) as bigint) as true_calls from
 (select m.mask, case when t.pos is null then 0 else 1 end as t from (select chrom, pos, ref, alt, bit_or(1 << (cast(substr(caller, 2) as int) - 1)) as mask from calls_v where filter = 'PASS' group by all) m
  left join truth_v t on m.chrom = t.chrom and m.pos = t.pos and m.ref = t.ref and m.alt = t.alt), range(1, 128) r(s) where mask & cast(s as int) <> 0 group by s""")
def caller_combos(v):
    return E.caller_combinations(v("calls_v"), v("truth_v"), CALLERS)


def _include(sql: str) -> str:
    return f"select * from calls_v c where {sql}"


TOUCH = "exists (select 1 from regions_v r where r.chrom = c.chrom and r.start0 < c.pos - 1 + length(c.ref) and c.pos - 1 < r.end0 and r.label = '{}')"


@query(_include(TOUCH.format("F")))
def include_regions(v):
    return I.include_regions(v("calls_v"), v("regions_v").where("label = 'F'"))


@query(_include("not " + TOUCH.format("O")))
def exclude_regions(v):
    return I.exclude_regions(v("calls_v"), v("regions_v").where("label = 'O'"))


@query(_include(TOUCH.format("F") + " and not " + TOUCH.format("O")))
def intersect_regions(v):
    r = v("regions_v")
    return I.intersect_regions(v("calls_v"), r.where("label = 'F'"), r.where("label = 'O'"))


@query("select chrom, pos, exists (select 1 from regions_v r where r.chrom = t.chrom and r.start0 < t.pos and t.pos <= r.end0) as in_region from truth_v t")
def in_region(v):
    return I.in_region(v("truth_v").select("chrom", "pos"), v("regions_v"))


@query("select chrom, unnest(range(start0 + 1, end0 + 1)) as pos from regions_v")
def sites_from_regions(v):
    return I.sites_from_regions(v("regions_v"))


@query(MERGED.format(by=""))
def merge_intervals(v):
    return I.merge_intervals(v("regions_v"))


@query(f"""with m as ({MERGED.format(by='label, ')}),
 e as (select chrom, start0 as p from m union select chrom, end0 from m union select distinct chrom, 0 from m union select chrom, max(end0) + 151 from m group by chrom),
 s as (select chrom, p as start0, lead(p) over (partition by chrom order by p) as end0 from e)
 select s.chrom, s.start0, s.end0, count(m.label) as n_sets, coalesce(string_agg(m.label, ',' order by m.label), '.') as labels
 from s left join m on m.chrom = s.chrom and m.start0 < s.end0 and s.start0 < m.end0 where s.end0 is not null group by s.chrom, s.start0, s.end0""")
def count_loci_labels(v):
    r = v("regions_v")
    return I.count_loci(r, r.groupBy("chrom").agg((F.max("end0") + 151).alias("size")))


@query(f"""with m as ({MERGED.format(by='')}), o as (select *, sum(end0 - start0) over (order by chrom, start0, end0) - (end0 - start0) as off, cast(ceil(sum(end0 - start0) over () / 7.0) as bigint) as per from m)
 select s + 1 as shard, chrom, greatest(start0, start0 + s * per - off) as start0, least(end0, start0 + (s + 1) * per - off) as end0
 from (select *, cast(unnest(range(cast(off // per as bigint), cast((off + end0 - start0 - 1) // per as bigint) + 1)) as bigint) as s from o)""")
def split_equal_bp(v):
    return I.split_equal_bp(I.merge_intervals(v("regions_v")), 7)


@query("""with recursive t as (select chrom, greatest(start0 - 20, 0) as i, least(greatest(start0 - 20, 0) + 200, end0 + 30) as j, end0 as e, 1 as k from regions_v
  union all select chrom, j - 50, case when j - 50 + 200 > e then e + 30 else j - 50 + 200 end, e, k + 1 from t where j < e + 30)
 select chrom, i as start0, j as end0, concat_ws('_', chrom, i, k) as name from t""")
def tile_regions(v):
    return I.tile_regions(v("regions_v"), 200, 50, 20, 30)


@query("""with e as (select chrom, start0 as p, 1 as d from regions_v union all select chrom, end0, -1 from regions_v union all select chrom, 0, 0 from regions_v union all select chrom, max(end0) + 151, 0 from regions_v group by chrom),
 s as (select chrom, p, sum(d) as d from e group by chrom, p), r as (select chrom, p as start0, lead(p) over w as end0, cast(sum(d) over w as bigint) as n_regions from s window w as (partition by chrom order by p)) select * from r where end0 is not null""")
def region_depth(v):
    r = v("regions_v")
    return I.region_depth(r, r.groupBy("chrom").agg((F.max("end0") + 151).alias("size")))


def _flags(c: str = "upper(ref || alt)") -> str:
    return ", ".join(f"case when {c} in {v} then 1 else 0 end as {k}" for k, v in X.SUBSTITUTIONS.items())


@query(f"select chrom, pos, ref, alt, {_flags()} from truth_v")
def substitution_class(v):
    return X.with_substitution(v("truth_v"))


COMPLEX = "select read_id, start0 as pos, substr('GATTACAGATTACA', cast(1 + read_id % 7 as int), cast(1 + read_id % 5 as int)) as ref, substr('CATGCATGCATG', cast(1 + read_id % 4 as int), cast(1 + read_id % 3 as int)) as alt from reads_v"


def _complex(v) -> DataFrame:
    reads = v("reads_v")
    return reads.sparkSession.sql(COMPLEX.replace("from reads_v", "from {r}"), r=reads)


@query(f"select read_id, case when length(ref) = 1 and length(alt) = 1 then 'snv' when length(ref) = 1 or length(alt) = 1 then 'indel' else 'complex' end as kind, length(alt) - length(ref) as indel_length from ({COMPLEX})")
def variant_class(v):
    return _complex(v).select("read_id", X.variant_class().alias("kind"), X.indel_length().cast("long").alias("indel_length"))


@query(f"""with c as (select *, least(length(ref), length(alt)) as m from ({COMPLEX}))
 select read_id, pos + o as pos, substr(ref, o + 1, 1) as ref, substr(alt, o + 1, 1) as alt from (select *, unnest(range(m)) as o from c) where substr(ref, o + 1, 1) <> substr(alt, o + 1, 1)
 union all select read_id, pos + m - 1, substr(ref, m), substr(ref, m, 1) from c where length(ref) > length(alt)
 union all select read_id, pos + m - 1, substr(ref, m, 1), substr(ref, m, 1) || substr(alt, m + 1) from c where length(ref) < length(alt)""")
def decompose_complex(v):
    return X.decompose_complex(_complex(v))


#: Windows of 81 bases, one after another, over whole sequences.
SEQ = "(select doc_id, w, list_extract(regexp_extract_all(seq0, '.{1,81}'), w) as seq from (select *, unnest(range(1, (length(seq0) + 80) // 81 + 1)) as w from sequences_v))"


def _windows(v) -> DataFrame:
    """Windows of whole sequences, each with the complexity of its sequence: words that cross the ends of windows count there."""
    whole = F.round(U.linguistic_complexity("seq0", 20), 9).alias("sequence_complexity")
    cut = F.posexplode(F.regexp_extract_all("seq0", F.lit(".{1,81}"), F.lit(0))).alias("w", "seq")
    return v("sequences_v").select("doc_id", "seq0", whole).select("doc_id", cut, "sequence_complexity").withColumn("w", (F.col("w") + 1).cast("long"))


@query("select doc_id, reverse(translate(seq0, 'GTCAN', 'CAGTN')) as rc from sequences_v")
def reverse_complement(v):
    return v("sequences_v").select("doc_id", X.reverse_complement("seq0").alias("rc"))


@query("select doc_id, list_max(list_transform(r, lambda x: length(x))) as longest, cast(len(r) as bigint) as runs from (select doc_id, regexp_extract_all(seq0, 'A+|C+|G+|T+') as r from sequences_v)")
def run_lengths(v):
    runs = v("sequences_v").select("doc_id", X.run_lengths("seq0").alias("r"))
    return runs.select("doc_id", F.array_max("r").cast("long").alias("longest"), F.size("r").cast("long").alias("runs"))


#: Most words of up to 20 letters, and complexity of windows and of whole sequences; of a whole one the different 20 letters from each place are taken first.
MOST = "case length({0}) when 1 then 1.0 else list_sum([least(pow(4, x), length({0}) - x + 1) for x in range(1, least(20, length({0})) + 1)]) end as m"
PARTS = f"""select doc_id, w, round(k / m, 9) as complexity from (select doc_id, w, any_value(m) as m, count(distinct substr(seq, i, z)) as k from (select *, unnest(range(1, length(seq) - z + 2)) as i from
 (select *, unnest(range(1, least(20, length(seq)) + 1)) as z from (select *, {MOST.format('seq')} from {SEQ}))) group by doc_id, w)"""
WHOLES = f"""select doc_id, round(sum(k) / any_value(m), 9) as complexity from (select doc_id, any_value(m) as m, count(distinct substr(s, 1, cast(z as int))) as k from (select distinct doc_id, m, substr(seq0, i, 20) as s from
 (select *, unnest(range(1, length(seq0) + 1)) as i from (select *, {MOST.format('seq0')} from sequences_v))), range(1, 21) r(z) where length(s) >= z group by doc_id, z) group by doc_id"""


@query(f"with parts as ({PARTS}), wholes as ({WHOLES}) select p.doc_id, p.w, p.complexity, s.complexity as sequence_complexity from parts p join wholes s on s.doc_id is not distinct from p.doc_id")
def linguistic_complexity(v):
    return _windows(v).select("doc_id", "w", F.round(U.linguistic_complexity("seq", 20), 9).alias("complexity"), "sequence_complexity")


@query()
def sequence_complexity_full(v):
    """Whole sequences of documents; SQL would list all substrings, so this is tested against plain Python."""
    return v("sequences_v").select("doc_id", F.round(U.full_complexity("seq0"), 9).alias("complexity"))


@query("""select read_id, round(case when p = 0 then 40.0 when p = 1 then 0.0 else least(-10 * log10(p), 40.0) end, 9) as phred, round(pow(10.0, -mapq / 10.0), 12) as p_wrong,
 case when d = 0 then case when u > 0 then 100.0 end else least(round(u / d, 9), 100.0) end as odds, case when t = 0 then './.' when (af + ar) / t > 0.85 then '1/1' when (af + ar) / t >= 0.01 then '0/1' else '0/0' end as gt,
 case when t = 0 then 0.0 else round((af + ar) / t, 9) end as vaf
 from (select *, (read_id % 101) / 100.0 as p, cast((read_id % 7) * (read_id % 5) as double) as u, cast((read_id % 3) * (read_id % 4) as double) as d, read_id % 3 as rf, read_id % 4 as rr, read_id % 7 as af, read_id % 5 as ar, cast(read_id % 3 + read_id % 4 + read_id % 7 + read_id % 5 as double) as t from reads_v)""")
def phred_and_ratios(v):
    i = F.col("read_id")
    rf, rr, af, ar = i % 3, i % 4, i % 7, i % 5
    odds = X.odds_ratio(rf.cast("double"), af.cast("double"), ar.cast("double"), rr.cast("double"))
    return v("reads_v").select("read_id", F.round(X.p2phred((i % 101) / F.lit(100.0), 40.0), 9).alias("phred"), F.round(X.phred2p(F.col("mapq")), 12).alias("p_wrong"), F.round(odds, 9).alias("odds"), X.genotype(rf, rr, af, ar).alias("gt"), F.round(X.vaf(af + ar, rf + rr), 9).alias("vaf"))


@query("""with m as (select *, row_number() over (partition by chrom, pos order by ref, alt) as k from (select distinct chrom, pos, ref, alt from calls_v where filter = 'PASS')),
 t as (select *, row_number() over (partition by chrom, pos order by ref, alt) as k from truth_v)
 select coalesce(m.chrom, t.chrom) as chrom, coalesce(m.pos, t.pos) as pos, coalesce(m.k, t.k) as k, case when m.pos is null then 'FalseNegative' when t.pos is null then 'FalsePositive' else 'Correct' end as status
 from m full join t on m.chrom = t.chrom and m.pos = t.pos and m.k = t.k""")
def compare_callsets(v):
    return E.compare_callsets(v("calls_v").where("filter = 'PASS'"), v("truth_v"))


@query("""select o_orderkey as site, o_custkey % 7 + o_orderkey % 2 as ref_fwd, o_orderkey % 5 + case when o_orderkey % 4 = 0 then 1 else 0 end as ref_rev,
 case when o_custkey % 3 = 0 then 2 else 0 end as alt_fwd, case when o_custkey % 3 = 0 then 0 else 1 end + o_custkey % 4 as alt_rev,
 case when o_orderkey % 4 = 0 then 0 else 1 end as gaps, case when o_custkey % 3 = 0 then 1 else 0 end as n_insertions, case when o_orderkey % 4 = 0 then 1 else 0 end as n_deletions from orders""")
def pileup_counts(v):
    return P.base_counts(v("pileup_v")).select("site", "ref_fwd", "ref_rev", "alt_fwd", "alt_rev", "gaps", "n_insertions", "n_deletions")


@query("""select o_orderkey as site, case when o_custkey % 3 = 0 then 1 else 0 end as g_fwd, case when o_custkey % 3 = 0 then 0 else 1 end as g_rev, case when o_custkey % 3 = 0 then 1 else 0 end as ins_fwd, 0 as ins_rev,
 0 as del_fwd, case when o_orderkey % 4 = 0 then 1 else 0 end as del_rev from orders""")
def pileup_depth4(v):
    p, out = v("pileup_v"), None
    for name, ref, alt in (("g", "A", "G"), ("ins", "A", "AAC"), ("del", "ATTT", "A")):
        p = P.depth4(p.withColumns({"ref": F.lit(ref), "alt": F.lit(alt)})).withColumnsRenamed({"dp_alt_fwd": f"{name}_fwd", "dp_alt_rev": f"{name}_rev"})
        out = ["site", *[f"{n}_{s}" for n in ("g", "ins", "del") for s in ("fwd", "rev")]]
    return p.select(*out)


@query("""select site, case ref when 'R' then 'N' when 'AM' then 'AN' else ref end as ref, alt, case when id like '%rs5%' then 'rs5' when id like '%rs9%' then 'rs9' else '' end as rs, case when id like '%COSM7%' then 'COSM7' when id like '%COSV8%' then 'COSV8' else '' end as cos
 from records_v where not (alt = '<DEL>' and info not like '%END=%')""")
def clean_records(v):
    ids = {k: F.concat_ws(",", c) for k, c in V.common_ids().items()}
    return V.drop_endless_symbolic(v("records_v")).select("site", V.mask_bases("ref").alias("ref"), "alt", ids["rs_ids"].alias("rs"), ids["cos_ids"].alias("cos"))


@query("""with t as (select read_id, read_id % 7 as a, read_id % 5 as b, read_id % 3 as c, read_id % 11 as d from reads_v),
 k as (select *, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) as k from t),
 p as (select *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1)) as p from k),
 o as (select *, max(case when k = a then p end) over (partition by read_id) as own from p)
 select read_id, round(least(1.0, sum(case when p <= own * (1 + 1e-7) then p else 0 end)), 9) as two_sided, round(least(1.0, sum(case when k >= a then p else 0 end)), 9) as greater from o group by read_id""")
def fisher_strand(v):
    i = F.col("read_id")
    cells = (i % 7, i % 5, i % 3, i % 11)
    return v("reads_v").select("read_id", F.round(T.fisher_exact(*cells), 9).alias("two_sided"), F.round(T.fisher_exact(*cells, greater=True), 9).alias("greater"))


@query("""select 'truth' as side, count(*) as total, count(*) filter (where exists (select 1 from calls_v c where c.chrom = t.chrom and c.pos = t.pos and c.filter = 'PASS')) as recovered from truth_v t""")
def truth_recovery(v):
    passed = v("calls_v").where("filter = 'PASS'").select("chrom", "pos").distinct().withColumn("__hit", F.lit(True))
    return v("truth_v").join(passed, ["chrom", "pos"], "left").agg(F.lit("truth").alias("side"), F.count("*").alias("total"), F.count("__hit").alias("recovered")).select("side", "total", "recovered")


# the other modules of queries register themselves
from callweave.plans import caller_queries, feature_queries, file_queries, read_queries  # noqa: E402, F401
