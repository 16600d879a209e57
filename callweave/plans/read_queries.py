"""Queries over reads: filters, pairs, quality control, depth, calls at sites and what reads say for variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import count_tests as T
from callweave.functions import expressions as X
from callweave.operators import ensemble as E
from callweave.operators import evidence as V
from callweave.operators import reads as R
from callweave.operators import site_calls as S
from callweave.plans.register import query

#: Operations of every read: kind k, length n, and where they start on the contig (r), in the read (q) and in the alignment (al).
OPS = """raw_ops as (select read_id, chrom, start0, cast(regexp_extract(x, '^[0-9]+') as bigint) as n, right(x, 1) as op, j
  from (select read_id, chrom, start0, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) as x, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) as j from reads_v)),
 ops as (select read_id, chrom, n, case when op in ('I', 'S') then 'ins' when op in ('D', 'N') then 'del' else 'match' end as k, row_number() over w as i,
  start0 + coalesce(sum(case when op in ('M', 'D', 'N', '=', 'X') then n end) over p, 0) as r, coalesce(sum(case when op in ('M', 'I', 'S', '=', 'X') then n end) over p, 0) as q, coalesce(sum(n) over p, 0) as al
  from raw_ops where op not in ('H', 'P') window w as (partition by read_id order by j), p as (partition by read_id order by j rows between unbounded preceding and 1 preceding)),
 ends as (select read_id, max(case when k <> 'ins' then r + n else r end) as end0 from ops group by read_id)"""
#: Calls of the reads at the places of ``sites`` (chrom, pos).
CALLS = f"""{OPS}, laid as (select *, lead(k) over (partition by read_id order by i) as nk, i - row_number() over (partition by read_id, k order by i) as g,
   max(case when k <> 'match' then al + n - 1 end) over (partition by read_id order by i rows between unbounded preceding and 1 preceding) as back from ops),
 runs as (select read_id, k, g, min(i) as i, sum(n) as total from laid group by read_id, k, g),
 placed as (select l.*, s.pos, s.pos = l.r + l.n as edge, u.total from laid l join sites s on s.chrom = l.chrom and l.k <> 'ins' and l.r < s.pos and s.pos <= l.r + l.n left join runs u on u.read_id = l.read_id and u.i = l.i + 1),
 called as (select *, case when k = 'del' then 'unknown' when not edge or nk is null or nk = 'match' then 'match' when nk = 'ins' then 'insertion' else 'deletion' end as kind,
   cast(case when k = 'del' or (edge and nk is null) then null when not edge or nk = 'match' then 0 when nk = 'ins' then total else -total end as bigint) as indel_length,
   cast(case when k <> 'del' then q + pos - 1 - r end as bigint) as read_offset, al + pos - 1 - r as p from placed),
 ahead as (select c.read_id, c.pos, c.i, min(greatest(o.al, c.p + abs(c.indel_length) + 2)) as first from called c join ops o on o.read_id = c.read_id and o.i > c.i and o.k <> 'match' and o.al + o.n - 1 > c.p + abs(c.indel_length) + 1 group by c.read_id, c.pos, c.i),
 site_rows as (select c.*, case when indel_length is not null then least(case when p - back <= 3 then cast(p - back as double) else cast('infinity' as double) end,
   case when first - p - abs(indel_length) - 1 <= 3 then cast(first - p - abs(indel_length) - 1 as double) else cast('infinity' as double) end) end as nearest
  from called c left join ahead a on a.read_id = c.read_id and a.pos = c.pos and a.i = c.i)"""
KEY = "chrom, pos, ref, alt"
VARIANTS = f"variants as (select distinct chrom, pos, ref, unnest(string_split(alt, ',')) as alt from vcf_v), sites as (select distinct chrom, pos from variants)"
#: Reads of a sample at variants, with their class and the quality of their base.
CLASSES = f"""{VARIANTS}, {CALLS}, met as (select v.ref, v.alt, c.*, t.* exclude (read_id, chrom), ascii(substr(quals, read_offset + 1, 1)) - 33 as bq, length(v.alt) - length(v.ref) as size,
   case when kind = 'match' and substr(seq, read_offset + 1, 1) = substr(v.ref, 1, 1) then 0
        when (length(v.alt) = length(v.ref) and kind = 'match' and substr(seq, read_offset + 1, 1) = v.alt) or (length(v.alt) < length(v.ref) and kind = 'deletion' and indel_length = length(v.alt) - length(v.ref)) or (length(v.alt) > length(v.ref) and kind = 'insertion') then 1 else 2 end as cls
  from site_rows c join reads_v t on t.read_id = c.read_id and t.flag & 4 = 0 and t.flag & 1024 = 0 and t.sample = 'tumor' join variants v on v.chrom = c.chrom and v.pos = c.pos)"""


def tumor(v) -> DataFrame:
    return v("reads_v").where("sample = 'tumor'")


def variants(v) -> DataFrame:
    return E.union_variants(v("vcf_v"))


@query("select * from reads_v where mapq >= 20 and nm <= 3 and (flag & 2) <> 0 and cigar not like '%S%'")
def filter_reads(v):
    return R.filter_reads(v("reads_v"), 20, 3, True, True)


@query("select * from reads_v where (flag & 1024) = 0")
def drop_duplicate_reads(v):
    return R.drop_duplicate_reads(v("reads_v"))


@query(f"with {OPS} select t.* from reads_v t join ends e on e.read_id = t.read_id where exists (select 1 from regions_v r where r.chrom = t.chrom and r.label = 'F' and r.start0 < e.end0 and t.start0 < r.end0)")
def reads_in_regions(v):
    return R.reads_in_regions(v("reads_v"), v("regions_v").where("label = 'F'"))


@query("""with c as (select read_id, cigar, seq, quals, coalesce(cast(nullif(regexp_extract(cigar, '^([0-9]+)S', 1), '') as int), 0) as head, case when cigar like '%S' and not regexp_full_match(cigar, '[0-9]+S') then cast(regexp_extract(cigar, '([0-9]+)S$', 1) as int) else 0 end as tail from reads_v)
 select read_id, regexp_replace(regexp_replace(cigar, '^[0-9]+S', ''), '[0-9]+S$', '') as cigar, head + tail as trimmed, substr(seq, head + 1, length(seq) - head - tail) as seq, substr(quals, head + 1, length(quals) - head - tail) as quals,
  regexp_replace(cigar, '^[0-9]+S|[0-9]+S$', '', 'g') as mate, substr(seq, head + 1, length(seq) - head - tail) as bi from c""")
def trim_soft_clips(v):
    tagged = v("reads_v").withColumn("tags", F.create_map(F.lit("MC"), "cigar", F.lit("BI"), "seq"))
    return R.trim_soft_clips(tagged).select("read_id", "cigar", "trimmed", "seq", "quals", F.col("tags")["MC"].alias("mate"), F.col("tags")["BI"].alias("bi"))


@query("select a.qname, a.chrom as chrom1, a.start0 as start01, b.chrom as chrom2, b.start0 as start02 from reads_v a join reads_v b on a.qname = b.qname where (a.flag & 64) <> 0 and (b.flag & 128) <> 0 and (a.flag & 256) = 0 and (b.flag & 256) = 0")
def mate_pairs(v):
    return R.mate_pairs(v("reads_v"))


@query("""with f as (select qname, flag, case when (flag & 16) <> 0 then reverse(translate(seq, 'GTCAN', 'CAGTN')) else seq end as s, case when (flag & 16) <> 0 then reverse(quals) else quals end as u from reads_v where (flag & 256) = 0)
 select a.qname, concat('@', a.qname, '/1', chr(10), a.s, chr(10), '+', chr(10), a.u) as fastq1, concat('@', b.qname, '/2', chr(10), b.s, chr(10), '+', chr(10), b.u) as fastq2 from f a join f b on a.qname = b.qname where (a.flag & 64) <> 0 and (b.flag & 128) <> 0""")
def reads_to_fastq(v):
    return R.reads_to_fastq(v("reads_v"))


@query("select read_id, case when (flag & 64) <> 0 then 'R1' when (flag & 128) <> 0 then 'R2' else 'R0' end as which, ascii(substr(quals, 1, 1)) - 33 as first, cast(list_sum(list_transform(string_split(quals, ''), lambda x: ascii(x) - 33)) as bigint) as total, quals as again from reads_v")
def qualities(v):
    q = X.qualities("quals")
    return v("reads_v").select("read_id", X.read_in_pair().alias("which"), q[0].alias("first"), F.aggregate(q, F.lit(0), lambda a, x: a + x).cast("long").alias("total"), X.quality_string(q).alias("again"))


FRAGMENT = "case when (flag & 2) <> 0 and abs(tlen) > 0 and abs(tlen) < 1000 then abs(tlen) end"


@query(f"""select count(*) as total, count(*) filter (where (flag & 1024) <> 0) as duplicates, round(count(*) filter (where (flag & 1024) <> 0) / count(*), 9) as duplicate_rate, count(*) filter (where (flag & 4) = 0 and cigar like '%S%' and (flag & 2) = 0) as clipped_discordant,
 count(*) filter (where (flag & 4) = 0 and cigar like '%S%' and (flag & 2) <> 0) as clipped_only, count(*) filter (where (flag & 4) = 0 and cigar not like '%S%' and (flag & 2) = 0) as discordant_only, count(*) filter (where (flag & 4) = 0 and mapq = 0) as mq0, count(*) filter (where (flag & 4) <> 0) as unmapped,
 cast(quantile_disc(case when (flag & 2) <> 0 then abs(tlen) end, 0.5) as bigint) as median_fragment, round(avg({FRAGMENT}), 6) as mean_fragment, round(stddev_pop({FRAGMENT}), 6) as sd_fragment from reads_v""")
def reads_qc(v):
    return R.reads_qc(v("reads_v")).withColumns({"duplicate_rate": F.round("duplicate_rate", 9), **{c: F.round(c, 6) for c in ("mean_fragment", "sd_fragment")}})


@query("select mapq, count(*) as n, round(count(*) / (select count(*) from reads_v), 9) as share from reads_v group by mapq")
def mapq_histogram(v):
    return R.mapq_histogram(v("reads_v")).withColumn("share", F.round("share", 9))


@query("select abs(tlen) as length, count(*) filter (where (flag & 1024) <> 0) as duplicates, count(*) as n, round(count(*) filter (where (flag & 1024) <> 0) / count(*), 9) as duplicate_rate from reads_v where (flag & 2) <> 0 group by abs(tlen)")
def fragment_histogram(v):
    return R.fragment_histogram(v("reads_v")).withColumn("duplicate_rate", F.round("duplicate_rate", 9))


DEPTH = """select chrom, start0, end0, depth from (select chrom, start0, lead(start0) over (partition by chrom order by start0) as end0, cast(sum(d) over (partition by chrom order by start0) as bigint) as depth
 from (select chrom, p as start0, sum(d) as d from (select chrom, s as p, 1 as d from spans union all select chrom, e, -1 from spans) group by chrom, p having sum(d) <> 0)) where depth > 0"""


@query(f"with {OPS}, spans as (select o.chrom, o.r as s, o.r + o.n as e from ops o join reads_v t on t.read_id = o.read_id where k = 'match' and mapq >= 10 and (flag & 1024) = 0) {DEPTH}")
def coverage_depth(v):
    return R.coverage_depth(v("reads_v"), 10)


GOOD_BASES = """bases as (select read_id, chrom, r + j as s, q + j as o from (select *, unnest(range(n)) as j from ops where k = 'match')),
 spans as (select b.chrom, b.s, b.s + 1 as e from bases b join reads_v t on t.read_id = b.read_id where mapq >= 10 and (flag & 1024) = 0 and ascii(substr(quals, cast(b.o + 1 as int), 1)) - 33 >= 20)"""


@query(f"""with {OPS}, {GOOD_BASES}, d as ({DEPTH}), m as (select chrom, start0 as s, end0 as e from regions_v where label = 'F'),
 f as (select chrom, min(s) as s, max(e) as e from (select *, sum(new) over (partition by chrom order by s, e) as g from (select *, case when s > max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from m)) group by chrom, g)
 select d.chrom, greatest(d.start0, f.s) as start0, least(d.end0, f.e) as end0, d.depth from d join f on f.chrom = d.chrom and d.start0 < f.e and f.s < d.end0""")
def base_depth_in_regions(v):
    return R.coverage_depth(v("reads_v"), 10, 20, v("regions_v").where("label = 'F'"))


CONTIGS = "sizes as (select chrom, max(start0) + 1000 as size from reads_v group by chrom)"


CALLABLE = f"""with {OPS}, {CONTIGS}, kept as (select * from reads_v where (flag & 1024) = 0 and (flag & 4) = 0),
 steps as (select o.chrom, o.r as p, 1 as a, case when mapq <= 1 then 1 else 0 end as l, 0 as g from ops o join kept t on t.read_id = o.read_id where k = 'match' union all select o.chrom, o.r + o.n, -1, case when mapq <= 1 then -1 else 0 end, 0 from ops o join kept t on t.read_id = o.read_id where k = 'match'),
 good as (select b.chrom, b.r + j as p from (select *, unnest(range(n)) as j from ops where k = 'match') b join kept t on t.read_id = b.read_id where mapq >= 10 and ascii(substr(quals, cast(b.q + j + 1 as int), 1)) - 33 >= 20),
 every as (select * from steps union all select chrom, p, 0, 0, 1 from good union all select chrom, p + 1, 0, 0, -1 from good union all select chrom, 0, 0, 0, 0 from sizes union all select chrom, size, 0, 0, 0 from sizes),
 sums as (select chrom, p, sum(a) as a, sum(l) as l, sum(g) as g from every group by chrom, p),
 run as (select chrom, p as start0, lead(p) over w as end0, sum(a) over w as a, sum(l) over w as l, sum(g) over w as g from sums window w as (partition by chrom order by p)),
 named as (select chrom, start0, end0, case when a = 0 then 'NO_COVERAGE' when a >= 10 and l > 0.1 * a then 'POOR_MAPPING_QUALITY' when g < 4 then 'LOW_COVERAGE' else 'CALLABLE' end as label from run where end0 is not null),
 marked as (select *, case when label = lag(label) over (partition by chrom order by start0) then 0 else 1 end as new from named), islands as (select *, sum(new) over (partition by chrom order by start0) as i from marked)
 select chrom, cast(min(start0) as bigint) as start0, cast(max(end0) as bigint) as end0, min(label) as label from islands group by chrom, i"""


@query(CALLABLE)
def callable_regions(v):
    reads = v("reads_v")
    return R.callable_regions(reads, reads.groupBy("chrom").agg((F.max("start0") + 1000).alias("size")))


@query(f"""with {OPS}, s as (select distinct chrom, pos from truth_v), r as (select t.*, e.end0 from reads_v t join ends e on e.read_id = t.read_id where (flag & 1024) = 0)
 select s.chrom, s.pos, count(qname) as dp, count(qname) filter (where mapq = 0) as mq0, count(qname) filter (where mapq >= 1 and (flag & 2) <> 0) as concordant, count(qname) filter (where mapq >= 1 and (flag & 2) = 0) as discordant,
 count(qname) filter (where mapq >= 1 and (flag & 16) = 0) as forward, count(qname) filter (where mapq >= 1 and (flag & 16) <> 0) as reverse, round(avg(mapq), 6) as mean_mq
 from s left join r on r.chrom = s.chrom and r.start0 < s.pos and s.pos <= r.end0 group by s.chrom, s.pos""")
def site_depth(v):
    return R.site_depth(v("reads_v"), v("truth_v").select("chrom", "pos").distinct())


@query(f"with sites as (select distinct chrom, pos from truth_v), {CALLS} select read_id, chrom, pos, kind, indel_length, read_offset, nearest from site_rows")
def read_site_calls(v):
    sites = v("truth_v").select("chrom", "pos").distinct()
    return S.site_calls(v("reads_v"), sites).select("read_id", "chrom", "pos", "kind", "indel_length", "read_offset", "nearest")


@query(f"with {CLASSES} select read_id, chrom, pos, ref, alt, cls, bq from met")
def read_classes(v):
    return V.read_classes(tumor(v), variants(v)).select("read_id", "chrom", "pos", "ref", "alt", "cls", "bq")


def _fisher(tests: dict[str, tuple[str, str, str, str]], source: str) -> str:
    """Two-sided exact tests of tables of columns of ``source``, as one row for each key."""
    tables = " union all ".join(f"select {KEY}, '{t}' as t, {a} as a, {b} as b, {c} as c, {d} as d from {source}" for t, (a, b, c, d) in tests.items())
    return f"""tables as ({tables}), chances as (select *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1)) as p
  from (select *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as k from tables)), own as (select *, max(case when k = a then p end) over (partition by {KEY}, t) as mine from chances),
 fisher as (select {KEY}, {', '.join(f"round(least(1.0, sum(case when t = '{t}' and p <= mine * (1 + 1e-7) then p end)), 6) as {t}" for t in tests)} from own group by {KEY})"""


OK = "mapq >= 1 and bq >= 5"
SIDES = (("ref", 0), ("alt", 1))
COUNTS = {
    "dp": "true", "mq0_reads": "mapq = 0", "noise_read_count": "cls = 2", "poor_read_count": "mapq < 1 and list_avg(list_transform(string_split(quals, ''), lambda x: ascii(x) - 33)) < 5",
    **{f"{s}_{n}": f"cls = {k} and {OK} and {w}" for s, k in SIDES for n, w in (("concordant_reads", "(flag & 2) <> 0"), ("discordant_reads", "(flag & 2) = 0"), ("call_forward", "(flag & 16) = 0"), ("call_reverse", "(flag & 16) <> 0"))},
    **{f"{s}_soft_clipped_reads": f"cls = {k} and regexp_matches(cigar, '^([0-9]+H)?[0-9]+S|[0-9]+S([0-9]+H)?$')" for s, k in SIDES}, **{f"{s}_unclipped": f"cls = {k} and not regexp_matches(cigar, '^([0-9]+H)?[0-9]+S|[0-9]+S([0-9]+H)?$')" for s, k in SIDES},
    **{f"{s}_indel_{d}bp": f"cls = {k} and nearest <= {d}" for s, k in SIDES for d in (1, 2, 3)},
}
MEANS = {f"{s}_{n}": f"round(avg({c}) filter (where cls = {k}), 6)" for s, k in SIDES for n, c in (("mq", "mapq"), ("bq", "bq"), ("edit_distance", "nm"))}
TESTS = {
    "concordance_fet": ("ref_concordant_reads", "alt_concordant_reads", "ref_discordant_reads", "alt_discordant_reads"),
    "strandbias_fet": ("ref_call_forward", "alt_call_forward", "ref_call_reverse", "alt_call_reverse"),
    "clipping_fet": ("ref_unclipped", "alt_unclipped", "ref_soft_clipped_reads", "alt_soft_clipped_reads"),
}
FEATURES = f"""{CLASSES}, counted as (select v.chrom, v.pos, v.ref, v.alt, {', '.join(f'count(m.read_id) filter (where {w}) as {n}' for n, w in COUNTS.items())}, {', '.join(f'{e} as {n}' for n, e in MEANS.items())}
   from variants v left join met m on m.chrom = v.chrom and m.pos = v.pos and m.ref = v.ref and m.alt = v.alt group by v.chrom, v.pos, v.ref, v.alt),
 pairs as (select {KEY}, count(*) filter (where n = 2 and x = 2) as consistent_mates, count(*) filter (where n = 2 and x = 1) as inconsistent_mates from (select {KEY}, qname, count(*) as n, count(*) filter (where cls = 1) as x from met group by {KEY}, qname) group by {KEY}),
 {_fisher(TESTS, 'counted')}, features as (select c.* exclude (ref_unclipped, alt_unclipped), coalesce(consistent_mates, 0) as consistent_mates, coalesce(inconsistent_mates, 0) as inconsistent_mates, length(alt) - length(ref) as indel_length,
   round(alt_edit_distance - ref_edit_distance - abs(length(alt) - length(ref)), 5) as edit_distance_difference, concordance_fet, strandbias_fet, clipping_fet from counted c left join pairs using ({KEY}) left join fisher using ({KEY}))"""


@query(f"with {FEATURES} select * from features")
def site_read_features(v):
    made = V.site_read_features(tumor(v), variants(v)).drop(*[f"p_mannwhitneyu_{m}" for m in V.RANKED])
    digits = {**{c: 6 for c in (*MEANS, *TESTS)}, "edit_distance_difference": 5}
    return made.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query()
def site_rank_tests(v):
    """The rank tests of ``site_read_features``; a normal tail is no SQL function, so they are tested by hand."""
    return V.site_read_features(tumor(v), variants(v)).select("chrom", "pos", "ref", "alt", *[f"p_mannwhitneyu_{m}" for m in V.RANKED])


@query(f"""with {CLASSES} select v.chrom, v.pos, v.ref, v.alt, count(m.read_id) filter (where cls = 1) as var_reads, count(m.read_id) filter (where cls = 0) as ref_reads, count(m.read_id) filter (where cls = 2) as other_reads, count(m.read_id) as depth,
 round(count(m.read_id) filter (where cls = 1) / nullif(count(m.read_id), 0), 9) as vaf from variants v left join (select * from met where mapq >= 1) m on m.chrom = v.chrom and m.pos = v.pos and m.ref = v.ref and m.alt = v.alt group by v.chrom, v.pos, v.ref, v.alt""")
def vaf_from_reads(v):
    return V.vaf_from_reads(tumor(v), variants(v)).withColumn("vaf", F.round("vaf", 9))


@query("""with t as (select read_id, read_id % 7 as a, read_id % 5 as b, read_id % 3 as c, read_id % 11 as d from reads_v),
 k as (select *, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) as k from t),
 p as (select *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1)) as p from k),
 o as (select *, max(case when k = a then p end) over (partition by read_id) as own from p)
 select read_id, round(least(1.0, sum(case when p <= own * (1 + 1e-7) then p else 0 end)), 9) as two_sided, round(least(1.0, sum(case when k >= a then p else 0 end)), 9) as greater from o group by read_id""")
def fisher_strand(v):
    i = F.col("read_id")
    cells = (i % 7, i % 5, i % 3, i % 11)
    return v("reads_v").select("read_id", F.round(T.fisher_exact(*cells), 9).alias("two_sided"), F.round(T.fisher_exact(*cells, greater=True), 9).alias("greater"))


@query("""with c as (select chrom, mapq, sum(case when (flag & 16) <> 0 then 1 else 0 end) as x, sum(case when (flag & 16) <> 0 then 0 else 1 end) as y from reads_v group by chrom, mapq),
 b as (select *, coalesce(sum(y) over (partition by chrom order by mapq rows between unbounded preceding and 1 preceding), 0) as below from c),
 s as (select chrom, cast(sum(x) as double) as n, cast(sum(y) as double) as m, sum(x * (below + y / 2.0)) as u, sum(pow(x + y, 3) - (x + y)) as t from b group by chrom)
 select chrom, cast(n as bigint) as n_alt, cast(m as bigint) as n_ref, cast(u as double) as u, round((n * m / 2 - u - 0.5) / sqrt(n * m / 12 * (n + m + 1 - t / ((n + m) * (n + m - 1)))), 6) as z from s""")
def rank_sum_scores(v):
    reads = v("reads_v").withColumn("reverse", F.col("flag").bitwiseAND(16) != 0)
    return T.rank_sums(reads, ["chrom"], "mapq", "reverse").select("chrom", "n_alt", "n_ref", F.col("u").cast("double").alias("u"), F.round("z", 6).alias("z"))
