"""Queries over wide feature rows: features of one and two samples, classified records, tallies, phasing, summaries, models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators import annotate as A
from callweave.operators import ensemble as E
from callweave.operators import evidence as V
from callweave.operators import features as W
from callweave.operators import models as M
from callweave.operators import phasing as P
from callweave.operators import summaries as G
from callweave.operators.reads import state_summary
from callweave.operators.reference import tiles
from callweave.plans import caller_queries as C
from callweave.plans import read_queries as R
from callweave.plans.register import query
from callweave.plans.views import BASE
from callweave.storage import settle

#: Length of the contigs that the reads and records of the views lie on.
CONTIG = 20_400


def _reference(v) -> DataFrame:
    """Tiles of the contigs of the reads, as a stored table."""
    base = BASE.format(pos="p", c="cast(substr(chrom, 4) as int)")
    contigs = settle(v("reads_v").select("chrom").distinct())  # or their bases would be filtered, and so made, for every read
    return settle(tiles(contigs.select("chrom", F.expr(f"array_join(transform(sequence(1, {CONTIG}), p -> {base}), '')").alias("sequence"))))


def _sources(v, paired: bool = True) -> W.Sources:
    reads = v("reads_v")
    return W.Sources(C.records(v), _reference(v), reads.where("sample = 'tumor'"), reads.where("sample = 'normal'") if paired else None, v("truth_v"), v("known_v"), v("known_v"), C.SUPPLIED)


def _paired(v) -> DataFrame:
    calls = C.records(v)
    return W.paired_features(E.union_variants(calls), _sources(v), C.SPECS)


def _single(v) -> DataFrame:
    calls = C.records(v)
    return W.single_features(E.union_variants(calls), _sources(v, False), [*A.SINGLE, A.arbitrary(1)])


VOTED = f"""{C.JOINED}, voted as (select *, {' + '.join(C.VERDICT_SQL)} as votes from wide)"""
#: Counts of one sample at variants, as columns of the features; reads of the other sample are left out by name.
SIDE = """{s}counts as (select v.chrom, v.pos, v.ref, v.alt, count(m.read_id) as {s}dp, count(m.read_id) filter (where cls = 0 and mapq >= 1 and bq >= 5) as {s}ref, count(m.read_id) filter (where cls = 1 and mapq >= 1 and bq >= 5) as {s}alt,
  round(avg(mapq) filter (where cls = 1), 6) as {s}alt_mq, count(m.read_id) filter (where cls = 1 and nearest <= 3) as {s}alt_indel from variants v left join (select * from every where sample = '{name}') m on m.chrom = v.chrom and m.pos = v.pos and m.ref = v.ref and m.alt = v.alt group by v.chrom, v.pos, v.ref, v.alt)"""
BOTH = R.CLASSES.replace(" and t.sample = 'tumor'", "").replace("met as (", "every as (")


@query(f"""with {VOTED}, {BOTH}, {SIDE.format(s='t_', name='tumor')}, {SIDE.format(s='n_', name='normal')}, known as (select chrom, pos, ref, alt, id, info from known_v),
 f as (select w.*, t.* exclude (chrom, pos, ref, alt), n.* exclude (chrom, pos, ref, alt), case when x.pos is null then 0 else 1 end as truth, k.id as kid, k.info as kinfo from voted w join t_counts t using (chrom, pos, ref, alt) join n_counts n using (chrom, pos, ref, alt) left join truth_v x using (chrom, pos, ref, alt) left join known k using (chrom, pos, ref, alt) where votes >= 0.5)
 select chrom as CHROM, pos as POS, ref as REF, alt as ALT, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(concat_ws(',', case when truth = 1 then 'TruePositive' else 'FalsePositive' end, kid), '[,;]'), lambda y: y <> ''))), ';') as ID,
  if_MuTect, if_VarDict, MuSE_Tier, if_Caller_1, cast(null as double) as if_LoFreq, M2_TLOD, round(VarDict_Score, 2) as VarDict_Score, Strelka_Score, case when kid is null then 0 else 1 end as if_dbsnp, case when kinfo like '%COMMON=1%' then 1 else 0 end as COMMON,
  case when kid is null then 0.0 when kinfo like '%;SNP;%' then null else cast(regexp_extract(kinfo, 'CNT=([0-9]+)', 1) as double) end as COSMIC_CNT, t_dp as T_DP, n_dp as N_DP, t_ref as T_REF, t_alt as T_ALT, n_ref as N_REF, n_alt as N_ALT, t_alt_mq as tBAM_ALT_MQ, n_alt_mq as nBAM_ALT_MQ, t_alt_indel as tBAM_ALT_InDel_3bp,
  round(case when n_ref * t_alt = 0 then case when n_alt * t_ref > 0 then 100.0 end else least(n_alt * t_ref / (n_ref * t_alt), 100.0) end, 6) as SOR, length(alt) - length(ref) as InDel_Length, truth as TrueVariant_or_False from f""")
def paired_features(v):
    f = _paired(v)
    both = lambda s, a: (F.col(f"{s}_{a}_FOR") + F.col(f"{s}_{a}_REV")).alias(f"{s}_{a}")
    return f.select(
        "CHROM", "POS", "REF", "ALT", "ID", "if_MuTect", "if_VarDict", "MuSE_Tier", "if_Caller_1", "if_LoFreq", "M2_TLOD", "VarDict_Score", "Strelka_Score", "if_dbsnp", "COMMON", "COSMIC_CNT", "T_DP", "N_DP",
        *[both(s, a) for s in "TN" for a in ("REF", "ALT")], F.round("tBAM_ALT_MQ", 6).alias("tBAM_ALT_MQ"), F.round("nBAM_ALT_MQ", 6).alias("nBAM_ALT_MQ"), "tBAM_ALT_InDel_3bp", F.round("SOR", 6).alias("SOR"), "InDel_Length", W.LABEL,
    )


@query(f"""with {C.JOINED.replace("case when " + C.SOMATIC + " or filter like '%PASS%' then 1.0 else 0.0 end", "case when filter = 'PASS' then 1.0 else 0.0 end")}, one2 as (select chrom, pos, ref, alt, coalesce(max(case when filter = 'PASS' then 1.0 else 0.0 end) filter (where caller = 'MuTect2'), 0.0) as a, coalesce(max(case when filter = 'PASS' then 1.0 else 0.0 end) filter (where caller = 'VarScan2'), 0.0) as b,
   coalesce(max(case when filter = 'PASS' then 1.0 else 0.0 end) filter (where caller = 'VarDict'), 0.0) as c, coalesce(max(case when filter like '%PASS%' then 1.0 else 0.0 end) filter (where caller = 'Strelka'), 0.0) as d, max({C._number('TLOD')}) filter (where caller = 'MuTect2') as tlod from one group by chrom, pos, ref, alt),
 {BOTH}, {SIDE.format(s='t_', name='tumor')}
 select chrom as CHROM, pos as POS, ref as REF, alt as ALT, a as if_MuTect, b as if_VarScan2, c as if_VarDict, d as if_Strelka, w.if_Caller_1, tlod as M2_TLOD, t_dp as T_DP, t_alt as T_ALT from one2 join wide w using (chrom, pos, ref, alt) join t_counts using (chrom, pos, ref, alt) where a + b + c + d + w.if_Caller_1 >= 0.5""")
def single_features(v):
    return _single(v).select("CHROM", "POS", "REF", "ALT", "if_MuTect", "if_VarScan2", "if_VarDict", "if_Strelka", "if_Caller_1", "M2_TLOD", "T_DP", (F.col("T_ALT_FOR") + F.col("T_ALT_REV")).alias("T_ALT"))


TOOLS = ["if_MuTect", "if_VarScan2", "if_SomaticSniper", "if_VarDict", "MuSE_Tier", "if_Strelka", "if_Caller_1"]
ONES = ", ".join(f"case when {t} = 1 then 1 else 0 end" for t in TOOLS)


@query(f"""with {VOTED}, n as (select *, list_sum([{ONES}]) as k, array_to_string([{ONES}], ',') as combo from voted where votes >= 0.5)
 select chrom, pos, ref, alt, 0.0 as qual, case when k > 3.5 then 'PASS' when k >= 1 and k >= 2.31 then 'LowQual' else 'REJECT' end as filter, case when k > 3.5 then 'SOMATIC;' else '' end || 'MVSDUK1=' || combo || ';NUM_TOOLS=' || cast(cast(k as bigint) as varchar) as info,
  15 as n_keys, 2 as n_samples from n""")
def consensus_records(v):
    made = W.features_to_records(_paired(v).drop("Seq_Complexity_Span"), TOOLS)
    return made.select(*E.KEY, "qual", "filter", "info", F.size(F.split(F.col("samples")[1], ":")).alias("n_keys"), F.size("samples").alias("n_samples"))


@query("""with s as (select *, case when (read_id % 97) / 96.0 >= 0.5 then 'PASS' when (read_id % 97) / 96.0 >= 0.1 then 'LowQual' else 'REJECT' end as f, read_id % 7 as rf, read_id % 5 as rr, read_id % 4 as af, read_id % 3 as ar from reads_v)
 select read_id, case when read_id % 97 = 96 then 255.0 when read_id % 97 = 0 then 0.0 else least(round_even(-10 * log10(1 - (read_id % 97) / 96.0), 1), 255.0) end as qual, f as filter, case when f = 'PASS' then 'SOMATIC;' else '' end || 'M=1;NUM_TOOLS=1;LC=' || format('{:.1f}', mapq / 4.0) || ';AF=' || format('{:.3g}', case when rf + rr + af + ar = 0 then 0 else (af + ar) / (rf + rr + af + ar) end) as info,
  case when rf + rr + af + ar = 0 then './.' when (af + ar) / (rf + rr + af + ar) > 0.85 then '1/1' when (af + ar) / (rf + rr + af + ar) >= 0.01 then '0/1' else '0/0' end || ':' || concat_ws(',', rf, rr, af, ar) || ':0,1,2,3:' || format('{:g}', mapq / 7.0) || ':.:' || format('{:g}', mapq * 1000.0) || ':.:0.5:.:1:1:.:.:' || cast(read_id % 9 as varchar) || ':' || format('{:.3g}', case when rf + rr + af + ar = 0 then 0 else (af + ar) / (rf + rr + af + ar) end) as sample from s""")
def scored_records(v):
    i = F.col("read_id")
    none = F.lit(None).cast("double")
    values = {"T_REF_FOR": i % 7, "T_REF_REV": i % 5, "T_ALT_FOR": i % 4, "T_ALT_REV": i % 3, "tBAM_REF_Concordant": F.lit(0), "tBAM_REF_Discordant": F.lit(1), "tBAM_ALT_Concordant": F.lit(2), "tBAM_ALT_Discordant": F.lit(3),
              "tBAM_REF_MQ": F.col("mapq") / 7.0, "tBAM_ALT_MQ": none, "tBAM_REF_BQ": F.col("mapq") * 1000.0, "tBAM_ALT_BQ": none, "tBAM_REF_NM": F.lit(0.5), "tBAM_ALT_NM": none, "tBAM_StrandBias_FET": F.lit(1.0), "tBAM_Concordance_FET": F.lit(1.0),
              "tBAM_p_MannWhitneyU_MQ": none, "tBAM_p_MannWhitneyU_BQ": none, "tBAM_MQ0": i % 9, "Seq_Complexity_Span": F.col("mapq") / 4.0, "SCORE": (i % 97) / 96.0, "if_MuTect": F.lit(1.0), "ID": F.lit("."), "REF": F.lit("A"), "ALT": F.lit("C"), "CHROM": F.col("chrom"), "POS": i}
    made = W.features_to_records(v("reads_v").select(*[c.alias(n) for n, c in values.items()]), ["if_MuTect"], paired=False)
    return made.select(F.col("pos").alias("read_id"), "qual", "filter", "info", F.col("samples")[0].alias("sample"))


@query("""select rid, array_to_string(list_filter(string_split(info, ';'), lambda x: not starts_with(x, 'NLOD') and not starts_with(x, 'NUM_TOOLS=')), ';') as info, fmt || ':NLOD:NUM_TOOLS:SCORE' as fmt, s0 as normal, s1 || ':' || coalesce(nullif(regexp_extract(info, '(^|;)NLOD=([^;]+)', 2), ''), 'False') || ':' || cast(rid % 9 as varchar) || ':' || cast(rid % 4 as varchar) || '.5' as tumor
 from (select * replace (info || ';NUM_TOOLS=' || cast(rid % 9 as varchar) as info) from raw_v)""")
def info_to_sample(v):
    rows = C.raw(v).withColumns({"info": F.concat("info", F.lit(";NUM_TOOLS="), F.col("rid") % 9), "qual": F.col("rid") % 4 + 0.5})
    made = W.info_to_sample(rows, "NLOD", 1, trained=True)
    return made.select("rid", "info", F.array_join("format", ":").alias("fmt"), F.col("samples")[0].alias("normal"), F.col("samples")[1].alias("tumor"))


def _kept(v) -> dict[str, DataFrame]:
    rows = settle(C.records(v))
    return {c: rows.where(F.col("caller") == c).drop("caller") for c in sorted(C.SUPPLIED)}


def _both_kinds(v, paired: bool, specs) -> DataFrame:
    made = [records.withColumn("kind", F.lit(kind)) for kind, (_, records) in W.run_kinds(_kept(v), _sources(v, paired), paired, specs).items()]
    return made[0].unionByName(made[1])


@query()
def run_paired(v):
    """Classified records of both kinds out of the raw records of all callers."""
    return _both_kinds(v, True, C.SPECS)


@query()
def run_single(v):
    """Classified records of both kinds out of the raw records of all callers, for the tumor alone."""
    return _both_kinds(v, False, [*A.SINGLE, A.arbitrary(1)])


#: Every caller as a sample, and the reads that its depths come from.
SAMPLES = {c: "tumor" if i % 2 else "normal" for i, c in enumerate(sorted(C.SUPPLIED))}
SAMPLE_CALLS = "c as (select caller as sample, chrom, pos, ref, filter, unnest(string_split(alt, ',')) as alt from vcf_v), w as (select distinct chrom, pos, ref, alt from c)"
SAMPLE_ROWS = f"(values {', '.join(f'{x}' for x in SAMPLES.items())}) s(sample, reads)"


def _sample_calls(v) -> DataFrame:
    return E.explode_alts(v("vcf_v").withColumnRenamed("caller", "sample")).select("sample", *E.KEY, "filter")


@query(f"with {SAMPLE_CALLS} select w.*, s.sample, coalesce(c.filter, 'NONE') as filter from w, {SAMPLE_ROWS} left join c on c.chrom = w.chrom and c.pos = w.pos and c.ref = w.ref and c.alt = w.alt and c.sample = s.sample")
def fill_missing_samples(v):
    return E.fill_missing_samples(_sample_calls(v), list(SAMPLES), "sample")


DEPTHS = "d as (select chrom, pos, ref, alt, sample, count(*) filter (where cls = 1) as x, count(*) as n from every where mapq >= 1 group by all)"


@query(f"""with {SAMPLE_CALLS}, {BOTH}, {DEPTHS}, t as (select w.*, s.sample, coalesce(c.filter, 'NONE') as f, coalesce(x, 0) as x, coalesce(n, 0) as n from w, {SAMPLE_ROWS} left join c on c.chrom = w.chrom and c.pos = w.pos and c.ref = w.ref and c.alt = w.alt and c.sample = s.sample
   left join d on d.chrom = w.chrom and d.pos = w.pos and d.ref = w.ref and d.alt = w.alt and d.sample = s.reads),
 u as (select *, replace(f, ';', ',') || ':' || cast(x as varchar) || '/' || cast(n as varchar) || '=' || case when n = 0 then 'nan' else format('{{:g}}', x / n) end as said, list_contains(string_split(f, ';'), 'PASS') as met from t)
 select chrom, pos, ref, alt, count(*) filter (where met) as num, {', '.join(f"max(said) filter (where sample = '{c}') as {c}" for c in SAMPLES)} from u group by chrom, pos, ref, alt having count(*) filter (where met) >= 1""")
def tally_samples(v):
    calls = _sample_calls(v)
    depths = V.vaf_by_sample(v("reads_v"), calls)
    of = F.coalesce(*[F.when(F.col("sample") == r, F.array(*[F.lit(c) for c, x in SAMPLES.items() if x == r])) for r in ("tumor", "normal")])
    return E.tally_samples(calls, depths.withColumn("sample", F.explode(of)), list(SAMPLES))


CLUSTERS = """s as (select chrom, pos, min(ref) as r, max(case when filter like '%PASS%' then 1.0 when filter like '%LowQual%' then 0.5 else 0.0 end) as score, list_distinct(flatten(list(string_split(alt, ',')))) as alts from near_v group by chrom, pos),
 m as (select *, case when pos - lag(pos) over (partition by chrom order by pos) <= 2 then 0 else 1 end as new from s), g as (select *, sum(new) over (partition by chrom order by pos) as g from m),
 k as (select chrom, min(pos) over (partition by chrom, g) as first, max(pos) over (partition by chrom, g) as last, pos, list_prepend(r, list_sort(list_filter(alts, lambda x: x <> r))) as options, score from g qualify max(pos) over (partition by chrom, g) - min(pos) over (partition by chrom, g) between 1 and 4)"""


@query(f"with {CLUSTERS} select chrom, first, last, pos, array_to_string(options, ',') as options, score from k")
def neighbour_clusters(v):
    return P.cluster_neighbours(v("near_v"), 2).withColumn("options", F.array_join("options", ","))


@query(f"""with {CLUSTERS}, c as (select chrom, first, last, avg(score) as score from k group by all), places as (select c.chrom, c.first, c.last, p.pos from c, lateral (select unnest(range(c.first, c.last + 1)) as pos) p),
 o as (select f.*, coalesce(k.options, [{BASE.format(pos='f.pos', c='cast(substr(f.chrom, 4) as int)')}]) as options from places f left join k on k.chrom = f.chrom and k.first = f.first and k.pos = f.pos), sites as (select distinct chrom, pos from o), {R.CALLS},
 b as (select o.chrom, o.first, o.last, o.pos, w.read_id, substr(t.seq, w.read_offset + 1, 1) as base, list_position(o.options, substr(t.seq, w.read_offset + 1, 1)) as i from o join site_rows w on w.chrom = o.chrom and w.pos = o.pos and w.kind <> 'unknown' join reads_v t on t.read_id = w.read_id and (t.flag & 4) = 0 and (t.flag & 1024) = 0),
 h as (select chrom, first, last, read_id, list(i order by pos) as hap, string_agg(base, '' order by pos) as text from b where i > 0 group by chrom, first, last, read_id having count(*) = last - first + 1),
 n as (select chrom, first, last, hap, text, count(*) as n, list_sum(hap) = last - first + 1 as plain from h group by all), refs as (select chrom, first, last, string_agg(options[1], '' order by pos) as ref from o group by all)
 select n.chrom, n.first as pos, any_value(r.ref) as ref, string_agg(text, ',' order by hap) filter (where not plain) as alt, case when any_value(c.score) > 2 / 3 then 'PASS' when any_value(c.score) >= 0.5 then 'LowQual' else 'REJECT' end as filter,
  cast(coalesce(sum(n) filter (where plain), 0) as varchar) || ',' || string_agg(cast(n as varchar), ',' order by hap) filter (where not plain) as depths from n join c using (chrom, first, last) join refs r using (chrom, first, last) group by n.chrom, n.first, n.last having count(*) filter (where not plain) > 0""")
def phase_variants(v):
    return P.phase_variants(v("near_v"), v("reads_v"), 2, _reference(v))


LABELLED = "(select mapq, nm, case when flag & 16 <> 0 then null else tlen end as tlen, cast(read_id % 3 = 0 as int) as label from reads_v)".replace("flag & 16 <> 0", "(flag & 16) <> 0")


def _labelled(v) -> DataFrame:
    return v("reads_v").select("chrom", "mapq", "nm", F.when(F.col("flag").bitwiseAND(16) == 0, F.col("tlen")).alias("tlen"), (F.col("read_id") % 3 == 0).cast("int").alias("label"))


LONG = f"(select label, feature, value from (select label, cast(mapq as double) as mapq, cast(nm as double) as nm, cast(tlen as double) as tlen from {LABELLED}) unpivot include nulls (value for feature in (mapq, nm, tlen)))"


@query(f"select feature, label, count(*) - count(value) as nulls, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, min(value) as least, max(value) as most, quantile_disc(value, 0.5) as median, quantile_disc(value, 0.9) as ninth from {LONG} group by feature, label")
def feature_summary(v):
    made = G.feature_summary(_labelled(v), ["mapq", "nm", "tlen"], "label", 1_000_000)
    return made.select("feature", "label", "nulls", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "least", "most", "median", F.col("deciles")[8].alias("ninth"))


@query(f"select feature, label, count(value) as n, min(value) as least, max(value) as most, true as near from {LONG} group by feature, label having count(value) > 0")
def sketched_deciles(v):
    """Sketches kept by contig and merged; ``near`` if the rank of each decile among all rows is off by 1 % at most."""
    labelled = _labelled(v).select("chrom", "label", *[F.col(c).cast("double").alias(c) for c in ("mapq", "nm", "tlen")])
    rows = labelled.unpivot(["chrom", "label"], ["mapq", "nm", "tlen"], "feature", "value").where("value is not null")
    kept = G.merge_sketches(G.quantile_sketches(rows, "value", ("feature", "label", "chrom")), ("feature", "label"))
    made = G.sketch_quantiles(kept, [k / 10 for k in range(11)])
    at = F.transform("quantiles", lambda q: F.struct((F.col("value") < q).cast("long").alias("below"), (F.col("value") <= q).cast("long").alias("upto")))
    counted = rows.join(made, ["feature", "label"]).withColumn("at", at)
    sums = [F.sum(F.col("at")[i][side]).alias(f"{side}{i}") for i in range(11) for side in ("below", "upto")]
    ranks = counted.groupBy("feature", "label", "n", F.col("quantiles")[0].alias("least"), F.col("quantiles")[10].alias("most")).agg(*sums)
    near = [(F.col(f"below{i}") <= (i / 10 + 0.01) * F.col("n")) & (F.col(f"upto{i}") >= (i / 10 - 0.01) * F.col("n")) for i in range(11)]
    return ranks.select("feature", "label", "n", "least", "most", reduce(lambda a, b: a & b, near).alias("near"))


@query(f"""with l as (select * from {LONG} where value is not null), e as (select feature, min(value) as lo, (max(value) - min(value)) / 49 as w from l group by feature), b as (select l.feature, label, cast(least(floor((value - lo) / w), 48) as int) as bin, lo, w from l join e on e.feature = l.feature)
 select feature, label, bin, round(lo + bin * w, 6) as start, count(*) as n, round(count(*) / (sum(count(*)) over (partition by feature, label) * w), 9) as density from b group by feature, label, bin, lo, w""")
def feature_histogram(v):
    made = G.feature_histogram(_labelled(v), ["mapq", "nm", "tlen"], "label")
    return made.withColumns({"start": F.round("start", 6), "density": F.round("density", 9)})


@query(R.CALLABLE.replace(" select chrom, cast(min(start0)", ", runs as (select chrom, cast(min(start0)") + ") select label, cast(sum(end0 - start0) as bigint) as bases from runs group by label")
def callable_summary(v):
    return state_summary(R.callable_regions(v))


@query()
def predicted_scores(v):
    """A classifier of 20 trees trained on the feature rows of the truth set, and its scores by the first 10."""
    rows = settle(_paired(v))
    return M.train_classifier([rows], rounds=20, depth=4).predict(rows, 10).select("CHROM", "POS", "REF", "ALT", M.LABEL, "SCORE")


@query()
def feature_importance(v):
    return M.train_classifier([settle(_single(v))], rounds=10, depth=4).importance()


@query()
def adaboost_scores(v):
    """AdaBoost of 10 trees of 4 levels on the single-sample feature rows, and its scores."""
    rows = settle(_single(v))
    return M.train_classifier([rows], rounds=10, depth=4, loss="exponential").predict(rows).select("CHROM", "POS", "REF", "ALT", M.LABEL, "SCORE")


@query()
def holdout_metrics(v):
    """Precision, sensitivity and F1 of halves scored by models of the other half, twice."""
    return M.repeated_holdout(settle(_single(v)), times=2, rounds=5, depth=3)
