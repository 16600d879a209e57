"""Queries over callers' records: uniform variants, verdicts, annotations and joins with known variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import expressions as X
from callweave.operators import annotate as A
from callweave.operators import ensemble as E
from callweave.operators import normalise as N
from callweave.operators import summaries as M
from callweave.operators import verdicts as V
from callweave.operators.pileup import with_pileup_depths
from callweave.plans.register import query
from callweave.plans.views import as_records
from callweave.sources import text as S


def raw(v) -> DataFrame:
    return as_records(v("raw_v"))


def records(v) -> DataFrame:
    return as_records(v("vcf_v"))


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    """Records with format and samples as text."""
    return df.select("rid", "pos", "ref", "alt", *columns, *[x for x in (F.array_join("format", ":").alias("fmt") if "format" in df.columns else None, F.array_join("samples", " ").alias("smp") if "samples" in df.columns else None) if x is not None])


KIND = "case when length(ref) = 1 and length(alt) = 1 then 'snv' else 'indel' end as kind"


def split_sql(source: str, columns: str) -> str:
    """Distinct single variants of a relation with pos, ref, alt and ``columns``, complex ones decomposed."""
    return f"""select distinct {columns}, pos, ref, alt, {KIND} from (with one as (select {columns}, pos, ref, unnest(string_split_regex(alt, '[,/]')) as alt from {source}), m as (select *, least(length(ref), length(alt)) as m, length(ref) > 1 and length(alt) > 1 as complex from one)
  select {columns}, pos, ref, alt from m where not complex
  union all select {columns}, pos + o, substr(ref, o + 1, 1), substr(alt, o + 1, 1) from (select *, unnest(range(m)) as o from m where complex) where substr(ref, o + 1, 1) <> substr(alt, o + 1, 1)
  union all select {columns}, pos + m - 1, substr(ref, m), substr(ref, m, 1) from m where complex and length(ref) > length(alt)
  union all select {columns}, pos + m - 1, substr(ref, m, 1), substr(ref, m, 1) || substr(alt, m + 1) from m where complex and length(ref) < length(alt))"""


@query("select rid, pos, ref, unnest(string_split_regex(alt, '[,/]')) as alt from raw_v")
def explode_alts(v):
    return E.explode_alts(v("raw_v").select("rid", "pos", "ref", "alt"))


@query(split_sql("raw_v", "rid, filter"))
def split_variants(v):
    return X.split_variants(v("raw_v").select("rid", "filter", "pos", "ref", "alt"))


def _info(key: str) -> str:
    return f"nullif(regexp_extract(info, '(^|;){key}=([^;]+)', 2), '')"


def _alternatives(split: tuple[str, ...], keep: tuple[str, ...], samples: tuple[str, ...], filter_: str = "filter") -> str:
    """Rows by alternative (split at commas) with the info and samples of records that have several."""
    own = [f"'{k}=' || string_split({_info(k)}, ',')[i]" for k in split] + [f"coalesce('{k}=' || {_info(k)}, case when list_contains(string_split(info, ';'), '{k}') then '{k}=True' end)" for k in keep]
    made = ", ".join(f"case when k > 1 then {x} else s{j} end as s{j}" for j, x in enumerate(samples))
    return f"""(select rid, pos, ref, alt1 as alt, {filter_} as filter, fmt, case when k > 1 then concat_ws(';', {', '.join(own)}) else info end as info, {made}
  from (select *, len(string_split(alt, ',')) as k, unnest(string_split(alt, ',')) as alt1, generate_subscripts(string_split(alt, ','), 1) as i from raw_v))"""


def _gt(j: int, kept: str) -> str:
    return f"case when {kept} then s{j} else regexp_replace(s{j}, '^[^:]+', '0/1') end"


GT = [f"split_part(s{j}, ':', 1)" for j in (0, 1)]


def _single(sql: str, samples: str) -> str:
    return f"select rid, pos, ref, alt, filter, info, fmt, {samples} as smp, kind from ({split_sql(sql, 'rid, filter, info, fmt, ' + ('s0, s1' if 's1' in samples else 's0'))})"


@query(_single(_alternatives(("NLOD", "TLOD"), ("STR", "ECNT"), (_gt(0, f"{GT[0]} in ('0/0', '0/1')"), _gt(1, f"({GT[1]} = '0/0' or {GT[0]} = '0/1')"))), "s0 || ' ' || s1"))
def normalise_mutect2(v):
    return _shown(N.normalise_mutect2(raw(v)), "filter", "info", "kind")


@query(_single(_alternatives(("NLOD", "TLOD"), ("STR", "ECNT"), (_gt(0, f"{GT[0]} in ('0/0', '0/1')"),), "case filter when 'germline_risk' then 'PASS' else filter end"), "s0"))
def normalise_mutect2_single(v):
    return _shown(N.normalise_mutect2_single(raw(v).withColumn("samples", F.slice("samples", 1, 1))), "filter", "info", "kind")


@query(f"select rid, pos, ref, alt, filter, info, fmt, s0 as smp, {KIND} from {_alternatives(('REFREP', 'IDREP', 'RU'), ('MQ',), (_gt(0, GT[0] + ' in ' + str(('0/0', '0/1'))),))}")
def normalise_strelka_single(v):
    return _shown(N.normalise_strelka_single(raw(v).withColumn("samples", F.slice("samples", 1, 1))), "filter", "info", "kind")


@query("select rid, pos, ref, alt, 'GT:' || fmt as fmt, '0/1:' || s0 || ' 0/1:' || s1 as smp from raw_v")
def normalise_strelka(v):
    return _shown(N.normalise_strelka(raw(v)))


@query("select rid, pos, regexp_replace(ref, '[^GCTAgcta]', 'N', 'g') as ref, alt, fmt, s0 || ' ' || s1 as smp from raw_v")
def normalise_somatic_sniper(v):
    return _shown(N.normalise_somatic_sniper(raw(v)))


@query("select rid, pos, ref, alt, fmt, s1 || ' ' || s0 as smp from raw_v where ref not like '%N%'")
def pick_samples(v):
    return _shown(N.pick_samples(raw(v), ["T", "N"], "T", "N"))


def _cell(j: int, i: int) -> str:
    return f"split_part(s{j}, ':', {i})"


#: Where RD, AD and the rest stand in the formats of raw_v: GT:RD:AD:DP, GT:AD:RD:ALD:SS and GT:DP.
_JOINED = [f"case rid % 3 when 0 then {_cell(j, 1)} || ':' || {_cell(j, 2)} || ',' || {_cell(j, 3)} || ':' || {_cell(j, 4)} when 1 then {_cell(j, 1)} || ':' || {_cell(j, 3)} || ',' || {_cell(j, 2)} || ':' || {_cell(j, 4)} || ':' || {_cell(j, 5)} else s{j} end" for j in (0, 1)]
_JOINED_KEYS = "case rid % 3 when 0 then 'GT:AD:DP' when 1 then 'GT:AD:ALD:SS' else fmt end"


@query(f"""with a as (select *, string_split(regexp_replace(replace(alt, '/', ','), '[^a-zA-Z0-9_,.]', '', 'g'), ',') as alts, regexp_replace(ref, '[^a-zA-Z0-9_].*$', '') as ref1 from raw_v),
 b as (select *, case when len(alts) = 2 and alts[1] = alts[2] then alts[1:1] else alts end as distinct_alts from a),
 c as (select *, case when len(distinct_alts) > 1 and list_contains(distinct_alts, ref1) then list_filter(distinct_alts, lambda x: x <> ref1) else distinct_alts end as others from b)
 select rid, pos, ref1 as ref, case when len(distinct_alts) > 1 then array_to_string(others[1:1] || list_filter(others[2:], lambda x: starts_with(x, ref1)), ',') else distinct_alts[1] end as alt, {_JOINED_KEYS} as fmt, {_JOINED[0]} || ' ' || {_JOINED[1]} as smp from c where not regexp_matches(ref1, '[^GCTAUgctau]')""")
def normalise_varscan2(v):
    return _shown(N.normalise_varscan2(raw(v)))


def _share(j: int) -> str:
    ad, rd = (f"cast(case rid % 3 when 0 then {_cell(j, a)} else {_cell(j, b)} end as double)" for a, b in ((3, 2), (2, 3)))
    return f"case when {ad} + {rd} = 0 then 0 else {ad} / ({ad} + {rd}) end"


@query(f"""select rid, pos, ref, alt, case when rid % 3 < 2 then 'GT:' || {_JOINED_KEYS} else fmt end as fmt, case when rid % 3 = 2 then s0 || ' ' || s1 else
  case when {_share(0)} > 0.8 then '1/1' when {_share(0)} > 0.25 then '0/1' else '0/0' end || ':' || {_JOINED[0]} || ' ' || case when {_share(1)} > 0.8 then '1/1' else '0/1' end || ':' || {_JOINED[1]} end as smp from (select * from raw_v where rid % 3 < 2 union all select * from raw_v where rid % 3 = 2)""".replace("cast(case rid % 3", "try_cast(case rid % 3"))
def normalise_joint_snv_mix2(v):
    return _shown(N.normalise_joint_snv_mix2(raw(v)))


_FOUR = [f"case rid % 3 when 0 then {_cell(j, 1)} || ':' || {_cell(j, 4)} || ':' || {_cell(j, 2)} || ',' || {_cell(j, 3)} when 1 then {_cell(j, 1)} || ':' || {_cell(j, 2)} || ':' || {_cell(j, 5)} || ':' || {_cell(j, 3)} || ',' || {_cell(j, 4)} end" for j in (0, 1)]


@query(f"""with a as (select rid, pos, regexp_replace(ref, '[^GCTAgcta]', 'N', 'g') as ref, regexp_replace(alt, '[^GCTAgcta]', 'N', 'g') as alt, regexp_replace(info, 'END=[0-9]+;', '', 'g') as info,
  case rid % 3 when 0 then 'GT:DP:DP4' when 1 then 'GT:AD:SS:DP4' else fmt end as fmt, case when rid % 3 = 2 then s0 || ' ' || s1 else {_FOUR[1]} || ' ' || {_FOUR[0]} end as smp from raw_v where ref <> alt)
 select distinct rid, pos, ref, alt, info, fmt, smp, case when info like '%TYPE=SNV%' then 'snv' else 'indel' end as kind from a where info not like '%TYPE=Complex%'
 union all select rid, pos, ref, alt, info, fmt, smp, kind from ({split_sql("(select * from a where info like '%TYPE=Complex%')", 'rid, info, fmt, smp')})""")
def normalise_vardict(v):
    return _shown(N.normalise_vardict(raw(v)), "info", "kind")


PARTS = {"MuTect2": 0, "VarScan2": 1, "Strelka": 2, "Caller_1": 3}


@query(f"""with inside as (select r.* from raw_v r where exists (select 1 from regions_v g where g.chrom = r.chrom and g.label = 'F' and g.start0 < r.pos - 1 + length(r.ref) and r.pos - 1 < g.end0) and not exists (select 1 from regions_v g where g.chrom = r.chrom and g.label = 'O' and g.start0 < r.pos - 1 + length(r.ref) and r.pos - 1 < g.end0))
 select caller, kind, count(*) as n, count(distinct chrom || pos || ref || '>' || alt) as variants from (
  select 'Platypus' as caller, chrom, pos, ref, alt, kind from ({split_sql("(select * from inside where rid % 3 = 0)", 'rid, chrom')})
  union all select 'Strelka', chrom, pos, ref, alt, {KIND} from inside where rid % 3 = 1
  union all select 'Caller_1', chrom, pos, ref, alt, kind from ({split_sql("(select * from inside where rid % 3 = 2)", 'rid, chrom')})) group by caller, kind""")
def combine_paired(v):
    rows, r = raw(v), v("regions_v")
    calls = {c: rows.where(f"rid % 3 = {k}") for k, c in enumerate(("Platypus", "Strelka", "Caller_1"))}
    made = N.combine(calls, include=r.where("label = 'F'"), exclude=r.where("label = 'O'"))
    return made.groupBy("caller", "kind").agg(F.count("*").alias("n"), F.countDistinct(F.concat("chrom", "pos", "ref", F.lit(">"), "alt")).alias("variants"))


@query(f"select distinct pos, ref, alt from (select pos, ref, alt, kind from ({split_sql('(select * from raw_v where rid % 2 = 0)', 'rid')}) union all select pos, ref, alt, kind from ({split_sql('(select * from raw_v where rid % 2 = 1)', 'rid')})) where kind = 'snv'")
def combine_single(v):
    rows = raw(v)
    made = N.combine({"LoFreq": rows.where("rid % 2 = 0"), "Caller_1": rows.where("rid % 2 = 1")}, N.SINGLE)
    return N.sites(made, "snv").select("pos", "ref", "alt").distinct()


SOMATIC = "(list_contains(string_split(info, ';'), 'SOMATIC') or regexp_matches(info, '(^|;)SOMATIC='))"
REFUSED = "['d7', 'd5', 'DIFF0.2', 'LongAT', 'MAF0.05', 'MSI6', 'NM4', 'NM4.25', 'pSTD', 'SN1.5']"
PHRED = "case when {p} = 0 then {cap} when {p} = 1 then 0.0 else least(-10 * log10({p}), {cap}) end"


@query(f"""with p as (select *, string_split(filter, ';') as fs, coalesce(try_cast({_info('SSF')} as double), 0) as ssf, coalesce(try_cast({_info('VD')} as double), 0) as vd, info like '%Somatic%' as says from records_v)
 select site, case when list_contains(fs, 'PASS') then 1.0 else 0.0 end as pass_word, case when filter = 'PASS' then 1.0 else 0.0 end as pass_only, case when filter like '%PASS%' then 1.0 else 0.0 end as pass_within,
 case when list_contains(fs, 'PASS') and {SOMATIC} then 1.0 else 0.0 end as somatic_and_pass, case when filter like '%PASS%' or {SOMATIC} then 1.0 else 0.0 end as somatic_or_pass, case when {SOMATIC} then 1.0 else 0.0 end as somatic_flag,
 case when filter = 'PASS' then 1.0 when regexp_full_match(filter, 'Tier[1-5]') then 1 - cast(substr(filter, 5) as int) / 10.0 else 0.0 end as tiered, case when {SOMATIC} then case when filter = 'PASS' then 1.0 else 0.5 end else 0.0 end as somatic_half,
 case when says and filter = 'PASS' then 1.0 when says and len(fs) <= 2 and not list_has_any(fs, {REFUSED}) and not (list_contains(fs, 'P0.05') and ssf >= 0.15) and not (list_has_any(fs, ['v3', 'v4']) and vd < 3) then 0.5 else 0.0 end as tolerated from p""")
def caller_verdicts(v):
    return V.with_verdicts(v("records_v"), list(V.VERDICTS)).select("site", *V.VERDICTS)


def _number(key: str) -> str:
    return f"try_cast({_info(key)} as double)"


#: Verdicts and metrics of the callers of vcf_v, as {column: (caller, expression)}.
VERDICT_SQL = {
    "if_MuTect": ("MuTect2", f"case when {SOMATIC} or filter like '%PASS%' then 1.0 else 0.0 end"), "if_VarScan2": ("VarScan2", f"case when {SOMATIC} then 1.0 else 0.0 end"),
    "if_SomaticSniper": ("SomaticSniper", "case when split_part(s1, ':', 2) = '2' then 1.0 else 0.0 end"),
    "if_VarDict": ("VarDict", f"case when info like '%Somatic%' and filter = 'PASS' then 1.0 when info like '%Somatic%' and len(string_split(filter, ';')) <= 2 and not list_has_any(string_split(filter, ';'), {REFUSED}) and not (list_contains(string_split(filter, ';'), 'P0.05') and {_number('SSF')} >= 0.15) and not (list_has_any(string_split(filter, ';'), ['v3', 'v4']) and try_cast(split_part(s0, ':', 3) as int) < 3) then 0.5 else 0.0 end"),
    "MuSE_Tier": ("MuSE", "case filter when 'PASS' then 1.0 when 'Tier2' then 0.8 when 'Tier4' then 0.6 else 0.0 end"), "if_Strelka": ("Strelka", "case when filter like '%PASS%' then 1.0 else 0.0 end"),
    "if_Caller_1": ("Caller_1", "case when filter like '%REJECT%' then 0.0 when filter like '%LowQual%' then 0.5 else 1.0 end"),
}
METRIC_SQL = {
    "M2_NLOD": ("MuTect2", _number("NLOD")), "M2_TLOD": ("MuTect2", _number("TLOD")), "M2_STR": ("MuTect2", "case when list_contains(string_split(info, ';'), 'STR') then 1.0 else 0.0 end"), "M2_ECNT": ("MuTect2", _number("ECNT")),
    "Sniper_Score": ("SomaticSniper", "case when split_part(s1, ':', 2) = '2' then try_cast(split_part(s1, ':', 3) as double) end"),
    "VarDict_Score": ("VarDict", f"round({PHRED.format(p=_number('SSF'), cap='100.0')}, 9)"), "MSI": ("VarDict", _number("MSI")), "MSILEN": ("VarDict", _number("MSILEN")), "SHIFT3": ("VarDict", _number("SHIFT3")),
    "Strelka_Score": ("Strelka", _number("SomaticEVS")), "Strelka_QSS": ("Strelka", _number("QSS")), "Strelka_TQSS": ("Strelka", _number("TQSS")),
}
SUPPLIED = {"MuTect2", "VarScan2", "SomaticSniper", "VarDict", "MuSE", "Strelka", "Caller_1"}
SPECS = [*A.PAIRED, A.arbitrary(1)]
JOINED = f"""one as (select * exclude (alt), unnest(string_split(alt, ',')) as alt from vcf_v), wide as (select chrom, pos, ref, alt, {', '.join(f"coalesce(max({e}) filter (where caller = '{c}'), 0.0) as {n}" for n, (c, e) in VERDICT_SQL.items())},
  {', '.join(f"max({e}) filter (where caller = '{c}') as {n}" for n, (c, e) in METRIC_SQL.items())} from one group by chrom, pos, ref, alt)"""


@query(f"with {JOINED} select * from wide")
def join_sources(v):
    calls = records(v)
    made = A.join_sources(E.union_variants(calls), calls, SPECS, SUPPLIED)
    return made.select(*E.KEY, *VERDICT_SQL, *METRIC_SQL).withColumn("VarDict_Score", F.round("VarDict_Score", 9))


@query(f"with {JOINED} select chrom, pos, ref, alt, {' + '.join(VERDICT_SQL)} as votes from wide where {' + '.join(VERDICT_SQL)} >= 0.5")
def candidate_votes(v):
    calls = records(v)
    made = A.join_sources(E.union_variants(calls), calls, SPECS, SUPPLIED).withColumn("votes", A.votes(SPECS))
    return E.min_callers(made, 0.5).select(*E.KEY, "votes")


@query(f"with {JOINED} select chrom, pos, ref, alt, if_VarScan2, cast(null as double) as if_MuTect, cast(null as double) as M2_TLOD, MSI from wide where {' + '.join(c for c in VERDICT_SQL if c != 'if_MuTect')} > 0")
def subset_callers(v):
    calls = records(v)
    wide = A.join_sources(E.union_variants(calls), calls, SPECS, SUPPLIED)
    return E.subtract_callers(wide, ["if_MuTect"], list(VERDICT_SQL)).select(*E.KEY, "if_VarScan2", "if_MuTect", "M2_TLOD", "MSI")


@query("""select c.chrom, c.pos, c.ref, c.alt, case when k.id is null then 0 else 1 end as if_dbsnp, case when k.info like '%COMMON=1%' then 1 else 0 end as COMMON, coalesce(k.id, '') as rs,
  case when k.id is null or k.info like '%;SNP;%' then 0 else 1 end as if_COSMIC, case when k.id is null then 0.0 when k.info like '%;SNP;%' then null else cast(regexp_extract(k.info, 'CNT=([0-9]+)', 1) as double) end as COSMIC_CNT
 from (select distinct chrom, pos, ref, alt from calls_v) c left join known_v k on k.chrom = c.chrom and k.pos = c.pos and k.ref = c.ref and k.alt = c.alt""")
def known_variants(v):
    made = A.with_cosmic(A.with_dbsnp(v("calls_v").select(*E.KEY).distinct(), v("known_v")), v("known_v"))
    return made.select(*E.KEY, "if_dbsnp", "COMMON", F.coalesce(F.array_join("rs_ids", ","), F.lit("")).alias("rs"), "if_COSMIC", "COSMIC_CNT")


@query("""select c.chrom, c.pos, c.ref, c.alt, coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(string_split_regex(concat_ws(';', c.id, k.id), '[;,]'), lambda x: x not in ('.', '')))), ';'), ''), '.') as id,
  concat_ws(';', 'DP=1', 'GENE=' || regexp_extract(k.info, 'GENE=([^;]+)', 1), 'CNT=' || regexp_extract(k.info, 'CNT=([^;]+)', 1)) as info
 from (select distinct chrom, pos, ref, alt, case when pos % 2 = 0 then 'x;rs1' else '.' end as id from calls_v) c left join known_v k on k.chrom = c.chrom and k.pos = c.pos and k.ref = c.ref and k.alt = c.alt""")
def transfer_info(v):
    calls = v("calls_v").select(*E.KEY).distinct().withColumns({"id": F.when(F.col("pos") % 2 == 0, "x;rs1").otherwise("."), "info": F.lit("DP=1")})
    return A.transfer_info(calls, v("known_v"), A.COSMIC_KEYS)


@query("""select site, case when regexp_matches(id, 'rs[0-9]+') then 1 else 0 end as if_dbsnp, case when regexp_matches(id, 'COS[MN][0-9]+') then 1 else 0 end as if_cosmic, case when list_contains(string_split(info, ';'), 'COMMON=1') then 1 else 0 end as if_common,
 coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(string_split_regex(concat_ws(',', id, 'FalsePositive'), '[,;]'), lambda x: x <> '.'))), ';'), ''), '.') as ids, len(string_split(info, ';')) as n_items, try_cast(nullif(regexp_extract(info, '(^|;)TLOD=([^;]+)', 2), '') as double) as tlod from records_v""")
def identifiers(v):
    flags = X.id_flags()
    merged = X.merge_identifiers(F.split("id", "[,;]"), F.array(F.lit("FalsePositive")))
    return v("records_v").select("site", *[flags[k].alias(k) for k in ("if_dbsnp", "if_cosmic", "if_common")], merged.alias("ids"), F.size(X.info_items("info")).cast("long").alias("n_items"), X.caller_metrics()["TLOD"].alias("tlod"))


@query("""with a as (select site, unnest(string_split(regexp_extract(effects, 'ANN=([^;]+)', 1), ',')) as x, generate_subscripts(string_split(regexp_extract(effects, 'ANN=([^;]+)', 1), ','), 1) as i from records_v),
 b as (select *, string_split(x, '|') as f from a), c as (select * from b where f[4] <> '' and regexp_matches(f[11], 'p\\.[a-zA-Z]+[0-9]+[a-zA-Z]+') and regexp_extract(f[11], 'p\\.([a-zA-Z]+)[0-9]+([a-zA-Z]+)', 1) <> regexp_extract(f[11], 'p\\.([a-zA-Z]+)[0-9]+([a-zA-Z]+)', 2))
 select r.site, coalesce(string_agg(f[4], ',' order by i), '') as genes, coalesce(string_agg(f[11], ',' order by i), '') as changes, coalesce(string_agg(f[7], ',' order by i), '') as transcripts from records_v r left join c on c.site = r.site group by r.site""")
def effect_annotations(v):
    told = X.effect_annotations("effects")
    return v("records_v").select("site", F.array_join(told["genes"], ",").alias("genes"), F.array_join(told["aa_changes"], ",").alias("changes"), F.array_join(told["transcripts"], ",").alias("transcripts"))


@query("select rid, pos, alt, split_part(s0, ':', case rid % 3 when 0 then 4 when 1 then 6 else 2 end) as dp, len(string_split(fmt, ':')) as keys, case rid % 3 when 1 then split_part(s1, ':', 5) end as ss from raw_v".replace("when 1 then 6 else 2 end) as dp", "else 2 end) as dp").replace("split_part(s0, ':', case rid % 3 when 0 then 4 else 2 end) as dp", "case when rid % 3 = 1 then null else split_part(s0, ':', case rid % 3 when 0 then 4 else 2 end) end as dp"))
def sample_values(v):
    made = raw(v).withColumns({"dp": S.sample_value("DP"), "keys": F.size(S.format_keys()).cast("long"), "ss": F.try_element_at(S.sample_map(1), F.lit("SS"))})
    return made.select("rid", "pos", "alt", "dp", "keys", "ss")


@query("select rid, ref, alt from raw_v where not regexp_matches(ref, '[^GCTAUgctau]')")
def drop_odd_reference(v):
    return V.drop_odd_reference(v("raw_v")).select("rid", "ref", "alt")


@query("select rid, ref, alt from raw_v where ref <> alt")
def drop_ref_equals_alt(v):
    return V.drop_ref_equals_alt(v("raw_v")).select("rid", "ref", "alt")


@query("select read_id, regexp_full_match(c, '(chr)?([1-9]|1[0-9]|2[0-2]|[XY]|MT?)') and regexp_full_match(quals, '[!-J]*') as valid from (select read_id, quals, case when read_id % 3 = 0 then chrom else 'chr' || cast(read_id % 30 as varchar) end as c from reads_v)")
def valid_records(v):
    rows = v("reads_v").withColumns({"chrom": F.when(F.col("read_id") % 3 == 0, F.col("chrom")).otherwise(F.concat(F.lit("chr"), (F.col("read_id") % 30).cast("string"))), "pos": F.col("start0")})
    return V.valid_records(rows, quals="quals").select("read_id", "valid")


@query("""with m as (select read_id, case when read_id % 4 = 0 then 'REJECT' else 'PASS' end as f, mapq as a, read_id % 50 as b, read_id % 6 as n, read_id % 13 as z, (read_id % 7) / 100.0 as w, read_id % 9 as d from reads_v)
 select read_id, case when f = 'PASS' and cast(a < 40 as int) + cast(b < 20 as int) + cast(n > 3 as int) + cast(z > 10 as int) + cast(w < 0.01 as int) + cast(d < 5 as int) >= 3 then 'LowQual' else f end as filter from m""")
def demote_pass(v):
    i = F.col("read_id")
    rows = v("reads_v").select("read_id", F.when(i % 4 == 0, "REJECT").otherwise("PASS").alias("filter"), F.col("mapq").alias("refMQ"), (i % 50).alias("refBQ"), (i % 6).alias("refNM"), (i % 13).alias("MQ0"), ((i % 7) / 100.0).alias("VAF"), (i % 9).alias("DP"), (i - 5).alias("zMQ"))
    return V.demote_pass(rows, fails=3).select("read_id", "filter")


@query(f"""select read_id, round({PHRED.format(p='(read_id % 101) / 100.0', cap='1001.0')}, 2) as phred, round(pow(10.0, -mapq / 10.0), 2) as fraction, round(read_id / 7.0, 2) as plain, round(case when aaab + aabb = 0 then 0.0 when aaab + aabb = 1 then 50.0 else least(-10 * log10(1 - aaab - aabb), 50.0) end, 6) as joint
 from (select *, (read_id % 4) / 8.0 as aaab, (read_id % 3) / 8.0 as aabb from reads_v)""")
def rescaled_scores(v):
    i = F.col("read_id")
    rows = v("reads_v").withColumn("info", F.concat(F.lit("AAAB="), (i % 4) / 8.0, F.lit(";AABB="), (i % 3) / 8.0))
    return rows.select("read_id", X.rescale((i % 101) / F.lit(100.0), "fraction", "phred").alias("phred"), X.rescale(F.col("mapq").cast("double"), "phred", "fraction").alias("fraction"), X.rescale(i / F.lit(7.0)).alias("plain"), F.round(V.joint_score(), 6).alias("joint"))


@query("""with p as (select p.*, c.ref as r, c.alt as a from (select chrom, pos, min(bases) as bases from pileup_v group by chrom, pos) p right join (select distinct chrom, pos, ref, alt from calls_v) c on c.chrom = p.chrom and c.pos = p.pos)
 select c.chrom, c.pos, c.ref, c.alt, case when p.bases is null then '.,.,.,.' else cast(length(b) - length(replace(b, '.', '')) as varchar) || ',' || cast(length(b) - length(replace(b, ',', '')) as varchar) || ',' || cast(length(b) - length(replace(b, c.alt, '')) as varchar) || ',' || cast(length(b) - length(replace(b, lower(c.alt), '')) as varchar) end as plDP4
 from (select distinct chrom, pos, ref, alt from calls_v) c left join (select chrom, pos, min(bases) as bases, regexp_replace(regexp_replace(regexp_replace(min(bases), '\\^.', '', 'g'), '\\+2AC|-3ttt', '', 'g'), '\\$', '', 'g') as b from pileup_v group by chrom, pos) p on p.chrom = c.chrom and p.pos = c.pos""")
def pileup_at_variants(v):
    pile = v("pileup_v").groupBy("chrom", "pos").agg(F.min("bases").alias("bases"))
    return with_pileup_depths(v("calls_v").select(*E.KEY).distinct(), pile).select(*E.KEY, "plDP4")


@query("""select substitution, is_true as label, count(*) as n from (select case when ref || alt in ('GC', 'CG') then 'GC2CG' when ref || alt in ('GT', 'CA') then 'GC2TA' when ref || alt in ('GA', 'CT') then 'GC2AT' when ref || alt in ('TA', 'AT') then 'TA2AT' when ref || alt in ('TG', 'AC') then 'TA2GC' when ref || alt in ('TC', 'AG') then 'TA2CG' end as substitution,
 case when t.pos is null then 0 else 1 end as is_true from (select distinct chrom, pos, ref, alt from calls_v) c left join truth_v t using (chrom, pos, ref, alt)) where substitution is not null group by substitution, is_true""")
def substitution_counts(v):
    return M.substitution_counts(E.label_truth(v("calls_v").select(*E.KEY).distinct(), v("truth_v")))
