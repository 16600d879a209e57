"""Wide feature rows of variants: callers' verdicts and metrics, known variants, reads of the samples, the sequence around.

``paired_features`` and ``single_features`` are plans over their inputs; ``features_to_records`` makes classified
variant records of their rows, ``run_paired`` and ``run_single`` go from callers' records to classified records.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.count_tests import fisher_exact
from callweave.functions.expressions import general, genotype, id_flags, merge_identifiers, odds_ratio, p2phred, rescale, vaf
from callweave.operators import annotate as A
from callweave.operators import normalise as N
from callweave.operators import verdicts as V
from callweave.operators.ensemble import KEY, consensus_label
from callweave.operators.evidence import site_read_features
from callweave.operators.reference import sequence_features
from callweave.storage import settle

#: Columns of a sample's read features, as {name of ``site_read_features``: column}; B is tBAM or nBAM, S is T or N.
SAMPLE_COLUMNS = {
    "dp": "S_DP", "ref_mq": "B_REF_MQ", "alt_mq": "B_ALT_MQ", "p_mannwhitneyu_mq": "B_p_MannWhitneyU_MQ", "ref_bq": "B_REF_BQ", "alt_bq": "B_ALT_BQ",
    "p_mannwhitneyu_bq": "B_p_MannWhitneyU_BQ", "ref_edit_distance": "B_REF_NM", "alt_edit_distance": "B_ALT_NM", "edit_distance_difference": "B_NM_Diff",
    "ref_concordant_reads": "B_REF_Concordant", "ref_discordant_reads": "B_REF_Discordant", "alt_concordant_reads": "B_ALT_Concordant", "alt_discordant_reads": "B_ALT_Discordant",
    "concordance_fet": "B_Concordance_FET", "ref_call_forward": "S_REF_FOR", "ref_call_reverse": "S_REF_REV", "alt_call_forward": "S_ALT_FOR", "alt_call_reverse": "S_ALT_REV",
    "strandbias_fet": "B_StrandBias_FET", "p_mannwhitneyu_endpos": "B_p_MannWhitneyU_EndPos", "ref_soft_clipped_reads": "B_REF_Clipped_Reads", "alt_soft_clipped_reads": "B_ALT_Clipped_Reads",
    "clipping_fet": "B_Clipping_FET", "mq0_reads": "B_MQ0", "noise_read_count": "B_Other_Reads", "poor_read_count": "B_Poor_Reads",
    "ref_indel_3bp": "B_REF_InDel_3bp", "ref_indel_2bp": "B_REF_InDel_2bp", "ref_indel_1bp": "B_REF_InDel_1bp",
    "alt_indel_3bp": "B_ALT_InDel_3bp", "alt_indel_2bp": "B_ALT_InDel_2bp", "alt_indel_1bp": "B_ALT_InDel_1bp",
}


def _named(column: str, sample: str) -> str:
    return column.replace("B_", f"{sample.lower()}BAM_", 1) if column.startswith("B_") else column.replace("S_", f"{sample}_", 1)


def _block(sample: str) -> list[str]:
    return [_named(c, sample) for c in SAMPLE_COLUMNS.values()]


_HEAD = ["CHROM", "POS", "ID", "REF", "ALT"]
_KNOWN = ["if_dbsnp", "COMMON", "if_COSMIC", "COSMIC_CNT", "Consistent_Mates", "Inconsistent_Mates", "Seq_Complexity_Span", "Seq_Complexity_Adj"]
_REPEATS = ["MSI", "MSILEN", "SHIFT3", "MaxHomopolymer_Length", "SiteHomopolymer_Length"]
#: The order of the columns.
PAIRED_COLUMNS = [
    *_HEAD, "if_MuTect", "if_VarScan2", "if_JointSNVMix2", "if_SomaticSniper", "if_VarDict", "MuSE_Tier", "if_LoFreq", "if_Scalpel", "if_Strelka", "if_TNscope", "if_Platypus",
    "Strelka_Score", "Strelka_QSS", "Strelka_TQSS", "VarScan2_Score", "SNVMix2_Score", "Sniper_Score", "VarDict_Score", *_KNOWN, *_block("N"),
    "M2_NLOD", "M2_TLOD", "M2_STR", "M2_ECNT", "SOR", *_REPEATS, *_block("T"), "InDel_Length",
]
SINGLE_COLUMNS = [
    *_HEAD, "if_MuTect", "if_Strelka", "if_VarScan2", "if_VarDict", "if_LoFreq", "if_Scalpel", "VarScan2_Score", *_KNOWN, "M2_TLOD", "M2_ECNT", *_REPEATS, *_block("T"), "InDel_Length",
]
LABEL = "TrueVariant_or_False"
#: Defaults of the pipeline.
MIN_CALLER, MIN_MQ, MIN_BQ = 0.5, 1, 5


@dataclass
class Sources:
    """What features are made of; all but calls, reference and tumor reads may be absent."""

    calls: DataFrame
    reference: DataFrame
    tumor: DataFrame
    normal: DataFrame | None = None
    truth: DataFrame | None = None
    dbsnp: DataFrame | None = None
    cosmic: DataFrame | None = None
    supplied: set[str] | None = None
    #: By sample (T, N), read features that are made already, of these variants and others.
    made: dict[str, DataFrame] = field(default_factory=dict)


def _sample_features(rows: DataFrame, keys: DataFrame, s: Sources, sample: str, min_mq: int, min_bq: int, scale: str | None) -> DataFrame:
    """Rows with a sample's read features under the columns' names; tests are rescaled, mates come as they are."""
    made = s.made[sample] if sample in s.made else site_read_features(s.tumor if sample == "T" else s.normal, keys, min_mq, min_bq)
    columns = [(rescale(F.col(c), "fraction", scale) if c.endswith("_fet") else F.col(c)).alias(_named(n, sample)) for c, n in SAMPLE_COLUMNS.items()]
    mates = [F.col(c).alias(f"__{sample}_{c}") for c in ("consistent_mates", "inconsistent_mates")]
    return rows.join(made.select(*KEY, *columns, *mates), KEY, "left")


def _voted(sites: DataFrame, s: Sources, specs: list[A.CallerSpec], min_caller: float) -> DataFrame:
    """Sites with the callers' verdicts.

    Those with too few votes go before any reads are joined; those left are settled, as every later join uses them.
    """
    own = {c: F.col(c) if c in sites.columns else F.lit(".") for c in ("id", "info")}
    rows = A.join_sources(sites.select(*KEY, *[v.alias(c) for c, v in own.items()]), s.calls, specs, s.supplied)
    return settle(rows.where(A.votes(specs) >= min_caller))


def _features(rows: DataFrame, s: Sources, min_mq: int, min_bq: int, scale: str | None) -> tuple[DataFrame, DataFrame]:
    """All columns of voted rows but those that only one mode has, and the variants' keys."""
    keys = rows.select(*KEY)
    flags = id_flags()
    rows = rows.withColumns({"if_dbsnp": flags["if_dbsnp"], "COMMON": flags["if_common"], "if_COSMIC": flags["if_cosmic"], "COSMIC_CNT": flags["cosmic_count"], "__ids": F.split("id", ";")})
    identifiers = [F.col("__ids")]
    if s.truth is None:
        rows = rows.withColumn(LABEL, F.lit(None).cast("int"))
    else:
        known = s.truth.select(*KEY).distinct().withColumn("__true", F.lit(1))
        rows = rows.join(known, KEY, "left").withColumn(LABEL, F.coalesce("__true", F.lit(0))).drop("__true")
        identifiers.append(F.array(F.when(F.col(LABEL) == 1, "TruePositive").otherwise("FalsePositive")))
    if s.dbsnp is not None:
        rows = A.with_dbsnp(rows.drop("if_dbsnp", "COMMON"), s.dbsnp)
        identifiers.append(F.col("rs_ids"))
    if s.cosmic is not None:
        rows = A.with_cosmic(rows.drop("if_COSMIC", "COSMIC_CNT"), s.cosmic)
        identifiers.append(F.col("cosmic_ids"))
    rows = rows.withColumn("__ID", merge_identifiers(*identifiers)).drop("__ids", "rs_ids", "cosmic_ids", "id", "info").withColumnRenamed("__ID", "ID")
    rows = sequence_features(rows, s.reference)
    rows = _sample_features(rows, keys, s, "T", min_mq, min_bq, scale)
    rows = rows.withColumnsRenamed({
        "complexity_span": "Seq_Complexity_Span", "complexity_adjacent": "Seq_Complexity_Adj", "max_homopolymer": "MaxHomopolymer_Length", "site_homopolymer": "SiteHomopolymer_Length",
        "__T_consistent_mates": "Consistent_Mates", "__T_inconsistent_mates": "Inconsistent_Mates",
    })
    return rows.withColumn("InDel_Length", F.length("alt") - F.length("ref")), keys


def _finished(rows: DataFrame, columns: list[str], specs: list[A.CallerSpec]) -> DataFrame:
    extra = [s.column for s in specs if s.column not in columns]
    return rows.withColumnsRenamed({"chrom": "CHROM", "pos": "POS", "ref": "REF", "alt": "ALT"}).select(*columns, *extra, LABEL)


def _paired_rows(rows: DataFrame, sources: Sources, specs: list[A.CallerSpec], min_mq: int, min_bq: int, scale: str | None) -> DataFrame:
    rows, keys = _features(rows, sources, min_mq, min_bq, scale)
    rows = _sample_features(rows, keys, sources, "N", min_mq, min_bq, scale)
    n_ref, n_alt, t_ref, t_alt = (F.col(f"{s}_{a}_FOR") + F.col(f"{s}_{a}_REV") for s in "NT" for a in ("REF", "ALT"))
    enriched = p2phred(fisher_exact(t_alt, n_alt, t_ref, n_ref, greater=True))
    scores = {c: rescale(F.col(c), "phred", scale) for c in ("SNVMix2_Score", "Sniper_Score", "VarDict_Score")}
    return _finished(rows.withColumns({"SOR": odds_ratio(n_ref, n_alt, t_ref, t_alt), "VarScan2_Score": rescale(enriched, "phred", scale), **scores}), PAIRED_COLUMNS, specs)


def _single_rows(rows: DataFrame, sources: Sources, specs: list[A.CallerSpec], min_mq: int, min_bq: int, scale: str | None) -> DataFrame:
    return _finished(_features(rows, sources, min_mq, min_bq, scale)[0], SINGLE_COLUMNS, specs)


def paired_features(sites: DataFrame, sources: Sources, specs: list[A.CallerSpec] = A.PAIRED, min_caller: float = MIN_CALLER, min_mq: int = MIN_MQ, min_bq: int = MIN_BQ, scale: str | None = None) -> DataFrame:
    """``PAIRED_COLUMNS``, a column for each added caller, and the label."""
    return _paired_rows(_voted(sites, sources, specs, min_caller), sources, specs, min_mq, min_bq, scale)


def single_features(sites: DataFrame, sources: Sources, specs: list[A.CallerSpec] = A.SINGLE, min_caller: float = MIN_CALLER, min_mq: int = MIN_MQ, min_bq: int = MIN_BQ, scale: str | None = None) -> DataFrame:
    """``SINGLE_COLUMNS``, a column for each added caller, and the label."""
    return _single_rows(_voted(sites, sources, specs, min_caller), sources, specs, min_mq, min_bq, scale)


#: Letters of callers in the field that says which of them called a variant.
LETTERS = {
    "if_MuTect": "M", "if_VarScan2": "V", "if_JointSNVMix2": "J", "if_SomaticSniper": "S", "if_VarDict": "D", "MuSE_Tier": "U", "if_LoFreq": "L", "if_Scalpel": "P",
    "if_Strelka": "K", "if_TNscope": "T", "if_Platypus": "Y",
}
#: Keys of a sample in classified records.
FORMAT = "GT:DP4:CD4:refMQ:altMQ:refBQ:altBQ:refNM:altNM:fetSB:fetCD:uMQ:uBQ:MQ0:VAF"


def _sample_text(sample: str) -> Column:
    b, count = f"{sample.lower()}BAM_", lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    number = lambda c: F.coalesce(general(F.col(c).cast("double")), F.lit("."))
    depth = [count(f"{sample}_{c}") for c in ("REF_FOR", "REF_REV", "ALT_FOR", "ALT_REV")]
    pairs = [count(b + c) for c in ("REF_Concordant", "REF_Discordant", "ALT_Concordant", "ALT_Discordant")]
    measures = [number(b + c) for c in ("REF_MQ", "ALT_MQ", "REF_BQ", "ALT_BQ", "REF_NM", "ALT_NM", "StrandBias_FET", "Concordance_FET", "p_MannWhitneyU_MQ", "p_MannWhitneyU_BQ")]
    share = general(vaf(depth[2] + depth[3], depth[0] + depth[1]), 3)
    four = lambda x: F.concat_ws(",", *[c.cast("string") for c in x])
    return F.concat_ws(":", genotype(*depth), four(depth), four(pairs), *measures, F.coalesce(F.col(b + "MQ0").cast("string"), F.lit(".")), share)


def features_to_records(features: DataFrame, tools: list[str], paired: bool = True, passes: float = 0.5, low: float = 0.1, keep_rejects: bool = True, phred: bool = True) -> DataFrame:
    """Classified records of feature rows: by SCORE where there is one, else by how many of ``tools`` (verdict columns) call a variant.

    The info field has each tool's call in the order of ``tools``, their number, the complexity and, for one sample,
    the allele fraction.
    """
    letters = "".join(LETTERS.get(t) or t.rsplit("_", 1)[1] for t in tools)
    full = lambda t: F.when(F.col(t).isNull(), ".").when(F.col(t) == 1, "1").otherwise("0")
    number = sum((F.coalesce((F.col(t) == 1).cast("int"), F.lit(0)) for t in tools), F.lit(0))
    rows = features.withColumn("__n", number)
    score = F.col("SCORE").cast("double") if "SCORE" in features.columns else F.lit(None).cast("double")
    label = F.when(score.isNotNull(), V.classify_score(score, passes, low)).otherwise(consensus_label("__n", len(tools)))
    quality = V.quality_of_score(score) if phred else F.coalesce(F.round(score, 1), F.lit(0.0))
    complexity = F.coalesce(F.format_string("%.1f", F.bround(F.col("Seq_Complexity_Span").cast("double"), 1)), F.lit(".")) if "Seq_Complexity_Span" in features.columns else None
    share = general(vaf(F.col("T_ALT_FOR") + F.col("T_ALT_REV"), F.col("T_REF_FOR") + F.col("T_REF_REV")), 3)
    items = [F.when(label == "PASS", "SOMATIC"), F.concat(F.lit(f"{letters}="), F.concat_ws(",", *[full(t) for t in tools])), F.concat(F.lit("NUM_TOOLS="), F.col("__n"))]
    items += [F.concat(F.lit("LC="), F.when(F.col("Seq_Complexity_Span").isNull(), ".").otherwise(complexity))] if complexity is not None else []
    items += [] if paired else [F.concat(F.lit("AF="), share)]
    samples = [_sample_text("N"), _sample_text("T")] if paired else [_sample_text("T")]
    out = rows.select(
        F.col("CHROM").alias("chrom"), F.col("POS").cast("long").alias("pos"), F.col("ID").alias("id"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"), quality.alias("qual"),
        label.alias("filter"), F.concat_ws(";", *items).alias("info"), F.split(F.lit(FORMAT), ":").alias("format"), F.array(*samples).alias("samples"),
    )
    return out if keep_rejects else out.where("filter <> 'REJECT'")


def info_to_sample(records: DataFrame, letters: str, tumor: int, trained: bool = False) -> DataFrame:
    """Records with the tools' calls and their number (and, if trained, the quality) moved from the info field to the tumor sample."""
    keys = [letters, "NUM_TOOLS"]
    moved = [F.coalesce(A.info_value("info", k), F.lit("False")) for k in keys] + ([F.coalesce(F.col("qual").cast("string"), F.lit("None"))] if trained else [])
    named = keys + (["SCORE"] if trained else [])
    records = records.withColumn("__moved", F.concat_ws(":", *moved))
    rest = F.filter(F.split("info", ";"), lambda x: ~(x.startswith("NUM_TOOLS=") | x.startswith(letters)))
    samples = F.transform("samples", lambda x, i: F.when(i == tumor, F.concat_ws(":", x, F.col("__moved"))).otherwise(x))
    info = F.coalesce(F.nullif(F.array_join(rest, ";"), F.lit("")), F.lit("."))
    return records.withColumns({"samples": samples, "info": info, "format": F.concat("format", F.array(*[F.lit(k) for k in named]))}).drop("__moved")


def run_kinds(records: dict[str, DataFrame], sources: Sources, paired: bool = True, specs: list[A.CallerSpec] | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None, score: Callable[[DataFrame], DataFrame] | None = None, kinds: tuple[str, ...] = ("snv", "indel"), min_caller: float = MIN_CALLER) -> dict[str, tuple[DataFrame, DataFrame]]:
    """By kind, feature rows and classified records out of callers' raw records; ``score`` adds SCORE.

    Reads are read once for the variants of all kinds: a caller may name the kind itself, so one variant can be of both.
    """
    specs = specs or (A.PAIRED if paired else A.SINGLE)
    combined = settle(N.combine(records, N.PAIRED if paired else N.SINGLE, include, exclude))
    made, voted = {}, {}
    for kind in kinds:
        made[kind] = replace(sources, calls=combined.where(F.col("kind") == kind), supplied=set(records))
        voted[kind] = _voted(N.sites(combined, kind), made[kind], specs, min_caller)
    keys = reduce(DataFrame.unionByName, [v.select(*KEY) for v in voted.values()]).distinct()
    reads = {"T": sources.tumor} | ({"N": sources.normal} if paired else {})
    told = {sample: settle(site_read_features(r, keys, MIN_MQ, MIN_BQ)) for sample, r in reads.items()}
    tools = [s.column for s in specs if s.caller in records]
    out = {}
    for kind in kinds:
        rows = (_paired_rows if paired else _single_rows)(voted[kind], replace(made[kind], made=told), specs, MIN_MQ, MIN_BQ, None)
        scored = settle(rows if score is None else score(rows))
        out[kind] = scored, features_to_records(scored, tools, paired)
    return out


def run_paired(records: dict[str, DataFrame], sources: Sources, kind: str = "snv", specs: list[A.CallerSpec] = A.PAIRED, include: DataFrame | None = None, exclude: DataFrame | None = None, score: Callable[[DataFrame], DataFrame] | None = None, min_caller: float = MIN_CALLER) -> tuple[DataFrame, DataFrame]:
    """``run_kinds`` of a pair of samples for one kind (snv or indel)."""
    return run_kinds(records, sources, True, specs, include, exclude, score, (kind,), min_caller)[kind]


def run_single(records: dict[str, DataFrame], sources: Sources, kind: str = "snv", specs: list[A.CallerSpec] = A.SINGLE, include: DataFrame | None = None, exclude: DataFrame | None = None, score: Callable[[DataFrame], DataFrame] | None = None, min_caller: float = MIN_CALLER) -> tuple[DataFrame, DataFrame]:
    """As ``run_paired``, for a tumor alone."""
    return run_kinds(records, sources, False, specs, include, exclude, score, (kind,), min_caller)[kind]
