"""Joins of variants with callers' records and known variants, and the columns that come of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.expressions import caller_metrics, info_flag, info_number, info_value, merge_identifiers, p2phred
from callweave.operators import verdicts as V
from callweave.operators.ensemble import KEY, default_verdict, explode_alts

def _sample(i: int, key: str) -> Column:
    """The value of a format key in a sample; null if it has none."""
    return F.get(F.split(F.get("samples", F.lit(i)), ":"), F.nullif(F.array_position("format", key), F.lit(0)).cast("int") - 1)


Expression = Callable[[], Column]


@dataclass(frozen=True)
class CallerSpec:
    """A caller: its name in ``caller``, the column of its verdict, the verdict, and what else its records tell.

    Verdict and metrics make columns over a record of ``scan_vcf``.  Any caller can be added, such as ``arbitrary(n)``.
    """

    caller: str
    column: str
    verdict: Expression
    metrics: dict[str, Expression] = field(default_factory=dict)


def arbitrary(n: int) -> CallerSpec:
    return CallerSpec(f"Caller_{n}", f"if_Caller_{n}", default_verdict)


def _metrics(*names: str, prefix: str = "") -> dict[str, Expression]:
    return {f"{prefix}{n}": lambda n=n: caller_metrics()[n] for n in names}


def _numbers(**keys: str) -> dict[str, Expression]:
    return {column: lambda k=k: info_number("info", k) for column, k in keys.items()}


def _sniper() -> Column:
    return _sample(1, "SS") == "2"


PAIRED = [
    CallerSpec("MuTect2", "if_MuTect", V.somatic_or_pass, _metrics("NLOD", "TLOD", "STR", "ECNT", prefix="M2_")),
    CallerSpec("VarScan2", "if_VarScan2", V.somatic_flag),
    CallerSpec("JointSNVMix2", "if_JointSNVMix2", lambda: F.lit(1.0), {"SNVMix2_Score": V.joint_score}),
    CallerSpec("SomaticSniper", "if_SomaticSniper", lambda: F.when(_sniper(), 1.0).otherwise(0.0), {"Sniper_Score": lambda: F.when(_sniper(), _sample(1, "SSC").try_cast("double"))}),
    CallerSpec("VarDict", "if_VarDict", lambda: V.strong_or_tolerated(depth=_sample(0, "VD")), {"VarDict_Score": lambda: p2phred(info_number("info", "SSF"), 100.0), **_metrics("MSI", "MSILEN", "SHIFT3")}),
    CallerSpec("MuSE", "MuSE_Tier", V.tiered),
    CallerSpec("LoFreq", "if_LoFreq", V.pass_only),
    CallerSpec("Scalpel", "if_Scalpel", V.somatic_half_without_pass),
    CallerSpec("Strelka", "if_Strelka", V.pass_within, _numbers(Strelka_Score="SomaticEVS", Strelka_QSS="QSS", Strelka_TQSS="TQSS")),
    CallerSpec("TNscope", "if_TNscope", V.somatic_or_pass),
    CallerSpec("Platypus", "if_Platypus", V.pass_word),
]
SINGLE = [
    CallerSpec("MuTect2", "if_MuTect", V.pass_only, _metrics("TLOD", "ECNT", prefix="M2_")),
    CallerSpec("Strelka", "if_Strelka", V.pass_within),
    CallerSpec("VarScan2", "if_VarScan2", V.pass_only, {"VarScan2_Score": lambda: _sample(0, "PVAL").try_cast("double")}),
    CallerSpec("VarDict", "if_VarDict", V.pass_only, {**_metrics("MSI", "MSILEN", "SHIFT3"), **_numbers(PMEAN="PMEAN", PSTD="PSTD", QSTD="QSTD")}),
    CallerSpec("LoFreq", "if_LoFreq", V.pass_only),
    CallerSpec("Scalpel", "if_Scalpel", V.pass_only),
]


def join_sources(sites: DataFrame, calls: DataFrame, specs: list[CallerSpec], supplied: set[str] | None = None) -> DataFrame:
    """Sites with every caller's verdict and metrics: one aggregation of all records by variant and one join, however many callers.

    A supplied caller without a record of a variant says 0; the verdict of one that wasn't supplied is null, as are all
    missing metrics.  Of several records of a caller the last one counts, by the column ``line`` if there is one.
    """
    used = [s for s in specs if supplied is None or s.caller in supplied]
    records = explode_alts(calls.where(F.col("caller").isin([s.caller for s in used])))
    fields = {s.caller: F.struct(s.verdict().cast("double").alias(s.column), *[c().cast("double").alias(n) for n, c in s.metrics.items()]) for s in used}

    def last(s: CallerSpec) -> Column:
        told = F.when(F.col("caller") == s.caller, fields[s.caller])
        return F.max_by(told, F.when(F.col("caller") == s.caller, F.col("line"))) if "line" in calls.columns else F.max(told)

    wide = records.groupBy(*KEY).agg(*[last(s).alias(f"__{i}") for i, s in enumerate(used)]) if used else None
    out = sites if wide is None else sites.join(wide, KEY, "left")
    made = {}
    for s in specs:
        i = used.index(s) if s in used else None
        made[s.column] = F.lit(None).cast("double") if i is None else F.coalesce(F.col(f"__{i}.{s.column}"), F.lit(0.0))
        made |= {n: F.lit(None).cast("double") if i is None else F.col(f"__{i}.{n}") for n in s.metrics}
    return out.withColumns(made).drop(*[f"__{i}" for i in range(len(used))])


def votes(specs: list[CallerSpec]) -> Column:
    """The sum of the verdicts of all supplied callers."""
    return sum((F.coalesce(F.col(s.column), F.lit(0.0)) for s in specs), F.lit(0.0))


def with_dbsnp(variants: DataFrame, known: DataFrame) -> DataFrame:
    """if_dbsnp, COMMON and rs_ids (an array, null if unknown) from known variants with id and info."""
    there = explode_alts(known).groupBy(*KEY).agg(F.max(F.struct(F.coalesce(info_value("info", "COMMON") == "1", F.lit(False)).cast("int").alias("common"), F.split("id", ",").alias("ids"))).alias("__k"))
    out = variants.join(there, KEY, "left")
    return out.withColumns({"if_dbsnp": F.col("__k").isNotNull().cast("int"), "COMMON": F.coalesce("__k.common", F.lit(0)), "rs_ids": F.col("__k.ids")}).drop("__k")


def with_cosmic(variants: DataFrame, known: DataFrame) -> DataFrame:
    """if_COSMIC, COSMIC_CNT and cosmic_ids; a record that is a SNP is not counted but keeps its ids, an absent one counts 0."""
    snp = F.coalesce(info_flag("info", "SNP"), F.lit(False)) | info_value("info", "SNP").isNotNull()
    told = F.struct((~snp).cast("int").alias("is"), F.when(~snp, info_number("info", "CNT")).alias("n"), F.split("id", ",").alias("ids"))
    there = explode_alts(known).groupBy(*KEY).agg(F.max(told).alias("__k"))
    out = variants.join(there, KEY, "left")
    count = F.when(F.col("__k").isNull(), 0.0).otherwise(F.col("__k.n"))
    return out.withColumns({"if_COSMIC": F.coalesce("__k.is", F.lit(0)), "COSMIC_CNT": count, "cosmic_ids": F.col("__k.ids")}).drop("__k")


#: Info fields that are taken over from two public databases.
DBSNP_KEYS = ("RSPOS", "GENEINFO", "dbSNPBuildID", "SAO", "SSR", "VC", "PM", "MUT", "KGPhase1", "KGPhase3", "OM", "CDA", "CAF", "COMMON")
COSMIC_KEYS = ("GENE", "CDS", "AA", "CNT")


def transfer_info(variants: DataFrame, known: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Variants with the chosen info fields of known ones added to their info, and with their ids."""
    value = lambda k: F.coalesce(F.concat(F.lit(f"{k}="), info_value("info", k)), F.when(info_flag("info", k), k))
    taken = explode_alts(known).select(*KEY, F.nullif(F.concat_ws(";", *[value(k) for k in keys]), F.lit("")).alias("__info"), F.col("id").alias("__id"))
    taken = taken.groupBy(*KEY).agg(F.max(F.struct("__id", "__info")).alias("__k"))
    out = variants.join(taken, KEY, "left")
    own = F.filter(F.array(F.nullif("info", F.lit(".")), F.col("__k.__info")), lambda x: x.isNotNull())
    info = F.coalesce(F.nullif(F.array_join(own, ";"), F.lit("")), F.lit("."))
    return out.withColumns({"info": info, "id": merge_identifiers(F.split("id", "[;,]"), F.split(F.col("__k.__id"), "[;,]"))}).drop("__k")
