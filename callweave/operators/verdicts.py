"""What each caller's filter and info fields say of a call: 1 for somatic, a fraction for less, 0 for no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.expressions import info_flag, info_value, p2phred

#: Verdicts of the tiers of one caller.
TIERS = {"PASS": 1.0, "Tier1": 0.9, "Tier2": 0.8, "Tier3": 0.7, "Tier4": 0.6, "Tier5": 0.5}
#: Filters that refuse half a verdict.
REFUSED = ["d7", "d5", "DIFF0.2", "LongAT", "MAF0.05", "MSI6", "NM4", "NM4.25", "pSTD", "SN1.5"]


def _one(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _passes(f: str) -> Column:
    return F.coalesce(F.col(f) == "PASS", F.lit(False))


def _contains_pass(f: str) -> Column:
    return F.coalesce(F.col(f).contains("PASS"), F.lit(False))


def _somatic(info: str) -> Column:
    """SOMATIC is there, as a flag or with a value."""
    return F.coalesce(info_flag(info, "SOMATIC"), F.lit(False)) | info_value(info, "SOMATIC").isNotNull()


def pass_word(f: str = "filter") -> Column:
    return _one(F.coalesce(F.col(f).rlike(r"\bPASS\b"), F.lit(False)))


def pass_only(f: str = "filter") -> Column:
    return _one(_passes(f))


def pass_within(f: str = "filter") -> Column:
    return _one(_contains_pass(f))


def somatic_and_pass(f: str = "filter", info: str = "info") -> Column:
    return _one((pass_word(f) == 1) & _somatic(info))


def somatic_or_pass(f: str = "filter", info: str = "info") -> Column:
    return _one(_somatic(info) | _contains_pass(f))


def somatic_flag(info: str = "info") -> Column:
    return _one(_somatic(info))


def tiered(f: str = "filter") -> Column:
    tiers = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    return F.coalesce(F.try_element_at(tiers, F.col(f)), F.lit(0.0))


def somatic_half_without_pass(f: str = "filter", info: str = "info") -> Column:
    return F.when(_somatic(info), F.when(_passes(f), 1.0).otherwise(0.5)).otherwise(0.0)


def strong_or_tolerated(f: str = "filter", info: str = "info", depth: Column | None = None) -> Column:
    """1 for PASS and Somatic; half for Somatic with at most two filters, none of them refused.

    ``depth`` is the variant depth of the first sample, else VD of the info field is taken; without any, filters of
    low depth refuse.  A missing SSF counts as 0 and so never refuses.
    """
    says = F.coalesce(F.col(info).contains("Somatic"), F.lit(False))
    filters = F.split(F.coalesce(F.col(f), F.lit("")), ";")
    p = F.coalesce(info_value(info, "SSF").try_cast("double"), F.lit(0.0))
    reads = F.coalesce((depth if depth is not None else info_value(info, "VD")).try_cast("double"), F.lit(0.0))
    refused = F.arrays_overlap(filters, F.array(*[F.lit(x) for x in REFUSED])) | (F.array_contains(filters, "P0.05") & (p >= 0.15)) | (F.arrays_overlap(filters, F.array(F.lit("v3"), F.lit("v4"))) & (reads < 3))
    return F.when(says & _passes(f), 1.0).when(says & ~refused & (F.size(filters) <= 2), 0.5).otherwise(0.0)


def joint_score(info: str = "info") -> Column:
    """Phred of one minus the summed probabilities of the two somatic genotypes, at most 50."""
    p = info_value(info, "AAAB").try_cast("double") + info_value(info, "AABB").try_cast("double")
    return p2phred(1 - p, 50.0)


#: Named verdicts as (filter column, info column) -> Column.
VERDICTS = {
    "pass_word": lambda f, i: pass_word(f), "pass_only": lambda f, i: pass_only(f), "pass_within": lambda f, i: pass_within(f), "somatic_and_pass": somatic_and_pass, "somatic_or_pass": somatic_or_pass,
    "somatic_flag": lambda f, i: somatic_flag(i), "tiered": lambda f, i: tiered(f), "somatic_half": somatic_half_without_pass, "tolerated": strong_or_tolerated,
}


def with_verdicts(calls: DataFrame, names: list[str], f: str = "filter", info: str = "info") -> DataFrame:
    return calls.withColumns({n: VERDICTS[n](f, info) for n in names})


def common_ids(ids: str = "id") -> dict[str, Column]:
    """Identifiers of two public databases in a record's id field, each as a sorted array."""
    parts = F.split(F.coalesce(F.col(ids), F.lit("")), "[,;]")
    return {"rs_ids": F.sort_array(F.filter(parts, lambda x: x.rlike("^rs[0-9]+"))), "cos_ids": F.sort_array(F.filter(parts, lambda x: x.rlike("^COS[MV][0-9]+")))}


def mask_bases(column: str) -> Column:
    """Letters other than the four bases become N."""
    return F.regexp_replace(column, "(?i)[^GCTA]", "N")


def drop_endless_symbolic(calls: DataFrame, alt: str = "alt", info: str = "info") -> DataFrame:
    """Without records of a symbolic alternative such as <DEL> that name no END."""
    symbolic = F.coalesce(F.col(alt).rlike(r"^<\w+>"), F.lit(False))
    return calls.where(~(symbolic & info_value(info, "END").isNull()))


def drop_odd_reference(calls: DataFrame, ref: str = "ref") -> DataFrame:
    return calls.where(~F.col(ref).rlike("[^GCTAUgctau]"))


#: Measures of a passing call that must not be smaller, or not larger (in size), than a limit.
AT_LEAST = {"refMQ": 40.0, "altMQ": 40.0, "refBQ": 20.0, "altBQ": 20.0, "VAF": 0.01, "DP": 5.0, "varDP": 1.0}
AT_MOST = {"refNM": 3.0, "altNM": 4.0, "fetSB": float("inf"), "fetCD": float("inf"), "zMQ": float("inf"), "zBQ": float("inf"), "MQ0": 10.0}


def demote_pass(calls: DataFrame, at_least: dict[str, float] = AT_LEAST, at_most: dict[str, float] = AT_MOST, fails: int = 1, f: str = "filter") -> DataFrame:
    """PASS becomes LowQual where at least ``fails`` of the measures present break their limit; nulls break none."""
    broken = [F.col(k) < v for k, v in at_least.items() if k in calls.columns] + [F.abs(k) > v for k, v in at_most.items() if k in calls.columns]
    count = sum((F.coalesce(x, F.lit(False)).cast("int") for x in broken), F.lit(0))
    return calls.withColumn(f, F.when((F.col(f) == "PASS") & (count >= fails), "LowQual").otherwise(F.col(f)))


def sample_measures(sample: Column) -> dict[str, Column]:
    """The measures of ``demote_pass`` out of a sample with the keys of our own output; DP and varDP are sums of DP4."""
    four = F.transform(F.split(sample["DP4"], ","), lambda x: x.try_cast("double"))
    plain = {k: sample[k].try_cast("double") for k in (*AT_LEAST, *AT_MOST) if k not in ("DP", "varDP")}
    return plain | {"DP": F.aggregate(four, F.lit(0.0), lambda a, x: a + x), "varDP": F.get(four, F.lit(2)) + F.get(four, F.lit(3))}


#: Contigs of a human genome, with or without a prefix.
HUMAN_CONTIG = "^(?:chr)?(?:[1-9]|1[0-9]|2[0-2]|[XY]|MT?)$"


def valid_records(calls: DataFrame, contig: str = HUMAN_CONTIG, quals: str | None = None) -> DataFrame:
    """``calls`` with the boolean valid: a contig of the pattern, a position, and qualities from ! to J where ``quals`` names them."""
    ok = F.col("chrom").rlike(contig) & F.col("pos").isNotNull()
    if quals is not None:
        ok = ok & F.col(quals).rlike("^[!-J]*$")
    return calls.withColumn("valid", F.coalesce(ok, F.lit(False)))


def drop_ref_equals_alt(calls: DataFrame) -> DataFrame:
    return calls.where("ref <> alt")


def classify_score(score: Column, passing: float = 0.5, low: float = 0.1) -> Column:
    return F.when(score >= passing, "PASS").when(score >= low, "LowQual").otherwise("REJECT")


def quality_of_score(score: Column, cap: float = 255.0) -> Column:
    """Phred of one minus the score to one decimal; 0 without a score."""
    return F.coalesce(F.bround(p2phred(1 - score, cap), 1), F.lit(0.0))
