"""Records of particular callers as uniform variants: one alternative and one kind a row, samples as NORMAL and TUMOR.

Records are rows of ``scan_vcf``: the fixed fields, ``format`` (keys) and ``samples`` (one string each).  Every function
rewrites columns and at most explodes rows, so a caller's whole file is one projection; ``NORMALISERS`` names them for
``combine``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.expressions import info_value, split_variants
from callweave.operators.ensemble import union_variants
from callweave.operators.intervals import intersect_regions
from callweave.operators.verdicts import drop_endless_symbolic, drop_odd_reference, mask_bases


def _sample(i: int) -> Column:
    return F.get("samples", F.lit(i))


def _cells(i: int) -> Column:
    return F.split(_sample(i), ":")


def _at(key: str) -> Column:
    """0-based place of a format key; null without it."""
    return F.nullif(F.array_position("format", key), F.lit(0)).cast("int") - 1


def _value(i: int, key: str) -> Column:
    return F.get(_cells(i), _at(key))


def _without(items: Column, at: Column) -> Column:
    return F.filter(items, lambda _, i: i != at)


def _set(items: Column, at: Column, value: Column) -> Column:
    return F.transform(items, lambda x, i: F.when(i == at, value).otherwise(x))


def pick_samples(calls: DataFrame, header: list[str], tumor: str, normal: str | None = None) -> DataFrame:
    """Sample columns by their names in the header, normal first; records with an N in the reference go."""
    wanted = [header.index(name) for name in (normal, tumor) if name is not None]
    return calls.where(~F.col("ref").contains("N")).withColumn("samples", F.array(*[_sample(i) for i in wanted]))


def split_alternatives(calls: DataFrame, split: tuple[str, ...], keep: tuple[str, ...], genotypes: tuple[Column, ...]) -> DataFrame:
    """One row for each alternative of a record.

    Records with several alternatives keep only some of their info: of the fields ``split`` the value that belongs to
    the alternative, and the fields ``keep`` as they are; their samples become ``genotypes``.
    """
    several = F.size(F.split("alt", ",")) > 1
    own = [F.concat(F.lit(f"{k}="), F.get(F.split(info_value("info", k), ","), F.col("__i"))) for k in split]
    flag = lambda k: F.when(F.array_contains(F.split("info", ";"), k), F.lit(f"{k}=True"))
    same = [F.coalesce(F.concat(F.lit(f"{k}="), info_value("info", k)), flag(k)) for k in keep]
    rows = calls.select("*", F.posexplode(F.split("alt", ",")).alias("__i", "__alt"))
    made = {"info": F.concat_ws(";", *own, *same), "samples": F.array(*genotypes)}
    rows = rows.withColumns({k: F.when(several, v).otherwise(F.col(k)) for k, v in made.items()})
    return rows.withColumn("alt", F.col("__alt")).drop("__i", "__alt")


def _heterozygous(sample: Column, kept: Column) -> Column:
    """The sample with genotype 0/1, unless ``kept``."""
    return F.when(kept, sample).otherwise(F.regexp_replace(sample, "^[^:]+", "0/1"))


def normalise_mutect2(calls: DataFrame, normal: int = 0, tumor: int = 1) -> DataFrame:
    """Paired calls with NLOD and TLOD by alternative; also serves callers that write the same fields."""
    plain = F.coalesce(_value(normal, "GT").isin("0/0", "0/1"), F.lit(False))
    tumor_kept = F.coalesce(_value(tumor, "GT") == "0/0", F.lit(False)) | F.coalesce(_value(normal, "GT") == "0/1", F.lit(False))
    genotypes = (_heterozygous(_sample(normal), plain), _heterozygous(_sample(tumor), tumor_kept))
    return split_variants(split_alternatives(calls, ("NLOD", "TLOD"), ("STR", "ECNT"), genotypes))


def normalise_mutect2_single(calls: DataFrame) -> DataFrame:
    """As the paired form, for a lone tumor: germline risk as the only filter is no reason against a call."""
    calls = calls.withColumn("filter", F.when(F.col("filter") == "germline_risk", "PASS").otherwise(F.col("filter")))
    plain = F.coalesce(_value(0, "GT").isin("0/0", "0/1"), F.lit(False))
    return split_variants(split_alternatives(calls, ("NLOD", "TLOD"), ("STR", "ECNT"), (_heterozygous(_sample(0), plain),)))


def _joined_depths(calls: DataFrame, samples: int, genotypes: list[Column] | None = None) -> DataFrame:
    """AD as reference and alternative depth, without RD; optionally with a genotype in front of each sample."""
    calls = calls.withColumns({"__ad": _at("AD"), "__rd": _at("RD")})
    ad, rd = F.col("__ad"), F.col("__rd")
    there = ad.isNotNull() & rd.isNotNull()
    made = []
    for i in range(samples):
        cells = _without(_set(_cells(i), ad, F.concat_ws(",", F.get(_cells(i), rd), F.get(_cells(i), ad))), rd)
        text = F.array_join(cells, ":") if genotypes is None else F.concat_ws(":", genotypes[i], F.array_join(cells, ":"))
        made.append(F.when(F.size("samples") > i, text))
    keys = _without(F.col("format"), rd)
    keys = keys if genotypes is None else F.concat(F.array(F.lit("GT")), keys)
    rest = F.slice("samples", samples + 1, F.greatest(F.size("samples") - samples, F.lit(0)))
    rewritten = F.concat(F.filter(F.array(*made), lambda x: x.isNotNull()), rest)
    out = calls.withColumns({"samples": F.when(there, rewritten).otherwise(F.col("samples")), "format": F.when(there, keys).otherwise(F.col("format"))})
    return out.drop("__ad", "__rd")


def normalise_varscan2(calls: DataFrame) -> DataFrame:
    """Alleles that other tools accept (later alternatives start with the reference), and joined depths."""
    ref = F.regexp_replace("ref", r"[^\w].*$", "")
    alt = F.regexp_replace(F.regexp_replace(F.replace(F.col("alt"), F.lit("/"), F.lit(",")), r"[^\w,.]", ""), r"(\w+),\1", "$1")
    calls = calls.withColumns({"ref": ref, "alt": alt})
    alts = F.split("alt", ",")
    first_equal = F.array_position(alts, F.col("ref")) - 1
    others = F.filter(alts, lambda _, i: i != first_equal)
    fitting = F.filter(others, lambda x, i: (i == 0) | x.startswith(F.col("ref")))
    calls = calls.withColumn("alt", F.when(F.size(alts) > 1, F.array_join(fitting, ",")).otherwise(F.col("alt")))
    return drop_odd_reference(_joined_depths(calls, 2))


def normalise_joint_snv_mix2(calls: DataFrame) -> DataFrame:
    """Joined depths, and genotypes by the share of the alternative."""
    share = [F.coalesce(F.try_divide(_value(i, "AD").try_cast("double"), _value(i, "AD").try_cast("double") + _value(i, "RD").try_cast("double")), F.lit(0.0)) for i in range(2)]
    normal = F.when(share[0] > 0.8, "1/1").when(share[0] > 0.25, "0/1").otherwise("0/0")
    return _joined_depths(calls, 2, [normal, F.when(share[1] > 0.8, "1/1").otherwise("0/1")])


def normalise_somatic_sniper(calls: DataFrame) -> DataFrame:
    return calls.withColumn("ref", mask_bases("ref"))


def normalise_vardict(calls: DataFrame) -> DataFrame:
    """Four depths as one field, NORMAL before TUMOR, no END; the kind as the caller says, complex ones decomposed.

    Records whose alternative is the reference go.
    """
    depth = F.when(_at("ALD").isNotNull(), "ALD").otherwise("AD")
    calls = calls.where("ref <> alt").withColumns({"__rd": _at("RD"), "__ad": F.nullif(F.array_position("format", depth), F.lit(0)).cast("int") - 1})
    rd, ad = F.col("__rd"), F.col("__ad")
    there = rd.isNotNull() & ad.isNotNull()

    def rest(items: Column) -> Column:
        return F.filter(items, lambda _, k: (k != rd) & (k != ad))

    def sample(i: int) -> Column:
        return F.array_join(F.concat(rest(_cells(i)), F.array(F.concat_ws(",", F.get(_cells(i), rd), F.get(_cells(i), ad)))), ":")

    paired = F.size("samples") > 1
    calls = calls.withColumns({
        "ref": mask_bases("ref"), "alt": mask_bases("alt"), "info": F.regexp_replace("info", "END=[0-9]+;", ""),
        "samples": F.when(~there, F.col("samples")).when(paired, F.array(sample(1), sample(0))).otherwise(F.array(sample(0))),
        "format": F.when(there, F.concat(rest(F.col("format")), F.array(F.lit("DP4")))).otherwise(F.col("format")),
    }).drop("__rd", "__ad")
    told = F.when(F.col("info").contains("TYPE=SNV"), "snv").when(F.col("info").rlike("TYPE=(Deletion|Insertion)"), "indel")
    calls = calls.withColumn("__told", told)
    whole = calls.where("__told is not null").withColumnRenamed("__told", "kind").distinct()
    return whole.unionByName(split_variants(calls.where("__told is null").drop("__told")))


def normalise_strelka(calls: DataFrame) -> DataFrame:
    """A genotype of 0/1 in front of every sample."""
    return calls.withColumns({"format": F.concat(F.array(F.lit("GT")), F.col("format")), "samples": F.transform("samples", lambda x: F.concat(F.lit("0/1:"), x))})


def normalise_strelka_single(calls: DataFrame) -> DataFrame:
    """One row for each alternative with its repeat counts; all but single bases are indels."""
    plain = F.coalesce(_value(0, "GT").isin("0/0", "0/1"), F.lit(False))
    rows = split_alternatives(calls, ("REFREP", "IDREP", "RU"), ("MQ",), (_heterozygous(_sample(0), plain),))
    return with_kind(rows)


def with_kind(calls: DataFrame) -> DataFrame:
    return calls.withColumn("kind", F.when((F.length("ref") == 1) & (F.length("alt") == 1), "snv").otherwise("indel"))


#: How the records of a caller become uniform; callers that aren't named pass as they are.
PAIRED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "MuTect2": normalise_mutect2, "TNscope": lambda c: normalise_mutect2(c, 1, 0), "VarScan2": lambda c: with_kind(normalise_varscan2(c)),
    "JointSNVMix2": lambda c: with_kind(normalise_joint_snv_mix2(c)), "SomaticSniper": lambda c: with_kind(normalise_somatic_sniper(c)),
    "VarDict": lambda c: normalise_vardict(drop_endless_symbolic(c)), "Strelka": lambda c: with_kind(normalise_strelka(c)), "Platypus": split_variants,
}
SINGLE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "MuTect2": normalise_mutect2_single, "VarScan2": lambda c: normalise_varscan2(split_variants(c)), "VarDict": PAIRED["VarDict"],
    "LoFreq": split_variants, "Strelka": normalise_strelka_single,
}


def combine(calls: dict[str, DataFrame], normalisers: dict[str, Callable[[DataFrame], DataFrame]] = PAIRED, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """The records of all callers inside the regions as one frame with ``caller`` and ``kind``.

    ``sites`` of it are the distinct variants of a kind.  Unknown callers, such as user-supplied ones, are split into
    kinds only.
    """
    every = []
    for caller, records in calls.items():
        inside = intersect_regions(records, include, exclude)
        every.append(normalisers.get(caller, split_variants)(inside).withColumn("caller", F.lit(caller)))
    return reduce(lambda a, b: a.unionByName(b), every)


def sites(combined: DataFrame, kind: str) -> DataFrame:
    """Distinct variants of one kind, snv or indel."""
    return union_variants(combined.where(F.col("kind") == kind))
