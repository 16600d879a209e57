"""Column expressions over variants and sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant_class(ref: str = "ref", alt: str = "alt") -> Column:
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "snv").when((r == 1) | (a == 1), "indel").otherwise("complex")


def indel_length(ref: str = "ref", alt: str = "alt") -> Column:
    return F.length(alt) - F.length(ref)


SUBSTITUTIONS = {"GC2CG": ("GC", "CG"), "GC2TA": ("GT", "CA"), "GC2AT": ("GA", "CT"), "TA2AT": ("TA", "AT"), "TA2GC": ("TG", "AC"), "TA2CG": ("TC", "AG")}


def with_substitution(df: DataFrame) -> DataFrame:
    """Six flags for the kinds of base changes."""
    change = F.upper(F.concat("ref", "alt"))
    return df.withColumns({k: change.isin(*v).cast("int") for k, v in SUBSTITUTIONS.items()})


def decompose_complex(df: DataFrame, only_complex: bool = False) -> DataFrame:
    """Rows of ref and alt as single-base changes and at most one indel, each at its own position.

    With ``only_complex``, rows that are already of one kind stay as they are.
    """
    m = F.least(F.length("ref"), F.length("alt"))
    bases = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(i.cast("int").alias("o"), F.substr(F.col("ref"), i + 1, F.lit(1)).alias("r"), F.substr(F.col("alt"), i + 1, F.lit(1)).alias("a")))
    single = F.filter(bases, lambda x: x["r"] != x["a"])
    tail = F.when(F.length("ref") > F.length("alt"), F.array(F.struct((m - 1).cast("int").alias("o"), F.substr("ref", m).alias("r"), F.substr(F.col("ref"), m, F.lit(1)).alias("a"))))
    tail = tail.when(F.length("ref") < F.length("alt"), F.array(F.struct((m - 1).cast("int").alias("o"), F.substr(F.col("ref"), m, F.lit(1)).alias("r"), F.concat(F.substr(F.col("ref"), m, F.lit(1)), F.substr("alt", m + 1)).alias("a"))))
    parts = F.concat(single, F.coalesce(tail, F.array().cast("array<struct<o:int,r:string,a:string>>")))
    if only_complex:
        parts = F.when(variant_class() == "complex", parts).otherwise(F.array(F.struct(F.lit(0).alias("o"), F.col("ref").alias("r"), F.col("alt").alias("a"))))
    out = df.withColumn("__p", F.explode(parts)).withColumns({"pos": F.col("pos") + F.col("__p.o"), "ref": F.col("__p.r"), "alt": F.col("__p.a")})
    return out.drop("__p")


def split_variants(df: DataFrame) -> DataFrame:
    """Distinct records of one alternative and one kind each, with ``kind`` snv or indel; other fields are copied."""
    single = df.withColumn("alt", F.explode(F.split("alt", "[,/]")))
    parts = decompose_complex(single, only_complex=True).distinct()
    return parts.withColumn("kind", F.when((F.length("ref") == 1) & (F.length("alt") == 1), "snv").otherwise("indel"))


def p2phred(p: Column, cap: float = float("inf")) -> Column:
    """-10 log10 p, at most ``cap``; null outside [0, 1]."""
    return F.when(p.isNull() | (p < 0) | (p > 1), None).when(p == 0, F.lit(cap)).when(p == 1, F.lit(0.0)).otherwise(F.least(-10 * F.log10(p), F.lit(cap)))


def phred2p(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def rescale(x: Column, original: str = "fraction", to: str | None = None, cap: float = 1001.0) -> Column:
    """A fraction as Phred (at most ``cap``) or the other way round, to two decimals; rounded only where both scales agree."""
    if (original, to) == ("fraction", "phred"):
        return F.bround(p2phred(x, cap), 2)
    if (original, to) == ("phred", "fraction"):
        return F.bround(phred2p(x), 2)
    return F.bround(x, 2)


def qualities(quals: str) -> Column:
    """The numbers that a quality string (Phred + 33) stands for."""
    return F.transform(F.regexp_extract_all(F.col(quals), F.lit("(?s)(.)"), F.lit(1)), lambda c: F.ascii(c) - 33)


def quality_string(numbers: Column) -> Column:
    """The quality string of an array of numbers."""
    return F.array_join(F.transform(numbers, lambda q: F.char(q + 33)), "")


def read_in_pair(flag: str = "flag") -> Column:
    """R1 or R2 by the flag's bits, R0 for neither."""
    bit = lambda n: F.col(flag).bitwiseAND(n) != 0
    return F.when(bit(64), "R1").when(bit(128), "R2").otherwise("R0")


def odds_ratio(n_ref: Column, n_alt: Column, t_ref: Column, t_alt: Column, cap: float = 100.0) -> Column:
    """(n_alt t_ref) / (n_ref t_alt), at most ``cap``; null if both are 0."""
    up, down = n_alt * t_ref, n_ref * t_alt
    return F.when(down == 0, F.when(up > 0, F.lit(cap))).otherwise(F.least(up / down, F.lit(cap)))


def vaf(alt: Column, ref: Column) -> Column:
    return F.coalesce(F.try_divide(alt, alt + ref), F.lit(0.0))


def genotype(rf: Column, rr: Column, af: Column, ar: Column, hom: float = 0.85, het: float = 0.01) -> Column:
    share = F.try_divide(af + ar, rf + rr + af + ar)
    return F.when(share.isNull(), "./.").when(share > hom, "1/1").when(share >= het, "0/1").otherwise("0/0")


def general(x: Column, digits: int = 6) -> Column:
    """A number in the shortest of plain and scientific form with ``digits`` significant digits; null stays null.

    Each step is a function over an array of one, so that what it uses several times is computed once.
    """
    scientific = lambda v: F.format_string(f"%.{digits - 1}e", F.abs(v))
    power = lambda text: F.regexp_extract(text, "e(.*)$", 1).try_cast("int")
    bare = lambda t: F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)

    def rounded(s: Column) -> Column:
        """Ties to even, as the formatter rounds them up."""
        near = F.when(s["e"] == -4, F.bround(s["x"], digits + 3))
        return F.struct(s["x"].alias("x"), scientific(reduce(lambda a, k: a.when(s["e"] == k, F.bround(s["x"], digits - 1 - k)), range(-3, digits), near).otherwise(s["x"])).alias("t"))

    def parts(s: Column) -> Column:
        mantissa = F.regexp_extract(s["t"], "^(.*)e", 1)
        return F.struct(s["x"].alias("x"), power(s["t"]).alias("e"), mantissa.alias("m"), F.replace(mantissa, F.lit("."), F.lit("")).alias("d"), F.regexp_extract(s["t"], "(e.*)$", 1).alias("p"))

    def shown(s: Column) -> Column:
        e, d = s["e"], s["d"]
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        plain = F.when(e < 0, small).when(e >= digits - 1, d).otherwise(F.concat(F.substr(d, F.lit(1), e + 1), F.lit("."), F.substr(d, e + 2)))
        text = F.when((e < -4) | (e >= digits), F.concat(bare(s["m"]), s["p"])).otherwise(bare(plain))
        return F.when(s["x"].isNull(), None).when(s["x"] == 0, "0").when(s["x"] < 0, F.concat(F.lit("-"), text)).otherwise(text)

    step = F.transform(F.array(x), lambda v: F.struct(v.alias("x"), power(scientific(v)).alias("e")))
    for f in (rounded, parts, shown):
        step = F.transform(step, f)
    return F.get(step, F.lit(0))


def reverse_complement(seq: str) -> Column:
    return F.translate(F.reverse(F.col(seq)), "GTCANgtcan", "CAGTNcagtn")


def run_lengths(seq: str) -> Column:
    """Lengths of the runs of equal characters."""
    return F.transform(F.regexp_extract_all(F.col(seq), F.lit(r"((.)\2*)"), F.lit(1)), F.length)


def info_items(info: str) -> Column:
    return F.split(info, ";")


def info_value(info: str, key: str) -> Column:
    """The value of KEY=value, null if absent."""
    return F.nullif(F.regexp_extract(info, rf"(?:^|;)\Q{key}\E=([^;\s]+)", 1), F.lit(""))


def info_flag(info: str, key: str) -> Column:
    return F.array_contains(F.split(info, ";"), key)


def info_number(info: str, key: str, kind: str = "double") -> Column:
    """The value of KEY=value as a number; null if absent or no number."""
    return info_value(info, key).try_cast(kind)


#: Numbers that callers leave in the info field, and their types; STR is a flag.
METRICS = {"MSI": "double", "MSILEN": "double", "SHIFT3": "double", "NLOD": "double", "TLOD": "double", "ECNT": "int"}


def caller_metrics(info: str = "info") -> dict[str, Column]:
    """Columns of ``METRICS``, and STR: 1 where the flag (or a value of it) is there."""
    tandem = (F.coalesce(info_flag(info, "STR"), F.lit(False)) | info_value(info, "STR").isNotNull()).cast("int")
    return {k: info_number(info, k, t) for k, t in METRICS.items()} | {"STR": tandem}


def id_flags(ids: str = "id", info: str = "info") -> dict[str, Column]:
    """What a record says of two public databases without looking them up; a null id or info says nothing."""
    says = lambda pattern: F.coalesce(F.col(ids).rlike(pattern), F.lit(False)).cast("int")
    common = F.coalesce(info_value(info, "COMMON") == "1", F.lit(False)).cast("int")
    return {"if_dbsnp": says("rs[0-9]+"), "if_common": common, "if_cosmic": says("COS[MN][0-9]+"), "cosmic_count": info_number(info, "CNT")}


def merge_identifiers(*parts: Column) -> Column:
    """The distinct identifiers of arrays and strings joined by ``;`` or ``,``, sorted; a dot if there are none."""
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])))
    named = F.filter(every, lambda x: x.isNotNull() & ~x.isin("", "."))
    return F.coalesce(F.nullif(F.array_join(F.array_sort(named), ";"), F.lit("")), F.lit("."))


def effect_annotations(info: str = "info") -> dict[str, Column]:
    """Genes, protein changes and transcripts of the annotations (ANN) that change an amino acid, as arrays in their order."""
    every = F.transform(F.split(F.coalesce(info_value(info, "ANN"), F.lit("")), ","), lambda x: F.split(x, r"\|"))
    change = lambda a, i: F.regexp_extract(F.coalesce(F.get(a, F.lit(10)), F.lit("")), r"p\.([a-zA-Z]+)[0-9]+([a-zA-Z]+)", i)
    kept = F.filter(every, lambda a: (F.coalesce(F.get(a, F.lit(3)), F.lit("")) != "") & (change(a, 1) != "") & (change(a, 1) != change(a, 2)))
    field = lambda i: F.transform(kept, lambda a: F.get(a, F.lit(i)))
    return {"genes": field(3), "aa_changes": field(10), "transcripts": field(6)}
