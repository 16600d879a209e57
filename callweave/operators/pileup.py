"""Base strings of pileups as counts, and their depths by strand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.expressions import general, vaf


def with_bases(pileup: DataFrame, bases: str = "bases") -> DataFrame:
    """``plain`` (one character a read), ``insertions`` and ``deletions`` (sequences, in lower case if reverse).

    Read starts with their mapping quality, and read ends, are dropped first.  An indel's length says how many of the
    following letters are its own.  Null bases have no reads.
    """
    clean = F.concat(F.lit("+0"), F.regexp_replace(F.coalesce(F.col(bases), F.lit("")), r"\^.|\$", ""))
    parts = F.transform(F.regexp_extract_all(clean, F.lit("([+-][0-9]+[^+-]*)"), F.lit(1)), lambda x: F.struct(
        F.left(x, F.lit(1)).alias("sign"), F.regexp_extract(x, "^[+-]([0-9]+)", 1).cast("int").alias("n"), F.regexp_replace(x, "^[+-][0-9]+", "").alias("text")))
    out = pileup.withColumn("__parts", parts)
    taken = lambda sign: F.transform(F.filter("__parts", lambda p: (p["sign"] == sign) & (p["n"] > 0)), lambda p: F.substr(p["text"], F.lit(1), p["n"]))
    plain = F.concat_ws("", F.transform("__parts", lambda p: F.substr(p["text"], p["n"] + 1)))
    return out.withColumns({"plain": plain, "insertions": taken("+"), "deletions": taken("-")}).drop("__parts")


def _count(pattern: str) -> Column:
    return F.regexp_count(F.col("plain"), F.lit(pattern)).cast("long")


def base_counts(pileup: DataFrame, bases: str = "bases") -> DataFrame:
    """Reads that match the reference and that don't, by strand, gaps, unknown bases and indels."""
    return with_bases(pileup, bases).withColumns({
        "ref_fwd": _count("[.]"), "ref_rev": _count(","), "alt_fwd": _count("[ACGT]"), "alt_rev": _count("[acgt]"), "unknown": _count("[Nn]"), "gaps": _count("[*#]"),
        "n_insertions": F.size("insertions").cast("long"), "n_deletions": F.size("deletions").cast("long"),
    })


def depth4(pileup: DataFrame, ref: str = "ref", alt: str = "alt", bases: str = "bases") -> DataFrame:
    """Depths of reference and alternative by strand; the alternative is one base, an insertion or a deletion."""
    counted = base_counts(pileup, bases)
    r, a = F.col(ref), F.col(alt)
    among = lambda name, seq: F.size(F.filter(name, lambda x: x == seq)).cast("long")
    added, gone = F.substr(a, F.lit(2)), F.substr(r, F.lit(2))
    by = lambda case: F.when(F.length(a) > F.length(r), among("insertions", case(added))).when(F.length(a) < F.length(r), among("deletions", case(gone))).otherwise((F.length("plain") - F.length(F.replace(F.col("plain"), case(a), F.lit("")))).cast("long"))
    return counted.withColumns({"dp_alt_fwd": by(F.upper), "dp_alt_rev": by(F.lower)})


def with_pileup_depths(variants: DataFrame, pileup: DataFrame) -> DataFrame:
    """Variants with plDP4 and plVAF of their first alternative from a sample's pileup; dots where it has no line."""
    first = variants.withColumn("__alt", F.get(F.split("alt", ","), F.lit(0)))
    there = pileup.select("chrom", "pos", F.coalesce("bases", F.lit("")).alias("__bases"))
    met = depth4(first.join(there, ["chrom", "pos"], "left"), "ref", "__alt", "__bases")
    four = [F.col(c) for c in ("ref_fwd", "ref_rev", "dp_alt_fwd", "dp_alt_rev")]
    known = F.col("__bases").isNotNull()
    share = general(vaf(four[2] + four[3], four[0] + four[1]), 3)
    out = met.withColumns({"plDP4": F.when(known, F.concat_ws(",", *[c.cast("string") for c in four])).otherwise(".,.,.,."), "plVAF": F.when(known, share).otherwise(".")})
    return out.select(*variants.columns, "plDP4", "plVAF")


def indel_totals(pileup: DataFrame, bases: str = "bases", depth: str = "depth") -> DataFrame:
    """Reads with an insertion or a deletion after a position, and their share of the depth there; 0 without depth."""
    counted = base_counts(pileup, bases)
    share = F.try_divide(F.col("n_insertions") + F.col("n_deletions"), F.col(depth))
    return counted.withColumn("indel_fraction", F.coalesce(share, F.lit(0.0)))
