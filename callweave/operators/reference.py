"""The reference sequence as overlapping tiles, windows around sites, and features of the sequence there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.expressions import p2phred, run_lengths
from callweave.functions.substrings import linguistic_complexity

#: Tiles begin every STEP bases and go on for OVERLAP bases beyond, so that a window is in one tile.
STEP = 4096
OVERLAP = 256


def tiles(sequences: DataFrame) -> DataFrame:
    """chrom, tile, start0 and seq of contigs with chrom and sequence."""
    starts = sequences.select("chrom", "sequence", F.explode(F.expr(f"sequence(0L, (length(sequence) - 1L) div {STEP})")).alias("tile"))
    cut = F.substr(F.col("sequence"), (F.col("tile") * STEP + 1).cast("int"), F.lit(STEP + OVERLAP))
    return starts.where("length(sequence) > 0").select("chrom", "tile", (F.col("tile") * STEP).alias("start0"), cut.alias("seq"))


def with_window(sites: DataFrame, reference: DataFrame, before: int, after: int, name: str = "window") -> DataFrame:
    """Sites with the bases [pos - before, pos + after), cut at the contig's ends, and its 0-based start as ``name``_start0.

    One equi-join with the tiles; a site outside the reference has nulls.
    """
    if before + after > OVERLAP:
        raise ValueError(f"windows hold {OVERLAP} bases at most")
    first = F.greatest(F.col("pos") - before, F.lit(0)).cast("long")
    keyed = sites.withColumn(f"{name}_start0", first).withColumn("__tile", F.floor(first / STEP).cast("long"))
    there = reference.select("chrom", F.col("tile").alias("__tile"), F.col("start0").alias("__start0"), F.col("seq").alias("__seq"))
    joined = keyed.join(there, ["chrom", "__tile"], "left")
    cut = F.substr(F.col("__seq"), (F.col(f"{name}_start0") - F.col("__start0") + 1).cast("int"), (F.col("pos") + after - F.col(f"{name}_start0")).cast("int"))
    return joined.withColumn(name, F.nullif(cut, F.lit(""))).drop("__tile", "__start0", "__seq")


def _part(start: Column, end: Column) -> Column:
    """Bases [start, end) of the window."""
    start = F.greatest(start, F.lit(0))
    return F.substr(F.col("window"), (start - F.col("window_start0") + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def _touching(seq: Column, allele: str) -> Column:
    """How many bases at the start of ``seq`` equal a one-base allele in a row."""
    same = F.length(F.regexp_extract(seq, r"^(.)\1*", 0))
    return F.when((F.length(allele) == 1) & (F.left(seq, F.lit(1)) == F.col(allele)), same).otherwise(0)


def sequence_features(variants: DataFrame, reference: DataFrame) -> DataFrame:
    """Homopolymer lengths and Phred-scaled complexity of the reference around variants.

    max_homopolymer: the longest run in 20 bases, the reference or alternative allele, and 20 bases; site_homopolymer: the
    run of either allele that touches the site, with the site.  complexity_span is over 81 bases around the site,
    complexity_adjacent the lower one of the 81 bases on either side; windows of up to 20 bases have none.
    """
    rows = with_window(variants, reference, 81, 81)
    pos = F.col("pos")
    rows = rows.withColumns({"__l": _part(pos - 20, pos), "__r": _part(pos + 1, pos + 21)})
    rows = rows.withColumns({"__ref41": F.concat("__l", "ref", "__r"), "__alt41": F.concat("__l", "alt", "__r"), "__back": F.reverse("__l")})
    rows = rows.withColumns({"__span": F.upper(_part(pos - 41, pos + 40)), "__left": F.upper(_part(pos - 81, pos)), "__right": F.upper(_part(pos, pos + 81))})
    # up to 20 bases have no complexity; null here, as calls of Python are made for all rows
    rows = rows.withColumns({f"__{w}": F.when(F.length(f"__{w}") > 20, F.col(f"__{w}")) for w in ("span", "left", "right")})
    longest = F.greatest(F.array_max(run_lengths("__ref41")), F.array_max(run_lengths("__alt41")))
    touching = [_touching(F.col("__r"), a) + _touching(F.col("__back"), a) for a in ("ref", "alt")]
    rows = rows.withColumns({"max_homopolymer": longest, "site_homopolymer": F.greatest(*touching) + 1})
    rows = rows.withColumns({f"__c{w}": linguistic_complexity(f"__{w}", 20) for w in ("span", "left", "right")})
    lower = F.when(F.col("__cleft").isNotNull(), F.least("__cleft", "__cright"))
    rows = rows.withColumns({"complexity_span": p2phred(1 - F.col("__cspan"), 40.0), "complexity_adjacent": p2phred(1 - lower, 40.0)})
    return rows.select(*[c for c in rows.columns if not c.startswith("__") and c not in ("window", "window_start0")])
