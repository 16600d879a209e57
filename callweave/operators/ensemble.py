"""Union of call sets, votes, consensus, and comparison with a truth set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.expressions import general
from callweave.storage import settle

KEY = ["chrom", "pos", "ref", "alt"]


def explode_alts(calls: DataFrame) -> DataFrame:
    """One row for each alternative of ``A,C`` or ``A/C``."""
    return calls.withColumn("alt", F.explode(F.split("alt", "[,/]")))


def union_variants(calls: DataFrame) -> DataFrame:
    return explode_alts(calls).select(*KEY).distinct()


def default_verdict(filter_col: str = "filter") -> Column:
    """The vote of any caller: REJECT 0, LowQual half, otherwise 1."""
    f = F.col(filter_col)
    return F.when(f.rlike(r"\bREJECT\b"), 0.0).when(f.rlike(r"\bLowQual\b"), 0.5).otherwise(1.0)


def count_votes(calls: DataFrame, verdict: Column | None = None) -> DataFrame:
    """votes (fractions count) and num_tools (full votes) of every variant; one vote for each caller."""
    voted = explode_alts(calls).withColumn("__vote", verdict if verdict is not None else default_verdict())
    single = voted.groupBy(*KEY, "caller").agg(F.max("__vote").alias("__vote"))
    return single.groupBy(*KEY).agg(F.sum("__vote").alias("votes"), F.sum((F.col("__vote") == 1).cast("long")).alias("num_tools"), F.count("*").alias("n_callers"))


def min_callers(votes: DataFrame, least: float = 0.5) -> DataFrame:
    return votes.where(F.col("votes") >= least)


def consensus_label(num_tools: str, tools: int) -> Column:
    """PASS over half of the tools, LowQual from one and a third on, else REJECT."""
    n = F.col(num_tools)
    return F.when(n > 0.5 * tools, "PASS").when((n >= 1) & (n >= 0.33 * tools), "LowQual").otherwise("REJECT")


def label_truth(variants: DataFrame, truth: DataFrame | None) -> DataFrame:
    """is_true 1 or 0; null without a truth set."""
    if truth is None:
        return variants.withColumn("is_true", F.lit(None).cast("int"))
    known = truth.select(*KEY).distinct().withColumn("__t", F.lit(1))
    return variants.join(known, KEY, "left").withColumn("is_true", F.coalesce("__t", F.lit(0))).drop("__t")


def metrics(labelled: DataFrame, truth: DataFrame, positive: Column) -> DataFrame:
    """tp, fp, fn (of the distinct variants of ``truth``), precision, sensitivity and f1 of the rows that are called positive."""
    wanted = truth.select(*KEY).distinct().agg(F.count("*").alias("__n"))
    got = labelled.agg(F.count_if(positive & (F.col("is_true") == 1)).alias("tp"), F.count_if(positive & (F.col("is_true") == 0)).alias("fp"))
    got = got.join(F.broadcast(wanted)).withColumn("fn", F.col("__n") - F.col("tp")).drop("__n")
    got = got.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("sensitivity", F.try_divide("tp", F.col("tp") + F.col("fn")))
    return got.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


#: Metrics of features that come from one caller alone.
OWN_METRICS = {
    "if_MuTect": ("M2_NLOD", "M2_TLOD", "M2_STR", "M2_ECNT"), "if_JointSNVMix2": ("SNVMix2_Score",), "if_SomaticSniper": ("Sniper_Score",),
    "if_VarDict": ("VarDict_Score", "MSI", "MSILEN", "SHIFT3"), "if_Strelka": ("Strelka_Score", "Strelka_QSS", "Strelka_TQSS"),
}


def subtract_callers(features: DataFrame, gone: list[str], callers: list[str]) -> DataFrame:
    """Feature rows that verdict columns ``callers`` other than ``gone`` support; columns of the gone callers become null."""
    rest = sum((F.coalesce(F.col(c), F.lit(0)) for c in callers if c not in gone), F.lit(0))
    empty = [c for g in gone for c in (g, *OWN_METRICS.get(g, ())) if c in features.columns]
    return features.where(rest > 0).withColumns({c: F.lit(None).cast(features.schema[c].dataType) for c in empty})


def caller_combinations(calls: DataFrame, truth: DataFrame, callers: list[str]) -> DataFrame:
    """For every non-empty set of callers (a bit mask): the calls any of them passes, and how many are true.

    Calls that no member of a set passes are those whose own callers lie outside it.  These are sums over subsets: one
    pass for each caller adds the sums of masks without it to those with it, so no call meets each set.
    """
    bit = F.element_at(F.create_map(*[x for i, c in enumerate(callers) for x in (F.lit(c), F.lit(1 << i))]), F.col("caller"))
    masks = calls.where(default_verdict() == 1).groupBy(*KEY).agg(F.bit_or(bit).alias("mask"))
    by_mask = settle(label_truth(masks.where("mask is not null"), truth).groupBy("mask").agg(F.count("*").alias("n"), F.sum("is_true").alias("t")))
    everything = (1 << len(callers)) - 1
    below = by_mask
    for i in range(len(callers)):
        mask = F.col("mask")
        below = below.withColumn("mask", F.explode(F.when(mask.bitwiseAND(1 << i) == 0, F.array(mask, mask.bitwiseOR(F.lit(1 << i)))).otherwise(F.array(mask))))
        below = below.groupBy("mask").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    whole = by_mask.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"), F.sum("t").alias("all_t"))
    sets = calls.sparkSession.range(1, everything + 1).select(F.col("id").cast("int").alias("callers"), (F.lit(everything) - F.col("id")).cast("int").alias("mask"))
    found = sets.join(below, "mask", "left").join(whole)  # one row
    found = found.select("callers", (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("calls"), (F.col("all_t") - F.coalesce("t", F.lit(0))).alias("true_calls"))
    return found.where("calls > 0")


def compare_callsets(mine: DataFrame, truth: DataFrame) -> DataFrame:
    """Correct, FalsePositive and FalseNegative by coordinate, pairing records of a coordinate in order."""
    def numbered(df: DataFrame) -> DataFrame:
        return df.select(*KEY).distinct().withColumn("k", F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("ref", "alt")))

    both = numbered(mine).withColumn("__m", F.lit(1)).join(numbered(truth).withColumn("__t", F.lit(1)).drop("ref", "alt"), ["chrom", "pos", "k"], "full_outer")
    status = F.when(F.col("__m").isNull(), "FalseNegative").when(F.col("__t").isNull(), "FalsePositive").otherwise("Correct")
    return both.select("chrom", "pos", F.col("k").cast("long").alias("k"), status.alias("status"))


def fill_missing_samples(calls: DataFrame, samples: list[str], sample: str = "caller") -> DataFrame:
    """Every variant in every sample, with filter NONE where it wasn't called."""
    wanted = calls.select(*KEY).distinct().withColumn(sample, F.explode(F.array(*[F.lit(s) for s in samples])))
    return wanted.join(calls.select(*KEY, sample, "filter"), [*KEY, sample], "left").withColumn("filter", F.coalesce("filter", F.lit("NONE")))


def tally_samples(calls: DataFrame, depths: DataFrame, samples: list[str], labels: tuple[str, ...] = ("PASS",), least: int = 1, sample: str = "sample") -> DataFrame:
    """One row for each variant that has one of ``labels`` in at least ``least`` samples: num, and each sample's text.

    ``depths`` has var_reads and depth of variants by sample; the text is filter:var_reads/depth=share.
    """
    every = fill_missing_samples(calls, samples, sample).join(depths.select(*KEY, sample, "var_reads", "depth"), [*KEY, sample], "left").na.fill(0, ["var_reads", "depth"])
    share = F.coalesce(general(F.try_divide("var_reads", "depth")), F.lit("nan"))
    text = F.concat(F.replace(F.col("filter"), F.lit(";"), F.lit(",")), F.lit(":"), F.col("var_reads"), F.lit("/"), F.col("depth"), F.lit("="), share)
    told = every.withColumns({"__text": text, "__met": F.arrays_overlap(F.split("filter", ";"), F.array(*[F.lit(x) for x in labels]))})
    by = told.groupBy(*KEY).agg(F.count_if("__met").alias("num"), *[F.max(F.when(F.col(sample) == s, F.col("__text"))).alias(s) for s in samples])
    return by.where(F.col("num") >= least)
