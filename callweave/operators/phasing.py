"""Phasing of neighbouring variants: haplotypes that reads show over clusters of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.intervals import merge_intervals, overlap_join
from callweave.operators.reads import at_sites, drop_duplicate_reads
from callweave.operators.reference import with_window
from callweave.operators.site_calls import with_calls
from callweave.storage import settle

#: Clusters hold this many positions at most.
LONGEST = 5


def cluster_neighbours(calls: DataFrame, threshold: int = 1) -> DataFrame:
    """Sites of records with a one-base reference, chained while the gap to the next is at most ``threshold``.

    One row for each site of a cluster of 2 to LONGEST positions: first and last (the cluster's ends), pos, options (the
    reference base and the alternatives in order) and score (1 for a PASS, a half for a LowQual filter).
    """
    score = F.when(F.col("filter").contains("PASS"), 1.0).when(F.col("filter").contains("LowQual"), 0.5).otherwise(0.0)
    single = calls.where(F.length("ref") == 1)
    by = single.groupBy("chrom", "pos").agg(F.min("ref").alias("ref"), F.collect_set("alt").alias("__alts"), F.max(score).alias("score"))
    options = F.concat(F.array("ref"), F.array_sort(F.array_except(F.flatten(F.transform("__alts", lambda a: F.split(a, ","))), F.array("ref"))))
    sites = by.select("chrom", "pos", options.alias("options"), "score")
    chains = merge_intervals(sites.select("chrom", F.col("pos").cast("long").alias("start0"), (F.col("pos") + threshold).cast("long").alias("end0")))
    chains = chains.withColumns({"first": F.col("start0"), "last": F.col("end0") - threshold}).where(f"last - first between 1 and {LONGEST - 1}")
    points = sites.withColumns({"start0": F.col("pos").cast("long"), "end0": F.col("pos").cast("long") + 1})
    return overlap_join(points, chains).select("chrom", "first", "last", "pos", "options", "score")


def phase_variants(calls: DataFrame, reads: DataFrame, threshold: int = 1, reference: DataFrame | None = None) -> DataFrame:
    """One record for each cluster in which reads show another haplotype than the reference.

    A read counts if it has a base at every position of the cluster and each is one of the options there.  ``ref``, ``alt``
    (haplotypes joined by commas, in the order of the options), ``depths`` (of the reference and of each alternative)
    and the filter: PASS if the mean score of the variants exceeds 2/3, LowQual from 1/2 on, else REJECT.  Gaps in clusters
    (``threshold`` above 1) are filled from ``reference``.
    """
    sites = cluster_neighbours(calls, threshold)
    cluster = ["chrom", "first", "last"]
    gathered = sites.groupBy(*cluster).agg(F.collect_list(F.struct("pos", "options")).alias("own"), F.avg("score").alias("score"))
    if threshold > 1:
        every = gathered.select(*cluster, "score", F.explode(F.sequence("first", "last")).alias("pos"), "own")
        every = with_window(every, reference, 1, 0, "__base").withColumn("__o", F.filter("own", lambda x: x["pos"] == F.col("pos")))
        options = F.coalesce(F.get("__o", F.lit(0))["options"], F.array("__base"))
        gathered = every.groupBy(*cluster, "score").agg(F.collect_list(F.struct("pos", options.alias("options"))).alias("own"))
    gathered = settle(gathered.withColumn("own", F.array_sort("own")))
    kept = with_calls(drop_duplicate_reads(reads.where(F.col("flag").bitwiseAND(4) == 0)))
    # a read meets a cluster once, at its first position, and looks up its bases at all of them
    met = at_sites(kept, gathered.select(*cluster, "own", F.col("first").alias("pos")))
    base = lambda x: F.substr(F.col("seq"), F.get(F.col("__calls.offset"), (x["pos"] - 1 - F.col("start0")).cast("int")) + 1, F.lit(1))
    shown = met.withColumn("hap", F.transform("own", lambda x: F.coalesce(F.array_position(x["options"], base(x)), F.lit(0))))
    shown = shown.where(~F.array_contains("hap", 0)).groupBy(*cluster, "hap").agg(F.count("*").alias("n"))
    told = shown.join(gathered, cluster)
    letters = F.array_join(F.transform("hap", lambda i, k: F.get(F.get("own", k)["options"], i.cast("int") - 1)), "")
    told = told.withColumns({"text": letters, "plain": F.array_join(F.transform("own", lambda x: F.get(x["options"], F.lit(0))), "")})
    out = told.groupBy(*cluster, "score", "plain").agg(F.array_sort(F.collect_list(F.when(F.col("text") != F.col("plain"), F.struct("hap", "text", "n")))).alias("alts"), F.sum(F.when(F.col("text") == F.col("plain"), F.col("n")).otherwise(0)).alias("ref_depth"))
    out = out.where("size(alts) > 0")
    label = F.when(F.col("score") > 2 / 3, "PASS").when(F.col("score") >= 0.5, "LowQual").otherwise("REJECT")
    depths = F.concat(F.array("ref_depth"), F.transform("alts", lambda x: x["n"]))
    return out.select("chrom", F.col("first").alias("pos"), F.col("plain").alias("ref"), F.array_join(F.transform("alts", lambda x: x["text"]), ",").alias("alt"), label.alias("filter"), F.array_join(depths.cast("array<string>"), ",").alias("depths"))
