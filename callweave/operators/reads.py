"""Operators over aligned reads with chrom, start0, cigar, mapq and flags as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.expressions import reverse_complement
from callweave.operators.intervals import merge_intervals, overlap_join, running, touching
from callweave.storage import settle

#: Sites that are sent to all tasks at most.
BROADCAST_SITES = 300_000


def parse_cigar(cigar: str = "cigar") -> Column:
    """The operations as structs (n, op)."""
    return F.transform(F.regexp_extract_all(F.col(cigar), F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, "^[0-9]+", 0).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def _summed(ops: str) -> Column:
    lengths = F.regexp_extract_all(F.col("cigar"), F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0), lambda a, n: a + n.cast("int"))


def with_end(reads: DataFrame) -> DataFrame:
    """end0 from the operations that use reference bases."""
    return reads.withColumn("end0", F.col("start0") + _summed("MDN=X"))


def filter_reads(reads: DataFrame, min_mapq: int = 20, max_nm: int = 8, proper_only: bool = False, no_clips: bool = False) -> DataFrame:
    out = reads.where((F.col("mapq") >= min_mapq) & (F.col("nm") <= max_nm))
    out = out.where(_bit(2)) if proper_only else out
    return out.where(~F.col("cigar").contains("S")) if no_clips else out


def _bit(n: int) -> Column:
    return F.col("flag").bitwiseAND(n) != 0


def drop_duplicate_reads(reads: DataFrame) -> DataFrame:
    return reads.where(~_bit(1024))


def reads_in_regions(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """The reads that overlap a region, each once."""
    spanned = with_end(reads).withColumnRenamed("end0", "__to")
    return touching(spanned, regions, "left_semi", "start0", "__to").drop("__to")


def trim_soft_clips(reads: DataFrame) -> DataFrame:
    """Reads without leading and trailing soft clips, and how many bases they had.

    Bases, qualities, the tags BI and BD and the mate's CIGAR (the tag MC) are cut alike, where there are such columns.
    """
    head = F.coalesce(F.nullif(F.regexp_extract("cigar", "^([0-9]+)S", 1), F.lit("")).cast("int"), F.lit(0))
    tail = F.coalesce(F.nullif(F.regexp_extract("cigar", "[A-Z=]([0-9]+)S$", 1), F.lit("")).cast("int"), F.lit(0))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^[0-9]+S", ""), "(?<=[A-Z=])[0-9]+S$", "")
    cut = lambda c: F.substr(c, F.col("__head") + 1, F.length(c) - F.col("trimmed"))
    clipped = reads.withColumns({"__head": head, "trimmed": head + tail})
    made = {"cigar": bare("cigar")} | {c: cut(F.col(c)) for c in ("seq", "quals") if c in reads.columns}
    if "tags" in reads.columns:
        made["tags"] = F.transform_values("tags", lambda k, v: F.when((k == "BI") | (k == "BD"), cut(v)).when(k == "MC", bare(v)).otherwise(v))
    return clipped.withColumns(made).drop("__head")


def mate_pairs(reads: DataFrame, columns: tuple[str, ...] = ("chrom", "start0")) -> DataFrame:
    """First and second read of each name side by side, with ``columns`` as column1 and column2; secondary reads don't count."""
    primary = reads.where(~_bit(256))
    side = lambda bit, n: primary.where(_bit(bit)).select("qname", *[F.col(c).alias(f"{c}{n}") for c in columns])
    return side(64, 1).join(side(128, 2), "qname")


def reads_to_fastq(reads: DataFrame) -> DataFrame:
    """fastq1 and fastq2 of every pair: names with /1 and /2, bases and qualities in the order of the sequencer."""
    forward = reads.withColumns({
        "__seq": F.when(_bit(16), reverse_complement("seq")).otherwise(F.col("seq")), "__quals": F.when(_bit(16), F.reverse("quals")).otherwise(F.col("quals")),
    })
    pairs = mate_pairs(forward, ("__seq", "__quals"))
    record = lambda n: F.concat_ws("\n", F.concat(F.lit("@"), "qname", F.lit(f"/{n}")), f"__seq{n}", F.lit("+"), f"__quals{n}")
    return pairs.select("qname", record(1).alias("fastq1"), record(2).alias("fastq2"))


def reads_qc(reads: DataFrame, max_length: int = 1000) -> DataFrame:
    """One row of totals: duplicates, clipped and discordant reads, MAPQ 0, unmapped ones, and the fragments of proper pairs.

    The median fragment is the first length that half of the proper pairs don't exceed; mean and deviation are over
    lengths below ``max_length``.
    """
    mapped, proper = ~_bit(4), _bit(2)
    clipped = F.col("cigar").contains("S")
    length = F.abs("tlen")
    fair = F.when(proper & (length > 0) & (length < max_length), length)
    return reads.agg(
        F.count("*").alias("total"), F.count_if(_bit(1024)).alias("duplicates"), F.try_divide(F.count_if(_bit(1024)), F.count("*")).alias("duplicate_rate"),
        F.count_if(mapped & clipped & ~proper).alias("clipped_discordant"), F.count_if(mapped & clipped & proper).alias("clipped_only"),
        F.count_if(mapped & ~clipped & ~proper).alias("discordant_only"), F.count_if(mapped & (F.col("mapq") == 0)).alias("mq0"), F.count_if(~mapped).alias("unmapped"),
        F.expr(f"percentile_disc(0.5) within group (order by case when flag & 2 <> 0 then abs(tlen) end)").cast("long").alias("median_fragment"),
        F.avg(fair).alias("mean_fragment"), F.stddev_pop(fair).alias("sd_fragment"),
    )


def mapq_histogram(reads: DataFrame) -> DataFrame:
    """Reads and their share by mapping quality."""
    total = reads.agg(F.count("*").alias("__total"))
    counted = reads.groupBy("mapq").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(total)).select("mapq", "n", (F.col("n") / F.col("__total")).alias("share"))


def fragment_histogram(reads: DataFrame) -> DataFrame:
    """Proper reads and duplicates among them by fragment length."""
    by = reads.where(_bit(2)).groupBy(F.abs("tlen").alias("length")).agg(F.count_if(_bit(1024)).alias("duplicates"), F.count("*").alias("n"))
    return by.withColumn("duplicate_rate", F.col("duplicates") / F.col("n"))


def coverage_depth(reads: DataFrame, min_mapq: int = 0, min_bq: int = 0, regions: DataFrame | None = None) -> DataFrame:
    """Blocks of equal depth (above 0) over aligned bases, inside regions if there are any, from +1 and -1 steps at the blocks' ends.

    Steps are first summed up by bin of a contig, so that running depths start from each bin's own sum and no window
    holds a contig.  With ``min_bq`` only bases of that quality count.
    """
    kept = reads.where((F.col("mapq") >= min_mapq) & ~_bit(1024))
    spans = kept.select("chrom", F.explode(aligned_blocks()).alias("x"), *(["quals"] if min_bq else []))
    if min_bq:
        spans = spans.select("chrom", F.explode(_good_runs(min_bq)).alias("x"))
    steps = spans.select("chrom", F.explode(F.array(F.struct(F.col("x.s").alias("at"), F.lit(1).alias("d")), F.struct((F.col("x.s") + F.col("x.n")).alias("at"), F.lit(-1).alias("d")))).alias("y"))
    net = steps.groupBy("chrom", F.col("y.at").alias("start0")).agg(F.sum("y.d").alias("d")).where("d <> 0")
    depth = running(net, "start0", step="d").where("total > 0").select("chrom", "start0", F.col("next").alias("end0"), F.col("total").cast("long").alias("depth"))
    return depth if regions is None else _clipped(depth, regions)


def _clipped(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """The parts of blocks inside regions, with the blocks' other columns."""
    met = overlap_join(blocks, merge_intervals(regions))
    inside = met.withColumns({"start0": F.greatest("start0", "r_start0"), "end0": F.least("end0", "r_end0")})
    return inside.select(*blocks.columns)


def _good_runs(min_bq: int) -> Column:
    """The runs of bases of at least that quality in the block x (s, q, n) of a read: s and n."""
    high = rf"[\x{{{33 + min_bq:x}}}-\x{{10ffff}}]"
    runs = F.regexp_extract_all(F.substr("quals", (F.col("x.q") + 1).cast("int"), F.col("x.n").cast("int")), F.lit(f"{high}+|[^{high[1:]}+"), F.lit(0))
    start = F.struct(F.col("x.s").alias("at"), F.array().cast("array<struct<s:bigint,n:bigint>>").alias("b"))
    add = lambda a, r: F.struct(
        (a["at"] + F.length(r)).alias("at"), F.when(F.ascii(r) - 33 >= min_bq, F.concat(a["b"], F.array(F.struct(a["at"].alias("s"), F.length(r).cast("long").alias("n"))))).otherwise(a["b"]).alias("b"))
    return F.aggregate(runs, start, add)["b"]


def aligned_blocks() -> Column:
    """The read's blocks of aligned bases: s (0-based on the contig), q (in the read) and n (bases)."""
    block = "struct<s:bigint,q:bigint,n:bigint>"
    start = F.struct(F.col("start0").cast("long").alias("at"), F.lit(0).cast("long").alias("q"), F.array().cast(f"array<{block}>").alias("b"))
    add = lambda a, x: F.struct(
        (a["at"] + F.when(F.lit("MDN=X").contains(x["op"]), x["n"]).otherwise(0)).alias("at"), (a["q"] + F.when(F.lit("MIS=X").contains(x["op"]), x["n"]).otherwise(0)).alias("q"),
        F.when(F.lit("M=X").contains(x["op"]), F.concat(a["b"], F.array(F.struct(a["at"].alias("s"), a["q"].alias("q"), x["n"].cast("long").alias("n"))))).otherwise(a["b"]).alias("b"))
    return F.aggregate(parse_cigar(), start, add)["b"]


#: Thresholds of callable regions.
CALLABLE = {"min_depth": 4, "max_depth": -1, "min_mapq": 10, "min_bq": 20, "max_low_mapq": 1, "low_share": 0.1, "low_depth": 10}


def callable_regions(reads: DataFrame, contigs: DataFrame, **options: float) -> DataFrame:
    """Contigs cut into runs of one state: NO_COVERAGE, POOR_MAPPING_QUALITY, LOW_COVERAGE, EXCESSIVE_COVERAGE or CALLABLE.

    A position is poorly mapped if at least ``low_depth`` reads cover it and over ``low_share`` of them have at most
    ``max_low_mapq``; coverage counts bases of good mapping and base quality.  One pass of steps for all three depths.
    """
    o = CALLABLE | options
    kept = reads.where(~_bit(1024) & ~_bit(4))
    blocks = kept.select("chrom", "mapq", "quals", F.explode(aligned_blocks()).alias("x"))
    step = lambda s, n, all_, low, good: F.array(F.struct(s.alias("at"), all_.alias("a"), low.alias("l"), good.alias("g")), F.struct((s + n).alias("at"), (-all_).alias("a"), (-low).alias("l"), (-good).alias("g")))
    low = (F.col("mapq") <= o["max_low_mapq"]).cast("int")
    whole = step(F.col("x.s"), F.col("x.n"), F.lit(1), low, F.lit(0))
    runs = F.when(F.col("mapq") >= o["min_mapq"], _good_runs(o["min_bq"]))
    bases = F.coalesce(F.flatten(F.transform(runs, lambda r: step(r["s"], r["n"], F.lit(0), F.lit(0), F.lit(1)))), F.array().cast("array<struct<at:bigint,a:int,l:int,g:int>>"))
    steps = blocks.select("chrom", F.explode(F.concat(whole, bases)).alias("y")).select("chrom", "y.*")
    ends = contigs.select("chrom", F.explode(F.array(F.lit(0).cast("long"), F.col("size"))).alias("at"), *[F.lit(0).alias(c) for c in "alg"])
    net = steps.unionByName(ends).groupBy("chrom", "at").agg(*[F.sum(c).alias(c) for c in "alg"])
    # three depths at once: as digits of one number, each below 2^20
    packed = running(net.withColumn("__d", (F.col("a") * (1 << 40) + F.col("l") * (1 << 20) + F.col("g")).cast("long")), "at", step="__d").where("next is not null")
    packed = packed.withColumns({"good": F.expr("total & 1048575"), "poor": F.expr("shiftright(total, 20) & 1048575"), "depth": F.expr("shiftright(total, 40)")})
    state = F.when(F.col("depth") == 0, "NO_COVERAGE").when((F.col("depth") >= o["low_depth"]) & (F.col("poor") > o["low_share"] * F.col("depth")), "POOR_MAPPING_QUALITY")
    state = state.when(F.col("good") < o["min_depth"], "LOW_COVERAGE").when(F.lit(o["max_depth"] >= 0) & (F.col("good") > o["max_depth"]), "EXCESSIVE_COVERAGE").otherwise("CALLABLE")
    states = packed.select("chrom", F.col("at").alias("start0"), F.col("next").alias("end0"), state.alias("label"))
    return merge_intervals(states, ("label", "chrom")).select("chrom", "start0", "end0", "label")


def state_summary(states: DataFrame) -> DataFrame:
    """Bases by state."""
    return states.groupBy("label").agg(F.sum(F.col("end0") - F.col("start0")).alias("bases"))


def reads_at_sites(reads: DataFrame, sites: DataFrame, broadcast_rows: int = BROADCAST_SITES) -> DataFrame:
    """Every read with every site (chrom, pos) that it spans."""
    return at_sites(with_end(reads), sites, broadcast_rows)


def at_sites(spans: DataFrame, sites: DataFrame, broadcast_rows: int = BROADCAST_SITES) -> DataFrame:
    """Spans (chrom, start0, end0) with the sites (chrom, pos) in them, met in bins.

    Up to ``broadcast_rows`` sites go to the spans, in narrow bins, and no span is shuffled; more are joined in wide ones.
    """
    sites = settle(sites)
    few = sites.count() <= broadcast_rows
    width = 128 if few else 1024
    binned = spans.withColumn("__bin", F.explode(F.expr(f"sequence(start0 div {width}, (end0 - 1) div {width})")))
    keyed = sites.withColumn("__bin", F.expr(f"(pos - 1) div {width}"))
    return binned.join(F.broadcast(keyed) if few else keyed, ["chrom", "__bin"]).where("start0 < pos and pos <= end0").drop("__bin")


def site_depth(reads: DataFrame, sites: DataFrame, min_mq: int = 1) -> DataFrame:
    """Depth, quality and strand counts of the reads over each site; uncovered sites have zeros."""
    met = reads_at_sites(drop_duplicate_reads(reads), sites)
    ok = F.col("mapq") >= min_mq
    by = met.groupBy("chrom", "pos").agg(F.count("*").alias("dp"), F.count_if(F.col("mapq") == 0).alias("mq0"), F.count_if(ok & _bit(2)).alias("concordant"), F.count_if(ok & ~_bit(2)).alias("discordant"), F.count_if(ok & ~_bit(16)).alias("forward"), F.count_if(ok & _bit(16)).alias("reverse"), F.round(F.avg("mapq"), 6).alias("mean_mq"))
    return sites.join(by, ["chrom", "pos"], "left").na.fill(0, ["dp", "mq0", "concordant", "discordant", "forward", "reverse"])
