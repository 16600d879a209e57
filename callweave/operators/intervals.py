"""Interval operators over frames with chrom, start0 and end0 (0-based, half open)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of the bins in which a contig's intervals or positions are worked on first.
MERGE_BIN = 1 << 16
#: Logarithms of the widths of nested bins; an interval lives in the smallest bin that holds it whole.
LEVELS = (10, 13, 16, 19, 22, 25, 28, 31, 62)
#: Into how many parts the bins of each level are dealt, as many rows may look for partners in wide ones.
PARTS = {19: 4, 22: 16} | dict.fromkeys(LEVELS[5:], 64)


def _keys(start: Column, end: Column, up: int) -> Column:
    """Where an interval is, and where it looks for wider partners: structs (side, level, bin, part).

    Two intervals overlap only if the bin of one is the bin of the other or lies inside it.  So an interval goes to its own bin, to all parts
    of it, as ``side`` up, and to one part of each bin around it as the other side; equal bins count for the side 0 alone.
    """
    first, last = start.cast("long"), F.greatest(start, end - 1).cast("long")
    levels = F.array(*[F.lit(s) for s in LEVELS])
    own = F.get(F.filter(levels, lambda s: F.call_function("shiftright", first, s) == F.call_function("shiftright", last, s)), F.lit(0))
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k in PARTS.items() for x in k]), own), F.lit(1))
    at = lambda side, s, part: F.struct(F.lit(side).alias("side"), s.alias("level"), F.call_function("shiftright", first, s).alias("bin"), part.cast("int").alias("part"))
    around = [F.when((own <= s) if up == 0 else (own < s), at(up, F.lit(s), F.pmod(F.shiftright(first, 10), F.lit(PARTS.get(s, 1))))) for s in LEVELS]
    return F.concat(F.transform(F.sequence(F.lit(0), parts - 1), lambda p: at(1 - up, own, p)), F.filter(F.array(*around), lambda x: x.isNotNull()))


def overlap_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of overlapping rows; the right side's interval comes out as r_start0 and r_end0.

    Both sides are looked up in nested bins (``_keys``), so a row costs a few dozen keys at most, however wide it is, and each
    pair meets once.  Sizes are judged before keys are made, so a broadcast could be many times larger than it seems: the sides are merged.
    """
    right = right.withColumnsRenamed({"start0": "r_start0", "end0": "r_end0"})
    a = left.withColumn("__bin", F.explode(_keys(F.col("start0"), F.col("end0"), 0)))
    b = right.withColumn("__bin", F.explode(_keys(F.col("r_start0"), F.col("r_end0"), 1)))
    return a.join(b.hint("merge"), ["chrom", "__bin"]).where((F.col("start0") < F.col("r_end0")) & (F.col("r_start0") < F.col("end0"))).drop("__bin")


def variant_footprint(variants: DataFrame) -> DataFrame:
    """start0 and end0 of the reference bases of 1-based variants."""
    return variants.withColumns({"start0": (F.col("pos") - 1).cast("long"), "end0": (F.col("pos") - 1 + F.length("ref")).cast("long")})


def touching(rows: DataFrame, regions: DataFrame, how: str, start: str = "start0", end: str = "end0") -> DataFrame:
    """Rows that overlap a region (``left_semi``) or none (``left_anti``), as they are.

    Distinct spans are looked up in nested bins; rows then meet the spans found on equal ends, so they are neither
    multiplied nor told apart by their other values, and nulls overlap nothing.
    """
    spans = rows.select(F.col("chrom").alias("s_chrom"), F.col(start).alias("s_start0"), F.col(end).alias("s_end0")).distinct()
    looking = spans.withColumn("s_bin", F.explode(_keys(F.col("s_start0"), F.col("s_end0"), 0)))
    held = regions.where("start0 < end0").select("chrom", "start0", "end0", F.explode(_keys(F.col("start0"), F.col("end0"), 1)).alias("r_bin"))
    hit = (F.col("s_chrom") == F.col("chrom")) & (F.col("s_bin") == F.col("r_bin")) & (F.col("s_start0") < F.col("end0")) & (F.col("start0") < F.col("s_end0"))
    # merged, as sizes are judged before keys are made
    found = looking.join(held.hint("merge"), hit, "left_semi").select("s_chrom", "s_start0", "s_end0").distinct()
    return rows.join(found, (rows["chrom"] == F.col("s_chrom")) & (rows[start] == F.col("s_start0")) & (rows[end] == F.col("s_end0")), how)


def _touched(variants: DataFrame, regions: DataFrame, how: str) -> DataFrame:
    spanned = variants.withColumns({"__from": (F.col("pos") - 1).cast("long"), "__to": (F.col("pos") - 1 + F.length("ref")).cast("long")})
    return touching(spanned, regions, how, "__from", "__to").drop("__from", "__to")


def include_regions(variants: DataFrame, regions: DataFrame) -> DataFrame:
    return _touched(variants, regions, "left_semi")


def exclude_regions(variants: DataFrame, regions: DataFrame) -> DataFrame:
    return _touched(variants, regions, "left_anti")


def intersect_regions(variants: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    variants = variants if include is None else include_regions(variants, include)
    return variants if exclude is None else exclude_regions(variants, exclude)


def in_region(positions: DataFrame, regions: DataFrame) -> DataFrame:
    """The boolean in_region: whether start0 < pos <= end0 for any region."""
    spanned = positions.select("chrom", "pos").distinct().withColumns({"__from": (F.col("pos") - 1).cast("long"), "__to": F.col("pos").cast("long")})
    hit = touching(spanned, regions, "left_semi", "__from", "__to").select("chrom", "pos", F.lit(True).alias("__in"))
    return positions.join(hit, ["chrom", "pos"], "left").withColumn("in_region", F.coalesce("__in", F.lit(False))).drop("__in")


def _islands(regions: DataFrame, within: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """Overlapping or touching intervals as one, as far as a window over ``within`` shows them; columns ``by``, start0, end0."""
    order = Window.partitionBy(*within).orderBy("start0", "end0")
    before = F.max("end0").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = regions.withColumn("__new", F.coalesce((F.col("start0") > before).cast("int"), F.lit(1)))
    islands = marked.withColumn("__island", F.sum("__new").over(order))
    return islands.groupBy(*within, "__island").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0")).select(*dict.fromkeys([*by, *within]), "start0", "end0")


def merge_intervals(regions: DataFrame, by: tuple[str, ...] = ("chrom",), width: int = MERGE_BIN) -> DataFrame:
    """Overlapping or touching intervals as one, within each value of ``by``.

    Rows are merged inside the bin of their start first.  How far earlier bins reach is a running maximum over one row for
    each bin; an island up to that reach, or the last of its bin that reaches the next bin with rows, is
    joined with others in a second merge, which sees those islands alone.
    """
    binned = regions.withColumn("__bin", F.floor(F.col("start0") / width))
    inner = _islands(binned, (*by, "__bin"), by)
    bins = inner.groupBy(*by, "__bin").agg(F.min("start0").alias("__first"), F.max("end0").alias("__last"))
    line = Window.partitionBy(*by).orderBy("__bin")
    reach = F.max("__last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__bin").alias("__of"), reach.alias("__reach"), F.lead("__first").over(line).alias("__next"))
    same = F.col("__bin").eqNullSafe(F.col("__of"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    crosses = F.coalesce(F.col("start0") <= F.col("__reach"), F.lit(False)) | F.coalesce(F.col("end0") >= F.col("__next"), F.lit(False))
    placed = inner.join(bins, same).select(*by, "start0", "end0", crosses.alias("__crosses"))
    joined = _islands(placed.where("__crosses").select(*by, "start0", "end0"), by, by)
    return placed.where("not __crosses").select(*by, "start0", "end0").unionByName(joined)


def running(rows: DataFrame, at: str, by: str = "chrom", step: str | None = None, width: int = MERGE_BIN) -> DataFrame:
    """Distinct positions with ``next``, the position after each, and the ``total`` of ``step`` up to and with it.

    Both are windows inside the bins of a contig, carried on by windows over one row for each bin, so that no window holds a contig.
    """
    binned = rows.withColumn("__bin", F.floor(F.col(at) / width)).withColumn("__step", F.col(step) if step else F.lit(0))
    bins = binned.groupBy(by, "__bin").agg(F.min(at).alias("__first"), F.sum("__step").alias("__sum"))
    line = Window.partitionBy(by).orderBy("__bin")
    before = F.coalesce(F.sum("__sum").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select(by, "__bin", before.alias("__base"), F.lead("__first").over(line).alias("__after"))
    inner = Window.partitionBy(by, "__bin").orderBy(at)
    out = binned.withColumns({"__lead": F.lead(at).over(inner), "__part": F.sum("__step").over(inner)}).join(bins, [by, "__bin"])
    out = out.withColumns({"next": F.coalesce("__lead", "__after"), "total": F.col("__base") + F.col("__part")})
    return out.drop("__bin", "__step", "__lead", "__part", "__base", "__after")


#: Labels that fit into one number as bits.
MOST_LABELS = 62


def count_loci(regions: DataFrame, contigs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Segments between all boundaries of the labelled, merged region sets: how many sets cover each, and which.

    Covers [0, size) of every contig that has a region; uncovered segments have labels '.'.  Labels come in the order of
    ``labels``, else sorted.  A label is a bit that its merged regions switch on and off, so a running sum of the switches is
    the set that covers a segment; with more labels than bits, segments and regions are joined.
    """
    merged = merge_intervals(regions, ("label", "chrom"))
    named = contigs.join(merged.select("chrom").distinct(), "chrom", "left_semi")
    names = [r[0] for r in regions.select("label").distinct().limit(MOST_LABELS + 1).collect() if r[0] is not None]
    ends = named.select("chrom", F.explode(F.array(F.lit(0).cast("long"), F.col("size"))).alias("at"), F.lit(0).cast("long").alias("d"))
    if len(names) > MOST_LABELS:
        return _joined_loci(merged, ends, labels)
    said = [*(x for x in labels or [] if x in names), *sorted(x for x in names if x not in (labels or []))]
    bit = F.coalesce(*[F.when(F.col("label") == x, F.lit(1 << i)) for i, x in enumerate(said)], F.lit(0)).cast("long")
    steps = merged.select("chrom", F.explode(F.array(F.struct(F.col("start0").alias("at"), bit.alias("d")), F.struct(F.col("end0").alias("at"), (-bit).alias("d")))).alias("x")).select("chrom", "x.at", "x.d")
    net = steps.unionByName(ends).groupBy("chrom", "at").agg(F.sum("d").alias("d"))
    segments = running(net, "at", step="d").where("next is not null").select("chrom", F.col("at").alias("start0"), F.col("next").alias("end0"), F.col("total").cast("long").alias("__on"))
    told = F.array_compact(F.array(*[F.when(F.col("__on").bitwiseAND(F.lit(1 << i)) != 0, F.lit(x)) for i, x in enumerate(said) if labels is None or x in labels])) if said else F.array().cast("array<string>")
    return segments.select("chrom", "start0", "end0", F.bit_count("__on").cast("long").alias("n_sets"), F.when(F.col("__on") == 0, ".").otherwise(F.array_join(told, ",")).alias("labels"))


def _joined_loci(merged: DataFrame, ends: DataFrame, labels: list[str] | None) -> DataFrame:
    edges = merged.select("chrom", F.explode(F.array("start0", "end0")).alias("at")).unionByName(ends.select("chrom", "at")).distinct()
    segments = running(edges, "at").where("next is not null").select("chrom", F.col("at").alias("start0"), F.col("next").alias("end0"))
    found = F.array_sort(F.collect_set("label"))
    ordered = found if labels is None else F.array_intersect(F.array(*[F.lit(x) for x in labels]), found)
    covered = overlap_join(segments, merged).groupBy("chrom", "start0", "end0").agg(F.count("*").alias("n_sets"), F.array_join(ordered, ",").alias("labels"))
    out = segments.join(covered, ["chrom", "start0", "end0"], "left")
    return out.select("chrom", "start0", "end0", F.coalesce("n_sets", F.lit(0)).cast("long").alias("n_sets"), F.coalesce("labels", F.lit(".")).alias("labels"))


def region_depth(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """Segments between all boundaries of the regions as they are, with how many cover each; equal neighbours stay apart."""
    steps = regions.select("chrom", F.explode(F.array(F.struct(F.col("start0").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end0").alias("at"), F.lit(-1).alias("d")))).alias("x")).select("chrom", "x.at", "x.d")
    named = contigs.join(regions.select("chrom").distinct(), "chrom", "left_semi")
    ends = named.select("chrom", F.explode(F.array(F.lit(0).cast("long"), F.col("size"))).alias("at"), F.lit(0).alias("d"))
    net = steps.unionByName(ends).groupBy("chrom", "at").agg(F.sum("d").alias("d"))
    return running(net, "at", step="d").where("next is not null").select("chrom", F.col("at").alias("start0"), F.col("next").alias("end0"), F.col("total").cast("long").alias("n_regions"))


def split_equal_bp(regions: DataFrame, shards: int, contigs: DataFrame | None = None) -> DataFrame:
    """Regions in order cut into ``shards`` parts of ceil(total / shards) bases, with 1-based shard numbers.

    Contigs go in the order of ``contigs`` (their ``offset``), else by name.  Running offsets are summed up inside bins,
    then over the bins of a contig, then over contigs, so no task sees all regions.
    """
    length = F.col("end0") - F.col("start0")
    total = regions.agg(F.sum(length)).first()[0] or 0
    per = -(-total // shards) or 1
    rows = regions.select("chrom", "start0", "end0", length.alias("__n"), F.floor(F.col("start0") / MERGE_BIN).alias("__bin"))
    inner = F.coalesce(F.sum("__n").over(Window.partitionBy("chrom", "__bin").orderBy("start0", "end0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = rows.groupBy("chrom", "__bin").agg(F.sum("__n").alias("__n"))
    if contigs is None:
        bins = bins.withColumn("__rank", F.col("chrom"))
    else:
        bins = bins.join(F.broadcast(contigs.select("chrom", F.col("offset").alias("__rank"))), "chrom", "left")
    whole = bins.groupBy("chrom", "__rank").agg(F.sum("__n").alias("__n"))
    ahead = Window.orderBy(F.col("__rank").asc_nulls_last(), "chrom").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("chrom", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__contig"))
    line = Window.partitionBy("chrom").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("chrom", "__bin", F.coalesce(F.sum("__n").over(line), F.lit(0)).alias("__base")).join(whole, "chrom")
    placed = rows.withColumn("__inner", inner).join(bins, ["chrom", "__bin"]).withColumn("__off", F.col("__inner") + F.col("__base") + F.col("__contig"))
    cut = placed.where("__n > 0").withColumn("__s", F.explode(F.expr(f"sequence(__off div {per}, (__off + __n - 1) div {per})")))
    start = F.greatest(F.col("start0"), F.col("start0") + F.col("__s") * per - F.col("__off"))
    end = F.least(F.col("end0"), F.col("start0") + (F.col("__s") + 1) * per - F.col("__off"))
    return cut.select((F.col("__s") + 1).alias("shard"), "chrom", start.alias("start0"), end.alias("end0"))


def tile_regions(regions: DataFrame, length: int = 5000, overlap: int = 150, left_flank: int | None = None, right_flank: int | None = None) -> DataFrame:
    """Tiles of fixed length with overlap over the regions with their flanks (``overlap`` bases unless given).

    Once a tile would pass the end of a region, it is the last one and ends with the region's right flank.
    """
    if length <= overlap:
        raise ValueError("tiles must be longer than their overlap")
    left, right = (overlap if f is None else f for f in (left_flank, right_flank))
    step = length - overlap
    rows = regions.select("chrom", F.greatest(F.col("start0") - left, F.lit(0)).alias("__i"), F.col("end0").alias("__e"), (F.col("end0") + right).alias("__end"))
    last = F.when(F.col("__i") + length >= F.col("__end"), 0).otherwise(F.greatest(F.lit(1), F.floor((F.col("__e") - length - F.col("__i")) / step) + 1)).cast("long")
    tiles = rows.withColumn("__last", last).withColumn("k", F.explode(F.expr("sequence(0L, __last)"))).withColumn("start0", F.col("__i") + F.col("k") * step)
    end = F.when(F.col("k") == F.col("__last"), F.col("__end")).otherwise(F.col("start0") + length)
    return tiles.select("chrom", "start0", end.alias("end0"), F.concat_ws("_", "chrom", "start0", F.col("k") + 1).alias("name"))


def sites_from_regions(regions: DataFrame) -> DataFrame:
    """Every base of the regions, as 1-based positions."""
    return regions.select("chrom", F.explode(F.sequence(F.col("start0") + 1, F.col("end0"))).alias("pos"))
