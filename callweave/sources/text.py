"""Text formats of variant work as tables: variant files, regions, contigs, sequences, reads, pileups, feature tables.

Every source is a projection of ``spark.read.text`` or ``spark.read.csv``; compressed files are read as they are.  A line that
lacks fields has nulls there.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.expressions import general
from callweave.operators.intervals import running
from callweave.operators.reads import parse_cigar
from callweave.operators.reference import OVERLAP, STEP
from callweave.operators.summaries import unsorted_records

FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")


def _lines(spark: SparkSession, path: str | list[str], skip: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").rlike(skip) & (F.trim("value") != ""))


def _field(i: int, parts: Column) -> Column:
    return F.get(parts, F.lit(i))


def _absent(value: Column) -> Column:
    """A dot stands for no value."""
    return F.nullif(value, F.lit("."))


def scan_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The eight fixed fields, the format keys, the samples as an array, and the file of each record."""
    parts = F.split("value", "\t")
    made = _lines(spark, path, "^#").select(*[_field(i, parts).alias(n) for i, n in enumerate(FIXED)], F.split(_field(8, parts), ":").alias("format"), F.slice(parts, 10, F.greatest(F.size(parts) - 9, F.lit(0))).alias("samples"), F.input_file_name().alias("file"))
    return made.withColumns({"pos": F.col("pos").cast("long"), "qual": _absent(F.col("qual")).try_cast("double"), **{n: _absent(F.col(n)) for n in ("id", "filter", "info")}})


def scan_vcf_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header lines: the kind (INFO, FORMAT, FILTER, CHROM, ...), the ID that it declares, and the line."""
    lines = spark.read.text(path).where(F.col("value").startswith("#"))
    kind = F.when(F.col("value").startswith("##"), F.regexp_extract("value", "^##([^=]+)=", 1)).otherwise(F.lit("CHROM"))
    return lines.select(kind.alias("kind"), F.nullif(F.regexp_extract("value", "^##[^=]+=<ID=([^,>]+)", 1), F.lit("")).alias("id"), F.col("value").alias("line"))


def format_keys() -> Column:
    return F.col("format")


def sample_map(sample: int = 0) -> Column:
    """A record's format keys with their values in one sample; the longer of the two is cut."""
    values = F.split(F.get("samples", F.lit(sample)), ":")
    n = F.least(F.size("format"), F.size(values))
    return F.map_from_arrays(F.slice("format", F.lit(1), n), F.slice(values, F.lit(1), n))


def sample_value(key: str, sample: int = 0) -> Column:
    """The value that a record of ``scan_vcf`` has for a format key in one sample; null if it has none."""
    return F.get(F.split(F.get("samples", F.lit(sample)), ":"), F.nullif(F.array_position("format", key), F.lit(0)).cast("int") - 1)


def scan_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, start0, end0 (one base where the end is missing) and label."""
    parts = F.split("value", r"\s+")
    start = _field(1, parts).cast("long")
    return _lines(spark, path, "^(track|browser|#)").select(_field(0, parts).alias("chrom"), start.alias("start0"), F.coalesce(_field(2, parts).cast("long"), start + 1).alias("end0"), _field(3, parts).alias("label"))


def scan_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Contig, size and offset (which grows with the order of appearance) of an index of sequences, or of a dictionary (@SQ lines).

    In a dictionary the offset is the sum of the sizes before, so one file's few lines are one window.
    """
    parts = F.split("value", "\t")
    if not path.endswith(".dict"):
        return _lines(spark, path, "^#").select(F.regexp_extract(_field(0, parts), r"^\S+", 0).alias("chrom"), _field(1, parts).cast("long").alias("size"), _field(2, parts).cast("long").alias("offset"))
    tag = lambda k: F.regexp_extract("value", rf"\t{k}:([^\t]+)", 1)
    rows = spark.read.text(path).where(F.col("value").startswith("@SQ")).select(F.regexp_extract(tag("SN"), r"^\S+", 0).alias("chrom"), tag("LN").cast("long").alias("size"), F.monotonically_increasing_id().alias("__line"))
    before = Window.orderBy("__line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("chrom", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))


#: Place of a line: its file, the split of the file, and a number that grows with the lines of a split.
SPLIT = ("__file", "__block")


def _split_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their place; the reader cuts files into splits of ``spark.sql.files.maxPartitionBytes``."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))


def file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value and ``line``: numbers without gaps from 0 in the order of the files, blank lines and headers included.

    Parts of a written table follow one another by their number, other files before them by name.  Lines are counted by split; windows
    see one row a split of one file, and one row a file, so no task sees all lines and none are sorted.
    """
    lines = _split_lines(spark, path)
    splits = lines.groupBy(*SPLIT).agg(F.min("__id").alias("__from"), F.count("*").alias("__n"))
    part = F.regexp_extract("__file", r"/part-(\d+)[^/]*$", 1).try_cast("long")
    files = splits.groupBy("__file").agg(F.sum("__n").alias("__n"))
    ahead = Window.orderBy(part.asc_nulls_first(), "__file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("__file", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("__base2", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(files, "__file")
    first = starts.select(*SPLIT, (F.col("__base") + F.col("__base2") - F.col("__from")).alias("__shift"))
    return lines.join(first, list(SPLIT)).select("value", (F.col("__id") + F.col("__shift")).alias("line"))


def scan_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sequences as overlapping tiles (chrom, tile, start0, seq); the name is cut at the first blank.

    A contig is never one row: each line gets its base offset by a running sum inside its split, which the splits of its file
    carry on, and tiles are put together from the pieces of their lines.  Contigs of one name in several places stay apart;
    empty ones and bases before the first name have no tiles.
    """
    head = F.col("value").startswith(">")
    made = _split_lines(spark, path).select(*SPLIT, "__id", F.when(head, F.regexp_extract("value", r"^>(\S*)", 1)).alias("__name"), F.when(head, "").otherwise(F.regexp_replace("value", r"\s", "")).alias("__bases"))
    upto = Window.partitionBy(*SPLIT).orderBy("__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = made.withColumn("__sum", F.sum(F.length("__bases").cast("long")).over(upto))
    own = F.last(F.when(F.col("__name").isNotNull(), F.struct(F.col("__id").alias("at"), F.col("__name").alias("chrom"), F.col("__sum").alias("before"))), ignorenulls=True)
    lines = summed.withColumn("__own", own.over(upto))

    last = lines.groupBy(*SPLIT).agg(F.max_by(F.struct("__own", "__sum"), "__id").alias("e"))
    last = last.select(*SPLIT, F.col("e.__own").alias("__last"), (F.col("e.__sum") - F.coalesce(F.col("e.__own.before"), F.lit(0))).alias("__tail"))
    inside = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = last.withColumn("__ahead", F.coalesce(F.sum("__tail").over(inside), F.lit(0)))
    begun = F.last(F.when(F.col("__last").isNotNull(), F.struct(F.col("__last.at").alias("at"), F.col("__last.chrom").alias("chrom"), F.col("__ahead").alias("before"))), ignorenulls=True)
    carried = ahead.withColumn("__open", begun.over(inside)).select(*SPLIT, "__open", (F.col("__ahead") - F.coalesce(F.col("__open.before"), F.lit(0))).alias("__carried"))

    n = F.length("__bases").cast("long")
    contig = F.when(F.col("__own").isNotNull(), F.struct("__own.at", "__own.chrom")).otherwise(F.struct("__open.at", "__open.chrom"))
    start = F.col("__sum") - n + F.when(F.col("__own").isNotNull(), -F.col("__own.before")).otherwise(F.col("__carried"))
    placed = lines.where(n > 0).join(carried, list(SPLIT)).select(contig.alias("c"), start.alias("__start"), "__bases").where("c.chrom is not null")
    reach = F.expr(f"sequence(greatest((__start - {OVERLAP}) div {STEP}, 0L), (__start + length(__bases) - 1) div {STEP})")
    cut = placed.withColumn("tile", F.explode(reach)).withColumn("__at", F.greatest(F.col("__start"), F.col("tile") * STEP))
    piece = F.substr("__bases", (F.col("__at") - F.col("__start") + 1).cast("int"), (F.col("tile") * STEP + STEP + OVERLAP - F.col("__at")).cast("int"))
    pieces = F.array_sort(F.collect_list(F.struct("__at", piece.alias("piece"))))
    return cut.groupBy("c", "tile").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("seq")).select("c.chrom", "tile", (F.col("tile") * STEP).alias("start0"), "seq")


def scan_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Aligned reads: the fields of a line, tags as a map, nm and the 0-based span."""
    parts = F.split("value", "\t")
    tags = F.transform(F.slice(parts, 12, F.greatest(F.size(parts) - 11, F.lit(0))), lambda t: F.split(t, ":", 3))
    mapped = F.map_from_entries(F.transform(tags, lambda t: F.struct(t[0], t[2])))
    named = ((0, "qname", "string"), (1, "flag", "int"), (2, "chrom", "string"), (4, "mapq", "int"), (5, "cigar", "string"), (6, "mate_chrom", "string"), (7, "mate_pos", "long"), (8, "tlen", "long"), (9, "seq", "string"), (10, "quals", "string"))
    made = _lines(spark, path, "^@[A-Z][A-Z]\t").select(*[_field(i, parts).cast(t).alias(n) for i, n, t in named], (_field(3, parts).cast("long") - 1).alias("start0"), mapped.alias("tags"))
    made = made.withColumns({c: F.nullif(c, F.lit("*")) for c in ("chrom", "cigar", "seq", "quals")} | {"nm": F.try_element_at("tags", F.lit("NM")).try_cast("int")})
    span = F.aggregate(F.filter(parse_cigar(), lambda x: F.lit("MDN=X").contains(x["op"])), F.lit(0), lambda a, x: a + x["n"])
    return made.withColumn("end0", F.col("start0") + F.coalesce(span, F.lit(0)))


def sample_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distinct samples that the read groups of alignment headers name."""
    groups = spark.read.text(path).where(F.col("value").startswith("@RG\t"))
    return groups.select(F.regexp_extract("value", r"\tSM:([^\t]+)", 1).alias("sample")).where("sample <> ''").distinct()


def scan_pileup(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, pos, ref, depth, bases, quals; lines of four fields have no reads."""
    parts = F.split("value", "\t")
    return _lines(spark, path, "^#").select(_field(0, parts).alias("chrom"), _field(1, parts).cast("long").alias("pos"), _field(2, parts).alias("ref"), _field(3, parts).cast("int").alias("depth"), _field(4, parts).alias("bases"), _field(5, parts).alias("quals"))


def scan_positions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    parts = F.split("value", r"\s+")
    return _lines(spark, path, "^#").select(_field(0, parts).alias("chrom"), _field(1, parts).cast("long").alias("pos"))


#: Columns of feature tables that are text; all others are numbers.
TEXT_COLUMNS = ("CHROM", "ID", "REF", "ALT")


def scan_features(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Labelled feature tables, each with its header; ``nan`` is null, and columns that a table lacks are null in its rows.

    Types follow from the columns' names, so files are read once; only their first lines are looked at before.
    """
    def one(p: str) -> DataFrame:
        names = spark.read.text(p).first()[0].split("\t")
        schema = ", ".join(f"`{n}` {'string' if n in TEXT_COLUMNS else 'bigint' if n == 'POS' else 'double'}" for n in names)
        return spark.read.csv(p, sep="\t", header=True, schema=schema, nullValue="nan", enforceSchema=False)

    paths = [path] if isinstance(path, str) else path
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, paths))


def concat_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows of variant, region or feature tables; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def unique_rows(rows: DataFrame) -> DataFrame:
    return rows.distinct()


def sort_by_contig(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Distinct rows in the order of contigs and positions, then of alleles; rows of unknown contigs come last.

    Copies are dropped before rows are dealt to ranges, so neither copies nor, with alleles, one crowded position fill a range.
    """
    rank = contigs.select("chrom", F.col("offset").alias("__rank"))
    alleles = [c for c in ("ref", "alt") if c in rows.columns]
    return unique_rows(rows).join(rank, "chrom", "left").orderBy(F.col("__rank").asc_nulls_last(), "chrom", "pos", *alleles).drop("__rank")


def vcf_header(declared: dict[str, tuple[str, str, str, str]], filters: dict[str, str], samples: list[str], kept: list[str] | None = None, dropped: tuple[str, ...] = ()) -> list[str]:
    """Header lines: ``declared`` has INFO or FORMAT, number, type and description by ``kind:ID``; FILTER by id.

    ``kept`` are lines of other headers, of which those that declare an ID in ``dropped`` go.  Declarations are sorted.
    """
    own = [f'##{k}=<ID={name.split(":", 1)[1]},Number={number},Type={kind},Description="{text}">' for name, (k, number, kind, text) in declared.items()]
    own += [f'##FILTER=<ID={n},Description="{text}">' for n, text in filters.items()]
    others = [x for x in kept or [] if x.startswith("##") and not any(f"=<ID={d}," in x for d in dropped) and not x.startswith("##fileformat")]
    listed = sorted({x for x in own + others if x.startswith(("##INFO", "##FORMAT", "##FILTER"))})
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    return ["##fileformat=VCFv4.1", *sorted(x for x in others if x not in listed), *listed, "\t".join(columns)]


def record_lines(rows: DataFrame) -> Column:
    """A record as a line, a dot for nulls; format and samples follow where there are any."""
    cells = [F.coalesce(F.col(n).cast("string"), F.lit(".")) if n in rows.columns else F.lit(".") for n in FIXED]
    cells[FIXED.index("qual")] = F.coalesce(general(F.col("qual"), 10), F.lit(".")) if "qual" in rows.columns else F.lit(".")
    if {"format", "samples"} <= set(rows.columns):
        tail = F.when(F.size("samples") > 0, F.concat_ws("\t", F.array_join("format", ":"), F.array_join("samples", "\t")))
        cells.append(tail)
    return F.concat_ws("\t", *cells)


def write_vcf(rows: DataFrame, path: str, contigs: DataFrame | None = None, header: list[str] | None = None) -> None:
    """Records as lines in order; parts follow one another by contig and position, the header is in the first one."""
    ordered = sort_by_contig(rows, contigs) if contigs is not None else rows.orderBy("chrom", "pos")
    lines = ordered.select(record_lines(rows).alias("value"))
    if header:
        first = rows.sparkSession.createDataFrame([(x,) for x in header], "value string").coalesce(1)
        lines = first.unionAll(lines)
    lines.write.text(path)


def record_places(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref and alt of written records, and ``line``, their place among the lines of all parts."""
    parts = F.split("value", "\t")
    records = file_lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return records.select(_field(0, parts).alias("chrom"), _field(1, parts).cast("long").alias("pos"), _field(3, parts).alias("ref"), _field(4, parts).alias("alt"), "line")


def written_disorder(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """``unsorted_records`` of written records as they stand in their files: 0 and 0 prove that the parts are in order."""
    return unsorted_records(record_places(spark, path), contigs)


def write_bed(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, sep="\t", emptyValue="")


#: Columns of feature tables that are written with six significant digits.
SHORT_COLUMNS = "BAM_(REF|ALT)_(MQ|BQ|NM)|BAM_NM_Diff|BAM_p_"


def write_features(rows: DataFrame, path: str) -> None:
    """A table with a header in each part; nulls are written as ``nan``, means and tests of reads with six digits."""
    short = {c: general(F.col(c)) for c in rows.columns if re.search(SHORT_COLUMNS, c)}
    rows.withColumns(short).write.csv(path, sep="\t", header=True, nullValue="nan", emptyValue="")


def write_fastq(pairs: DataFrame, path1: str, path2: str) -> None:
    """Rows with fastq1 and fastq2 as two sets of files with equal parts in equal order."""
    for n, path in ((1, path1), (2, path2)):
        pairs.select(F.col(f"fastq{n}").alias("value")).write.text(path)


def spread(rows: DataFrame, shards: int, chunk: int = 4, line: str = "line") -> DataFrame:
    """``rows`` with the shard that each goes to: ``chunk`` rows in a row to one, then to the next.

    ``line`` numbers the rows without gaps from 0, anew for each file, as ``numbered`` does.
    """
    return rows.withColumn("shard", F.pmod(F.floor(F.col(line) / chunk), F.lit(shards)).cast("int"))


def numbered(rows: DataFrame, order: str, by: str | None = None) -> DataFrame:
    """``rows`` with ``line``, numbers without gaps from 0 in the order of an integer column, within each value of ``by``.

    Bins of the order are counted first, so no task sees all rows.
    """
    key = rows.withColumn("__by", F.col(by) if by else F.lit(0))
    distinct = key.groupBy("__by", order).agg(F.count("*").alias("__n"))
    first = running(distinct, order, "__by", "__n").select("__by", order, (F.col("total") - F.col("__n")).alias("__first"), "__n")
    ties = F.row_number().over(Window.partitionBy("__by", order).orderBy(F.xxhash64(*[F.col(c) for c in rows.columns])))
    return key.join(first.drop("__n"), ["__by", order]).withColumn("line", F.col("__first") + ties - 1).drop("__by", "__first")
