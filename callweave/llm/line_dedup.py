"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

All lines with a visible character are compared over all documents, blanks at the ends aside.  A line
goes if an equal line, or one within one edit (a character inserted, deleted or replaced), stands earlier:
in a document with a smaller id, or further up in the same document.  Callers may ask for ``min_chars`` characters
for the step of one edit, as shorter lines that differ by one ("Page 1", "Page 2") mostly say different things; equal lines go at any length.

Lines within one edit have a common variant: both with the same character left out, or one with a
character left out and the other whole.  Emitting a hash for each left-out character of each line would
be a row for every character of the corpus, so variants are made coarse first.  Leaving out one of two
halves shows which lines can have a partner at all; leaving out one of about sqrt(n) blocks shows where the
difference must be; only there are single characters left out.  Lines that share a variant at one position are all
within one edit of each other, so each is compared with the earliest alone, and no group is paired up.  Every
pair is confirmed by its edit distance.

Edge cases: a null text stays null and has no lines; documents without an id come last; rows with equal id and
text count as one document (all stay alike), rows with equal id and other text are ordered by a hash of the
text; a document that loses all its lines has an empty text; an empty table gives an empty table; extra
columns are returned as they are by ``drop_repeated_lines`` and may have any other name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import BROADCAST_ROWS, bounded, cut_lineage, fresh

#: Characters that a line has at least to take part in the step of one edit.
MIN_CHARS = 1
LAST = (1 << 63) - 1


def _order(id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.xxhash64(text_col)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each compared line: where it is (doc, version, pos), its text and its key (h1, h2)."""
    doc, version = _order(id_col, text_col)
    rows = docs.where(F.col(text_col).isNotNull()).select(doc.alias("doc"), version.alias("version"), F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    rows = rows.select("doc", "version", "pos", F.trim("raw").alias("line")).where(F.col("line").rlike(r"\S"))
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), F.col("line"))})


#: Hashes of a line with the first or second of two halves left out, for pairs whose shorter line has m characters.
HALVES = """
    flatten(transform(array(n, n - 1), m -> array(
        xxhash64('front', m, substring(line, 1, cast(m div 2 as int))),
        xxhash64('back', m, right(line, cast(m - m div 2 as int))))))
"""

#: The line's blocks for pairs whose longer line has m characters: role 0 if it is the longer (or both are), 1 if the shorter.
BLOCKS = """
    flatten(transform(array(named_struct('m', n, 'role', 0), named_struct('m', n + 1, 'role', 1)), r ->
        transform(sequence(0, cast(ceil(r.m / ceil(sqrt(r.m))) as int) - 1), j -> named_struct(
            'role', r.role,
            'at', cast(j * ceil(sqrt(r.m)) as int),
            'size', cast(least(ceil(sqrt(r.m)), r.m - j * ceil(sqrt(r.m))) as int) - r.role,
            'm', r.m))))
"""

#: What is left of a block without each of its characters in turn; of the shorter line's block, the block itself.
VARIANTS = """
    case when role = 0
         then transform(sequence(1, length(block)), i -> named_struct('v', xxhash64(key, concat(substring(block, 1, i - 1), substring(block, i + 1))), 'i', i))
         else array(named_struct('v', xxhash64(key, block), 'i', 0)) end
"""


def _near_lines(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier one within one edit; lines without halves take no part."""
    halves = distinct.select("h1", "h2", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("half")
    found = cut_lineage(halves.join(shared, "half", "left_semi").groupBy("h1", "h2").agg(F.lit(1).alias("one")).drop("one"))
    firsts = cut_lineage(distinct.join(found, ["h1", "h2"]).select("h1", "h2", "first"))
    texts = lines.join(bounded(firsts), ["h1", "h2"]).where("doc = first.doc and version = first.version and pos = first.pos")
    texts = cut_lineage(texts.dropDuplicates(["h1", "h2"]).select("h1", "h2", "first", "line", F.length("line").alias("n")))
    blocks = texts.select("h1", "h2", "first", "line", F.explode(F.expr(BLOCKS)).alias("b")).selectExpr(
        "h1", "h2", "first", "b.role as role", "b.at as at", "substring(line, b.at + 1, b.size) as block",
        "xxhash64(b.m, b.at, substring(line, 1, b.at), substring(line, b.at + b.size + 1)) as key",
    )
    common = blocks.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.min("role").alias("role")).where("lo <> hi and role = 0").select("key")
    narrow = cut_lineage(blocks.join(common, "key", "left_semi"))
    variants = narrow.select("h1", "h2", "first", "role", "at", F.explode(F.expr(VARIANTS)).alias("v")).select("h1", "h2", "first", "role", F.col("v.v").alias("v"), (F.col("at") + F.col("v.i")).alias("i"))
    left_out = variants.where("role = 0")
    earliest = left_out.groupBy("v", "i").agg(F.min(F.struct("first", "h1", "h2")).alias("e"), F.count("*").alias("k")).where("k > 1").select("v", "i", "e")
    replaced = left_out.join(earliest, ["v", "i"]).where("first > e.first").select("h1", "h2", "e.h1", "e.h2").toDF("h1", "h2", "e1", "e2")
    both = left_out.alias("x").join(variants.where("role = 1").alias("y"), F.expr("x.v = y.v"))
    later = "x.first > y.first"
    inserted = both.selectExpr(f"if({later}, x.h1, y.h1) as h1", f"if({later}, x.h2, y.h2) as h2", f"if({later}, y.h1, x.h1) as e1", f"if({later}, y.h2, x.h2) as e2")
    pairs = replaced.unionByName(inserted).distinct()
    own = texts.select("h1", "h2", "line")
    other = texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("other"))
    return pairs.join(own, ["h1", "h2"]).join(other, ["e1", "e2"]).where("levenshtein(line, other, 1) between 0 and 1").select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, version and pos of every line that goes."""
    lines = _lines(docs, id_col, text_col)
    keyed = lines.withColumn("n", F.length("line")).select("doc", "version", "pos", "h1", "h2", F.when(F.col("n") >= min_chars, F.expr(HALVES)).alias("halves"))
    distinct = cut_lineage(keyed.groupBy("h1", "h2").agg(F.min(F.struct("doc", "version", "pos")).alias("first"), F.count("*").alias("copies"), F.first("halves").alias("halves")))
    near = _near_lines(lines, distinct).withColumn("near", F.lit(True))
    concerned = distinct.join(near, ["h1", "h2"], "left").where("near or copies > 1").select("h1", "h2", "first", "near")
    occurrences = lines.select("doc", "version", "pos", "h1", "h2").join(concerned, ["h1", "h2"])
    return occurrences.where("near or not (doc = first.doc and version = first.version and pos = first.pos)").select("doc", "version", "pos")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, counts: bool = False) -> DataFrame:
    """``docs`` with the shortened texts; with ``counts`` also n_lines and n_removed."""
    doc_key, version_key, gone = fresh(docs.columns, "__doc", "__version", "__dropped")
    dropped = dropped_lines(docs, id_col, text_col, min_chars).groupBy("doc", "version").agg(F.array_sort(F.collect_set("pos")).alias(gone))
    dropped = cut_lineage(dropped.withColumnsRenamed({"doc": doc_key, "version": version_key}))
    lines_dropped = dropped.agg(F.sum(F.size(gone))).first()[0] or 0
    dropped = bounded(dropped) if lines_dropped <= 4 * BROADCAST_ROWS else dropped
    doc, version = _order(id_col, text_col)
    joined = docs.withColumns({doc_key: doc, version_key: version}).join(dropped, [doc_key, version_key], "left")
    rest = F.array_join(F.filter(F.split(text_col, "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(rest)
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(F.split(text_col, "\n"))).cast("long")
        columns += [n_lines.alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*columns)
