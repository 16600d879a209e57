"""Quality rules: base counts, and divergence from the histograms of a document's language.

Every document gets a histogram over character classes and one over common words.  The reference of
a language is the mean of the normalised histograms of all its documents that pass the base rules and
the length guards; a language with fewer than ``MIN_REFERENCE_DOCS`` of those, or none named, takes the
mean over all languages.  A document is kept if it passes the base rules and its Jensen-Shannon distances
(base 2, 0 to 1) from the reference stay within ``CLASS_LIMIT`` and ``WORD_LIMIT``: pairs (a, b) for
a + b / sqrt(words), as short texts stray further by chance.  A distance counts only from ``MIN_CHARS``
characters or ``MIN_WORDS`` words on.

Edge cases: a null or empty text has no words and fails the base rules; null and repeated ids, repeated
rows and null languages give one row each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import bounded, cut_lineage, slices, tidy
from callweave.llm.text_arrays import BLANK, DIGIT, LOWER, STOP, SYMBOL, TextArrays

BATCH_BYTES = 4 << 20
WINDOW_WORDS = 8
MIN_BASE_WORDS = 20
MAX_REPEATED_PERCENT = 30
MIN_CHARS = 100
MIN_WORDS = 50
MIN_REFERENCE_DOCS = 20
#: Languages whose references (about a kilobyte each) are broadcast at most; beyond that the join shuffles.
BROADCAST_LANGS = 20_000
CLASS_LIMIT = (0.13, 1.2)
WORD_LIMIT = (0.18, 2.0)

#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were there one all we can her has will would"
    " der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
    " le la les et des du que en un une est pour qui dans par plus pas au sur ne se ce il sont avec elle ou son cette nous leur"
    " el los las y del por con para su al lo como más pero sus ya o fue ha si porque sin sobre"
)
WORDS = list(dict.fromkeys(COMMON_WORDS.split()))
CLASSES = ("lower", "upper", "other_letter", "digit", "blank", "stop", "symbol", "other")


def _histograms(t: TextArrays) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each text's characters by class, and of its words by common word (last: any other)."""
    d, first = t.data, t.first_bytes
    upper = t.upper
    flags = [LOWER[d], upper, first & (d >= 0x80) & ~upper, DIGIT[d], BLANK[d], STOP[d], SYMBOL[d]]
    classes = np.stack([t.per_text(f) for f in flags] + [t.per_text(first)], axis=1)
    classes[:, -1] -= classes[:, :-1].sum(axis=1)
    plain = pc.utf8_lower(pc.ascii_trim(t.coded.dictionary, characters=".,;:!?'\"()-"))
    known = pc.index_in(plain, value_set=pa.array(WORDS)).fill_null(len(WORDS)).to_numpy()
    words = np.bincount(t.word_text * (len(WORDS) + 1) + known[t.codes], minlength=t.n * (len(WORDS) + 1)) if len(t.codes) else np.zeros(t.n * (len(WORDS) + 1), np.int64)
    return classes, words.reshape(t.n, -1)


def _counts(batches: Iterable[pa.RecordBatch]):
    for whole in batches:
        for part in slices(whole, "text", BATCH_BYTES):
            t = TextArrays(part.column("text"))
            classes, words = _histograms(t)
            columns = {"n_words": t.n_words, "word_chars": t.per_text(t.visible & t.first_bytes), "n_symbols": t.per_text(SYMBOL[t.data])}
            columns["n_dup_lines"] = np.bincount(t.line_text[t.repeated_line], minlength=t.n)
            columns["n_repeat_words"] = np.bincount(t.word_text[t.repeated_words(WINDOW_WORDS)], minlength=t.n)
            arrays = [pa.array(x.astype(np.int64)) for x in columns.values()]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int32).ravel()), x.shape[1]).cast(pa.list_(pa.int32())) for x in (classes, words)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), *arrays, *lists], ["id", "lang", *columns, "classes", "common"])


def _normal(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def _sums(batches: Iterable[pa.RecordBatch]):
    """Sums of normalised histograms by language within a partition's batches."""
    for b in batches:
        if b.num_rows:
            langs = b.column("lang").dictionary_encode()
            which = langs.indices.to_numpy()
            for name in ("classes", "common"):
                p = _normal(np.array(b.column(name).flatten()).reshape(b.num_rows, -1).astype(float))
                sums = np.zeros((len(langs.dictionary), p.shape[1]))
                np.add.at(sums, which, p)
                n = np.bincount(which, minlength=len(sums))
                k = np.tile(np.arange(p.shape[1]), len(sums))
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(np.repeat(np.arange(len(sums)), p.shape[1]))), pa.array([name] * len(k)), pa.array(k, pa.int32()), pa.array(sums.ravel()), pa.array(np.repeat(n, p.shape[1]))], ["lang", "kind", "k", "total", "n"])


def language_references(counted: DataFrame) -> DataFrame:
    """lang, classes_ref and common_ref; the row without lang holds the mean over all languages."""
    fair = counted.where(~F.col("base_failed") & (F.col("n_words") >= MIN_WORDS) & (F.aggregate("classes", F.lit(0), lambda a, x: a + x) >= MIN_CHARS))
    sums = fair.select(F.coalesce("lang", F.lit("")).alias("lang"), "classes", "common").mapInArrow(_sums, "lang string, kind string, k int, total double, n long")
    by = sums.groupBy("lang", "kind", "k").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    every = by.groupBy("kind", "k").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "kind", "k", "total", "n")
    means = by.where((F.col("lang") != "") & (F.col("n") >= MIN_REFERENCE_DOCS)).unionByName(every)
    rows = means.groupBy("lang", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("total") / F.col("n")).alias("p")))), lambda x: x["p"]).alias("p"))
    return rows.groupBy("lang").agg(*[F.max(F.when(F.col("kind") == k, F.col("p"))).alias(f"{k}_ref") for k in ("classes", "common")])


def jensen_shannon(counts: Column, reference: Column) -> Column:
    """The distance of a histogram of counts from a distribution, null if either is empty."""
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)
    p = F.transform(counts, lambda x: x / total)

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, reference, lambda x, y: part(x, y) + part(y, x))
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col``, the base counts, base_failed, class_distance, word_distance and kept for every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    id_type = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(tidy(_counts), f"id {id_type}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<int>, common array<int>")
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    counted = cut_lineage(counted.withColumn("base_failed", failed))
    references = cut_lineage(language_references(counted))
    judged = counted.join(bounded(references.where(F.col("lang").isNotNull()), BROADCAST_LANGS), "lang", "left")
    every = references.where(F.col("lang").isNull()).first()
    for kind, distance in (("classes", "class_distance"), ("common", "word_distance")):
        mean = F.array(*[F.lit(x) for x in every[f"{kind}_ref"]]) if every else F.lit(None).cast("array<double>")
        judged = judged.withColumn(distance, jensen_shannon(F.col(kind), F.coalesce(F.col(f"{kind}_ref"), mean)))
    n_chars = F.aggregate("classes", F.lit(0), lambda a, x: a + x)

    def beyond(distance: str, limit: tuple[float, float]) -> Column:
        return F.col(distance) > F.lit(limit[0]) + limit[1] / F.sqrt(F.col("n_words"))

    far = ((n_chars >= MIN_CHARS) & beyond("class_distance", CLASS_LIMIT)) | ((F.col("n_words") >= MIN_WORDS) & beyond("word_distance", WORD_LIMIT))
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance")
    return judged.select(F.col("id").alias(id_col), *names, kept.alias("kept"))
