"""Target-distribution importance resampling: hashed features weigh documents, a distributed quickselect draws them.

Features are runs of 1 to ``ngrams`` consecutive words of the lower-cased text (A-Z only), hashed into ``buckets``.  One
pass counts them over all documents and one over all target texts: every task adds up its own histogram, so what is
shuffled and collected is one row a bucket.  A bucket's gain is its scaled log-ratio of smoothed shares; a second pass
adds up the gains of each document.  To the weight comes Gumbel noise that only depends on seed and id, so the highest
scores are a draw without replacement.

The boundary of the draw is found by quickselect over the scored table: a round takes ``PIVOTS`` random keys out of the
interval that still holds the k-th key, counts exactly how many keys lie before, at and after each, and goes on between
the two that enclose it.  A round moves a few rows whatever the number of documents, and there are about log16(n) of them.
Only the winners are sorted, by ranges; their rank is their place in their range plus the winners of all ranges before.

Edge cases: a null or empty text has no features and the weight 0; a null id draws the noise of an empty id and comes after
all ids at equal scores; repeated ids and repeated rows take part one by one, equal keys in order of an internal row
number; without target texts all target counts are 0; with an empty table, or a draw of no rows, no row has a rank; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import cut_lineage, parallelism, slices, tidy, utf8
from callweave.llm.text_arrays import DIGIT, LOWER, TextArrays

BATCH_BYTES = 4 << 20
#: Longer texts are hashed one by one.
SHORT_BYTES = 64
#: Random keys that a round of the quickselect compares with.
PIVOTS = 15
_FEATURE = DIGIT | LOWER | (np.arange(256) >= 0x80)
_AT = (1 << 33) - 1


def _crc_table() -> np.ndarray:
    """The 256 remainders of the reflected polynomial of crc32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0))
    return table


_CRC = _crc_table()


def crc32(texts: pa.Array) -> np.ndarray:
    """Unsigned crc32 of the bytes of every text: byte by byte over all short texts at once."""
    data, at = utf8(texts)
    n, crc = np.diff(at), np.full(len(texts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] <= SHORT_BYTES]
    ends = np.searchsorted(-n[order], -np.arange(SHORT_BYTES), "left")
    for j in range(int(n[order[0]]) if len(order) else 0):
        live = order[: ends[j]]
        crc[live] = (crc[live] >> np.uint32(8)) ^ _CRC[(crc[live] ^ data[at[live] + j]) & 0xFF]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n > SHORT_BYTES):
        crc[i] = zlib.crc32(data[at[i] : at[i + 1]])
    return crc.astype(np.int64)


class FeatureTexts(TextArrays):
    """Words are runs of digits, letters a-z and everything beyond ASCII."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts, lower=True)
        self.visible = _FEATURE[self.data]

    def features(self, ngrams: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and text of every feature."""
        found, owner = [], []
        for n in range(1, ngrams + 1):
            at = np.arange(max(len(self.words) - n + 1, 0))
            at = at[self.word_text[at] == self.word_text[at + n - 1]]
            runs = self.words if n == 1 else pc.binary_join_element_wise(*(self.words.take(pa.array(at + j)) for j in range(n)), " ")
            found.append(crc32(runs) % buckets)
            owner.append(self.word_text[at])
        return np.concatenate(found), np.concatenate(owner)


def bucket_counts(docs: DataFrame, ngrams: int = 1, buckets: int = 10_000, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterable[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                total += np.bincount(FeatureTexts(part.column("text")).features(ngrams, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    per_task = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(count), "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for row in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of smoothed target share over smoothed source share, rounded down."""
    whole, aimed, n = float(source.sum() + len(source)), float(target.sum() + len(target)), zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * aimed))) for s, t in n], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, ngrams: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_features, n_words and the sum of the gains of each document's features."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def weigh(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                texts = FeatureTexts(part.column("text"))
                bucket, owner = texts.features(ngrams, len(gain))
                n, weight = np.bincount(owner, minlength=texts.n), np.zeros(texts.n, np.int64)
                np.add.at(weight, owner, gain[bucket])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(texts.n_words.astype(np.int64)), pa.array(weight)], ["id", "n_features", "n_words", "weight"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(weigh), f"id {id_type}, n_features long, n_words long, weight long")


def noise(seed: int) -> Column:
    """Scaled Gumbel noise out of the first 32 bits of sha256(seed:id)."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((drawn.cast("double") + 0.5) / 4294967296.0)))


def kth_key(table: DataFrame, key: Column, k: int, seed: int = 0) -> tuple:
    """The k-th smallest of the distinct structs ``key`` (k from 1), found by random pivots and exact counts."""
    table = table.select(key.alias("key"))
    kind = table.schema["key"].dataType
    literal = lambda p: F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(p, kind.fields, strict=True)))
    inside, before, turn, bounds = table, 0, 0, [None, None]
    while True:
        turn += 1
        mixed = F.xxhash64("key", F.lit(seed), F.lit(turn))
        pivots = [tuple(r["key"]) for r in inside.orderBy(mixed, "key").limit(PIVOTS).sort("key").collect()]
        listed = F.array(*map(literal, pivots))
        place = inside.select(F.size(F.filter(listed, lambda p: p < F.col("key"))).alias("after"), F.exists(listed, lambda p: p == F.col("key")).alias("at"))
        counts, passed = {(r["after"], r["at"]): r["count"] for r in place.groupBy("after", "at").count().collect()}, before
        for i, p in enumerate(pivots):
            less, same = passed + counts.get((i, False), 0), counts.get((i, True), 0)
            if less < k <= less + same:
                return p
            if less >= k:
                bounds[1] = p
                break
            bounds[0], passed = p, less + same
        before, inside = passed, table
        if bounds[0] is not None:
            inside = inside.where(F.col("key") > literal(bounds[0]))
        if bounds[1] is not None:
            inside = inside.where(F.col("key") < literal(bounds[1]))


def draw(
    docs: DataFrame, target: DataFrame, percent: int = 10, ngrams: int = 1, buckets: int = 10_000, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """``id_col``, n_features, weight, score and rank: 1, 2, 3... for the drawn documents, null for all others."""
    gain = gains(bucket_counts(docs, ngrams, buckets, text_col), bucket_counts(target, ngrams, buckets, target_text))
    scored = weights(docs, gain, ngrams, id_col, text_col).withColumn("score", F.col("weight") + noise(seed))
    scored = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()))
    fits = F.col("n_words") >= min_words
    key = F.struct((-F.col("score")).alias("score"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    shown = ["id", "n_features", "weight", "score"]
    k = percent * scored.where(fits).count() // 100
    if k == 0:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank")).withColumnRenamed("id", id_col)
    edge = kth_key(scored.where(fits), key, k, seed)
    last = F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(edge, scored.select(key.alias("key")).select("key.*").dtypes, strict=True)))
    won = fits & (key <= last)
    winners = scored.where(won).withColumn("key", key).repartitionByRange(parallelism(docs.sparkSession), "key").sortWithinPartitions("key")
    winners = cut_lineage(winners.select(*shown, F.monotonically_increasing_id().alias("at")))
    ranges = sorted(winners.groupBy(F.shiftright("at", 33).alias("range")).count().collect())
    starts, total = [], 0
    for at, n in ranges:
        starts.append((at, total))
        total += n
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "range long, start long"))
    ranked = winners.join(starts, F.shiftright("at", 33) == F.col("range")).select(*shown, (F.col("start") + F.col("at").bitwiseAND(F.lit(_AT)) + 1).alias("rank"))
    return scored.where(~won).select(*shown, F.lit(None).cast("long").alias("rank")).unionByName(ranked).withColumnRenamed("id", id_col)
