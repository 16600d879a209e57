"""Token-id files: each document compressed alone, with a zstandard dictionary that all share.

A file holds blocks of neighbouring documents as rows: ``blob`` has the documents' compressed ids
(unsigned 16-bit little-endian, 32-bit if the vocabulary needs it), ``doc_ids``, ``n_tokens`` and
``frame_at`` are the index to read one document without the others, ``first_id`` and ``last_id`` let Parquet
skip blocks for it, and ``dict_hash`` names the dictionary, which is stored beside the blocks and checked against
its hash when it is read.  Documents lie in ascending id order: ``part`` is the
rank of the id range, ``part_start`` counts the ids of the part before the block.

The dictionary is trained on ``DICT_DOCS`` documents at most, those with the smallest hash of their
id among texts of up to ``DICT_CHARS`` characters; it changes sizes of files only.  A sample too small for training
serves as the dictionary's content itself.

Edge cases: a null text is empty and has the end id alone; documents with a null id come first, equal
ids in any order; repeated rows are kept; an empty table gives files without blocks; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.llm.bpe import BATCH_BYTES, PieceEncoder
from callweave.llm.common import parallelism, shared_folder, slices, tidy

DICT_DOCS = 1000
DICT_CHARS = 8192
DICT_BYTES = 64 << 10
BLOCK_IDS = 1 << 20
LEVEL = 1
BLOCKS = "dict_hash string, part int, part_start long, n_ids long, first_id long, last_id long, doc_ids array<long>, n_tokens array<int>, frame_at array<int>, blob binary"


def train_dictionary(docs: DataFrame, path: str, end_id: int, dtype: str) -> bytes:
    """A dictionary over the serialized ids of a bounded sample; never empty."""
    sample = docs.where(F.length("text").between(1, DICT_CHARS)).select("id").orderBy(F.xxhash64("id"), "id").limit(DICT_DOCS)
    texts = docs.join(F.broadcast(sample.distinct()), "id", "left_semi").where(F.length("text").between(1, DICT_CHARS)).select("text").limit(2 * DICT_DOCS)
    flat, at = PieceEncoder(path).encode(pa.array([r.text for r in texts.collect()], pa.string()))
    rows = [np.append(flat[at[i] : at[i + 1]], end_id).astype(dtype).tobytes() for i in range(len(at) - 1)]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, rows)) // 8), rows).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short documents to train on
        content = b"".join(rows)[-DICT_BYTES:]
        return content + np.full(8, end_id).astype(dtype).tobytes()


def _dictionary(raw: bytes, digest: str) -> zstandard.ZstdCompressionDict:
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError(f"the stored dictionary is not {digest}")
    return zstandard.ZstdCompressionDict(raw)


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write the files to ``folder`` (``blocks`` and ``dictionary``)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dtype = "<u2" if max(len(PieceEncoder(path).id_bytes), end_id + 1) <= 1 << 16 else "<u4"
    raw = train_dictionary(rows, path, end_id, dtype)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw), dtype)], "dict_hash string, dictionary binary, dtype string").write.mode("overwrite").parquet(f"{folder}/dictionary")
    parts = parallelism(spark)
    edges = rows.select(F.percentile_approx("id", [i / parts for i in range(1, parts)], 100 * parts).alias("e")).first().e if parts > 1 else []
    edges = np.array(sorted(set(edges or [])), np.int64)
    sent = spark.sparkContext.broadcast(raw)

    def compress(batches: Iterable[pa.RecordBatch]):
        encoder, packer = PieceEncoder(path), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(sent.value, digest), write_content_size=True, write_checksum=False, write_dict_id=False)
        for whole in batches:
            for piece in slices(whole, "text", BATCH_BYTES):
                flat, at = encoder.encode(piece.column("text"))
                ids = piece.column("id")
                part = np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(edges, ids.fill_null(0).to_numpy(), "right"), 0)
                frames = [packer.compress(np.append(flat[at[i] : at[i + 1]], end_id).astype(dtype).tobytes()) for i in range(piece.num_rows)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(part, pa.int32()), pa.array(np.diff(at) + 1, pa.int32()), pa.array(frames, pa.binary())], ["id", "part", "n", "frame"])

    def blocks(batches: Iterable[pa.RecordBatch]):
        start, part, held, size = 0, 0, [], 0

        def block():
            frames, ids = [x[2] for x in held], [x[0] for x in held]
            known = [i for i in ids if i is not None]
            return pa.RecordBatch.from_pylist([{"dict_hash": digest, "part": part, "part_start": start, "n_ids": size, "first_id": min(known, default=None), "last_id": max(known, default=None), "doc_ids": ids, "n_tokens": [x[1] for x in held], "frame_at": np.cumsum([0, *map(len, frames)]).tolist(), "blob": b"".join(frames)}], schema=ARROW_BLOCKS)

        for whole in batches:
            for i, p, n, frame in zip(*(whole.column(c).to_pylist() for c in ("id", "part", "n", "frame")), strict=True):
                if held and (p != part or size + n > BLOCK_IDS):
                    yield block()
                    start, held, size = (start + size if p == part else 0), [], 0
                part = p
                held.append((i, n, frame))
                size += n
        if held:
            yield block()

    framed = rows.mapInArrow(tidy(compress), "id long, part int, n int, frame binary")
    ordered = framed.repartition(parts, "part").sortWithinPartitions("part", "id")
    ordered.mapInArrow(blocks, BLOCKS).write.mode("overwrite").parquet(f"{folder}/blocks")


ARROW_BLOCKS = pa.schema([("dict_hash", pa.string()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("frame_at", pa.list_(pa.int32())), ("blob", pa.binary())])


def _stored(spark: SparkSession, folder: str) -> dict[str, tuple[bytes, str]]:
    """The dictionaries (one, of up to ``DICT_BYTES``) and number types by hash."""
    return {r.dict_hash: (bytes(r.dictionary), r.dtype) for r in spark.read.parquet(f"{folder}/dictionary").collect()}


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of each row of one document: its block is found by statistics, and only its own frames are decompressed."""
    stored = _stored(spark, folder)
    block = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    at = F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.get("doc_ids", i) == doc_id)
    frames = block.select("dict_hash", "blob", "frame_at", F.explode(at).alias("i"))
    cut = frames.select("dict_hash", F.substr("blob", F.get("frame_at", "i") + 1, F.get("frame_at", F.col("i") + 1) - F.get("frame_at", "i")).alias("frame"))
    out = []
    for r in cut.collect():
        raw, dtype = stored[r.dict_hash]
        out.append(np.frombuffer(zstandard.ZstdDecompressor(dict_data=_dictionary(raw, r.dict_hash)).decompress(bytes(r.frame)), dtype).tolist())
    return out


def read_token_files(spark: SparkSession, folder: str, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ``ids`` or ``ids_crc32``."""
    sent = spark.sparkContext.broadcast(_stored(spark, folder))
    table = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kinds = {"ids": "array<int>", "ids_crc32": "long"}
    arrow = {"ids": pa.list_(pa.int32()), "ids_crc32": pa.int64()}

    def unpack(batches: Iterable[pa.RecordBatch]):
        readers: dict = {}
        for whole in batches:
            for r in whole.to_pylist():
                raw, dtype = sent.value[r["dict_hash"]]
                if r["dict_hash"] not in readers:
                    readers[r["dict_hash"]] = zstandard.ZstdDecompressor(dict_data=_dictionary(raw, r["dict_hash"]))
                reader, blob, at = readers[r["dict_hash"]], r["blob"], r["frame_at"]
                ids = [np.frombuffer(reader.decompress(blob[at[i] : at[i + 1]]), dtype) for i in range(len(at) - 1)]
                n = np.array([len(x) for x in ids], np.int64)
                columns = {"ids": lambda ids=ids: [x.astype(np.int32) for x in ids], "ids_crc32": lambda ids=ids: [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]}
                start = r["base"] + r["part_start"] + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(start), pa.array(n), *(pa.array(columns[k](), arrow[k]) for k in outputs)], ["doc_id", "start", "n_tokens", *outputs])

    based = table.join(F.broadcast(totals), "part")
    return based.mapInArrow(tidy(unpack), "doc_id long, start long, n_tokens long, " + ", ".join(f"{k} {kinds[k]}" for k in outputs))


def token_files(docs: DataFrame, path: str, end_id: int = 0, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Write the files to a new folder below the shared one, and read them back."""
    folder = f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, folder, end_id)
    return read_token_files(docs.sparkSession, folder, outputs)
