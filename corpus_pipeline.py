"""A corpus pipeline out of the operators of ``callweave.llm``.

Documents of low quality go, repeated lines go, one document of each near-duplicate group stays, sources are mixed
to target weights, and what is left is encoded.  Each stage takes (spark, docs, sf_dir) and gives a
DataFrame; all but the last keep the columns of ``documents``.  ``run`` writes each stage but the last to the shared
checkpoint folder as Parquet and reads it again, so that no stage computes another one anew.

Edge cases: a null text is an empty one for the classifier and goes with the documents left without a word; null labels are
left out; without labels every document scores 0.5 and stays; rows with equal id and text are kept or dropped alike by the
first two stages, of equal texts the smallest id stays; empty tables give an empty result; columns beside those of
``documents`` are kept by all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import bpe_codec, chosen_path, line_crf, line_dedup, soft_mixing
from callweave.llm.common import shared_folder

#: Weights of the mixing stage; low quality has gone before.
MIX_WEIGHTS = {"low": 0.0, "good": 0.95, "toxic": 0.05}
#: How often a document may be repeated at most; without a bound, 202,041 documents of `check_l` became 6,420,558.  ``soft_mixing`` warns of what is unmet.
MIX_MAX_RATE = 4.0
#: Shorter lines that differ by one character ("Page 1", "Page 2") are no copies of each other for this corpus; equal ones are.
NEAR_LINE_CHARS = 20


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts."""
    return line_crf.keep_good(docs, line_crf.train(docs, _labels(spark, sf_dir)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus; documents left without a word go."""
    shortened = line_dedup.drop_repeated_lines(docs, min_chars=NEAR_LINE_CHARS)
    if "n_chars" in docs.columns:
        shortened = shortened.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return shortened.where(F.trim(F.translate("text", "\n\t\r", "   ")) != "")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, and all others; rows that share an id are kept or dropped together."""
    kept = chosen_path.near_duplicates(docs, shingle_words=5, threshold=0.8).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their domains ask for."""
    return soft_mixing.mix(docs, _labels(spark, sf_dir), MIX_WEIGHTS, max_rate=MIX_MAX_RATE)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids, with the digest of what they decode to."""
    import public_tokenizers

    return bpe_codec.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]

#: None: a classifier fitted by gradient steps and a tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    *first, (_, last) = STAGES
    for name, stage in first:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return last(spark, docs, sf_dir)
