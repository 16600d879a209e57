"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callweave.llm.bpe_codec import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), _vocabulary(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callweave.llm.quality_rules import quality_rules

    judged = quality_rules(_table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 9) for c in ("class_distance", "word_distance")})


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callweave.llm.chosen_path import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, threshold=0.8)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callweave.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callweave.llm.line_dedup import drop_repeated_lines

    return drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callweave.llm.token_files import token_files

    return token_files(_table(spark, sf_dir, "documents"), _vocabulary(), outputs=("ids_crc32",))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callweave.llm import line_crf

    docs = _table(spark, sf_dir, "documents")
    model = line_crf.train(docs, _table(spark, sf_dir, "labels"))
    return line_crf.score(docs, model).withColumn("held_out", F.coalesce(line_crf.fold("doc_id") == 0, F.lit(False)))


def op8_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callweave.llm.prefix_forest import PrefixForestIndex

    return PrefixForestIndex(_table(spark, sf_dir, "embeddings")).search(F.col("id") % 20 == 0)


def op9_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callweave.llm.shards import shard

    return shard(_table(spark, sf_dir, "documents"), shards=8)


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callweave.llm.soft_mixing import soft_mixture

    return soft_mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callweave.llm.token_alignment import align_tokens

    return align_tokens(_table(spark, sf_dir, "documents"), _vocabulary(), _vocabulary("piece_bpe_32k.model"))


def op12_host_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callweave.llm.host_suffix import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callweave.llm.importance_draw import draw

    return draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, ngrams=1, buckets=10_000, min_words=20, seed=2024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_tree": op1_bpe_tree,
    "op2_quality_rules": op2_quality_rules,
    "op3_chosen_path": op3_chosen_path,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_files": op6_token_files,
    "op7_line_crf": op7_line_crf,
    "op8_prefix_forest": op8_prefix_forest,
    "op9_best_fit_shards": op9_best_fit_shards,
    "op10_soft_mixing": op10_soft_mixing,
    "op11_token_alignment": op11_token_alignment,
    "op12_host_suffix": op12_host_suffix,
    "op13_importance_draw": op13_importance_draw,
}
