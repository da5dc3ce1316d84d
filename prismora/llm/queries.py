"""The queries of this package: thin, each applying its operator with production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, lm, oracles, packing, quality, quotes, substrings, tiff, token_counts, warc
from .common import documents, id_crc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.encode_texts(documents(spark, sf_dir))
    keyed = media.select(F.struct("id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("of"), "media")
    pages = tiff.tiff_pages(keyed, "of", "media")
    return pages.select(
        F.col("id.id").alias("doc_id"), F.col("id.n_bytes").alias("n_bytes"), F.length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"), F.col("id.media_bytes").alias("media_bytes"), F.col("id.media_sha256").alias("media_sha256"),
        F.concat_ws(" ", F.format_string("%dx%d compression=%d predictor=%d %s=%d", "width", "height", "compression", "predictor", "layout", "n_blocks"), F.concat(F.lit("crc="), F.hex(F.crc32("pixels")))).alias("feature"), "page", "error",
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_texts(documents(spark, sf_dir), id_crc(F.col("doc_id")) % 10 != 0)
    return scored.select("doc_id", (id_crc(F.col("doc_id")) % 10 == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.near_duplicate_passages(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), TOKENIZER)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.classify(documents(spark, sf_dir), labels, id_crc(F.col("doc_id")) % 3 != 1)
    return scored.select("doc_id", (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), TOKENIZER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_tiff_pages, op2_jaccard_join, op3_lm_scoring, op4_quotation_linking, op5_warc, op6_substring_dedup, op7_decontamination, op8_token_counts, op9_quality, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": oracles.JACCARD, "op4_quotation_linking": quotes.SQL, "op5_warc": oracles.WARC}
