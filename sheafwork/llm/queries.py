"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import avi, hpy, licences, neardup, packing, quality, sketch, suffixes, twins, warc
from .bpe import encode_decode
from .common import documents, materialise

Query = Callable[[SparkSession, str], DataFrame]


def op1_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.stored(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(documents(spark, sf_dir))


def op4_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, quality.fit(docs, labels))


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op6_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated(documents(spark, sf_dir))


def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as two WARC replicas, the second cut into other segments, with bit rot in one record of 64 and one of
    512 lost: what the audit finds."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    stored = materialise(warc.segments(pages), "segments", "zstd")
    other = materialise(warc.segments(pages, warc.bit_rot(), warc.SEGMENT // 3), "segments", "zstd")
    ours = warc.replica(stored)
    return warc.audit(ours, warc.replica(other, len(ours.nodes) - 1))


def op9_hierarchical_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpy.scores(documents(spark, sf_dir))


def op10_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited(documents(spark, sf_dir))


# what SQL can express of the above

def payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_avi_mjpeg(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def licence_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_licence_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_sparse_suffixes(spark, sf_dir).drop("first_doc_id")


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_hierarchical_pitman_yor(spark, sf_dir).selectExpr("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "round(base_score, 4) base_score")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_scaled_sketch(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


TWINS = {
    "op5_chosen_path": twins.near_duplicates(neardup.PERCENT),
    "payload_digests": twins.PAYLOADS,
    "licence_phrases": twins.licences(licences.BASE),
    "repeated_spans": twins.REPEATED,
    "base_scores": twins.BASE_SCORES,
    "edited_texts": twins.EDITED,
}


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k in TWINS or k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)
