"""Documents to packed training sequences.

Quality classifier (rejected documents go), near-dedup (one document of each group stays), passage dedup (spans of 50
words or more that an earlier document has are cut, documents left without words go), cost-balanced packing.

All stages but the last give back the columns of documents, whatever their names, and count n_chars anew where a text is
cut. Null text: empty, which the classifier rejects where it has ratings to learn from; else it stays and is packed as
its end token alone. Null ids: never deduplicated, packed. Rows that repeat an id: each is rated, they stay or go together
in near-dedup, each is packed. Ties: of equal documents the smallest id stays. Very long texts: whole. Empty table: no
rows at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sheafwork.llm import neardup, packing, quality, suffixes
from sheafwork.llm.common import documents, materialise
from sheafwork.session import ship


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.stage(docs, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffixes.stage(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), memo=500_000)


STAGES = [("quality_filter", quality_filter), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", pack)]
#: SQL can't express a trained classifier or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
