"""Canonical tables: files of ordered pages, lines of documents, rendered cells, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, page (from 1), text, n (code points)."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("page"), "text", F.length("text").cast("long").alias("n"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, line (from 1), text: documents cut at newlines."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return docs.select("doc", (F.col("at") + 1).cast("long").alias("line"), "text")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec, i (from 1), v: embeddings as rows of doubles."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vec"), F.posexplode("embedding").alias("i", "v"))
    return rows.select("vec", (F.col("i") + 1).cast("long").alias("i"), F.col("v").cast("double").alias("v"))


#: The same tables in DuckDB's SQL.
SQL = {
    "pages": "(select conv_id as file, turn + 1 as page, text, length(text) as n from conversations)",
    "lines": "(select doc_id as doc, line, text from (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from documents))",
    "signal": "(select vec_id as vec, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings)",
}
