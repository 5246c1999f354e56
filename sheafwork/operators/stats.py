"""Statistics over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bullets(lines: DataFrame, least: int = 3) -> DataFrame:
    """token, n, inside: marks of one or two characters that start at least so many lines, and more lines than have them
    further in. Each line gives the marks it has further in once, so that they meet by an equi-join."""
    token = F.regexp_extract("text", "^([^ \t]{1,2})[ \t]+[^ \t]", 1)
    starts = lines.groupBy(token.alias("token")).agg(F.count("*").alias("n")).where(f"token <> '' and not token rlike '[A-Za-z0-9]' and n >= {least}")
    rest = F.expr("substring(text, 2)")
    marks = lambda n: F.regexp_extract_all(rest, F.lit(f"(?=([^A-Za-z0-9 \t]{{{n}}}))"), F.lit(1))
    inside = lines.select(F.explode(F.array_distinct(F.concat(marks(1), marks(2)))).alias("token")).groupBy("token").agg(F.count("*").alias("inside"))
    return starts.join(inside, "token", "left").select("token", "n", F.coalesce("inside", F.lit(0)).alias("inside")).where("inside < n")


def weighted_mode(rows: DataFrame, key: str, value: str, weight: str, order: str) -> DataFrame:
    """The value of most weight for each key, the earliest of equals."""
    sums = rows.groupBy(key, value).agg(F.sum(weight).alias(weight), F.min(order).alias("_first"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(weight), "_first"))
    return sums.withColumn("_k", best).where("_k = 1").select(key, value, weight)


def spread(rows: DataFrame, key: str, value: str) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return rows.groupBy(key).agg(F.count("*").alias("n"), r(F.median(value)).alias("middle"), r(F.coalesce(F.stddev_pop(value), F.lit(0.0))).alias("spread"), r(F.min(value)).alias("low"), r(F.max(value)).alias("high"))


def deviation(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Median of the distances from the median."""
    middle = rows.groupBy(key).agg(F.median(value).alias("m"))
    return rows.join(middle, key).groupBy(key).agg(F.round(F.median(F.abs(F.col(value) - F.col("m"))), 6).alias("mad"))


def local_threshold(rows: DataFrame, key: str, order: str, value: str, reach: int, k: float = 0.18, scale: float = 128.0) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-reach, reach)
    limit = F.avg(value).over(w) * (1 + k * (F.stddev_pop(value).over(w) / scale - 1))
    return rows.select(key, order, (F.col(value) < limit).alias("dark"))


def otsu(rows: DataFrame, key: str, bin: str) -> DataFrame:
    """The bin that parts the histogram best, the first of equals."""
    w = Window.partitionBy(key)
    run = w.orderBy(bin).rowsBetween(Window.unboundedPreceding, 0)
    h = rows.groupBy(key, bin).agg(F.count("*").alias("n"))
    c = h.select(key, bin, F.sum("n").over(run).alias("n0"), F.sum(F.col("n") * F.col(bin)).over(run).alias("s0"), F.sum("n").over(w).alias("n1"), F.sum(F.col("n") * F.col(bin)).over(w).alias("s1"))
    d = (F.col("s0") * F.col("n1") - F.col("s1") * F.col("n0")).cast("double")
    score = F.when(F.col("n0") == F.col("n1"), 0.0).otherwise(F.round(d * d / (F.col("n0").cast("double") * (F.col("n1") - F.col("n0"))), 4))
    best = F.row_number().over(w.orderBy(F.desc("score"), bin))
    return c.withColumn("score", score).withColumn("k", best).where("k = 1").select(key, F.col(bin).alias("threshold"))
