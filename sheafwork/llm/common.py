"""Shared pieces: reading tables, writing intermediate tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is named, a local one will do on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = kept.get() if kept.isDefined() else None
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file:///tmp/sheafwork-checkpoints"
    return named.rstrip("/")


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sheafwork-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_paths = [path]
    return out


def discard(df: DataFrame) -> None:
    """Delete the tables behind it that materialise() wrote, when nothing reads them any more: what was computed from them
    is in the shared folder itself."""
    spark = df.sparkSession
    for path in df._shared_paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files whose DataFrames are gone: their rows are in the shared folder by now,
    so nothing that is still to be computed needs them. Else they stay until the driver happens to collect its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as Python strings, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with columns c0, c1 and so on, so that no name clashes, and the names to give back."""
    names = docs.columns
    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))), names


def named(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


#: What a Python worker remembers from task to task, by operator.
_remembered: list[dict] = []


def release() -> None:
    """Give freed memory back to the system, where the C library can; else it stays with the idle worker."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def use(*memos: dict) -> None:
    """Forget what other operators remembered: a worker serves many stages, one after the other."""
    mine = {id(m) for m in memos}
    for m in _remembered:
        if id(m) not in mine:
            m.clear()
    _remembered[:] = memos
    release()


class Memo(dict):
    """A dict that computes missing values and is emptied when it holds `most` entries."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text, so that what Python holds doesn't depend on the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    release()
