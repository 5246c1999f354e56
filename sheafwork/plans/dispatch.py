"""Operations on files of pages by name, as a request names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import outline, paging, records

OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "merge": lambda pages: paging.numbered(pages).select("file", "page", "sequence"),
    "split": lambda pages, every: paging.split_every(pages, every),
    "split-parts": lambda pages, parts: paging.split_parts(pages, parts),
    "split-size": lambda pages, most: paging.split_by_size(pages, most),
    "split-bookmarks": lambda pages, marks: outline.split_at_bookmarks(pages, marks),
    "split-keywords": lambda pages, keywords: paging.split_at(pages, records.starts_with_any(F.col("text"), keywords)),
    "rotate": lambda pages, turn, spec="": paging.counted(pages).withColumn("rotate", F.when(paging.page_set(spec, F.col("n_pages"), F.col("page")), paging.turned(F.lit(0), turn)).otherwise(0)),
    "reorder": lambda pages, order: records.reordered(pages, order),
    "extract": lambda pages, wanted: paging.extract(pages, wanted),
    "delete": lambda pages, spec: paging.deleted(pages, spec),
    "page-numbers": lambda pages: paging.bates(pages),
    "compose": lambda pages, plan, cuts=(): paging.compose(pages, plan, list(cuts)),
}


def run(name: str, pages: DataFrame, **options) -> DataFrame:
    """The result of an operation; a name that isn't one is an error."""
    if name not in OPERATIONS:
        raise ValueError(f"{name} is no operation")
    return OPERATIONS[name](pages, **options)
