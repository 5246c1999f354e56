"""Delimited text in a column: lenient quoting, sniffed delimiters."""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

# Delimiters in the order in which they are tried, rows that are looked at, widths that still count.
CANDIDATES, ROWS, WIDEST = ",;\t", 60, 24


@functools.cache
def pattern(delimiter: str) -> re.Pattern:
    """A quoted head (which only an empty field can have) and what follows it, up to a delimiter, a newline or the end."""
    d = re.escape(delimiter)
    return re.compile(rf'(?:"((?:[^"]|"")*)(?:"|$))?([^{d}\n]*)({d}|\n|$)')


def parse(text: str, delimiter: str) -> Iterator[list[str]]:
    """Records: doubled quotes stand for themselves, newlines may stand within, a last one without a newline counts."""
    row: list[str] = []
    at, find = 0, pattern(delimiter).match
    while at < len(text):
        head, tail, end = (m := find(text, at)).groups()
        at = m.end()
        row.append((head or "").replace('""', '"') + tail.replace("\r", ""))
        if end != delimiter:
            yield row
            row = []
    if row:  # the text ends with a delimiter
        yield [*row, ""]


def sniff(text: str) -> str:
    """Of comma, semicolon and tab the one whose first rows agree most on a width of two or more; the earlier of equals."""
    best, found = 0.0, ","
    for delimiter in CANDIDATES:
        rows = list(itertools.islice((r for r in parse(text, delimiter) if any(x.strip() for x in r)), ROWS))
        widths = Counter(map(len, rows))
        if widths:
            width = max(widths, key=lambda w: (widths[w], w))
            score = widths[width] / len(rows) * min(width, WIDEST) if width > 1 else 0.0
            if score > best:
                best, found = score, delimiter
    return found


@F.pandas_udf(StringType())
def sniffed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: sniff(t or ""))


def records(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_fields, first, fields: the records of each text under its sniffed delimiter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                rows = enumerate(parse(r.text or "", sniff(r.text or "")))
                while some := list(itertools.islice(rows, 4096)):
                    yield pd.DataFrame([(r.doc_id, i, len(x), x[0], x) for i, x in some], columns=["doc_id", "row", "n_fields", "first", "fields"])

    return docs.mapInPandas(run, "doc_id long, row long, n_fields long, first string, fields array<string>")
