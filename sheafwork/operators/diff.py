"""Word differences of paired pages: longest common subsequences, pair by pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def edits(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    """(same, removed or added; words) runs; removed words come first where either would do."""
    n, m = len(before), len(after)
    first = next((k for k, (a, b) in enumerate(zip(before, after)) if a != b), min(n, m))  # the common beginning is the same
    numbers: dict[str, int] = {}
    left, right = (np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in (before, after))
    # whether the words to come have as much in common without this one: a bit for each pair, and two rows of lengths
    rest = m - first
    down: list[np.ndarray] = [np.empty(0, np.uint8)] * n
    below = np.zeros(rest + 1, np.int32)
    for i in range(n - 1, first - 1, -1):
        row = np.zeros(rest + 1, np.int32)
        best = np.where(right[first:] == left[i], below[1:] + 1, below[:-1])
        # the longest to the right: a running maximum from the end
        row[:-1] = np.maximum.accumulate(best[::-1])[::-1]
        down[i] = np.packbits(below[:-1] >= row[1:])
        below = row
    out: list[tuple[str, list[str]]] = []

    def put(kind: str, word: str) -> None:
        if out and out[-1][0] == kind:
            out[-1][1].append(word)
        else:
            out.append((kind, [word]))

    i = j = 0
    while i < n or j < m:
        if i < n and j < m and before[i] == after[j]:
            put("same", before[i])
            i, j = i + 1, j + 1
        elif i < n and (j == m or down[i][(j - first) >> 3] >> (7 - (j - first & 7)) & 1):
            put("removed", before[i])
            i += 1
        else:
            put("added", after[j])
            j += 1
    return [(kind, " ".join(words)) for kind, words in out]


def page_diffs(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, page, at, kind, text: the edits of each page that either side has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.file, r.page, at, kind, text) for r in batch.itertuples() for at, (kind, text) in enumerate(edits((r.old or "").split(), (r.new or "").split()))]
            yield pd.DataFrame(rows, columns=["file", "page", "at", "kind", "text"])

    pairs = before.withColumnRenamed("text", "old").join(after.withColumnRenamed("text", "new"), ["file", "page"], "full_outer")
    return pairs.mapInPandas(run, "file long, page long, at long, kind string, text string")
