"""Comparison of two documents: pages matched by their words, changes counted and written up."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diff import edits

# Fixed value: pages less alike than this aren't the same page.
SAME = 0.6


def likeness(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if a and b else float(not total)


def aligned(before: list[list[str]], after: list[list[str]]) -> list[tuple[int | None, int | None]]:
    """The pairs of pages, in order, that are most alike in sum; pages without a partner stand alone, those of the first
    document before those of the second."""
    left, right = [Counter(x) for x in before], [Counter(x) for x in after]
    alike = {(i, j): s for i, a in enumerate(left) for j, b in enumerate(right) if (s := likeness(a, b)) >= SAME}
    n, m = len(left), len(right)
    rest = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            rest[i][j] = max(rest[i + 1][j], rest[i][j + 1], alike[i, j] + rest[i + 1][j + 1] if (i, j) in alike else 0.0)
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and (i, j) in alike and rest[i][j] == alike[i, j] + rest[i + 1][j + 1]:
            out.append((i + 1, j + 1))
            i, j = i + 1, j + 1
        elif j == m or i < n and rest[i + 1][j] >= rest[i][j + 1]:
            out.append((i + 1, None))
            i += 1
        else:
            out.append((None, j + 1))
            j += 1
    return out


PAIRS = "pair long, nth long, before long, after long, added long, removed long, changes array<struct<kind:string,text:string>>"


def page_pairs(pages: DataFrame) -> DataFrame:
    """pages: pair, side (0 or 1), page, text. The matched pages of each pair of documents, with their changes. A pair of
    documents is one group, as large as its pages."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "page"])
        before, after = ([t.split() for t in rows.text[rows.side == s].fillna("")] for s in (0, 1))
        out = []
        for nth, (i, j) in enumerate(aligned(before, after), 1):
            changes = edits(before[i - 1] if i else [], after[j - 1] if j else [])
            count = lambda kind: sum(len(t.split()) for k, t in changes if k == kind)
            out.append((rows.pair.iloc[0], nth, i, j, count("added"), count("removed"), [{"kind": k, "text": t} for k, t in changes]))
        found = pd.DataFrame(out, columns=[x.split()[0] for x in PAIRS.split(", ")[:7]])
        return found.astype({"before": "Int64", "after": "Int64"})

    return pages.select("pair", "side", "page", "text").groupBy("pair").applyInPandas(run, PAIRS)


def totals(pairs: DataFrame) -> DataFrame:
    """For each pair of documents: words added and removed, pages that differ, pages only in one."""
    differs = (F.col("added") > 0) | (F.col("removed") > 0)
    return pairs.groupBy("pair").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count_if(differs).alias("changed"), F.count_if(F.col("before").isNull()).alias("inserted"), F.count_if(F.col("after").isNull()).alias("deleted"), F.count("*").alias("n_pages"))


def report(pairs: DataFrame) -> DataFrame:
    """pair, text: the changes as Markdown, the pages that differ under headings of their own."""
    differs = (F.col("added") > 0) | (F.col("removed") > 0)
    before, after = F.col("before").cast("string"), F.col("after").cast("string")
    title = F.when(F.col("before").isNull(), F.concat(F.lit("## Page "), after, F.lit(" — added"))).when(F.col("after").isNull(), F.concat(F.lit("## Page "), before, F.lit(" — removed")))
    title = title.when(F.col("before") == F.col("after"), F.concat(F.lit("## Page "), before)).otherwise(F.concat(F.lit("## Page "), before, F.lit(" → "), after))
    line = lambda c: F.when(c["kind"] == "added", F.concat(F.lit("**+** "), c["text"])).otherwise(F.concat(F.lit("**−** ~~"), c["text"], F.lit("~~")))
    body = F.array_join(F.transform(F.filter("changes", lambda c: c["kind"].isin("added", "removed")), line), "\n\n")
    rows = pairs.withColumn("part", F.when(differs, F.concat(title, F.lit("\n\n"), body)))
    parts = rows.groupBy("pair").agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("nth", "part")))).alias("parts"))
    count = lambda c, s: F.concat(F.lit("- "), c.cast("string"), F.lit(s))
    head = F.concat_ws("\n", F.lit("# What changed\n"), count(F.col("added"), " words added"), count(F.col("removed"), " words removed"), F.concat(F.lit("- "), F.col("changed").cast("string"), F.lit(" of "), F.col("n_pages").cast("string"), F.lit(" pages differ")))
    return totals(pairs).join(parts, "pair").select("pair", F.concat_ws("\n\n", head, F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")).alias("text"))
