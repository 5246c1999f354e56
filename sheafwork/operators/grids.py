"""Columns of text and rows of tables, from runs and lines. Each page or column is one group, as large as itself."""

from __future__ import annotations

from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .structure import assembled

# Gaps between cells and rows, and how far a wrapped cell may stray, by the size of the type.
CELL_GAP, ROW_GAP, USUAL_GAP, STRAY, LEAST_ROWS = 1.4, 1.6, 1.75, 0.3, 3


def cells(runs: DataFrame) -> DataFrame:
    """Cells of lines: doc, line, cell, x, right, text, from runs (doc, line, run, text, x, right, size, spacer). A new one
    begins after a wide gap or a wide blank."""
    w = Window.partitionBy("doc", "line").orderBy("x", "run")
    wide = CELL_GAP * F.col("size")
    edge = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = (F.col("x") - edge > wide) | (F.col("spacer") & (F.col("right") - F.col("x") > wide))
    rows = runs.withColumn("cut", F.when(cut, 1).otherwise(0)).withColumn("cell", F.sum("cut").over(w))
    inked = rows.where("not spacer").groupBy("doc", "line", "cell").agg(F.min("x").alias("x"), F.max("right").alias("right"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "run", "text"))), lambda r: r["text"]), " ").alias("text"))
    nth = F.row_number().over(Window.partitionBy("doc", "line").orderBy("x")) - 1
    return inked.where(F.trim("text") != "").withColumn("cell", nth.cast("long"))


ROWS = "doc long, table long, row long, cell long, x double, text string"


def tables(lines: DataFrame, cells: DataFrame, body: float) -> DataFrame:
    """Rows of tables in columns of lines (doc, line, top, bottom) with cells (doc, line, cell, x, text): consecutive lines
    of two cells or more, three at least, with no gap out of keeping with the column's. A line of one cell that begins
    where a cell above does is the rest of that cell."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        found: list[list[list[list]]] = []  # tables of rows of cells [x, text]
        group: list[list[list]] = []
        held = [(top, bottom, own[["x", "text"]].dropna().values.tolist()) for (_, top, bottom), own in page.sort_values(["line", "cell"]).groupby(["line", "top", "bottom"], sort=True)]
        gaps = sorted(b[0] - a[1] for a, b in zip(held, held[1:]) if b[0] > a[1])
        most = max(ROW_GAP * body, USUAL_GAP * (gaps[len(gaps) // 2] if gaps else 0.0))
        last = None

        def done() -> None:
            if len(group) >= LEAST_ROWS:
                found.append(list(group))
            group.clear()

        for top, bottom, own in held:
            apart = last is not None and top - last > most
            last = bottom
            above = next((c for c in group[-1] if abs(c[0] - own[0][0]) <= STRAY * body), None) if group and len(own) == 1 and not apart else None
            if above:
                above[1] = f"{above[1]} {own[0][1]}".strip()
                continue
            if apart or len(own) < 2:
                done()
            if len(own) > 1:
                group.append(own)
        done()
        rows = [(page.doc.iloc[0], t, r, c, x, text) for t, table in enumerate(found) for r, row in enumerate(table) for c, (x, text) in enumerate(row)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in ROWS.split(", ")])

    return lines.select("doc", "line", "top", "bottom").join(cells.select("doc", "line", "cell", "x", "text"), ["doc", "line"], "left").groupBy("doc").applyInPandas(run, ROWS)


# Fixed values of columns: widths of the gutter by type and page, lines of each side and in all, shares, depth.
GUTTER, GUTTER_PAGE, SIDE_LINES, LEAST_LINES, SHARE, OVERLAP, FILL, DEPTH = 1.6, 0.028, 6, 10, 0.2, 0.5, 0.45, 2


def lines_of(runs: pd.DataFrame) -> pd.DataFrame:
    own = runs.assign(line=assembled(runs))
    own = own[~own.spacer]
    return own.groupby("line").agg(x=("x", "min"), right=("right", "max"), top=("top", "min"), bottom=("bottom", "max"))


def fill(lines: pd.DataFrame) -> float:
    width = lines.right.max() - lines.x.min()
    return median((lines.right - lines.x) / width) if width > 0 else 0.0


def cut(runs: pd.DataFrame, body: float, width: float, depth: int = 0) -> list[pd.DataFrame]:
    """The runs of each column: parted at the widest gutter between two stacks of lines that stand side by side and fill
    their widths; and so on within them."""
    if depth > DEPTH or len(lines_of(runs)) < LEAST_LINES:
        return [runs]
    inked = runs[~runs.spacer].sort_values("x")
    reach = inked.right.cummax()
    gaps = pd.DataFrame({"from": reach.iloc[:-1].to_numpy(), "to": inked.x.iloc[1:].to_numpy()})
    gaps["wide"] = gaps["to"] - gaps["from"]
    middle = (runs.x + runs.right) / 2
    for g in gaps[gaps.wide >= max(GUTTER * body, GUTTER_PAGE * width)].sort_values("wide", ascending=False, kind="stable").itertuples():
        sides = [runs[middle < (g.to + g._1) / 2], runs[middle >= (g.to + g._1) / 2]]
        a, b = map(lines_of, sides)
        if min(len(a), len(b)) < SIDE_LINES or min(len(a), len(b)) < SHARE * (len(a) + len(b)):
            continue
        shorter = min(x.bottom.max() - x.top.min() for x in (a, b))
        overlap = min(a.bottom.max(), b.bottom.max()) - max(a.top.min(), b.top.min())
        if shorter > 0 and overlap >= OVERLAP * shorter and min(fill(a), fill(b)) >= FILL:
            return [c for side in sides for c in cut(side, body, width, depth + 1)]
    return [runs]


def columns(runs: DataFrame, body: float, width: float) -> DataFrame:
    """Runs (doc, page, run, x, right, top, bottom, baseline, size, spacer) with their column, from 0."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema), "column long"])

    def run(page: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([c.assign(column=i) for i, c in enumerate(cut(page, body, width))])

    return runs.groupBy("doc", "page").applyInPandas(run, schema)


# The least and the largest margin in points.
MARGINS = (18.0, 108.0)


def margins(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc, width and height of most pages (doc, page, width, height), the medians of their margins, and whether other
    sizes occur. blocks: doc, page, x, right, top, bottom, running."""
    size = pages.withColumn("w", F.round("width").cast("long")).withColumn("h", F.round("height").cast("long"))
    counts = size.groupBy("doc", "w", "h").agg(F.count("*").alias("n"), F.min("page").alias("first"), F.min_by("width", "page").alias("width"), F.min_by("height", "page").alias("height"))
    most = counts.groupBy("doc").agg(F.max_by(F.struct("w", "h", "width", "height"), F.struct("n", -F.col("first"))).alias("s"), (F.count("*") > 1).alias("varies"))
    body = blocks.where("not running").groupBy("doc", "page").agg(F.min("x").alias("left"), F.max("right").alias("right"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    rows = size.select("doc", "page", "w", "h", "width", "height").join(body, ["doc", "page"]).join(most.select("doc", "s"), "doc").where("w = s.w and h = s.h")
    of = lambda c: F.median(c)
    found = rows.groupBy("doc").agg(of("left").alias("left"), of(F.col("width") - F.col("right")).alias("right"), of("top").alias("top"), of(F.col("height") - F.col("bottom")).alias("bottom"))
    clamp = lambda c: F.floor(F.greatest(F.lit(MARGINS[0]), F.least(F.lit(MARGINS[1]), F.coalesce(c, F.lit(0.0)))) + 0.5).cast("long").alias(c)
    return most.join(found, "doc", "left").select("doc", "s.width", "s.height", *map(clamp, ("left", "right", "top", "bottom")), "varies")


def quantile(rows: DataFrame, key: str, column: str, share: float, bins: int = 512) -> DataFrame:
    """key, quantile of values of 0 and more by a histogram up to the largest: the middle of the bin that reaches it."""
    most = rows.groupBy(key).agg(F.max(column).alias("most"), F.count("*").alias("n"))
    bin_ = F.when(F.col("most") > 0, F.least(F.floor(F.col(column) / F.col("most") * bins), F.lit(bins - 1))).otherwise(0)
    counts = rows.join(most, key).groupBy(key, "most", "n", bin_.alias("bin")).agg(F.count("*").alias("held"))
    seen = F.sum("held").over(Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumn("seen", seen).where(F.col("seen") >= F.col("n") * share)
    return reached.groupBy(key, "most").agg(F.min("bin").alias("bin")).select(key, F.when(F.col("most") > 0, (F.col("bin") + 0.5) / bins * F.col("most")).otherwise(0.0).alias("quantile"))
