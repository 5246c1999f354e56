"""Placement: sheets, tiles, bands, clusters and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def booklet(files: DataFrame) -> DataFrame:
    """file, sheet, side, place, page for files (file, n_pages): folded sheets, blanks null."""
    total = F.floor((F.col("n_pages") + 3) / 4) * 4
    sheets = files.withColumn("total", total).withColumn("sheet", F.explode(F.expr("sequence(0L, cast(total div 4 - 1 as bigint))")))
    s, t = F.col("sheet"), F.col("total")
    sides = F.array(*(F.struct(F.lit(a).alias("side"), F.lit(b).alias("place"), p.alias("p")) for a, b, p in (("front", "left", t - 2 * s), ("front", "right", 1 + 2 * s), ("back", "left", 2 + 2 * s), ("back", "right", t - 1 - 2 * s))))
    rows = sheets.select("file", "sheet", "n_pages", F.explode(sides).alias("x"))
    return rows.select("file", "sheet", "x.side", "x.place", F.when(F.col("x.p") <= F.col("n_pages"), F.col("x.p")).alias("page"))


def cells_on_sheets(pages: DataFrame, rows: int, columns: int) -> DataFrame:
    k = F.col("page") - 1
    return pages.select("file", "page", (F.floor(k / (rows * columns)) + 1).alias("sheet"), F.floor((k % (rows * columns)) / columns).alias("row"), (k % columns).alias("col"))


def poster(items: DataFrame, across: int, down: int, overlap: float) -> DataFrame:
    """Tiles of items (item, width, height)."""
    spots = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in range(across) for y in range(down))))
    w, h = F.col("width") / across, F.col("height") / down
    rows = items.withColumn("s", spots)
    return rows.select("item", F.col("s.x").alias("tile_x"), F.col("s.y").alias("tile_y"), w.alias("tile_width"), h.alias("tile_height"), (F.col("s.x") * (w - overlap)).alias("at_x"), (F.col("s.y") * (h - overlap)).alias("at_y"))


def placed(lines: DataFrame) -> DataFrame:
    """Lines on a fixed pitch: doc, line, top, bottom, w."""
    top = F.col("line") * 14.0 + F.floor(F.col("line") / 6) * 30
    return lines.select("doc", "line", top.alias("top"), (top + 11).alias("bottom"), F.length("text").cast("long").alias("w"))


def bands(lines: DataFrame, gap: float) -> DataFrame:
    w = Window.partitionBy("doc").orderBy("line")
    starts = F.when(F.col("top") - F.lag("bottom").over(w) > gap, 1).otherwise(0)
    return lines.withColumn("starts", starts).select("doc", "line", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("band"))


def clusters(edges: DataFrame, gap: float, least: int = 2) -> DataFrame:
    """doc, band, x, n: runs of edges w no further apart than gap, at their median."""
    w = Window.partitionBy("doc").orderBy("w", "line")
    rows = edges.withColumn("starts", F.when(F.col("w") - F.lag("w").over(w) > gap, 1).otherwise(0))
    rows = rows.withColumn("band", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc", "band").agg(F.round(F.median("w"), 6).alias("x"), F.count("*").alias("n")).where(F.col("n") >= least)


def nearest(cells: DataFrame, columns: list[tuple[int, float, float]]) -> DataFrame:
    """The column (number, left, right) that holds x, else the one with the nearest left edge, the first of equals."""
    far = F.array(*(F.struct(F.when((F.col("x") >= a - 0.5) & (F.col("x") < b), -1.0).otherwise(F.abs(F.col("x") - a)).alias("d"), F.lit(k).alias("col")) for k, a, b in columns))
    return cells.withColumn("col", F.array_min(far)["col"]).drop("x")
