"""Structure from positioned runs and lines: lines, paragraphs, columns, tables and how sure they are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Shares of the type size that part lines and words, and that make a line's style.
SAME_LINE, SAME_LINE_LEAST, WORD_GAP, FLAT, STYLE = 0.42, 0.6, 0.18, 0.5, 0.6


def assembled(runs: pd.DataFrame) -> pd.Series:
    """The line of each run of a page, from 0, in the order of baselines. A line's baseline is that of its widest run,
    so each run depends on those before: a fold, a page at a time."""
    line, base, size, widest = -1, 0.0, 0.0, 0.0
    out = pd.Series(0, index=runs.index, dtype="int64")
    for r in runs.sort_values(["baseline", "x", "run"], kind="stable").itertuples():
        width = r.right - r.x
        if line >= 0 and abs(r.baseline - base) <= max(SAME_LINE * max(r.size, size), SAME_LINE_LEAST):
            size = max(size, r.size)
            if width > widest:
                widest, base = width, r.baseline
        else:
            line, base, size, widest = line + 1, r.baseline, r.size, width
        out[r.Index] = line
    return out


def lines(runs: DataFrame) -> DataFrame:
    """doc, page, line with text, box, size and style, from runs (doc, page, run, text, x, right, top, bottom, baseline,
    size, bold, italic, spacer). Style and size are those of most characters."""
    numbered = runs.groupBy("doc", "page").applyInPandas(lambda p: p.assign(line=assembled(p)), _ddl(runs))
    w = Window.partitionBy("doc", "page", "line").orderBy("x", "run")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    flat = ~F.col("spacer") & (F.col("right") - F.col("x") < FLAT)
    edge = F.last(F.when(~flat, F.col("right")), ignorenulls=True).over(before)
    loose = F.lag(flat | F.col("spacer"), 1, False).over(w) | flat | (F.col("x") - edge > WORD_GAP * F.col("size"))
    placed = numbered.withColumn("loose", loose & (F.row_number().over(w) > 1))
    said = F.array_sort(F.collect_list(F.when(~F.col("spacer"), F.struct("x", "run", F.when(F.col("loose"), " ").otherwise("").alias("gap"), "text"))))
    joined = F.ltrim(F.regexp_replace(F.array_join(F.transform(said, lambda r: F.concat(r["gap"], r["text"])), ""), "(\\s) ", "$1"))
    inked = ~F.col("spacer")
    weight = F.when(inked, F.length("text")).otherwise(0)
    sums = placed.groupBy("doc", "page", "line").agg(
        joined.alias("text"), F.min(F.when(inked, F.col("x"))).alias("x"), F.max(F.when(inked, F.col("right"))).alias("right"), F.min(F.when(inked, F.col("top"))).alias("top"), F.max(F.when(inked, F.col("bottom"))).alias("bottom"),
        (F.sum(F.when(F.col("bold"), weight).otherwise(0)) >= STYLE * F.sum(weight)).alias("bold"), (F.sum(F.when(F.col("italic"), weight).otherwise(0)) >= STYLE * F.sum(weight)).alias("italic"),
    )
    sizes = placed.where("not spacer").groupBy("doc", "page", "line", "size").agg(F.sum(F.length("text")).alias("weight"), F.min("x").alias("first"))
    best = sizes.groupBy("doc", "page", "line").agg(F.max_by("size", F.struct("weight", -F.col("first"))).alias("size"))
    return sums.join(best, ["doc", "page", "line"]).where(F.trim("text") != "")


def _ddl(runs: DataFrame) -> str:
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema), "line long"])


def running(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, signature, n: what stands in the same margin on at least three pages and three fifths of them. lines: doc,
    page, text, baseline, bottom; pages: doc, page, height."""
    sig = T.running_signature(F.col("text"), F.col("baseline"), F.col("bottom"), F.col("height"))
    seen = lines.join(pages, ["doc", "page"]).select("doc", "page", sig.alias("signature")).where("signature <> ''").distinct()
    least = pages.groupBy("doc").agg(F.greatest(F.lit(3), F.ceil(F.count("*") * 0.6)).alias("least"))
    return seen.groupBy("doc", "signature").agg(F.count("*").alias("n")).join(least, "doc").where("n >= least").drop("least")


def flagged(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines with `running`: whether they are running heads or feet."""
    heads = running(lines, pages).select("doc", "signature", F.lit(True).alias("found"))
    sig = T.running_signature(F.col("text"), F.col("baseline"), F.col("bottom"), F.col("height"))
    rows = lines.join(pages, ["doc", "page"]).withColumn("signature", sig).join(heads, ["doc", "signature"], "left")
    return rows.withColumn("running", F.coalesce("found", F.lit(False))).drop("found", "signature", "height")


# Fixed values of paragraphs: leading, indents and short lines as shares of the body, the column or the leading.
LEADING, INDENT, SHORT_JUSTIFIED, SHORT_RAGGED, OTHER_SIZE, JUSTIFIED = 1.35, 0.5, 1.5, 0.25, 0.06, 0.6


def paragraphs(lines: DataFrame, body: float) -> DataFrame:
    """Lines (doc, column, line, text, x, right, baseline, size, bold) with `para`, their paragraph in the column. One
    begins after a gap, at an indent, after a short last line, at a change of type and with each list item."""
    key = ["doc", "column"]
    w = Window.partitionBy(*key).orderBy("line")
    was = lambda c: F.lag(c).over(w)
    rows = lines.withColumn("gap", F.col("baseline") - was("baseline"))
    edges = rows.groupBy(*key).agg(F.min("x").alias("left_edge"), F.max("right").alias("right_edge"), F.coalesce(F.median(F.when((F.col("gap") > 0) & (F.col("gap") < 3 * body), F.col("gap"))), F.lit(1.2 * body)).alias("leading"), F.count("*").alias("n_lines"))
    rows = rows.join(edges, key)
    width = F.col("right_edge") - F.col("left_edge")
    flush = (F.col("right_edge") - F.col("right") <= F.greatest(F.lit(2.0), 0.02 * width)).cast("int")
    of_column = Window.partitionBy(*key)
    rows = rows.withColumn("justified", (F.col("n_lines") >= 4) & (F.avg(flush).over(of_column) >= JUSTIFIED))
    item = T.list_marker(F.col("text")).isNotNull()
    short = F.col("right_edge") - was("right")
    ended = was("text").rlike(r"[.!?:;”\"'’]\s*$") & ~F.trim("text").rlike("^[a-z]")
    breaks = (
        (F.col("gap") > LEADING * F.col("leading"))
        | ((F.col("x") - was("x") > INDENT * body) & (was("x") - F.col("left_edge") <= INDENT * body) & ~F.lag(item).over(w))
        | (F.col("justified") & (short > SHORT_JUSTIFIED * body))
        | (~F.col("justified") & (short > SHORT_RAGGED * width) & ended)
        | (F.abs(F.col("size") - was("size")) > OTHER_SIZE * was("size"))
        | (F.col("bold") != was("bold"))
        | item
    )
    starts = rows.withColumn("starts", F.when(F.row_number().over(w) == 1, 0).when(breaks, 1).otherwise(0))
    return starts.withColumn("para", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).select(*lines.columns, "para")


def space_before(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, band, column, block, top, bottom) with the space above them in their column."""
    w = Window.partitionBy("doc", "band", "column").orderBy("block")
    return blocks.withColumn("space", F.greatest(F.lit(0.0), F.coalesce(F.col("top") - F.lag("bottom").over(w), F.lit(0.0))))


def kept_edges(edges: Column, least: float = 1.5) -> Column:
    """Of sorted edges those further than `least` from the last that was kept."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(edges), start, lambda done, e: F.when((F.size(done) == 0) | (e - F.element_at(done, -1) > least), F.concat(done, F.array(e))).otherwise(done))


def ruled_boundaries(boundaries: DataFrame, rules: DataFrame, body: float) -> DataFrame:
    """Column boundaries (doc, boundary) with a vertical rule (doc, x) nearer than the body size. An equi-join: both
    are dealt to cells as wide as the body, and a rule also to the cells beside its own."""
    cell = lambda c: F.floor(F.col(c) / body)
    a = boundaries.withColumn("cell", cell("boundary"))
    b = rules.select("doc", F.col("x").alias("rule_x"), F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("cell"))
    near = a.join(b, ["doc", "cell"]).where(F.abs(F.col("rule_x") - F.col("boundary")) < body).select("doc", "boundary").distinct()
    return boundaries.join(near, ["doc", "boundary"], "left_semi")


# What the parts of the evidence are worth, and how sure whitespace alone can make.
PARTS = {"row_support": 0.28, "alignment": 0.28, "shape": 0.16, "size": 0.28}
RULES, CEILING, CEILING_RULES, LEAST_ROWS, RULED_ALIGNMENT, FLOOR = 0.25, 0.85, 0.15, 3, 0.85, 0.7


def table_confidence(rows: Column, row_support: Column, alignment: Column, shape: Column, spanning: Column, matched: Column, boundaries: Column, drawn: Column) -> Column:
    """How sure a grid is a table: filled cells, straight edges, even rows, their number; and rules, of which `spanning`
    run across and `matched` of its boundaries are drawn."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    part = F.when(boundaries > 0, matched / boundaries).otherwise(0.0)
    ruled = unit(F.least(F.lit(1.0), spanning / 2) * 0.5 + part * 0.5)
    straight = F.when(drawn, F.greatest(alignment, F.lit(RULED_ALIGNMENT))).otherwise(alignment)
    parts = {"row_support": row_support, "alignment": straight, "shape": shape, "size": unit((rows - LEAST_ROWS + 1) / 4)}
    inferred = unit(sum(PARTS[k] * v for k, v in parts.items()))
    return F.least(inferred + RULES * ruled, CEILING + CEILING_RULES * ruled)


def continued(tables: DataFrame, body: float) -> DataFrame:
    """Tables (doc, table, page, height, top, bottom, edges, first_rows) with `group`: a table that breaks at the foot of
    a page goes on at the head of the next, in the same columns, unless it begins anew."""
    w = Window.partitionBy("doc").orderBy("page", "table")
    was = lambda c: F.lag(c).over(w)
    near = F.forall(F.arrays_zip(F.col("edges").alias("a"), was("edges").alias("b")), lambda p: F.abs(p["a"] - p["b"]) <= max(4.0, 0.5 * body))
    skip = F.when(F.element_at("first_rows", 1) == F.element_at(was("first_rows"), 1), 2).otherwise(1)
    own, other = F.try_element_at("first_rows", skip), F.try_element_at(was("first_rows"), skip)
    anew = own.isNotNull() & other.isNotNull() & (own == other)
    goes_on = (F.col("page") == was("page") + 1) & (F.size("edges") == F.size(was("edges"))) & near & (was("bottom") >= 0.75 * was("height")) & (F.col("top") <= 0.35 * F.col("height")) & ~anew
    rows = tables.withColumn("starts", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("group", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("starts")


def without_repeated_heads(rows: DataFrame) -> DataFrame:
    """Rows (doc, group, table, row, text) of continued tables without a later table's first row that repeats the head."""
    w = Window.partitionBy("doc", "group").orderBy("table", "row")
    head = F.first("text").over(w)
    first = F.first("table").over(w)
    return rows.withColumn("again", (F.col("row") == 0) & (F.col("table") != first) & (F.col("text") == head)).where("not again").drop("again")


def sheet_titles(tables: DataFrame) -> DataFrame:
    """Tables (doc, page, table) with a sheet's name: the page, and which table where it has several."""
    w = Window.partitionBy("doc", "page")
    several = F.count("*").over(w) > 1
    nth = F.row_number().over(w.orderBy("table"))
    return tables.withColumn("sheet", F.concat(F.lit("Page "), F.col("page").cast("string"), F.when(several, F.concat(F.lit(" table "), nth.cast("string"))).otherwise("")))


def has_header(cells: DataFrame) -> DataFrame:
    """doc, header: whether row 0 of cells (doc, row, col, text, numeric, bold) is a header: three rows or more, two
    labels, no number in it, and either bold over others or above numbers."""
    filled, head = F.col("text") != "", F.col("row") == 0
    sums = cells.groupBy("doc").agg(
        F.count_distinct("row").alias("n_rows"), F.sum((head & filled).cast("int")).alias("labels"), F.max(head & F.col("numeric")).alias("head_number"), F.max(~head & F.col("numeric")).alias("number"),
        F.min(F.when(head & filled, F.col("bold"))).alias("head_bold"), F.max(~head & filled & ~F.col("bold")).alias("light"),
    )
    return sums.select("doc", ((F.col("n_rows") >= 3) & (F.col("labels") >= 2) & ~F.col("head_number") & ((F.coalesce("head_bold", F.lit(False)) & F.col("light")) | F.col("number"))).alias("header"))


def majority(runs: DataFrame, key: list[str]) -> DataFrame:
    """For each key the size and font of most characters, and whether three fifths of them are bold or italic."""
    weight = F.length("text")
    share = lambda c: (F.sum(F.when(F.col(c), weight).otherwise(0)) >= STYLE * F.sum(weight)) & (F.sum(weight) > 0)
    out = runs.groupBy(*key).agg(share("bold").alias("bold"), share("italic").alias("italic"))
    for c in ("size", "font"):
        sums = runs.groupBy(*key, c).agg(F.sum(weight).alias("w"), F.min("run").alias("first"))
        out = out.join(sums.groupBy(*key).agg(F.max_by(c, F.struct("w", -F.col("first"))).alias(c)), key)
    return out


def document_font(runs: DataFrame) -> DataFrame:
    """doc, font for an office document: fixed pitch or serifs if most characters have them, else plain."""
    weight = F.length("text").cast("double")
    share = lambda c: F.sum(F.when(F.col(c), weight).otherwise(0)) / F.sum(weight)
    return runs.groupBy("doc").agg(F.when(share("mono") > 0.6, "Courier New").when(share("serif") > 0.5, "Times New Roman").otherwise("Arial").alias("font"))


def boxes(rows: DataFrame, key: list[str]) -> DataFrame:
    """The box around the boxes (x, right, top, bottom) of each key."""
    return rows.groupBy(*key).agg(F.min("x").alias("x"), F.max("right").alias("right"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def fitted_widths(widths: DataFrame, usable: float, least: float = 24.0, pad: float = 6.0) -> DataFrame:
    """Widths of a table's columns from those of their cells (doc, col, width): at most 0.55 of the room each; where
    they don't fit, those of less than a fair share stay and the others share the rest."""
    natural = widths.groupBy("doc", "col").agg(F.greatest(F.lit(least), F.least(F.max("width") + 2 * pad, F.lit(max(0.55 * usable, least)))).alias("natural"))
    w = Window.partitionBy("doc")
    fair = usable / F.count("*").over(w)
    rows = natural.withColumn("fair", fair).withColumn("total", F.sum("natural").over(w))
    rows = rows.withColumn("modest", F.sum(F.when(F.col("natural") <= F.col("fair"), F.col("natural")).otherwise(0.0)).over(w))
    rest = F.greatest(F.lit(least), F.col("natural") / (F.col("total") - F.col("modest")) * (usable - F.col("modest")))
    stuck = (F.col("total") - F.col("modest") <= 0) | (usable - F.col("modest") <= 0)
    out = F.when(F.col("total") <= usable, F.col("natural")).when(stuck, F.greatest("fair", F.lit(least))).when(F.col("natural") <= F.col("fair"), F.col("natural")).otherwise(rest)
    return rows.select("doc", "col", out.alias("width"))


def ink_box(pixels: DataFrame) -> DataFrame:
    """doc and the first and last row and column with enough dark pixels (doc, x, y, dark, width, height): four, or
    0.0015 of the line."""
    out = None
    for axis, across, low, high in (("y", "width", "top", "bottom"), ("x", "height", "left", "right")):
        counts = pixels.groupBy("doc", axis).agg(F.sum(F.col("dark").cast("int")).alias("n"), F.max(across).alias("across"))
        found = counts.where(F.col("n") >= F.greatest(F.lit(4), F.ceil(F.col("across") * 0.0015))).groupBy("doc").agg(F.min(axis).alias(low), F.max(axis).alias(high))
        out = found if out is None else out.join(found, "doc")
    return out


def document(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines of documents with what the whole document says of them: doc, page, line, text, ratio (their size against that
    of most text), running, level. In two passes: first lines, then the statistics over all pages."""
    found = lines(runs)
    size = F.floor(2 * F.col("size") + 0.5) / 2
    weights = found.groupBy("doc", size.alias("body")).agg(F.sum(F.length("text")).alias("w"), F.min(F.struct("page", "line")).alias("first"))
    body = weights.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("w"), "first"))).where("k = 1").select("doc", "body")
    rows = flagged(found.withColumn("baseline", F.col("bottom")), pages).join(body, "doc")
    ratio = F.col("size") / F.col("body")
    level = F.when(F.col("running"), 0).otherwise(T.heading_level(F.col("text"), ratio, F.col("bold")))
    return rows.select("doc", "page", "line", "text", F.round(ratio, 6).alias("ratio"), "running", level.alias("level"))


def written_pages(blocks: DataFrame) -> DataFrame:
    """doc, text: the blocks (doc, page, block, kind, level, text) as Markdown, pages parted by rules."""
    from ..functions.markdown import written

    text = written(F.col("kind"), F.col("level"), F.col("text"))
    pages = blocks.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("block", text.alias("text")))).alias("b"))
    joined = pages.select("doc", "page", F.array_join(F.transform("b", lambda b: b["text"]), "\n\n").alias("text"))
    whole = joined.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return whole.select("doc", F.array_join(F.transform("p", lambda p: p["text"]), "\n\n---\n\n").alias("text"))


def picture_plan(pages: DataFrame, wanted: Column, dpi: int, ending: str = "png") -> DataFrame:
    """file, page, name, dpi of the pictures to be made of the wanted pages (file, stem, page, n_pages, width, height): as
    fine as asked for, as far as the page's size allows."""
    from ..functions.media import dpi_ceiling

    digits = F.length(F.col("n_pages").cast("string"))
    name = F.concat(F.col("stem"), F.lit("-"), F.lpad(F.col("page").cast("string"), digits, "0"), F.lit(f".{ending}"))
    return pages.where(wanted).select("file", "page", name.alias("name"), F.least(F.lit(dpi), dpi_ceiling(F.col("width"), F.col("height"))).alias("dpi"))
