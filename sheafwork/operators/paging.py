"""Page algebra on (file, page, ...) rows: merge, select, compose, split, number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Files of one block; numbering over all files goes block by block.
BLOCK = 4096


def page_set(spec: str, count: Column, page: Column) -> Column:
    """Whether a page is in a selection: comma-separated `all`, `odd`, `even`, `last`, `n`, `a-b`, `a-`, `-b`. Ranges
    may be written either way round and are clamped to the file; unknown parts are ignored."""
    found = F.lit(False)
    parts = [p.strip().lower() for p in spec.split(",")]
    if not any(parts):
        return F.lit(True)
    for part in parts:
        a, dash, b = (x.strip() for x in part.partition("-"))
        if part == "all":
            found = F.lit(True)
        elif part in ("odd", "even"):
            found = found | (page % 2 == (1 if part == "odd" else 0))
        elif part == "last":
            found = found | (page == count)
        elif part.isdigit():
            found = found | (page == int(part))
        elif dash and (a.isdigit() or not a) and (b.isdigit() or not b) and (a or b):
            clamp = lambda x: F.greatest(F.lit(1), F.least(x, count))
            low, high = clamp(F.lit(int(a)) if a else F.lit(1)), clamp(F.lit(int(b)) if b else count)
            found = found | page.between(F.least(low, high), F.greatest(low, high))
    return found


def counted(pages: DataFrame) -> DataFrame:
    """With n_pages, the pages of the file."""
    return pages.join(pages.groupBy("file").agg(F.count("*").alias("n_pages")), "file")


def numbered(pages: DataFrame) -> DataFrame:
    """With page_in_file, n_pages and sequence: the place among all files' pages. File counts are summed block by
    block, so no window holds more than a file's pages, a block's files or the blocks."""
    sizes = pages.groupBy("file").agg(F.count("*").alias("n_pages")).withColumn("block", F.floor(F.col("file") / BLOCK))
    blocks = sizes.groupBy("block").agg(F.sum("n_pages").alias("size"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", before(Window.orderBy("block"), "size").alias("skip"))
    sizes = sizes.withColumn("inside", before(Window.partitionBy("block").orderBy("file"), "n_pages")).join(blocks, "block")
    own = F.row_number().over(Window.partitionBy("file").orderBy("page"))
    out = pages.withColumn("page_in_file", own.cast("long")).join(sizes, "file")
    return out.withColumn("sequence", F.col("skip") + F.col("inside") + F.col("page_in_file")).drop("block", "inside", "skip")


def padded(number: Column, width: int) -> Column:
    """Zeros in front; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def bates(pages: DataFrame, prefix: str = "", start: int = 1, width: int = 6) -> DataFrame:
    """With a label that counts on over all files, and `Page x of y` in the file."""
    rows = numbered(pages)
    label = F.concat(F.lit(prefix), padded(F.col("sequence") + (start - 1), width))
    return rows.withColumn("label", label).withColumn("page_label", F.format_string("Page %d of %d", "page_in_file", "n_pages"))


def turned(angle: Column, turn: int) -> Column:
    return F.pmod(angle + turn, F.lit(360))


def snapped(angle: Column) -> Column:
    """To the nearest quarter turn, halves up."""
    return F.pmod(F.floor(angle / 90 + 0.5) * 90, F.lit(360))


def extract(pages: DataFrame, wanted: list[int]) -> DataFrame:
    """Chosen pages in the order asked for, as pos."""
    plan = pages.sparkSession.createDataFrame(list(enumerate(wanted, 1)), "pos long, page long")
    return pages.join(F.broadcast(plan), "page").select("file", "pos", "page", "text", "n")


def deleted(pages: DataFrame, spec: str) -> DataFrame:
    """Pages of each file without those of a selection; a file of which nothing is left gives one row with an error."""
    rows = counted(pages)
    gone = page_set(spec, F.col("n_pages"), F.col("page"))
    left = rows.where(~gone).select("file", "page", F.lit(None).cast("string").alias("error"))
    empty = rows.groupBy("file").agg(F.min(gone.cast("int")).alias("all")).where("all = 1")
    return left.union(empty.select("file", F.lit(None).cast("bigint"), F.lit("nothing left")))


def missing(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries of a plan (pos, file, page) whose source has no such page; a plan must have none."""
    return plan.join(pages.select("file", "page").distinct(), ["file", "page"], "left_anti").select("pos", "file", "page")


def compose(pages: DataFrame, plan: DataFrame, cuts: list[int]) -> DataFrame:
    """A plan (pos, file, page, rotate) resolved against its sources, in groups cut after the given positions; missing
    says that the source has no such page."""
    group = sum((F.when(F.col("pos") > c, 1).otherwise(0) for c in sorted(set(cuts)) if c > 0), F.lit(0)) + 1
    rows = plan.join(pages.withColumn("found", F.lit(True)), ["file", "page"], "left")
    return rows.select("pos", "file", "page", snapped(F.col("rotate")).alias("rotate"), group.cast("long").alias("part"), "n", F.col("found").isNull().alias("missing"))


def split_every(pages: DataFrame, size: int) -> DataFrame:
    return pages.withColumn("part", (F.floor((F.col("page") - 1) / size) + 1).cast("long"))


def split_parts(pages: DataFrame, parts: int) -> DataFrame:
    """Equal parts of each file, larger ones first."""
    return pages.withColumn("part", F.ntile(parts).over(Window.partitionBy("file").orderBy("page")).cast("long"))


def split_by_size(pages: DataFrame, most: int) -> DataFrame:
    """Greedy parts of at most `most`; a larger page is a part of its own. A fold over each file's pages."""
    folded = pages.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("page", "n"))).alias("rows"))
    fold = f"""aggregate(rows, struct(array() as out, 1L as part, 0L as total), (s, x) ->
        struct(concat(s.out, array(struct(x.page as page, x.n as n, if(s.total > 0 and s.total + x.n > {most}, s.part + 1, s.part) as part))) as out,
               if(s.total > 0 and s.total + x.n > {most}, s.part + 1, s.part) as part,
               if(s.total > 0 and s.total + x.n > {most}, x.n, s.total + x.n) as total), s -> s.out)"""
    fold = fold.replace("array() as out", "cast(array() as array<struct<page:bigint,n:bigint,part:bigint>>) as out")
    return folded.select("file", F.explode(F.expr(fold)).alias("r")).select("file", "r.page", "r.n", "r.part")


def split_at(pages: DataFrame, starts: Column) -> DataFrame:
    """A new part at each page where `starts` holds."""
    w = Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("part", F.sum(F.when(starts, 1).otherwise(0)).over(w).cast("long"))


def split_around(pages: DataFrame, blank: Column, handling: str) -> DataFrame:
    """Parts between blank pages: these are dropped, or go with the part before (`previous`) or after them (`next`). There
    is no part without content but in a file that has none."""
    w = Window.partitionBy("file").orderBy("page")
    rows = pages.withColumn("_blank", blank).withColumn("_before", F.lag("_blank").over(w))
    some = F.max((~F.col("_blank")).cast("int"))
    if handling == "next":
        starts = F.col("_blank") & ~F.col("_before") & (some.over(w.rowsBetween(1, Window.unboundedFollowing)) == 1)
    elif handling == "previous":
        starts = ~F.col("_blank") & F.col("_before") & (some.over(w.rowsBetween(Window.unboundedPreceding, -1)) == 1)
    else:
        starts = ~F.col("_blank") & F.coalesce("_before", F.lit(True))
    rows = rows.withColumn("_starts", F.coalesce(starts, F.lit(False)).cast("int"))
    part = F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) + (0 if handling == "drop" else 1)
    rows = rows.withColumn("part", part.cast("long"))
    return (rows.where("not _blank") if handling == "drop" else rows).drop("_blank", "_before", "_starts")


def ranges(selected: DataFrame) -> DataFrame:
    """Runs of pages of each file as text: 1-3, 5."""
    island = F.col("page") - F.row_number().over(Window.partitionBy("file").orderBy("page"))
    runs = selected.withColumn("island", island).groupBy("file", "island").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    grouped = runs.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("a", text.alias("text")))).alias("runs"))
    return grouped.select("file", F.concat_ws(", ", F.transform("runs", lambda r: r.text)).alias("ranges"))


def dice(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset likeness of the words of two texts (columns keys, text) with the same keys: twice the shared words
    over all words."""
    words = lambda d, c: d.select(*keys, F.explode(F.expr("filter(split(text, '[ \\\\t\\\\n\\\\r]+'), x -> x <> '')")).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias(c))
    size = lambda d, c: d.select(*keys, F.expr("size(filter(split(text, '[ \\\\t\\\\n\\\\r]+'), x -> x <> ''))").cast("long").alias(c))
    shared = words(left, "a").join(words(right, "b"), [*keys, "word"]).groupBy(*keys).agg(F.sum(F.least("a", "b")).alias("shared"))
    rows = size(left, "n_left").join(size(right, "n_right"), keys).join(shared, keys, "left")
    both = F.col("n_left") + F.col("n_right")
    return rows.withColumn("likeness", F.when(both == 0, 1.0).otherwise(2 * F.coalesce("shared", F.lit(0)) / both)).drop("shared")
