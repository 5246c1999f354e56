"""Rows of forms, sheets, packages and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Form fields (form, name, value) with the values given (form, name, given), and what became of each: filled, kept,
    or skipped for names that the form hasn't."""
    state = F.when(~F.coalesce("in_form", F.lit(False)), "skipped").when(F.coalesce("is_given", F.lit(False)), "filled").otherwise("kept")
    both = fields.withColumn("in_form", F.lit(True)).join(values.withColumn("is_given", F.lit(True)), ["form", "name"], "full_outer")
    return both.select("form", "name", F.when(F.coalesce("is_given", F.lit(False)), F.col("given")).otherwise(F.col("value")).alias("value"), state.alias("state"))


def shared_strings(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Cells (sheet, row, col, index) with the text of the shared string (sheet, index, text); empty where there is none."""
    return cells.join(strings, ["sheet", "index"], "left").select("sheet", "row", "col", F.coalesce("text", F.lit("")).alias("text"))


def without_covered(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells (sheet, row, col) without those that a merged range (sheet, r0, c0, r1, c1) covers, but for its first."""
    rows = merges.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    covered = rows.where("not (row = r0 and col = c0)").select("sheet", "row", "col")
    return cells.join(covered, ["sheet", "row", "col"], "left_anti")


def unmatched(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """source, text, problem: calls (source, text) that no rule (source, text) names, and rules that no call needs. Both
    must be empty for an audit to pass."""
    keys = ["source", "text"]
    extra = calls.join(rules, keys, "left_anti").withColumn("problem", F.lit("undocumented"))
    return extra.union(rules.join(calls, keys, "left_anti").withColumn("problem", F.lit("unused"))).distinct()


def lost_objects(before: DataFrame, after: DataFrame) -> DataFrame:
    """Objects (file, object, digest) that the rewritten file hasn't unchanged."""
    return before.join(after, ["file", "object", "digest"], "left_anti")


def named_pages(links: DataFrame, destinations: DataFrame) -> DataFrame:
    """Links (file, link, name) with the page of the named destination (file, name, page); null if there is none."""
    return links.join(destinations, ["file", "name"], "left").select("file", "link", "page")


def composition(objects: DataFrame) -> DataFrame:
    """file, n_images, image_bytes, share, is_scan and what to say of a small saving, from objects (file, kind, bytes)."""
    image = F.col("kind") == "image"
    rows = objects.groupBy("file").agg(F.count_if(image).alias("n_images"), F.sum(F.when(image, F.col("bytes")).otherwise(0)).alias("image_bytes"), F.sum("bytes").alias("total"))
    rows = rows.withColumn("share", F.when(F.col("total") > 0, F.col("image_bytes") / F.col("total")).otherwise(0.0))
    message = F.when(F.col("share") > 0.6, F.when(F.col("n_images") == 1, "a single scanned image").otherwise("scanned images")).when(F.col("share") > 0.25, "partly images").otherwise("")
    return rows.select("file", "n_images", "image_bytes", F.round("share", 6).alias("share"), ((F.col("share") > 0.6) & (F.col("n_images") <= 40)).alias("is_scan"), message.alias("message"))


def with_pages(items: DataFrame, key: str, page: str) -> DataFrame:
    """Equal contents once: key, the pages that have them in order, and how often they occur."""
    return items.groupBy(key).agg(F.array_sort(F.collect_set(page)).alias("pages"), F.count("*").alias("copies"))


def receipts(files: DataFrame) -> DataFrame:
    """job, bytes in and out, ratio and what was saved, from files (job, bytes_in, bytes_out)."""
    rows = files.groupBy("job").agg(F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"))
    return rows.withColumn("ratio", F.round(F.col("bytes_out") / F.col("bytes_in"), 6)).withColumn("saved", F.greatest(F.lit(0), F.col("bytes_in") - F.col("bytes_out")))


def crop_boxes(boxes: DataFrame) -> DataFrame:
    """One crop box for the pages (file, page, width, height, turn, x0, y0, x1, y1) of each size: the box around all.
    Pages turned a quarter have the size that is shown."""
    turned = F.col("turn") % 180 == 90
    size = lambda a, b: F.round(F.when(turned, F.col(b)).otherwise(F.col(a))).cast("long")
    rows = boxes.withColumn("w", size("width", "height")).withColumn("h", size("height", "width"))
    return rows.groupBy("file", "w", "h").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def blank(ink: Column, limit: float) -> Column:
    """Whether a page's share of ink is that of a blank one."""
    return ink <= limit


def ink_share(pixels: DataFrame) -> DataFrame:
    """file, page, ink: the share of pixels (file, page, luma, alpha) that are dark and not clear."""
    dark = (F.col("luma") < 245) & (F.col("alpha") > 8)
    return pixels.groupBy("file", "page").agg(F.avg(dark.cast("double")).alias("ink"))


def starts_with_any(text: Column, keywords: str, case_sensitive: bool = False) -> Column:
    """Whether the first 900 characters of a page hold one of the keywords (comma-separated, taken literally)."""
    head = F.substring(text, 1, 900)
    wanted = [k.strip() for k in keywords.split(",") if k.strip()]
    folded = lambda c: c if case_sensitive else F.lower(c)
    out = F.lit(False)
    for k in wanted:
        out = out | F.contains(folded(head), folded(F.lit(k)))
    return out


def strict_ranges(spec: str, count: Column) -> Column:
    """The pages of groups such as `1-3 5`, each once and in the order given; null where a part isn't a range of the
    file's pages. The text is read once, on the driver."""
    parts = [p for p in spec.replace(",", " ").split() if p]
    pages: list[int] = []
    for p in parts:
        a, _, b = p.partition("-")
        if not a.isdecimal() or b and not b.isdecimal() or int(a) < 1 or int(b or a) < int(a):
            return F.lit(None).cast("array<bigint>")
        pages += [k for k in range(int(a), int(b or a) + 1) if k not in pages]
    if not pages:
        return F.lit(None).cast("array<bigint>")
    return F.when(count >= max(pages), F.array(*map(F.lit, pages)).cast("array<bigint>"))


def out_of_range(spec: str, count: Column) -> Column:
    """The parts of a page selection that lie beyond the file's end."""
    out = []
    for part in (p.strip() for p in spec.split(",")):
        low, dash, high = (x.strip() for x in part.partition("-"))
        if part.isdecimal():
            out.append(F.when((count < int(part)) | F.lit(int(part) < 1), int(part)))
        elif dash and low.isdecimal() and high.isdecimal():
            first = min(int(low), int(high))
            out.append(F.when(count < first, first))
    return F.filter(F.array(*out).cast("array<bigint>"), lambda x: x.isNotNull()) if out else F.array().cast("array<bigint>")


def reordered(pages: DataFrame, order: list[int]) -> DataFrame:
    """Pages of each file in a given order, as pos; files for which it is no permutation are left out."""
    spark = pages.sparkSession
    sizes = pages.groupBy("file").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") == (len(order) if sorted(order) == list(range(1, len(order) + 1)) else -1))
    plan = spark.createDataFrame(list(enumerate(order, 1)), "pos long, page long")
    return pages.join(sizes.select("file"), "file", "left_semi").join(F.broadcast(plan), "page").select("file", "pos", "page")


def keywords(rows: DataFrame, lists: list[str]) -> DataFrame:
    """Rows with all keywords of their lists, each once, in the order in which they come."""
    return rows.withColumn("keywords", F.array_distinct(F.flatten(F.array(*lists))))


def outliving(fields: DataFrame, info: DataFrame) -> DataFrame:
    """Metadata fields (file, field, value) that still say what the information dictionary (file, entry) doesn't."""
    names = F.create_map(*(F.lit(x) for pair in FIELDS.items() for x in pair))
    rows = fields.withColumn("entry", F.try_element_at(names, F.col("field"))).where("entry is not null")
    return rows.join(info, ["file", "entry"], "left_anti").select("file", "field", "value")


# Fields of a metadata packet and the entries that mean the same.
FIELDS = {
    "dc:title": "title", "dc:creator": "author", "dc:description": "subject", "dc:subject": "keywords",
    "pdf:Keywords": "keywords", "xmp:CreatorTool": "creator", "pdf:Producer": "producer",
}


def merged_fields(found: DataFrame) -> DataFrame:
    """file, field, value: the values (file, field, ord, value) of each field in order, one that is part of what is there
    already left out."""
    rows = found.groupBy("file", "field").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("v"))
    add = lambda done, x: F.when(done == "", x["value"]).when(F.contains(done, x["value"]), done).otherwise(F.concat(done, F.lit(", "), x["value"]))
    return rows.select("file", "field", F.aggregate("v", F.lit(""), add).alias("value"))


def feed(entries: DataFrame) -> DataFrame:
    """One row, xml: entries (title, url, updated) newest first as an Atom feed."""
    from ..functions.text import escaped

    entry = F.concat(F.lit("<entry><title>"), escaped(F.col("title")), F.lit('</title><link href="'), escaped(F.col("url")), F.lit('"/><updated>'), F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry>"))
    rows = entries.select(F.struct((-F.unix_micros(F.col("updated").cast("timestamp"))).alias("age"), "url", entry.alias("entry")).alias("e"))
    return rows.agg(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), ""), F.lit("</feed>")).alias("xml"))


def blank_row(fields: Column) -> Column:
    return F.forall(fields, lambda x: F.trim(x) == "")


def worth_keeping(images: DataFrame, least: int = 32, masks: bool = False) -> DataFrame:
    """Images (width, height, mask) whose shorter side is long enough; masks only if asked for."""
    return images.where((F.least("width", "height") >= least) & (F.lit(masks) | ~F.col("mask")))


def sure(tables: DataFrame, floor: float = 0.7) -> DataFrame:
    """Tables (confidence) with `accepted`: whether they are sure enough to be written."""
    return tables.withColumn("accepted", F.col("confidence") >= floor)


def valid_message(id_: Column, files: Column) -> Column:
    """Whether a request can be taken: a whole number as id, and files."""
    return id_.isNotNull() & (id_ == F.floor(id_)) & files.isNotNull()


def searched(catalogue: DataFrame, query: str, category: str | None = None, most: int = 7) -> DataFrame:
    """The first entries (ord, category, search) that hold the query, within a category if one is named."""
    rows = catalogue.where(F.contains(F.lower("search"), F.lit(query.strip().lower())))
    return (rows if category is None else rows.where(F.col("category") == category)).orderBy("ord").limit(most)


def mean_confidence(words: DataFrame) -> DataFrame:
    """file, confidence: the mean over recognised words (file, confidence) that have one."""
    return words.groupBy("file").agg(F.avg(F.when(~F.isnan("confidence"), F.col("confidence"))).alias("confidence"))


def glyphs(shown: DataFrame, fonts: DataFrame) -> DataFrame:
    """font, codes: the distinct codes (page, name, code) shown with each font (page, name, font)."""
    return shown.join(fonts, ["page", "name"]).groupBy("font").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def missing_fonts(fonts: DataFrame) -> DataFrame:
    """file, fonts: the base names, without the tags of subsets, of fonts (file, name, embedded) that aren't embedded."""
    name = F.regexp_replace("name", r"^[A-Z]{6}\+", "")
    return fonts.where("not embedded").groupBy("file").agg(F.array_sort(F.collect_set(name)).alias("fonts"))


def probe(pages: DataFrame) -> DataFrame:
    """file, n_pages, max_dpi of pages (file, width, height): how finely all of them can be drawn."""
    from ..functions.media import dpi_ceiling

    return pages.groupBy("file").agg(F.count("*").alias("n_pages"), F.min(dpi_ceiling(F.col("width"), F.col("height"))).alias("max_dpi"))
