"""Outlines: trees of titles that point at pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Levels of a tree that are followed; a cycle ends there.
LEVELS = 32


def depths(nodes: DataFrame) -> DataFrame:
    """node, depth of each node (node, parent) that hangs from a root, by a recursive query; nodes in a cycle hang from
    none."""
    spark = nodes.sparkSession
    return spark.sql(
        f"""with recursive tree(node, depth) as (
            select node, 0 from {{nodes}} where parent is null
            union all select n.node, t.depth + 1 from {{nodes}} n join tree t on n.parent = t.node where t.depth < {LEVELS})
        select node, cast(depth as bigint) depth from tree""",
        nodes=nodes,
    )


def closure(links: DataFrame, start: DataFrame) -> DataFrame:
    """node: what can be reached from the start by links (node, part), the start included: a recursive union over a
    bounded number of steps."""
    return links.sparkSession.sql(
        f"""with recursive found(node, step) as (
            select node, 0 from {{start}}
            union all select l.part, f.step + 1 from {{links}} l join found f on l.node = f.node where f.step < {LEVELS})
        select distinct node from found""",
        links=links, start=start,
    )


def remapped(nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """node, page of the nodes (node, parent, file, page, ord) that survive a plan (pos, file, page), with the position
    of their page in the result, its first one. A node whose page is gone stays if one below it does, and points where
    the first of those below it points."""
    first = plan.groupBy("file", "page").agg(F.min("pos").alias("own"))
    rows = nodes.join(first, ["file", "page"], "left").select("node", "parent", "ord", "own")
    return rows.sparkSession.sql(
        f"""with recursive up(node, at, trail, found) as (
            select node, node, cast('' as string), own from {{rows}} where own is not null
            union all select u.node, c.parent, concat(lpad(cast(c.ord as string), 8, '0'), '/', u.trail), u.found
            from up u join {{rows}} c on c.node = u.at join {{rows}} p on p.node = c.parent where p.own is null and length(u.trail) < {9 * LEVELS})
        select at node, min_by(found, trail) page from up group by at""",
        rows=rows,
    )


def split_at_bookmarks(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Pages (file, page) with part (from 1) and name, cut where bookmarks (file, page, ord, title) point. Of several on
    a page the first counts; what stands before the first is front matter."""
    w = Window.partitionBy("file", "page").orderBy("ord")
    chosen = marks.withColumn("k", F.row_number().over(w)).where("k = 1").select("file", "page", "title")
    rows = pages.select("file", "page").join(chosen, ["file", "page"], "left")
    run = Window.partitionBy("file").orderBy("page")
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    begins = (F.col("title").isNotNull() | (F.row_number().over(run) == 1)).cast("int")
    rows = rows.withColumn("begins", begins).withColumn("part", F.sum("begins").over(so_far).cast("long"))
    title = F.coalesce(F.last("title", ignorenulls=True).over(so_far), F.lit("Front matter"))
    width = F.length(F.max("part").over(Window.partitionBy("file")).cast("string"))
    safe = T.slug(title)
    return rows.select("file", "page", "part", F.concat_ws("-", F.lpad(F.col("part").cast("string"), width, "0"), F.when(safe == "", "untitled-section").otherwise(safe)).alias("name"))
