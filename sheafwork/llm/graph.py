"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_shuffles, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node that can be reached) for each node with a link, from links between longs.

    Large-star and small-star steps in turn until nothing changes; each round is written to the shared folder. A node
    with many links is pre-aggregated before the shuffle, and its join is one that adaptive execution can split.
    Links of a node to itself and null ends are left out. No links: no rows.
    """
    kept = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct()
    state = materialise(kept, "links")
    before = None
    while True:
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v as u", "m as v").distinct()
        down = large.selectExpr("greatest(u, v) u", "least(u, v) v").where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").selectExpr("v as u", "m as v").union(least.selectExpr("u", "m as v")).distinct()
        following = materialise(small, "links")
        now = following.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        discard(state)
        state = following
        free_shuffles(state.sparkSession)
        if tuple(now) == before:
            break
        before = tuple(now)
    # a star around each root
    out = state.selectExpr("u node", "v root").union(state.selectExpr("v", "v").distinct())
    out._shared_paths = state._shared_paths
    return out
