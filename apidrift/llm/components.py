"""Connected components of a link table, by alternating stars.

In a large star each node hands its larger neighbours to the smallest node of its neighbourhood, in a small star
its smaller ones. Both keep components and shorten paths; when nothing changes every node points at the
smallest of its component. Only aggregates and joins are used, so a hub with a large share of all links is
summed up in the map tasks and its join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.llm.tables import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v) of each node's neighbourhood, replaced by links to its smallest member."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")).select(F.col("u").alias("at"), "least")
    side = F.col("v") > F.col("u") if large else F.col("v") <= F.col("u")
    moved = both.join(least, F.col("u") == F.col("at"))
    out = moved.where(side).select(F.col("v").alias("u"), F.col("least").alias("v"))
    if not large:
        out = out.union(least.select("at", "least"))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all linked nodes; ``links`` has two columns u, v. Self-links and repeated links do no harm."""
    now = written(links.select("u", "v").where("u <> v").distinct(), "links")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        now = written(_star(_star(now, True), False), "links")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
