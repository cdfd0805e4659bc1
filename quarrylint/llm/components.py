"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylint.functions.staging import stage


def _starred(links: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours above (large) or up to (small) a node are hung on the smallest one around it."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        below = both.where("v < u")
        least = below.groupBy("u").agg(F.min("v").alias("m"))
        moved = below.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def _sum_of(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """node, component (smallest node of it) for each node that has a link; ``links`` are pairs u, v.

    Each round writes its links, so lineage stays one round long; the number of rounds grows with
    the logarithm of the longest chain.
    """
    now = stage(links.where("u <> v").distinct(), "links", folder)
    before, after = None, _sum_of(now)
    while after != before:
        now = stage(_starred(_starred(now, True), False), "links", folder)
        before, after = after, _sum_of(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
