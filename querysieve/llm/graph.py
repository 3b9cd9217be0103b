"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querysieve.session import materialise


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` (smallest node reachable) for every node that has a link to another.

    Each round hangs a node's neighbours below its smallest one, first for larger neighbours, then for
    smaller ones; links between far ends halve, and only minima and pairs are shuffled. A written table
    ends each round. Null ends and links of a node to itself are ignored; no links give no rows.
    """
    a, b = F.col(src), F.col(dst)
    pairs = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs, before = materialise(pairs, "links"), None
    while True:
        seen = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                pairs.select("v", "v").distinct()
            )
        before = seen
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialise(small.union(least).distinct(), "links")
