"""Connected components of a list of links, by alternating large and small stars.

Links never leave the cluster: a round is two aggregations and two joins, its result is written to the shared folder, and
rounds go on until the stars no longer change, about log2 of the longest path. The minima are written before they are
joined back, so that both sides of the join are plain shuffles and the optimiser can split a hub with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.session import staged


def _stars(links: DataFrame) -> DataFrame:
    """links (u, v) with v < u. Large star: neighbours above a node go to the least of its neighbourhood; small star: those below."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "large")
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("v < u").distinct()
    large = staged(large, "stars")
    least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "small")
    low = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for each node that has a link; root is the least node of its component. links: a, b, of any one type that has an order."""
    now = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = staged(now, "links"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or seen[0] == 0:
            break
        now, before = staged(_stars(now), "links"), seen
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
