"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgframe.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id``, ``root`` of every node that has a link (columns u, v; u <> v): the root is the least node it can reach.

    Each round's links are a written table; there are about as many rounds as the logarithm of the longest path. The
    loop ends when a round changes nothing, which a count and an order-free checksum of the links tell.
    """
    links = links.select("u", "v").filter("u <> v")
    before = None
    while True:
        links = written(_small_star(_large_star(links)), "component-links")
        state = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return links.select(F.col("u").alias("id"), F.col("v").alias("root")).union(links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = state
