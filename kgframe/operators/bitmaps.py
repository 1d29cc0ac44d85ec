"""Distinct counts below the groups of a hierarchy as bitmaps that go up its links, without a row for each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgframe.operators.graph import numbered_by
from kgframe.sources.shared import written


def group_bitmaps(links: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """group_id, bucket, bits: the variables below each group (links: child, parent, kind), as bits of their dense numbers.

    ``variables`` (column variable), if given, are the only ones that count. Bitmaps of 32,768 numbers go up the links
    between groups; each round sends on only those that the last one changed, so a variable that is reached twice
    counts once, and cycles end. A group with many children gets partial bitmaps from each task.
    """
    own = links.filter("kind = 'variable'").select(F.col("child").alias("variable"), F.col("parent").alias("group_id"))
    if variables is not None:
        own = own.join(variables.select("variable").distinct(), "variable", "left_semi")
    numbers = own.select("variable").distinct().transform(numbered_by, "variable", "number")
    own = own.join(numbers, "variable").groupBy("group_id", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    up = written(links.filter("kind = 'group'").select(F.col("child").alias("group_id"), "parent").distinct(), "group-links")
    found = written(own.withColumn("changed", F.lit(True)), "bitmaps")
    while True:
        lifted = found.filter("changed").join(up, "group_id").select(F.col("parent").alias("group_id"), "bucket", "bits", F.lit(None).cast("long").alias("had"))
        both = found.select("group_id", "bucket", "bits", F.bitmap_count("bits").alias("had")).unionByName(lifted)
        joined = both.groupBy("group_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.coalesce(F.max("had"), F.lit(0)).alias("had"))
        found = written(joined.select("group_id", "bucket", "bits", (F.bitmap_count("bits") > F.col("had")).alias("changed")), "bitmaps")
        if found.filter("changed").isEmpty():
            return found.drop("changed")


def counts_below(links: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """group_id, n: how many distinct variables, or wanted ones, lie below each group; groups without any are left out."""
    return group_bitmaps(links, variables).groupBy("group_id").agg(F.sum(F.bitmap_count("bits")).alias("n"))
