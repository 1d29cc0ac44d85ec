"""Reachability labels: "what lies below X" as a range of numbers in place of a traversal.

A spanning forest takes one edge of each node; a node's label is its place in a walk of the forest and the number of
nodes below it, so all that is below lies in one range. The other edges, which should be few, are kept as a table and
add ranges. Labels are computed once and written; queries then read ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgframe.sources.shared import Rounds, written


#: Ranges meet numbers by equal bins of 2 ** BIN numbers.
BIN = 16


def _bins(low: str, high: str) -> Column:
    return F.sequence(F.shiftright(low, BIN), F.shiftright(high, BIN))


@dataclass
class Labels:
    """nodes: node, low, high (its own number and the last below it); extra: child's range (low, high) under parent's number (at)."""

    nodes: DataFrame
    extra: DataFrame


def sums_before(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Add ``before``: of each row the sum of ``value`` over the rows of its key that come before it (order: unique in a key).

    Rows are sorted into ranges by key and order; a range adds what those before it hold of its first key, so no task
    holds a whole key.
    """
    dealt = written(df.repartitionByRange(key, order).withColumn("range", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    earlier = dealt.groupBy(key, "range").agg(F.sum(value).alias("s")).select(key, "range", F.coalesce(F.sum("s").over(whole), F.lit(0)).alias("earlier"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(key, "range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("own", own).join(earlier, [key, "range"]).withColumn("before", F.col("earlier") + F.col("own")).drop("own", "earlier", "range")


def containment_labels(edges: DataFrame, predicate: str) -> Labels:
    """Labels of all nodes of one predicate's edges (subject below object).

    Of several parents the least is the forest's. A node that only a cycle leads to is a root, and all of its edges
    are extra. There are two rounds for each level of the forest; each is a written table.
    """
    up = written(edges.filter((F.col("predicate") == predicate) & F.col("object_id").isNotNull() & F.col("subject_id").isNotNull()).select(F.col("subject_id").alias("node"), F.col("object_id").alias("parent")).distinct(), "label-edges")
    nodes = up.select("node").union(up.select("parent")).distinct()
    tree = written(up.filter("node <> parent").groupBy("node").agg(F.min("parent").alias("parent")), "label-tree")
    levels = Rounds("label-levels")
    last = levels.add(nodes.join(tree, "node", "left_anti").select("node", F.lit(None).cast(tree.schema["parent"].dataType).alias("parent"), F.lit(0).alias("level")))
    depth = 0
    while not last.isEmpty():
        depth += 1
        last = levels.add(tree.join(last.select(F.col("node").alias("parent")), "parent").select("node", "parent", F.lit(depth).alias("level")))
    placed = levels.all()
    looped = nodes.join(placed, "node", "left_anti").select("node", F.lit(None).cast(tree.schema["parent"].dataType).alias("parent"), F.lit(0).alias("level"))
    placed = written(placed.unionByName(looped), "label-forest")
    sizes = Rounds("label-sizes")
    below = None
    for level in range(depth, -1, -1):
        here = placed.filter(F.col("level") == level).select("node", "parent", "level")
        if below is not None:
            here = here.join(below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("under")), "node", "left").withColumn("size", 1 + F.coalesce("under", F.lit(0))).drop("under")
        else:
            here = here.withColumn("size", F.lit(1).cast("long"))
        below = sizes.add(here)
    sized = sizes.all().withColumn("key", F.coalesce("parent", F.lit("")))  # roots are siblings; an empty id has them as its own, too
    sized = sized.withColumn("key", F.struct(F.col("parent").isNull().alias("root"), "key"))
    offsets = written(sums_before(sized, "key", "node", "size"), "label-offsets")
    found = Rounds("labels")
    last = found.add(offsets.filter("level = 0").select("node", F.col("before").alias("low"), (F.col("before") + F.col("size") - 1).alias("high")))
    for level in range(1, depth + 1):
        here = offsets.filter(F.col("level") == level).join(last.select(F.col("node").alias("parent"), F.col("low").alias("start")), "parent")
        low = F.col("start") + 1 + F.col("before")
        last = found.add(here.select("node", low.alias("low"), (low + F.col("size") - 1).alias("high")))
    nodes = found.all()
    forest = placed.filter("parent IS NOT NULL").select("node", "parent")
    extra = up.join(forest, ["node", "parent"], "left_anti").join(nodes, "node").join(nodes.select(F.col("node").alias("parent"), F.col("low").alias("at")), "parent")
    return Labels(nodes, written(extra.select("at", "low", "high").distinct(), "label-extra"))


def below(labels: Labels, places: DataFrame) -> DataFrame:
    """place, node: what lies below the wanted places (column place); a place lies below itself only on a cycle.

    Ranges of the wanted places take in the ranges that extra edges add to them until there are none left; only extra
    edges are joined for that. Then every node in a range is below.
    """
    own = labels.nodes.join(places.select(F.col("place").alias("node")).distinct(), "node")
    # below a place itself: its range but for its own number
    first = own.select(F.col("node").alias("place"), (F.col("low") + 1).alias("low"), "high", F.col("low").alias("from"))
    ranges = Rounds("label-ranges")
    last = ranges.add(first.filter(F.col("from") <= F.col("high")))
    while not labels.extra.isEmpty() and not last.isEmpty():
        more = labels.extra.select("at", F.col("low").alias("l"), F.col("high").alias("h"))
        spread = last.withColumn("bin", F.explode(_bins("from", "high")))
        met = spread.join(more.withColumn("bin", F.shiftright("at", BIN)), "bin").filter(F.col("at").between(F.col("from"), F.col("high"))).select("place", F.col("l").alias("low"), F.col("h").alias("high"), F.col("l").alias("from")).distinct()
        last = ranges.add(met.join(ranges.all(), ["place", "low", "high", "from"], "left_anti"))
    wanted = ranges.all().filter("low <= high").select("place", F.col("low").alias("begin"), F.col("high").alias("end")).distinct()
    wanted = wanted.withColumn("bin", F.explode(_bins("begin", "end")))
    held = labels.nodes.withColumn("bin", F.shiftright("low", BIN)).join(wanted, "bin")
    return held.filter(F.col("low").between(F.col("begin"), F.col("end"))).select("place", "node").distinct()
