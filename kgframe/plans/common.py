"""Bound tables as the queries take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgframe.operators import facets, graph
from kgframe.sources import bind


class Bound:
    """The bound tables of one test folder, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, sparse: bool = False):
        self.spark, self.sf_dir, self.sparse = spark, sf_dir, sparse

    def raw(self, name: str) -> DataFrame:
        return bind.read(self.spark, self.sf_dir, name)

    @property
    def triples(self) -> DataFrame:
        return bind.triples(self.spark, self.sf_dir)

    @property
    def edges(self) -> DataFrame:
        return bind.edges(self.spark, self.sf_dir)

    @property
    def nodes(self) -> DataFrame:
        return bind.nodes(self.spark, self.sf_dir)

    @property
    def obs(self) -> DataFrame:
        obs = bind.observations(self.spark, self.sf_dir)
        return bind.with_nulls(obs) if self.sparse else obs

    @property
    def rules(self) -> DataFrame:
        return bind.rules(self.spark)

    @property
    def flows(self) -> DataFrame:
        return bind.flows(self.spark, self.sf_dir)

    @property
    def events(self) -> DataFrame:
        return bind.event_edges(self.spark, self.sf_dir)

    @property
    def ranked(self) -> DataFrame:
        return facets.facet_stats(self.obs, self.rules)

    def below(self, place: str) -> DataFrame:
        """child, ancestor, depth: what lies in one place, found by walking down from it."""
        start = self.spark.createDataFrame([(place,)], "node string")
        return graph.reached(self.edges, start, "containedInPlace", False).select(F.col("object").alias("child"), F.col("node").alias("ancestor"), "depth")

    def above(self, places: DataFrame) -> DataFrame:
        """child, ancestor, depth: what holds the wanted places (column place), found by walking up from them."""
        return graph.reached(self.edges, places.select(F.col("place").alias("node")), "containedInPlace").select(F.col("node").alias("child"), F.col("object").alias("ancestor"), "depth")

    def regions(self) -> DataFrame:
        return self.raw("region").select(F.concat(F.lit("region/"), F.col("r_regionkey")).alias("node"))

    def places(self) -> DataFrame:
        return self.raw("nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey")).alias("entity"))

    def variables(self) -> DataFrame:
        return self.raw("part").filter("p_size <= 10").select(F.concat(F.lit("Qty_"), F.col("p_brand")).alias("variable")).distinct()

    def pairs(self) -> DataFrame:
        """Wanted (variable, entity): every brand with the nations whose key and brand end in the same parity."""
        v = self.raw("part").select("p_brand").distinct().select(F.concat(F.lit("Qty_"), F.col("p_brand")).alias("variable"), (F.substring("p_brand", -1, 1).cast("int") % 2).alias("k"))
        e = self.raw("nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey")).alias("entity"), (F.col("n_nationkey") % 2).alias("k"))
        return v.join(e, "k").select("variable", "entity")


PAIRS = """pairs AS (
  SELECT 'Qty_' || b AS variable, 'nation/' || n_nationkey AS entity FROM (SELECT DISTINCT p_brand AS b FROM part) p JOIN nation ON right(b, 1)::INT % 2 = n_nationkey % 2
)"""
VARIABLES = "variables AS (SELECT DISTINCT 'Qty_' || p_brand AS variable FROM part WHERE p_size <= 10)"
