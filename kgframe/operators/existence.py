"""Which variables, groups and sources have data for which places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgframe.operators.graph import tagged
from kgframe.operators.hierarchy import _as_edges, variables_below


def entity_variables(obs: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Distinct (entity, variable), of the wanted entities if given."""
    rows = obs.select("entity", "variable")
    return (rows.join(entities, "entity", "left_semi") if entities is not None else rows).distinct()


def variables_by_slot(flows: DataFrame, variables: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """variable, entity, slot: distinct within each slot; a third entity counts only with a second."""
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"entity{i}").alias("entity")) for i in (1, 2)], F.struct(F.lit(3).alias("slot"), F.when(F.col("entity2").isNotNull(), F.col("entity3")).alias("entity")))
    rows = flows.select(F.col("variable_measured").alias("variable"), F.explode(slots).alias("s")).select("variable", "s.entity", "s.slot").filter("entity IS NOT NULL")
    rows = rows.join(variables, "variable", "left_semi") if variables is not None else rows
    return (rows.join(entities, "entity", "left_semi") if entities is not None else rows).distinct()


def variable_source_existence(obs: DataFrame, edges: DataFrame, variables: DataFrame, sources: DataFrame) -> DataFrame:
    """variable, source: wanted variables with data of a wanted source (column source), by the provenances' edges."""
    of = edges.filter(F.col("predicate").isin("source", "isPartOf")).select(F.col("subject_id").alias("provenance"), F.col("object_id").alias("source")).distinct()
    pairs = obs.select("variable", "provenance").distinct().join(of, "provenance").select("variable", "source")
    return pairs.join(variables, "variable", "left_semi").join(sources, "source", "left_semi").select("variable", "source").distinct()


def group_source_existence(obs: DataFrame, edges: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """group_id, source: groups with a variable below that has data of a wanted source."""
    variables = obs.select("variable").distinct()
    seeds = variable_source_existence(obs, edges, variables, sources).select(F.col("source").alias("tag"), F.col("variable").alias("node"))
    return tagged(_as_edges(links), seeds, "up").select(F.col("node").alias("group_id"), F.col("tag").alias("source"))


def group_place_existence(seen: DataFrame, links: DataFrame, places: DataFrame) -> DataFrame:
    """group_id, entity: groups with a variable below that is seen (variable, entity) for a wanted place (column entity)."""
    seeds = seen.join(places, "entity", "left_semi").select(F.col("entity").alias("tag"), F.col("variable").alias("node")).distinct()
    return tagged(_as_edges(links), seeds, "up").select(F.col("node").alias("group_id"), F.col("tag").alias("entity"))


def existence(variable_places: DataFrame, group_places: DataFrame, variable_sources: DataFrame, group_sources: DataFrame) -> DataFrame:
    """item, target of all four kinds of check, each given as two columns in that order."""
    return reduce(DataFrame.unionByName, [df.toDF("item", "target") for df in (variable_places, group_places, variable_sources, group_sources)])


def existence_by_kind(items: DataFrame, targets: DataFrame, obs: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """item, target: which wanted items (column item: variables, groups, topics) have data for which targets (places, sources).

    What an item or a target is follows from where it occurs: each of the four checks takes those it knows.
    """
    entities, sources = targets.select(F.col("target").alias("entity")), targets.select(F.col("target").alias("source"))
    seen = entity_variables(obs, entities)
    variables = items.select(F.col("item").alias("variable"))
    checks = existence(seen.select("variable", "entity"), group_place_existence(seen, links, entities), variable_source_existence(obs, edges, variables, sources), group_source_existence(obs, edges, links, sources))
    return checks.join(items, "item", "left_semi").select("item", "target")


def count_sv_svg(seen: DataFrame, links: DataFrame, items: DataFrame, entities: DataFrame) -> DataFrame:
    """item, entity, n: 0 for a variable with data, the number of descendant variables with data for a group."""
    wanted = seen.select("variable", "entity").distinct().join(entities, "entity", "left_semi")
    own = wanted.select(F.col("variable").alias("item"), "entity", F.lit(0).cast("long").alias("n"))
    below = variables_below(links, items.select(F.col("item").alias("group_id"))).join(wanted, "variable").groupBy(F.col("group_id").alias("item"), "entity").agg(F.count("*").alias("n"))
    return own.unionByName(below).join(items, "item", "left_semi")


def count_with_formulas(seen: DataFrame, pairs: DataFrame, formulas: DataFrame) -> DataFrame:
    """variable, entity, how: wanted pairs with data (data), or all of whose inputs of one formula have (formula).

    formulas: output, formula_id, input.
    """
    seen = seen.select("variable", "entity").distinct()
    direct = pairs.join(seen, ["variable", "entity"], "left_semi").withColumn("how", F.lit("data"))
    missing = pairs.join(seen, ["variable", "entity"], "left_anti")
    needs = formulas.groupBy("formula_id").agg(F.countDistinct("input").alias("needs"))
    inputs = formulas.join(needs, "formula_id").select(F.col("output").alias("variable"), "formula_id", "input", "needs").distinct()
    there = missing.join(inputs, "variable").join(seen.withColumnRenamed("variable", "input"), ["input", "entity"])
    made = there.groupBy("variable", "entity", "formula_id", "needs").agg(F.countDistinct("input").alias("n")).filter("n = needs").select("variable", "entity").distinct()
    return direct.unionByName(made.withColumn("how", F.lit("formula")))


def filter_variables_by_entity(seen: DataFrame, variables: DataFrame, entities: DataFrame | None) -> DataFrame:
    """Wanted variables with data for one of the entities at least; without entities all of them."""
    if entities is None:
        return variables
    return variables.join(seen.join(entities, "entity", "left_semi"), "variable", "left_semi")


def existing_groups(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids (column id) that are groups."""
    groups = triples.filter("predicate = 'typeOf' AND object_id = 'StatVarGroup'").select(F.col("subject_id").alias("id"))
    return ids.join(groups, "id", "left_semi")


def place_availability(seen: DataFrame, pairs: DataFrame) -> DataFrame:
    """variable, entity, available of every wanted pair."""
    there = seen.select("variable", "entity").distinct().withColumn("available", F.lit(True))
    return pairs.join(there, ["variable", "entity"], "left").withColumn("available", F.coalesce("available", F.lit(False)))
