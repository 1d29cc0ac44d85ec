"""Fetching observations by variable, entity, place and date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgframe.functions.scalars import date_bounds
from kgframe.operators.graph import entities_of_type, reached

FACET = ["import_name", "provenance_url", "measurement_method", "observation_period", "scaling_factor", "unit"]
SERIES = ["variable", "entity", *FACET]


def obs_for(obs: DataFrame, variables: DataFrame, entities: DataFrame, date: str | None = None) -> DataFrame:
    """Observations of the wanted variables (column variable) and entities (column entity) with a value, of one date if given."""
    found = obs.join(variables, "variable", "left_semi").join(entities, "entity", "left_semi").filter(F.col("value").isNotNull())
    return found.filter(F.col("date") == date) if date else found


def obs_by_entity_type(obs: DataFrame, triples: DataFrame, variables: DataFrame, type_: str, date: str | None = None) -> DataFrame:
    """``obs_for`` over all entities of a type."""
    return obs_for(obs, variables, entities_of_type(triples, type_).withColumnRenamed("subject_id", "entity"), date)


def obs_by_slots(flows: DataFrame, entities: DataFrame, variables: DataFrame | None = None, mode: str = "all", date: str | None = None) -> DataFrame:
    """Points of multi-entity series whose first entity is wanted (column entity1). mode: all, latest (of each series) or exact."""
    found = flows.join(entities, "entity1", "left_semi")
    if variables is not None:
        found = found.join(variables, "variable_measured", "left_semi")
    if mode == "exact":
        return found.filter(F.col("date") == date)
    return latest(found, ["variable_measured", "entity1", "entity2", "entity3", "facet_id"]) if mode == "latest" else found


def latest(points: DataFrame, keys: list[str]) -> DataFrame:
    """The newest point of each series, with one aggregation in place of a sort."""
    return points.groupBy(*keys).agg(F.max_by("value", "date").alias("value"), F.max("date").alias("date"))


def latest_per_series(obs: DataFrame) -> DataFrame:
    """The latest point of each series."""
    return latest(obs, SERIES)


def places_below(edges: DataFrame, ancestor: str) -> DataFrame:
    """entity: the places anywhere below one, found by walking down from it."""
    start = edges.sparkSession.createDataFrame([(ancestor,)], "node string")
    return reached(edges, start, "containedInPlace", outward=False).select(F.col("object").alias("entity"))


def obs_contained_in(obs: DataFrame, edges: DataFrame, triples: DataFrame, variables: DataFrame, ancestor: str, child_type: str, mode: str = "all", date: str | None = None) -> DataFrame:
    """Observations of the places of a type that lie anywhere below an ancestor. mode: all, latest or exact."""
    inside = places_below(edges, ancestor)
    typed = entities_of_type(triples, child_type).withColumnRenamed("subject_id", "entity").join(inside, "entity", "left_semi")
    found = obs_for(obs, variables, typed, date if mode == "exact" else None)
    return latest_per_series(found) if mode == "latest" else found


def filter_series_by_props(obs: DataFrame, **props: str | None) -> DataFrame:
    """Series whose columns have the given values; an empty value matches all."""
    for column, value in props.items():
        if value:
            obs = obs.filter(F.col(column) == value)
    return obs


def filter_by_date_interval(obs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Observations whose first day lies between the first day of ``start`` and the last of ``end``, each of any granularity."""
    first = date_bounds(F.col("date"))["start"]
    if start:
        obs = obs.filter(first >= date_bounds(F.lit(start))["start"])
    return obs.filter(first <= date_bounds(F.lit(end))["end"]) if end else obs


def entity_variable_pairs_count(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """variable, entity, n: the dates of each wanted pair (columns variable, entity), 0 where there are none."""
    counts = obs.groupBy("variable", "entity").agg(F.count("date").alias("n"))
    return pairs.join(counts, ["variable", "entity"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def trim_empty_entities(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """The wanted pairs (columns variable, entity) that have any observation, each once."""
    return pairs.select("variable", "entity").distinct().join(obs, ["variable", "entity"], "left_semi")


def valid_dcids(df: DataFrame, column: str) -> DataFrame:
    """Rows whose id is neither empty nor has a space or comma."""
    return df.filter((F.col(column) != "") & ~F.col(column).rlike("[ ,]"))


def nth_page(df: DataFrame, order: list[str], size: int, offset: int) -> DataFrame:
    """A page in the given order, with has_more: whether a row follows it. Reads size + 1 rows."""
    page = df.orderBy(*order).offset(offset).limit(size + 1)
    rows = page.withColumn("__n", F.row_number().over(Window.orderBy(*order)))  # size + 1 rows at most
    return rows.withColumn("has_more", F.max("__n").over(Window.partitionBy()) > size).filter(F.col("__n") <= size).drop("__n")
