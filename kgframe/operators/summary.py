"""Summaries of what the observations cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgframe.operators.joins import join_on
from kgframe.operators.observations import FACET

SERIES_KEYS = ["variable", "provenance", "measurement_method", "observation_period", "scaling_factor", "unit"]


def _typed(obs: DataFrame, triples: DataFrame) -> DataFrame:
    types = triples.filter("predicate = 'typeOf'").select(F.col("subject_id").alias("entity"), F.col("object_id").alias("entity_type")).distinct()
    return obs.join(types, "entity")


def _sample(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n least entities of each group, joined by commas."""
    distinct = rows.select(*keys, "entity").distinct()
    first = distinct.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("entity"))).filter(F.col("r") <= n)
    return first.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("entity")), ",").alias("sample"))


def statvar_place_type_summary(obs: DataFrame, triples: DataFrame, n: int = 3) -> DataFrame:
    """variable, entity_type: entities, least, greatest value, and up to n sample entities."""
    rows = _typed(obs.filter("value IS NOT NULL"), triples)
    keys = ["variable", "entity_type"]
    sums = rows.groupBy(*keys).agg(F.countDistinct("entity").alias("entities"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return join_on(sums, _sample(rows, keys, n), keys)


def statvar_provenance_summary(obs: DataFrame, triples: DataFrame, n: int = 3) -> DataFrame:
    """Of each series key and entity type: dates, values, counts, sample entities and the provenance's name."""
    rows = _typed(obs.filter("value IS NOT NULL"), triples)
    keys = [*SERIES_KEYS, "entity_type"]
    sums = rows.groupBy(*keys).agg(
        F.min("date").alias("earliest"), F.max("date").alias("latest"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("obs_count"), F.countDistinct("entity").alias("entities")
    )
    names = triples.filter("predicate = 'name'").groupBy(F.col("subject_id").alias("provenance")).agg(F.max("object_value").alias("provenance_name"))
    return join_on(sums, _sample(rows, keys, n), keys).join(names, "provenance", "left")


def series_rollup(summary: DataFrame, level: str = "series") -> DataFrame:
    """The provenance summary rolled up over entity types (series), and over series too (provenance)."""
    keys = SERIES_KEYS if level == "series" else ["variable", "provenance"]
    return summary.groupBy(*keys).agg(
        F.min("earliest").alias("earliest"), F.max("latest").alias("latest"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("obs_count").alias("obs_count"),
        F.sum("entities").alias("entities"), F.array_join(F.sort_array(F.collect_set("entity_type")), ",").alias("entity_types"),
    )


def entity_count_by_date(obs: DataFrame) -> DataFrame:
    """Distinct entities for each (variable, date, provenance)."""
    return obs.groupBy("variable", "date", "provenance").agg(F.countDistinct("entity").alias("entities"))


def observation_dates(obs: DataFrame) -> DataFrame:
    """variable, date, facet columns, entities, position: facets of each date by how many entities they cover."""
    per = obs.groupBy("variable", "date", *FACET).agg(F.countDistinct("entity").alias("entities"))
    order = Window.partitionBy("variable", "date").orderBy(F.desc("entities"), *FACET)
    return per.withColumn("position", F.row_number().over(order))


def variable_facet_metadata(obs: DataFrame, triples: DataFrame) -> DataFrame:
    """variable, facet columns: observations, dates, entities covered and place types seen."""
    facts = obs.groupBy("variable", *FACET).agg(F.count("*").alias("obs_count"), F.min("date").alias("earliest"), F.max("date").alias("latest"), F.countDistinct("entity").alias("entities"))
    types = _typed(obs.select("variable", "entity", *FACET).distinct(), triples).groupBy("variable", *FACET).agg(F.array_join(F.sort_array(F.collect_set("entity_type")), ",").alias("place_types"))
    return join_on(facts, types, ["variable", *FACET], "left")


def facet_usage_log(obs: DataFrame) -> DataFrame:
    """variable, facet columns: number of series, first and last year."""
    year = F.substring("date", 1, 4)
    return obs.groupBy("variable", *FACET).agg(F.countDistinct("entity").alias("series"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def ingestion_low_water_mark(history: DataFrame) -> DataFrame:
    """The first creation among runs after the last success (columns created, status); among all if none succeeded."""
    last = history.filter("status = 'SUCCESS'").agg(F.max("created").alias("last_success"))
    return history.crossJoin(F.broadcast(last)).filter("last_success IS NULL OR created > last_success").agg(F.min("created").alias("low_water_mark"))  # one row
