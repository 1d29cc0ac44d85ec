"""Multi-dimensional series: constraints, containment of slots, availability, and output shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgframe.operators.observations import latest
from kgframe.sources.shared import written

#: Component -> column of the bound series.
COMPONENTS = {"variableMeasured": "variable_measured", "entity1": "entity1", "entity2": "entity2", "entity3": "entity3", "facetId": "facet_id", "TIME_PERIOD": "date"}
SLOTS = 3


def sdmx_where(constraints: dict[str, list[str]], components: dict[str, str] = COMPONENTS) -> F.Column:
    """AND over components of (column IN values). A variable is required, and LATEST can't go with dates."""
    if not constraints.get("variableMeasured"):
        raise ValueError("variableMeasured is required")
    dates = constraints.get("TIME_PERIOD", [])
    if "LATEST" in dates and len(dates) > 1:
        raise ValueError("LATEST can't be combined with dates")
    unknown = set(constraints) - set(components)
    if unknown:
        raise ValueError(f"unknown components: {sorted(unknown)}")
    terms = [F.col(components[c]).isin(v) for c, v in constraints.items() if v and v != ["LATEST"]]
    return reduce(lambda a, b: a & b, terms)


def sdmx_obs(points: DataFrame, constraints: dict[str, list[str]]) -> DataFrame:
    """Points under constraints; TIME_PERIOD LATEST gives the newest of each series."""
    found = points.filter(sdmx_where(constraints))
    return latest(found, ["variable_measured", "entity1", "entity2", "entity3", "facet_id"]) if constraints.get("TIME_PERIOD") == ["LATEST"] else found


def slot_places(closure: DataFrame, types: DataFrame, ancestor: str, type_: str, extra: DataFrame | None = None) -> DataFrame:
    """place: places of a type below an ancestor, and extra ones."""
    inside = closure.filter(F.col("ancestor") == ancestor).select(F.col("child").alias("place"))
    found = inside.join(types.filter(F.col("type") == type_).select("place"), "place", "left_semi")
    return (found.unionByName(extra) if extra is not None else found).distinct()


def sdmx_obs_contained(points: DataFrame, constraints: dict[str, list[str]], slots: dict[str, DataFrame]) -> DataFrame:
    """``sdmx_obs`` whose constrained slots each lie in their own set of places (column place)."""
    for slot, places in slots.items():
        points = points.join(places.withColumnRenamed("place", slot), slot, "left_semi")
    return sdmx_obs(points, constraints)


def observation_property_values(properties: DataFrame) -> DataFrame:
    """variable, slots: the sorted observation properties (variable, property), observationAbout where there are none; three at most."""
    per = properties.groupBy("variable").agg(F.array_sort(F.collect_set("property")).alias("slots"))
    slots = F.when(F.size("slots") == 0, F.array(F.lit("observationAbout"))).otherwise(F.col("slots"))
    return per.select("variable", slots.alias("slots")).filter(F.size("slots") <= SLOTS)


def compatible(slots: DataFrame) -> DataFrame:
    """shapes: how many different slot lists the variables have; they go into one query where it is 1."""
    return slots.agg(F.countDistinct("slots").alias("shapes"))


def sdmx_availability(points: DataFrame, component: str, constraints: dict[str, list[str]], dates: list[str] | None = None, slots: dict[str, DataFrame] | None = None) -> DataFrame:
    """value: distinct non-empty values of a component under constraints, containment, and where a date of a list exists."""
    if dates:
        points = points.filter(F.col("date").isin(dates))
    for slot, places in (slots or {}).items():
        points = points.join(places.withColumnRenamed("place", slot), slot, "left_semi")
    column = COMPONENTS[component]
    return points.filter(sdmx_where(constraints)).filter(F.coalesce(column, F.lit("")) != "").select(F.col(column).alias("value")).distinct()


def sdmx_csv_rows(series: DataFrame, points: DataFrame, keys: list[str], structure_id: str) -> DataFrame:
    """The rows of the CSV form: a series without points still has one, an empty dimension reads NotApplicable."""
    rows = series.join(points, keys, "left")
    dims = [F.coalesce(F.expr(f"nullif({k}, '')"), F.lit("NotApplicable")).alias(k) for k in keys]
    return rows.select(F.lit("dataflow").alias("STRUCTURE"), F.lit(structure_id).alias("STRUCTURE_ID"), F.lit("I").alias("ACTION"), *dims, F.col("date").alias("TIME_PERIOD"), F.col("value").alias("OBS_VALUE"))


def write_sdmx_csv(rows: DataFrame, path: str) -> None:
    """Write rows as CSV files with a header and CRLF line ends; a null value is an empty field."""
    rows.write.option("header", True).option("lineSep", "\r\n").csv(path)


def jsonstat_cube(points: DataFrame, dimensions: list[str], value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(flat_index, value) of the cells there are, row-major, and (dimension, position, category) of the sorted categories.

    The points are written once; the distinct categories of all dimensions are numbered together, over range partitions.
    """
    points = written(points.select(*dimensions, value_col), "cube-points")
    named = points.select(F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(d).cast("string").alias("category")) for i, d in enumerate(dimensions)])).alias("c")).select("c.*").distinct()
    dealt = written(named.repartitionByRange("at", "category").withColumn("part", F.spark_partition_id()), "categories")
    counts = dealt.groupBy("part", "at").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("part", "at").orderBy("category")) - 1)
    places = written(own.join(before, ["part", "at"]).select("at", "category", (F.col("before") + F.col("own")).cast("int").alias("position")), "cube-categories")
    numbered = [places.select(F.element_at(F.array(*map(F.lit, dimensions)), F.col("at") + 1).alias("dimension"), "position", "category")]
    sizes = [places.filter(F.col("at") == i).select(F.col("category"), "position") for i in range(len(dimensions))]
    rows = points
    for d, c in zip(dimensions, sizes):
        n = c.agg(F.count("*").alias(f"n_{d}"))
        rows = rows.join(c.select(F.col("category").alias(f"c_{d}"), F.col("position").alias(f"at_{d}")), F.col(d).cast("string") == F.col(f"c_{d}")).drop(f"c_{d}").crossJoin(F.broadcast(n))  # one row
    index = reduce(lambda acc, d: acc * F.col(f"n_{d}") + F.col(f"at_{d}"), dimensions, F.lit(0).cast("long"))
    return rows.select(index.alias("flat_index"), value_col), reduce(DataFrame.unionByName, numbered)
