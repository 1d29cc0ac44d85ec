"""Schemas of the statistical graph's tables, and readers that check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


TRIPLES = T.StructType(_strings("subject_id", "predicate", "object_id", "object_value"))
OBSERVATIONS = T.StructType(
    [*_strings("entity", "variable", "date"), T.StructField("value", T.DoubleType()), *_strings("provenance", "unit", "scaling_factor", "measurement_method", "observation_period", "properties")]
)
NODES = T.StructType([*_strings("subject_id", "value", "name"), T.StructField("types", T.ArrayType(T.StringType()))])
EDGES = T.StructType(_strings("subject_id", "predicate", "object_id", "provenance"))
SERIES = T.StructType(_strings("variable_measured", "entity1", "extra_entities_id", "facet_id", "entities", "facet"))
POINTS = T.StructType(_strings("variable_measured", "entity1", "extra_entities_id", "facet_id", "date", "value"))
IMPORTS = T.StructType([T.StructField("imported_at", T.TimestampType()), *_strings("status", "metadata")])
EXPECTED = {"triples": TRIPLES, "observations": OBSERVATIONS, "nodes": NODES, "edges": EDGES, "series": SERIES, "points": POINTS, "imports": IMPORTS}


def load(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read a table with a given schema, from CSV with a header line or any format that carries its own names."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def load_observations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Observations with their types; empty fields of CSV files are null, and facets with nulls are equal where their other columns are."""
    return load(spark, path, OBSERVATIONS, fmt)


def load_triples(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Triples: object_id for a node, object_value for a literal; the other one is null."""
    return load(spark, path, TRIPLES, fmt)


def validate_tables(spark: SparkSession, tables: dict[str, DataFrame], expected: dict[str, T.StructType] = EXPECTED) -> DataFrame:
    """table, problem ("missing table" or "missing column"), column: what the given tables lack."""
    rows = [(name, "missing table", None) for name in expected if name not in tables]
    rows += [(name, "missing column", c) for name, s in expected.items() if name in tables for c in s.fieldNames() if c not in tables[name].columns]
    return spark.createDataFrame(rows, "`table` string, problem string, `column` string")


def series_to_long(series: DataFrame, points_col: str = "points") -> DataFrame:
    """One row for each entry of a date -> value map, with the other columns."""
    rest = [c for c in series.columns if c != points_col]
    return series.select(*rest, F.explode(points_col).alias("date", "value"))


def long_to_series(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points gathered as one array of (date, value) for each series, sorted by date."""
    return points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", "value"))).alias("points"))


def entity_slots(series: DataFrame) -> DataFrame:
    """Series with columns read from their JSON ``entities`` and ``facet``."""
    entity = lambda i: F.get_json_object("entities", f"$.entity{i}")
    facet = lambda name: F.get_json_object("facet", f"$.{name}")
    return series.withColumns({"entity2": entity(2), "entity3": entity(3), "observation_period": facet("observationPeriod"), "unit": facet("unit"), "measurement_method": facet("measurementMethod"), "provenance": facet("provenance")})


def decode_attributes(json: F.Column | str) -> F.Column:
    """A JSON object's scalar members as a map of strings; nested members are left out, what is no object gives null."""
    found = F.from_json(json, "map<string,string>")
    return F.map_filter(found, lambda k, v: v.isNotNull() & ~v.rlike(r"^[\[{]"))


def recent_imports(imports: DataFrame, limit: int = 100) -> DataFrame:
    """The latest imports, newest first."""
    return imports.orderBy(F.desc("imported_at"), "status", "metadata").limit(limit)
