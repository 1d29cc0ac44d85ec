"""The graph's tables as views of the TPC-H-like test tables: places, variables, facets, trade flows, events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _facts(df: DataFrame, subject: F.Column, facts: list[tuple[str, F.Column | None, F.Column | None]]) -> DataFrame:
    """Triples of every row: the facts are exploded from one scan."""
    null = F.lit(None).cast("string")
    rows = F.array(*[F.struct(F.lit(p).alias("predicate"), (o if o is not None else null).alias("object_id"), (v if v is not None else null).alias("object_value")) for p, o, v in facts])
    return df.select(subject.alias("subject_id"), F.explode(rows).alias("f")).select("subject_id", "f.*")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    one = spark.range(1)
    part = t("part").select("p_brand", "p_type", "p_size")
    parts = [
        _facts(one, F.lit("Earth"), [("typeOf", F.lit("Place"), None), ("name", None, F.lit("Earth"))]),
        _facts(t("region"), _key("region/", "r_regionkey"), [("typeOf", F.lit("Continent"), None), ("name", None, F.col("r_name")), ("containedInPlace", F.lit("Earth"), None)]),
        _facts(t("nation"), _key("nation/", "n_nationkey"), [("typeOf", F.lit("Country"), None), ("name", None, F.col("n_name")), ("containedInPlace", _key("region/", "n_regionkey"), None)]),
        _facts(t("customer"), _key("customer/", "c_custkey"), [("typeOf", F.lit("Customer"), None), ("name", None, F.col("c_name")), ("containedInPlace", _key("nation/", "c_nationkey"), None)]),
        _facts(t("supplier"), _key("supplier/", "s_suppkey"), [("typeOf", F.lit("Supplier"), None), ("name", None, F.col("s_name")), ("containedInPlace", _key("nation/", "s_nationkey"), None)]),
        _facts(part.select("p_brand").distinct(), _key("Qty_", "p_brand"), [("typeOf", F.lit("StatisticalVariable"), None), ("name", None, F.concat(F.lit("Quantity of "), F.col("p_brand")))]),
        part.filter("p_size <= 2").select(_key("Qty_", "p_brand").alias("subject_id"), F.lit("memberOf").alias("predicate"), _key("g/", "p_type").alias("object_id"), F.lit(None).cast("string").alias("object_value")).distinct(),
        _facts(part.select("p_type").distinct(), _key("g/", "p_type"), [("typeOf", F.lit("StatVarGroup"), None), ("name", None, F.col("p_type")), ("specializationOf", F.lit("g/Root"), None)]),
        _facts(one, F.lit("g/Root"), [("typeOf", F.lit("StatVarGroup"), None), ("name", None, F.lit("Root"))]),
        _facts(
            one.select(F.explode(F.array(F.lit("O"), F.lit("F"))).alias("s")), _key("prov/", "s"),
            [("typeOf", F.lit("Provenance"), None), ("name", None, _key("Import", "s")), ("url", None, F.concat(F.lit("https://www.source"), F.lower("s"), F.lit(".example.org/data"))), ("source", _key("source/", "s"), None)],
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


TRIPLES_SQL = """
triples AS (
  SELECT 'Earth' AS subject_id, 'typeOf' AS predicate, 'Place' AS object_id, NULL::VARCHAR AS object_value
  UNION ALL SELECT 'Earth', 'name', NULL, 'Earth'
  UNION ALL SELECT 'region/' || r_regionkey, 'typeOf', 'Continent', NULL FROM region
  UNION ALL SELECT 'region/' || r_regionkey, 'name', NULL, r_name FROM region
  UNION ALL SELECT 'region/' || r_regionkey, 'containedInPlace', 'Earth', NULL FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, 'typeOf', 'Country', NULL FROM nation
  UNION ALL SELECT 'nation/' || n_nationkey, 'name', NULL, n_name FROM nation
  UNION ALL SELECT 'nation/' || n_nationkey, 'containedInPlace', 'region/' || n_regionkey, NULL FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'typeOf', 'Customer', NULL FROM customer
  UNION ALL SELECT 'customer/' || c_custkey, 'name', NULL, c_name FROM customer
  UNION ALL SELECT 'customer/' || c_custkey, 'containedInPlace', 'nation/' || c_nationkey, NULL FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'typeOf', 'Supplier', NULL FROM supplier
  UNION ALL SELECT 'supplier/' || s_suppkey, 'name', NULL, s_name FROM supplier
  UNION ALL SELECT 'supplier/' || s_suppkey, 'containedInPlace', 'nation/' || s_nationkey, NULL FROM supplier
  UNION ALL SELECT DISTINCT 'Qty_' || p_brand, 'typeOf', 'StatisticalVariable', NULL FROM part
  UNION ALL SELECT DISTINCT 'Qty_' || p_brand, 'name', NULL, 'Quantity of ' || p_brand FROM part
  UNION ALL SELECT DISTINCT 'Qty_' || p_brand, 'memberOf', 'g/' || p_type, NULL FROM part WHERE p_size <= 2
  UNION ALL SELECT DISTINCT 'g/' || p_type, 'typeOf', 'StatVarGroup', NULL FROM part
  UNION ALL SELECT DISTINCT 'g/' || p_type, 'name', NULL, p_type FROM part
  UNION ALL SELECT DISTINCT 'g/' || p_type, 'specializationOf', 'g/Root', NULL FROM part
  UNION ALL SELECT 'g/Root', 'typeOf', 'StatVarGroup', NULL
  UNION ALL SELECT 'g/Root', 'name', NULL, 'Root'
  UNION ALL SELECT 'prov/' || s, 'typeOf', 'Provenance', NULL FROM (VALUES ('O'), ('F')) v(s)
  UNION ALL SELECT 'prov/' || s, 'name', NULL, 'Import' || s FROM (VALUES ('O'), ('F')) v(s)
  UNION ALL SELECT 'prov/' || s, 'url', NULL, 'https://www.source' || lower(s) || '.example.org/data' FROM (VALUES ('O'), ('F')) v(s)
  UNION ALL SELECT 'prov/' || s, 'source', 'source/' || s, NULL FROM (VALUES ('O'), ('F')) v(s)
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples as edges: a literal is the object itself."""
    return triples(spark, sf_dir).select("subject_id", "predicate", F.coalesce("object_id", "object_value").alias("object_id"), F.lit("prov/O").alias("provenance"))


EDGES_SQL = "edges AS (SELECT subject_id, predicate, coalesce(object_id, object_value) AS object_id, 'prov/O' AS provenance FROM triples)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir).filter(F.col("predicate").isin("name", "typeOf"))
    return t.groupBy("subject_id").agg(F.max("object_value").alias("name"), F.sort_array(F.collect_set("object_id")).alias("types"))


NODES_SQL = "nodes AS (SELECT subject_id, max(object_value) AS name, list_sort(list(DISTINCT object_id) FILTER (WHERE object_id IS NOT NULL)) AS types FROM triples WHERE predicate IN ('name', 'typeOf') GROUP BY subject_id)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by supplier nation and brand, monthly and yearly; a line's flags are its method and its source."""
    line = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supp = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = line.join(part, line.l_partkey == part.p_partkey).join(supp, line.l_suppkey == supp.s_suppkey)
    monthly = rows.groupBy("s_nationkey", "p_brand", "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM").alias("date")).agg(F.sum("l_quantity").alias("value"))
    keys = ["s_nationkey", "p_brand", "l_returnflag", "l_linestatus"]
    yearly = monthly.groupBy(*keys, F.substring("date", 1, 4).alias("date")).agg(F.sum("value").alias("value"))
    both = monthly.withColumn("observation_period", F.lit("P1M")).unionByName(yearly.withColumn("observation_period", F.lit("P1Y")))
    return both.select(
        _key("nation/", "s_nationkey").alias("entity"), _key("Qty_", "p_brand").alias("variable"), "date", "value", _key("prov/", "l_linestatus").alias("provenance"), F.lit("").alias("unit"), F.lit("").alias("scaling_factor"),
        F.col("l_returnflag").alias("measurement_method"), "observation_period", _key("Import", "l_linestatus").alias("import_name"),
        F.concat(F.lit("https://www.source"), F.lower("l_linestatus"), F.lit(".example.org/data")).alias("provenance_url"),
    )


def with_nulls(obs: DataFrame) -> DataFrame:
    """Observations as files have them: columns of the facet that say nothing are null."""
    return obs.withColumns({"unit": F.expr("nullif(unit, '')"), "scaling_factor": F.expr("nullif(scaling_factor, '')"), "measurement_method": F.expr("nullif(measurement_method, 'N')")})


OBS_SQL = """
obs_rows AS (
  SELECT s_nationkey, p_brand, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m') AS month, l_quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
),
obs AS (
  SELECT 'nation/' || s_nationkey AS entity, 'Qty_' || p_brand AS variable, date, value, 'prov/' || l_linestatus AS provenance, '' AS unit, '' AS scaling_factor,
         l_returnflag AS measurement_method, observation_period, 'Import' || l_linestatus AS import_name,
         'https://www.source' || lower(l_linestatus) || '.example.org/data' AS provenance_url
  FROM (
    SELECT s_nationkey, p_brand, l_returnflag, l_linestatus, month AS date, 'P1M' AS observation_period, sum(l_quantity) AS value FROM obs_rows GROUP BY ALL
    UNION ALL
    SELECT s_nationkey, p_brand, l_returnflag, l_linestatus, substr(month, 1, 4), 'P1Y', sum(l_quantity) FROM obs_rows GROUP BY ALL
  )
)"""

#: Facet rules: import, method, period, unit (null matches all), score.
RULES = [("ImportO", None, None, None, 2), ("ImportO", "A", None, None, 1), ("ImportF", "R", "P1M", None, 1001), ("ImportF", None, "P1Y", None, 50)]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "import_name string, measurement_method string, observation_period string, unit string, score int")


RULES_SQL = "rules(import_name, measurement_method, observation_period, unit, score) AS (VALUES ('ImportO', NULL, NULL, NULL, 2), ('ImportO', 'A', NULL, NULL, 1), ('ImportF', 'R', 'P1M', NULL, 1001), ('ImportF', NULL, 'P1Y', NULL, 50))"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between nations, by part type (no third place for one variable): the points of multi-entity series."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    supp = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = (
        line.join(part, line.l_partkey == part.p_partkey).join(supp, line.l_suppkey == supp.s_suppkey).join(orders, line.l_orderkey == orders.o_orderkey).join(cust, orders.o_custkey == cust.c_custkey)
    )
    by_type = rows.groupBy("s_nationkey", "c_nationkey", "p_type", "l_linestatus", F.date_format("l_shipdate", "yyyy").alias("date")).agg(F.sum("l_quantity").alias("value"))
    whole = by_type.groupBy("s_nationkey", "c_nationkey", "l_linestatus", "date").agg(F.sum("value").alias("value")).withColumn("p_type", F.lit(None).cast("string"))
    return by_type.unionByName(whole).select(
        F.when(F.col("p_type").isNull(), "Trade").otherwise("TradeByType").alias("variable_measured"), _key("nation/", "s_nationkey").alias("entity1"), _key("nation/", "c_nationkey").alias("entity2"),
        _key("type/", "p_type").alias("entity3"), F.col("l_linestatus").alias("facet_id"), "date", F.col("value").cast("long").cast("string").alias("value"),
    )


FLOWS_SQL = """
flow_rows AS (
  SELECT s_nationkey, c_nationkey, p_type, l_linestatus, strftime(l_shipdate, '%Y') AS date, l_quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
flows AS (
  SELECT CASE WHEN p_type IS NULL THEN 'Trade' ELSE 'TradeByType' END AS variable_measured, 'nation/' || s_nationkey AS entity1, 'nation/' || c_nationkey AS entity2,
         'type/' || p_type AS entity3, l_linestatus AS facet_id, date, value::BIGINT::VARCHAR AS value
  FROM (
    SELECT s_nationkey, c_nationkey, p_type, l_linestatus, date, sum(l_quantity) AS value FROM flow_rows GROUP BY ALL
    UNION ALL
    SELECT s_nationkey, c_nationkey, NULL, l_linestatus, date, sum(l_quantity) FROM flow_rows GROUP BY ALL
  )
)"""


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_type, place, date, magnitude (unit and number), props of every event."""
    e = read(spark, sf_dir, "events")
    return e.select(
        _key("event/", "event_id").alias("event_id"), "event_type", _key("user/", "user_id").alias("place"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("Unit "), F.format_string("%.2f", F.col("value"))).alias("magnitude"), "props",
    )


EVENTS_SQL = """
ev AS (
  SELECT 'event/' || event_id AS event_id, event_type, 'user/' || user_id AS place, strftime(ts, '%Y-%m-%d') AS date, 'Unit ' || printf('%.2f', value) AS magnitude, props FROM events
)"""
