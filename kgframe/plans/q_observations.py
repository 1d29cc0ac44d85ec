"""Queries on fetching, filtering and ranking observations (survey F, J1, J19, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgframe.operators import facets, graph, observations
from kgframe.plans.common import PAIRS, VARIABLES, Bound
from kgframe.plans.registry import query

OBS_COLUMNS = "variable, entity, date, value, import_name, measurement_method, observation_period"
SERIES = "variable, entity, import_name, provenance_url, measurement_method, observation_period, scaling_factor, unit"


def cut(df, columns: str = OBS_COLUMNS):
    return df.select(*columns.split(", "))


@query("f1_obs_for", f"{VARIABLES} SELECT {OBS_COLUMNS} FROM obs WHERE variable IN (FROM variables) AND entity IN (SELECT 'nation/' || n_nationkey FROM nation WHERE n_regionkey < 2) AND date = '1996-03'")
def f1(spark, d):
    b = Bound(spark, d)
    places = b.raw("nation").filter("n_regionkey < 2").select(F.concat(F.lit("nation/"), F.col("n_nationkey")).alias("entity"))
    return cut(observations.obs_for(b.obs, b.variables(), places, "1996-03"))


_FLOW = "variable_measured, entity1, entity2, entity3, facet_id, date, value"


@query("f2_obs_by_slots_all", f"SELECT {_FLOW} FROM flows WHERE entity1 IN (SELECT 'nation/' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def f2_all(spark, d):
    b = Bound(spark, d)
    e = b.raw("nation").filter("n_regionkey = 1").select(F.concat(F.lit("nation/"), F.col("n_nationkey")).alias("entity1"))
    return observations.obs_by_slots(b.flows, e).select(*_FLOW.split(", "))


@query("f2_obs_by_slots_latest", "SELECT variable_measured, entity1, entity2, entity3, facet_id, arg_max(value, date) AS value, max(date) AS date FROM flows WHERE variable_measured = 'Trade' AND entity1 IN (SELECT 'nation/' || n_nationkey FROM nation) GROUP BY ALL")
def f2_latest(spark, d):
    b = Bound(spark, d)
    v = spark.createDataFrame([("Trade",)], "variable_measured string")
    return observations.obs_by_slots(b.flows, b.places().withColumnRenamed("entity", "entity1"), v, "latest")


@query("f2_obs_by_slots_exact", f"SELECT {_FLOW} FROM flows WHERE variable_measured = 'TradeByType' AND date = '1997'")
def f2_exact(spark, d):
    b = Bound(spark, d)
    v = spark.createDataFrame([("TradeByType",)], "variable_measured string")
    return observations.obs_by_slots(b.flows, b.places().withColumnRenamed("entity", "entity1"), v, "exact", "1997").select(*_FLOW.split(", "))


@query("f3_filter_series_by_props", f"SELECT {OBS_COLUMNS} FROM obs WHERE measurement_method = 'R' AND observation_period = 'P1Y'")
def f3(spark, d):
    return cut(observations.filter_series_by_props(Bound(spark, d).obs, measurement_method="R", observation_period="P1Y", unit=None, scaling_factor=""))


@query("f4_filter_facets", f"SELECT {OBS_COLUMNS} FROM obs WHERE provenance_url LIKE 'https://www.sourceo.example.org/%'")
def f4(spark, d):
    return cut(facets.filter_facets(Bound(spark, d).obs, domains=["sourceo.example.org"]))


@query("f4_filter_pages_by_domain", "SELECT page_id, url FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) LIKE '%example.net'", base=False)
def f4_pages(spark, d):
    from kgframe.functions.scalars import host_ends_with

    return Bound(spark, d).raw("pages").select("page_id", "url").filter(host_ends_with(F.col("url"), ["example.net"]))


@query("f5_drop_inferior_facets", f"SELECT {SERIES}, score, facet_rank FROM ranked WHERE score <= 1000 OR facet_rank = 1")
def f5(spark, d):
    return facets.drop_inferior_facets(Bound(spark, d).ranked).select(*SERIES.split(", "), "score", F.col("facet_rank").cast("long").alias("facet_rank"))


@query("f6_filter_by_date_interval", f"SELECT {OBS_COLUMNS} FROM obs WHERE (date || CASE WHEN length(date) = 4 THEN '-01-01' ELSE '-01' END)::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def f6(spark, d):
    return cut(observations.filter_by_date_interval(Bound(spark, d).obs, "1996", "1997-06"))


@query("f8_filter_nodes_by_type", "SELECT subject_id, 'Country' AS matched FROM triples WHERE predicate = 'typeOf' AND object_id = 'Country' UNION ALL SELECT subject_id, 'Supplier' FROM triples WHERE predicate = 'typeOf' AND object_id = 'Supplier'")
def f8(spark, d):
    return graph.filter_nodes_by_type(Bound(spark, d).nodes, ["Country", "Supplier"]).select("subject_id", F.array_join("matched", ",").alias("matched"))


@query("f10_valid_dcids", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '' AND NOT regexp_matches(o_orderpriority, '[ ,]')", base=False)
def f10(spark, d):
    return observations.valid_dcids(Bound(spark, d).raw("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("f11_trim_empty_entities", f"{PAIRS} SELECT DISTINCT p.variable, p.entity FROM pairs p JOIN obs o ON o.variable = p.variable AND o.entity = p.entity")
def f11(spark, d):
    b = Bound(spark, d)
    return observations.trim_empty_entities(b.pairs(), b.obs)


@query("j1_obs_by_entity_type", f"{VARIABLES} SELECT {OBS_COLUMNS} FROM obs WHERE variable IN (FROM variables) AND entity IN (SELECT subject_id FROM triples WHERE predicate = 'typeOf' AND object_id = 'Country') AND date = '1998'")
def j1(spark, d):
    b = Bound(spark, d)
    return cut(observations.obs_by_entity_type(b.obs, b.triples, b.variables(), "Country", "1998"))


_INSIDE = "entity IN (SELECT child FROM closure WHERE ancestor = 'region/2') AND entity IN (SELECT subject_id FROM triples WHERE predicate = 'typeOf' AND object_id = 'Country')"


def _contained(spark, d, mode, date=None):
    b = Bound(spark, d)
    return observations.obs_contained_in(b.obs, b.edges, b.triples, b.variables(), "region/2", "Country", mode, date)


@query("j5_obs_contained_in_all", f"{VARIABLES} SELECT {OBS_COLUMNS} FROM obs WHERE variable IN (FROM variables) AND {_INSIDE}")
def j5_all(spark, d):
    return cut(_contained(spark, d, "all"))


@query("j5_obs_contained_in_exact", f"{VARIABLES} SELECT {OBS_COLUMNS} FROM obs WHERE variable IN (FROM variables) AND {_INSIDE} AND date = '1997'")
def j5_exact(spark, d):
    return cut(_contained(spark, d, "exact", "1997"))


@query("j5_obs_contained_in_latest", f"{VARIABLES} SELECT {SERIES}, arg_max(value, date) AS value, max(date) AS date FROM obs WHERE variable IN (FROM variables) AND {_INSIDE} GROUP BY ALL")
def j5_latest(spark, d):
    return _contained(spark, d, "latest").select(*SERIES.split(", "), "value", "date")


@query("j19_entity_variable_pairs_count", f"{PAIRS} SELECT p.variable, p.entity, count(o.date) AS n FROM pairs p LEFT JOIN obs o ON o.variable = p.variable AND o.entity = p.entity GROUP BY ALL")
def j19(spark, d):
    b = Bound(spark, d)
    return observations.entity_variable_pairs_count(b.obs, b.pairs())


@query("w1_rank_facets", f"SELECT {SERIES}, facet_rank FROM ranked")
def w1(spark, d):
    return Bound(spark, d).ranked.select(*SERIES.split(", "), F.col("facet_rank").cast("long").alias("facet_rank"))


@query("w2_rank_series", f"SELECT {SERIES}, row_number() OVER (PARTITION BY variable, entity ORDER BY score, latest DESC, obs_count DESC, import_name, measurement_method, observation_period, scaling_factor, unit, provenance_url) AS series_rank FROM scored")
def w2(spark, d):
    b = Bound(spark, d)
    return facets.rank_series(facets.facet_score(facets.series_of(b.obs), b.rules)).select(*SERIES.split(", "), F.col("series_rank").cast("long").alias("series_rank"))


@query("w2_rank_cohorts", "SELECT variable, import_name, measurement_method, observation_period, score, row_number() OVER (PARTITION BY variable ORDER BY score, measurement_method, observation_period, scaling_factor, unit, provenance_url, import_name) AS cohort_rank FROM (SELECT DISTINCT variable, import_name, provenance_url, measurement_method, observation_period, scaling_factor, unit, score FROM scored)")
def w2_cohorts(spark, d):
    b = Bound(spark, d)
    cohorts = facets.facet_score(b.obs.select("variable", *observations.FACET).distinct(), b.rules)
    return facets.rank_cohorts(cohorts).select("variable", "import_name", "measurement_method", "observation_period", "score", F.col("cohort_rank").cast("long").alias("cohort_rank"))


@query("w3_sample_per_group", "SELECT variable, measurement_method, entity FROM (SELECT *, row_number() OVER (PARTITION BY variable, measurement_method ORDER BY entity) AS n FROM (SELECT DISTINCT variable, measurement_method, entity FROM obs)) WHERE n <= 3")
def w3(spark, d):
    return facets.sample_per_group(Bound(spark, d).obs.select("variable", "measurement_method", "entity").distinct(), ["variable", "measurement_method"], "entity")


@query("w4_latest_per_series", f"SELECT {SERIES}, arg_max(value, date) AS value, max(date) AS date FROM obs GROUP BY ALL")
def w4(spark, d):
    return observations.latest_per_series(Bound(spark, d).obs).select(*SERIES.split(", "), "value", "date")


@query("w5_facet_score", f"SELECT {SERIES}, score FROM scored")
def w5(spark, d):
    b = Bound(spark, d)
    return facets.facet_score(facets.series_of(b.obs), b.rules).select(*SERIES.split(", "), "score")


@query("w6_order_by_type_priority", "SELECT object_id AS node, subject_id AS dcid, type, row_number() OVER (PARTITION BY object_id ORDER BY CASE type WHEN 'Supplier' THEN 1 ELSE 2 END, type, subject_id) AS position FROM (SELECT e.object_id, e.subject_id, t.object_id AS type FROM edges e JOIN triples t ON t.subject_id = e.subject_id AND t.predicate = 'typeOf' WHERE e.predicate = 'containedInPlace')")
def w6(spark, d):
    b = Bound(spark, d)
    t = b.triples.filter("predicate = 'typeOf'").select(F.col("subject_id").alias("dcid"), F.col("object_id").alias("type"))
    c = b.edges.filter("predicate = 'containedInPlace'").select(F.col("object_id").alias("node"), F.col("subject_id").alias("dcid")).join(t, "dcid")
    return facets.order_by_type_priority(c, ["Supplier"]).withColumn("position", F.col("position").cast("long"))


_NATIONS = "points AS (SELECT variable, entity, sum(value) AS value FROM obs WHERE observation_period = 'P1Y' GROUP BY ALL)"


def _points(b):
    return b.obs.filter("observation_period = 'P1Y'").groupBy("variable", "entity").agg(F.sum("value").alias("value"))


def _long(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


@query("w7_location_rankings", f"{_NATIONS} SELECT variable, entity, value, rank() OVER (PARTITION BY variable ORDER BY value DESC) AS rank_from_top, rank() OVER (PARTITION BY variable ORDER BY value) AS rank_from_bottom, count(*) OVER (PARTITION BY variable) AS total FROM points")
def w7(spark, d):
    return _long(facets.location_rankings(_points(Bound(spark, d))), "rank_from_top", "rank_from_bottom")


@query(
    "w7_location_rankings_per_capita",
    f"{_NATIONS}, people AS (SELECT 'nation/' || c_nationkey AS entity, count(*) AS people FROM customer GROUP BY ALL), heads AS (SELECT variable, entity, value / people AS value FROM points JOIN people USING (entity)) SELECT variable, entity, round(value, 6) AS value, rank() OVER (PARTITION BY variable ORDER BY value DESC) AS rank_from_top, rank() OVER (PARTITION BY variable ORDER BY value) AS rank_from_bottom, count(*) OVER (PARTITION BY variable) AS total FROM heads",
)
def w7_heads(spark, d):
    b = Bound(spark, d)
    people = b.raw("customer").groupBy(F.concat(F.lit("nation/"), F.col("c_nationkey")).alias("entity")).agg(F.count("*").alias("people"))
    return _long(facets.location_rankings(_points(b), people), "rank_from_top", "rank_from_bottom").withColumn("value", F.round("value", 6))


@query("w8_related_locations", f"{_NATIONS} SELECT * FROM (SELECT variable, entity, value, rank() OVER (PARTITION BY variable ORDER BY value DESC) AS rank_from_top, rank() OVER (PARTITION BY variable ORDER BY value) AS rank_from_bottom, count(*) OVER (PARTITION BY variable) AS total FROM points) WHERE entity = 'nation/3'")
def w8(spark, d):
    return _long(facets.location_rankings(_points(Bound(spark, d))), "rank_from_top", "rank_from_bottom").filter("entity = 'nation/3'")


_BEST = "points AS (SELECT o.*, r.score, r.facet_rank FROM obs o JOIN ranked r USING (variable, entity, import_name, provenance_url, measurement_method, observation_period, scaling_factor, unit))"


@query("w9_best_value_latest", f"{_BEST} SELECT variable, entity, date, value, facet_rank FROM (SELECT *, row_number() OVER (PARTITION BY variable, entity ORDER BY date DESC, facet_rank) AS n FROM points WHERE score <= 1000 OR facet_rank = 1) WHERE n = 1")
def w9(spark, d):
    b = Bound(spark, d)
    return _long(facets.best_value(b.obs, b.ranked), "facet_rank")


@query("w9_best_value_on_date", f"{_BEST} SELECT variable, entity, date, value, facet_rank FROM (SELECT *, row_number() OVER (PARTITION BY variable, entity ORDER BY facet_rank) AS n FROM points WHERE date = '1996-05') WHERE n = 1")
def w9_date(spark, d):
    b = Bound(spark, d)
    return _long(facets.best_value(b.obs, b.ranked, "1996-05"), "facet_rank")


@query("w10_best_series_top", f"SELECT {SERIES}, facet_rank FROM ranked WHERE facet_rank = 1")
def w10(spark, d):
    return _long(facets.best_series(Bound(spark, d).ranked).select(*SERIES.split(", "), "facet_rank"), "facet_rank")


@query("w10_best_series_of_import", f"SELECT {SERIES}, facet_rank FROM (SELECT *, row_number() OVER (PARTITION BY variable, entity ORDER BY facet_rank) AS n FROM ranked WHERE import_name = 'ImportF') WHERE n = 1")
def w10_import(spark, d):
    return _long(facets.best_series(Bound(spark, d).ranked, "ImportF").select(*SERIES.split(", "), "facet_rank"), "facet_rank")


@query("w10_best_series_latest", f"SELECT {SERIES}, facet_rank FROM (SELECT *, row_number() OVER (PARTITION BY variable, entity ORDER BY latest DESC, facet_rank) AS n FROM ranked) WHERE n = 1")
def w10_latest(spark, d):
    return _long(facets.best_series(Bound(spark, d).ranked, use_latest=True).select(*SERIES.split(", "), "facet_rank"), "facet_rank")


@query("w11_bulk_point", f"{PAIRS}, {_BEST} SELECT variable, entity, date, value, facet_rank FROM (SELECT *, row_number() OVER (PARTITION BY variable, entity ORDER BY date DESC, facet_rank) AS n FROM points JOIN pairs USING (variable, entity) WHERE score <= 1000 OR facet_rank = 1) WHERE n = 1")
def w11(spark, d):
    b = Bound(spark, d)
    return _long(facets.bulk_point(b.obs, b.rules, b.pairs()), "facet_rank")


@query("w11_bulk_point_all_facets", f"{PAIRS}, {_BEST} SELECT variable, entity, facet_rank, max(date) AS date, arg_max(value, date) AS value FROM points JOIN pairs USING (variable, entity) GROUP BY ALL")
def w11_all(spark, d):
    b = Bound(spark, d)
    return _long(facets.bulk_point(b.obs, b.rules, b.pairs(), all_facets=True), "facet_rank")


@query("w12_bulk_series", f"{PAIRS}, {_BEST} SELECT variable, entity, facet_rank, date, value FROM points JOIN pairs USING (variable, entity) WHERE facet_rank = 1")
def w12(spark, d):
    b = Bound(spark, d)
    return _long(facets.bulk_series(b.obs, b.rules, b.pairs()), "facet_rank")


@query("w12_bulk_series_linked", f"{VARIABLES}, {_BEST} SELECT variable, entity, facet_rank, date, value FROM points WHERE facet_rank = 1 AND variable IN (FROM variables) AND entity IN (SELECT 'nation/' || n_nationkey FROM nation WHERE n_regionkey = 3)")
def w12_linked(spark, d):
    b = Bound(spark, d)
    children = graph.places_in(b.triples, spark.createDataFrame([("region/3",)], "parent string"), "Country").select(F.col("child").alias("entity"))
    return _long(facets.bulk_series(observations.obs_for(b.obs, b.variables(), children), b.rules), "facet_rank")


_PRIMARY = "per AS (SELECT variable, import_name, provenance_url, measurement_method, observation_period, scaling_factor, unit, count(DISTINCT entity) AS places, count(*) AS points, max(date) AS latest, avg(facet_rank) AS avg_rank, max(score) AS score FROM points GROUP BY ALL)"
_LAST = "measurement_method, observation_period, scaling_factor, unit, provenance_url, import_name"


def _primary(spark, d, score_desc=None):
    b = Bound(spark, d)
    points = facets.ranked_points(b.obs, b.rules)
    return _long(facets.select_primary_source(points, score_desc), "source_rank").select("variable", "import_name", "measurement_method", "observation_period", "places", "points", "latest", "source_rank")


@query("w13_select_primary_source", f"{_BEST}, {_PRIMARY} SELECT variable, import_name, measurement_method, observation_period, places, points, latest, row_number() OVER (PARTITION BY variable ORDER BY places DESC, points DESC, latest DESC, avg_rank, {_LAST}) AS source_rank FROM per")
def w13(spark, d):
    return _primary(spark, d)


@query("w14_rank_sdmx_facets", f"{_BEST}, {_PRIMARY} SELECT variable, import_name, measurement_method, observation_period, places, points, latest, row_number() OVER (PARTITION BY variable ORDER BY places DESC, points DESC, latest DESC, score DESC, {_LAST}) AS source_rank FROM per")
def w14(spark, d):
    return _primary(spark, d, True)


@query("w15_nth_page", "SELECT subject_id, predicate, object_id, (SELECT count(*) > 150 FROM edges WHERE predicate = 'name') AS has_more FROM edges WHERE predicate = 'name' ORDER BY subject_id LIMIT 100 OFFSET 50")
def w15(spark, d):
    e = Bound(spark, d).edges.filter("predicate = 'name'").select("subject_id", "predicate", "object_id")
    return observations.nth_page(e, ["subject_id", "predicate", "object_id"], 100, 50)


@query("w16_limit_per_type", "SELECT node, predicate, object, type FROM (SELECT e.object_id AS node, e.predicate, e.subject_id AS object, t.object_id AS type, row_number() OVER (PARTITION BY e.object_id, t.object_id ORDER BY e.subject_id) AS n FROM edges e JOIN triples t ON t.subject_id = e.subject_id AND t.predicate = 'typeOf' WHERE e.predicate = 'containedInPlace') WHERE n <= 5")
def w16(spark, d):
    b = Bound(spark, d)
    t = b.triples.filter("predicate = 'typeOf'").select(F.col("subject_id").alias("object"), F.col("object_id").alias("type"))
    n = b.edges.filter("predicate = 'containedInPlace'").select(F.col("object_id").alias("node"), "predicate", F.col("subject_id").alias("object"), F.lit("").alias("value")).join(t, "object")
    return facets.limit_per_type(n, 5).select("node", "predicate", "object", "type")


@query("w17_systematic_sample", f"SELECT {SERIES}, date FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY date DESC) - 1 AS back, ceil(count(*) OVER (PARTITION BY {SERIES}) / 5.0) AS step FROM obs) WHERE back % step = 0")
def w17(spark, d):
    return facets.systematic_sample(Bound(spark, d).obs, SERIES.split(", "), "date", 5).select(*SERIES.split(", "), "date")


_SAME = " AND ".join(f"o.{c} IS NOT DISTINCT FROM r.{c}" for c in SERIES.split(", "))
_BEST_SPARSE = f"points AS (SELECT o.*, r.score, r.facet_rank FROM obs o JOIN ranked r ON {_SAME})"


@query("w5_facet_score_null_facets", f"SELECT {SERIES}, score FROM scored", sparse=True)
def w5_nulls(spark, d):
    b = Bound(spark, d, sparse=True)
    return facets.facet_score(facets.series_of(b.obs), b.rules).select(*SERIES.split(", "), "score")


@query("w9_best_value_null_facets", f"{_BEST_SPARSE} SELECT variable, entity, date, value, facet_rank FROM (SELECT *, row_number() OVER (PARTITION BY variable, entity ORDER BY date DESC, facet_rank) AS n FROM points WHERE score <= 1000 OR facet_rank = 1) WHERE n = 1", sparse=True)
def w9_nulls(spark, d):
    b = Bound(spark, d, sparse=True)
    return _long(facets.best_value(b.obs, b.ranked), "facet_rank")


@query("w9_best_value_on_date_null_facets", f"{_BEST_SPARSE} SELECT variable, entity, date, value, facet_rank FROM (SELECT *, row_number() OVER (PARTITION BY variable, entity ORDER BY facet_rank) AS n FROM points WHERE date = '1996-05') WHERE n = 1", sparse=True)
def w9_date_nulls(spark, d):
    b = Bound(spark, d, sparse=True)
    return _long(facets.best_value(b.obs, b.ranked, "1996-05"), "facet_rank")


@query("w12_bulk_series_null_facets", f"{PAIRS}, {_BEST_SPARSE} SELECT variable, entity, facet_rank, date, value FROM points JOIN pairs USING (variable, entity) WHERE facet_rank = 1", sparse=True)
def w12_nulls(spark, d):
    b = Bound(spark, d, sparse=True)
    return _long(facets.bulk_series(b.obs, b.rules, b.pairs()), "facet_rank")


@query("x_slice_latest_best_in_region", f"{VARIABLES}, {_BEST} SELECT variable, entity, date, value FROM (SELECT *, row_number() OVER (PARTITION BY variable, entity ORDER BY date DESC, facet_rank) AS n FROM points WHERE {_INSIDE} AND variable IN (FROM variables) AND (score <= 1000 OR facet_rank = 1)) WHERE n = 1")
def flagship(spark, d):
    """The latest value from the best source of each variable, for all countries in a continent."""
    b = Bound(spark, d)
    inside = observations.obs_contained_in(b.obs, b.edges, b.triples, b.variables(), "region/2", "Country")
    return facets.best_value(inside, facets.facet_stats(inside, b.rules)).select("variable", "entity", "date", "value")
