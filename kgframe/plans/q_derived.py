"""Queries on formulas, merges, multi-dimensional series, events and topics (survey X, M, SDMX, V, T, S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgframe.operators import events as ev
from kgframe.operators import formula as fo
from kgframe.operators import merge as me
from kgframe.operators import sdmx as sd
from kgframe.plans.common import PAIRS, Bound
from kgframe.plans.registry import query
from kgframe.sources import bind, tables

FACET = "import_name, provenance_url, measurement_method, observation_period, scaling_factor, unit"
_OPS = "a AS (SELECT * FROM obs WHERE variable = 'Qty_Brand#11'), b AS (SELECT * FROM obs WHERE variable = 'Qty_Brand#12')"
_JOIN = f"FROM a JOIN b USING (entity, {FACET}, date)"
#: The same pairs of operands as one aggregation over what is needed alone: a and b are the values of one point.
_POINTS = f"WITH {bind.OBS_SQL.strip().replace('obs AS (', 'obs AS MATERIALIZED (')}, points AS (SELECT entity, {FACET}, date, max(value) FILTER (variable = 'Qty_Brand#11') AS a, max(value) FILTER (variable = 'Qty_Brand#12') AS b FROM obs WHERE variable IN ('Qty_Brand#11', 'Qty_Brand#12') GROUP BY ALL)"


def _long(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _ab(b):
    obs = b.obs
    return {"a": fo.operand(obs, "Qty_Brand#11"), "b": fo.operand(obs, "Qty_Brand#12")}


@query("x1_formula_operands", f"SELECT entity, date, value FROM obs WHERE variable = 'Qty_Brand#11' AND measurement_method = 'N' AND observation_period = 'P1M'")
def x1(spark, d):
    return fo.operand(Bound(spark, d).obs, "Qty_Brand#11", measurement_method="N", observation_period="P1M").select("entity", "date", "value")


@query("x2_eval_formula", f"{_POINTS} SELECT 'Share' AS variable, entity, {FACET}, date, round(a / (a + b) * 100, 6) AS value FROM points WHERE a IS NOT NULL AND b IS NOT NULL", base=False)
def x2(spark, d):
    out = fo.eval_formula(_ab(Bound(spark, d)), lambda a, b: a / (a + b) * 100, "Share")
    return out.withColumn("value", F.round("value", 6))


@query("x3_mark_derived_facets", f"{_OPS} SELECT DISTINCT import_name, measurement_method, observation_period, true AS is_dc_aggregate {_JOIN}")
def x3(spark, d):
    out = fo.mark_derived_facets(fo.eval_formula(_ab(Bound(spark, d)), lambda a, b: a + b, "Sum"))
    return out.groupBy("import_name", "measurement_method", "observation_period", "is_dc_aggregate").agg(F.countDistinct("facet_id").alias("n")).filter("n = 1").drop("n")


@query(
    "x4_fill_holes",
    f"{_POINTS}, f0 AS (SELECT 'Sum' AS variable, entity, {FACET}, date, a + b AS value, 0 AS formula_order FROM points WHERE a IS NOT NULL AND b IS NOT NULL AND entity < 'nation/2'), firsts AS MATERIALIZED (SELECT DISTINCT entity FROM f0), "
    f"f1 AS (SELECT 'Sum' AS variable, p.entity, {FACET}, date, a * 2 AS value, 1 AS formula_order FROM points p LEFT JOIN firsts ON firsts.entity = p.entity WHERE a IS NOT NULL AND firsts.entity IS NULL) "
    "SELECT variable, entity, import_name, measurement_method, observation_period, date, value, formula_order FROM (FROM f0 UNION ALL FROM f1)",
    base=False,
)
def x4(spark, d):
    b = Bound(spark, d)
    obs = b.obs
    ops = _ab(b)
    asked = b.places().select(F.explode(F.array(F.lit("Qty_Brand#11"), F.lit("Sum"))).alias("variable"), "entity")
    first = fo.eval_formula({k: v.filter("entity < 'nation/2'") for k, v in ops.items()}, lambda a, b: a + b, "Sum")
    second = fo.eval_formula({"a": ops["a"]}, lambda a: a * 2, "Sum")
    return fo.fill_holes(asked, obs, [first, second]).select("variable", "entity", "import_name", "measurement_method", "observation_period", "date", "value", "formula_order")


@query("x5_load_formulas", "SELECT 'Ratio_' || p_brand AS output, 'Qty_' || p_brand || ' / Qty_Brand#11' AS expressions FROM (SELECT DISTINCT p_brand FROM part)", base=False)
def x5(spark, d):
    p = Bound(spark, d).raw("part").select("p_brand").distinct()
    s = F.concat(F.lit("calc/"), "p_brand")
    null = F.lit(None).cast("string")
    facts = F.array(
        *[F.struct(F.lit(k).alias("predicate"), o.alias("object_id"), v.alias("object_value")) for k, o, v in (
            ("typeOf", F.lit("StatisticalCalculation"), null), ("outputProperty", F.concat(F.lit("Ratio_"), "p_brand"), null), ("inputPropertyExpression", null, F.concat(F.lit("Qty_"), "p_brand", F.lit(" / Qty_Brand#11"))))]
    )
    triples = p.select(s.alias("subject_id"), F.explode(facts).alias("f")).select("subject_id", "f.*")
    return fo.load_formulas(triples).withColumn("expressions", F.array_join("expressions", ","))


_SIG = "SELECT entity, import_name || '^' || provenance_url || '^' || measurement_method || '^' || observation_period || '^' || scaling_factor || '^' || unit AS facet, string_agg(date, ',' ORDER BY date) AS dates"


@query(
    "x6_derived_series",
    f"{_OPS}, sa AS ({_SIG} FROM a GROUP BY ALL), sb AS ({_SIG} FROM b GROUP BY ALL), longest AS (SELECT entity, dates FROM (SELECT entity, dates, row_number() OVER (PARTITION BY entity ORDER BY length(dates) DESC, dates DESC) AS r FROM (SELECT DISTINCT sa.entity, sa.dates FROM sa JOIN sb USING (entity, dates))) WHERE r = 1), "
    f"fa AS (SELECT entity, max(facet) AS facet FROM sa JOIN longest USING (entity, dates) GROUP BY 1), fb AS (SELECT entity, max(facet) AS facet FROM sb JOIN longest USING (entity, dates) GROUP BY 1), "
    "pa AS (SELECT a.entity, a.date, a.value FROM a JOIN fa ON a.entity = fa.entity AND fa.facet = a.import_name || '^' || a.provenance_url || '^' || a.measurement_method || '^' || a.observation_period || '^' || a.scaling_factor || '^' || a.unit), "
    "pb AS (SELECT b.entity, b.date, b.value FROM b JOIN fb ON b.entity = fb.entity AND fb.facet = b.import_name || '^' || b.provenance_url || '^' || b.measurement_method || '^' || b.observation_period || '^' || b.scaling_factor || '^' || b.unit) "
    "SELECT 'Sum' AS variable, entity, date, pa.value + pb.value AS value FROM pa JOIN pb USING (entity, date)",
)
def x6(spark, d):
    return fo.derived_series(_ab(Bound(spark, d)), lambda a, b: a + b, "Sum")


# --- merges: the same observations as two sources that overlap ---
def _two(b):
    r = b.ranked
    return r.filter("entity < 'nation/2'"), r.filter("entity > 'nation/1'")


_TWO = "r0 AS (SELECT * FROM ranked WHERE entity < 'nation/2'), r1 AS (SELECT * FROM ranked WHERE entity > 'nation/1'), st AS (SELECT *, 0 AS priority FROM r0 UNION ALL SELECT *, 1 FROM r1)"


@query("m1_merge_observations", f"{_TWO} SELECT variable, entity, import_name, measurement_method, observation_period, row_number() OVER (PARTITION BY variable, entity ORDER BY priority, facet_rank) AS position FROM st")
def m1(spark, d):
    return _long(me.merge_observations([*_two(Bound(spark, d))]).select("variable", "entity", "import_name", "measurement_method", "observation_period", "position"), "position")


_NV = "n0 AS (SELECT subject_id AS node, predicate AS property, object_id AS dcid, 'a' AS src FROM edges WHERE subject_id < 'nation/2'), n1 AS (SELECT subject_id AS node, predicate AS property, object_id AS dcid, 'b' AS src FROM edges WHERE subject_id > 'nation/1')"


def _values(b):
    e = b.edges.select(F.col("subject_id").alias("node"), F.col("predicate").alias("property"), F.col("object_id").alias("dcid"))
    return e.filter("node < 'nation/2'").withColumn("src", F.lit("a")), e.filter("node > 'nation/1'").withColumn("src", F.lit("b"))


@query("m2_merge_nodes", f"{_NV} SELECT node, property, dcid, src FROM n0 UNION ALL SELECT node, property, dcid, src FROM n1 WHERE (node, property, dcid) NOT IN (SELECT (node, property, dcid) FROM n0)")
def m2(spark, d):
    return me.merge_nodes([*_values(Bound(spark, d))])


_FACTS = "f0 AS (SELECT subject_id AS node, predicate AS property, object_id AS dcid, object_value AS value, 'a' AS src FROM triples WHERE subject_id < 'nation/2'), f1 AS (SELECT subject_id AS node, predicate AS property, object_id AS dcid, CASE WHEN subject_id LIKE 'region/%' THEN lower(object_value) ELSE object_value END AS value, 'b' AS src FROM triples WHERE subject_id > 'nation/1')"


@query("m2_merge_nodes_literals", f"{_FACTS} FROM f0 UNION SELECT f1.* FROM f1 LEFT JOIN f0 ON f0.node = f1.node AND f0.property = f1.property AND (f0.dcid = f1.dcid OR (f0.dcid IS NULL AND f1.dcid IS NULL AND f0.value IS NOT DISTINCT FROM f1.value)) WHERE f0.node IS NULL")
def m2_literals(spark, d):
    t = Bound(spark, d).triples.select(F.col("subject_id").alias("node"), F.col("predicate").alias("property"), F.col("object_id").alias("dcid"), F.col("object_value").alias("value"))
    second = t.withColumn("value", F.when(F.col("node").startswith("region/"), F.lower("value")).otherwise(F.col("value")))
    return me.merge_nodes([t.filter("node < 'nation/2'").withColumn("src", F.lit("a")), second.filter("node > 'nation/1'").withColumn("src", F.lit("b"))])


_CAND = "c0 AS (SELECT 'n' || n_regionkey AS node, 'nation/' || n_nationkey AS dcid, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE (n_nationkey % 5)::VARCHAR END AS score FROM nation), c1 AS (SELECT 'n' || (s_nationkey % 5) AS node, 'nation/' || s_nationkey AS dcid, '9' AS score FROM supplier)"


def _candidates(b):
    n = b.raw("nation").select(F.concat(F.lit("n"), "n_regionkey").alias("node"), F.concat(F.lit("nation/"), "n_nationkey").alias("dcid"), F.when(F.col("n_nationkey") % 3 != 0, (F.col("n_nationkey") % 5).cast("string")).alias("score"))
    s = b.raw("supplier").select(F.concat(F.lit("n"), F.col("s_nationkey") % 5).alias("node"), F.concat(F.lit("nation/"), "s_nationkey").alias("dcid"), F.lit("9").alias("score")).distinct()
    return n, s


@query("m3_merge_resolve", f"{_CAND} SELECT node, dcid, score, row_number() OVER (PARTITION BY node ORDER BY score::DOUBLE DESC NULLS LAST, priority, dcid) AS position FROM (SELECT *, 0 AS priority FROM c0 UNION ALL SELECT DISTINCT *, 1 FROM c1 WHERE (node, dcid) NOT IN (SELECT (node, dcid) FROM c0))")
def m3(spark, d):
    return _long(me.merge_resolve([*_candidates(Bound(spark, d))]).select("node", "dcid", "score", "position"), "position")


@query("m3_merge_resolve_unresolved", "u0 AS (SELECT 'n' || n_nationkey AS node, CASE WHEN n_nationkey % 3 > 0 THEN 'nation/' || n_nationkey END AS dcid, NULL::VARCHAR AS score FROM nation), u1 AS (SELECT DISTINCT 'n' || s_nationkey AS node, CASE WHEN s_nationkey % 2 > 0 THEN 'nation/' || s_nationkey END AS dcid, '9' AS score FROM supplier) SELECT node, dcid, score, row_number() OVER (PARTITION BY node ORDER BY score::DOUBLE DESC NULLS LAST, priority, dcid) AS position FROM (SELECT *, 0 AS priority FROM u0 UNION ALL SELECT u1.*, 1 FROM u1 LEFT JOIN u0 ON u0.node = u1.node AND u0.dcid IS NOT DISTINCT FROM u1.dcid WHERE u0.node IS NULL)")
def m3_unresolved(spark, d):
    b = Bound(spark, d)
    n = lambda key, k, score: (F.concat(F.lit("n"), key).alias("node"), F.when(F.col(key) % k > 0, F.concat(F.lit("nation/"), key)).alias("dcid"), score.cast("string").alias("score"))
    sources = [b.raw("nation").select(*n("n_nationkey", 3, F.lit(None))), b.raw("supplier").select(*n("s_nationkey", 2, F.lit("9"))).distinct()]
    return _long(me.merge_resolve(sources).select("node", "dcid", "score", "position"), "position")


@query("k7_sort_candidates_by_score", f"{_CAND} SELECT node, dcid, score, row_number() OVER (PARTITION BY node ORDER BY score::DOUBLE DESC NULLS LAST, dcid) AS position FROM c0")
def k7(spark, d):
    return _long(me.sort_candidates_by_score(_candidates(Bound(spark, d))[0], "dcid"), "position")


@query("m4_merge_events", "SELECT event_id, event_type FROM ev")
def m4(spark, d):
    e = Bound(spark, d).events.select("event_id", "event_type")
    return me.merge_events([e.filter("event_id < 'event/5'"), e.filter("event_id > 'event/3'")]).select("event_id", "event_type")


@query("m5_merge_dates", "SELECT DISTINCT variable, date FROM obs")
def m5(spark, d):
    o = Bound(spark, d).obs
    return me.merge_dates([o.filter("date < '1998'"), o.filter("date > '1996'")])


@query("m6_merge_summaries", f"{_TWO}, s AS (SELECT variable, import_name, priority, sum(obs_count)::BIGINT AS n FROM st GROUP BY ALL) SELECT variable, import_name, n FROM s WHERE priority = 0 OR variable NOT IN (SELECT variable FROM s WHERE priority = 0)")
def m6(spark, d):
    return me.merge_summaries([x.groupBy("variable", "import_name").agg(F.sum("obs_count").alias("n")) for x in _two(Bound(spark, d))]).drop("priority")


@query("m7_merge_variable_info", "p0 AS (SELECT variable, provenance, count(*) AS n FROM obs WHERE entity < 'nation/2' GROUP BY ALL), p1 AS (SELECT variable, provenance, count(*) AS n FROM obs WHERE entity > 'nation/1' AND provenance = 'prov/O' GROUP BY ALL) FROM p1 UNION ALL SELECT * FROM p0 WHERE (variable, provenance) NOT IN (SELECT (variable, provenance) FROM p1)")
def m7(spark, d):
    o = Bound(spark, d).obs
    n = lambda x: x.groupBy("variable", "provenance").agg(F.count("*").alias("n"))
    return me.merge_variable_info([n(o.filter("entity < 'nation/2'")), n(o.filter("entity > 'nation/1' AND provenance = 'prov/O'"))]).drop("priority")


@query("m7_merge_variable_info_without_provenance", "p0 AS (SELECT variable, nullif(provenance, 'prov/O') AS provenance, count(*) AS n FROM obs WHERE entity < 'nation/2' GROUP BY ALL), p1 AS (SELECT variable, nullif(provenance, 'prov/O') AS provenance, count(*) AS n FROM obs WHERE entity > 'nation/1' AND variable < 'Qty_Brand#3' GROUP BY ALL) FROM p1 UNION ALL SELECT p0.* FROM p0 LEFT JOIN p1 ON p0.variable = p1.variable AND p0.provenance IS NOT DISTINCT FROM p1.provenance WHERE p1.variable IS NULL")
def m7_nulls(spark, d):
    o = Bound(spark, d).obs.withColumn("provenance", F.expr("nullif(provenance, 'prov/O')"))
    n = lambda x: x.groupBy("variable", "provenance").agg(F.count("*").alias("n"))
    return me.merge_variable_info([n(o.filter("entity < 'nation/2'")), n(o.filter("entity > 'nation/1' AND variable < 'Qty_Brand#3'"))]).drop("priority")


@query("m8_merge_group_info", "SELECT 'g/' || p_type AS group_id, count(*) AS n, p_type AS name FROM part GROUP BY p_type", base=False)
def m8(spark, d):
    p = Bound(spark, d).raw("part")
    half = lambda x, name: x.groupBy(F.concat(F.lit("g/"), "p_type").alias("group_id")).agg(F.count("*").alias("n"), name.alias("name"))
    return me.merge_group_info([half(p.filter("p_partkey % 2 = 0"), F.lit("")), half(p.filter("p_partkey % 2 = 1"), F.max("p_type"))])


@query("m9_merge_search_interleave", "s0 AS (SELECT 'v' || p_partkey AS dcid, p_partkey AS rank FROM part), s1 AS (SELECT 'v' || (p_partkey + 20) AS dcid, p_partkey AS rank FROM part), once AS (SELECT dcid, min((rank, priority)) AS k FROM (SELECT *, 0 AS priority FROM s0 UNION ALL SELECT *, 1 FROM s1) GROUP BY 1) SELECT dcid, k[1] AS rank, k[2] AS priority FROM once ORDER BY k, dcid LIMIT 60")
def m9(spark, d):
    p = Bound(spark, d).raw("part")
    s = lambda k: p.select(F.concat(F.lit("v"), F.col("p_partkey") + k).alias("dcid"), F.col("p_partkey").alias("rank"))
    return me.merge_search_interleave([s(0), s(20)], 60)


@query("m10_merge_query_rows", "SELECT DISTINCT subject_id, predicate FROM edges ORDER BY subject_id, subject_id, predicate LIMIT 200")
def m10(spark, d):
    e = Bound(spark, d).edges.select("subject_id", "predicate")
    return me.merge_query_rows([e, e], "subject_id", 200)


@query("m11_merge_statvar_search", "SELECT DISTINCT p_brand, p_type FROM part", base=False)
def m11(spark, d):
    p = Bound(spark, d).raw("part").select("p_brand", "p_type")
    return me.merge_statvar_search([p.filter("p_size < 30"), p.filter("p_size > 20")]).unionByName(p.filter("p_size BETWEEN 20 AND 30")).distinct()


@query("m12_merge_sdmx", "SELECT variable_measured, entity1, facet_id, date, value FROM flows WHERE variable_measured = 'Trade' UNION ALL SELECT variable_measured, entity1, facet_id, date, value FROM flows WHERE variable_measured = 'TradeByType'")
def m12(spark, d):
    f = Bound(spark, d).flows.select("variable_measured", "entity1", "facet_id", "date", "value")
    return me.merge_sdmx([f.filter("variable_measured = 'Trade'"), f.filter("variable_measured = 'TradeByType'")])


@query("m13_merge_availability", "SELECT DISTINCT entity2 FROM flows")
def m13(spark, d):
    f = Bound(spark, d).flows
    return me.merge_availability([f.filter("entity1 < 'nation/2'"), f.filter("entity1 > 'nation/1'")], "entity2")


@query("m14_distinct_source_series", f"{_TWO} SELECT variable, entity, measurement_method, observation_period, import_name FROM (SELECT *, row_number() OVER (PARTITION BY variable, entity, measurement_method, observation_period ORDER BY latest DESC, priority * 10 + (import_name = 'ImportF')::INT) AS n FROM st) WHERE n = 1")
def m14(spark, d):
    rows = me.stacked([*_two(Bound(spark, d))]).withColumn("priority", F.col("priority") * 10 + (F.col("import_name") == "ImportF").cast("int"))
    return me.distinct_source_series(rows, ["variable", "entity", "measurement_method", "observation_period"]).select("variable", "entity", "measurement_method", "observation_period", "import_name")


@query("m15_merge_hierarchies", "SELECT DISTINCT subject_id AS child, object_id AS parent FROM triples WHERE predicate IN ('memberOf', 'specializationOf')")
def m15(spark, d):
    t = Bound(spark, d).triples
    s = lambda p: t.filter(F.col("predicate").isin(p)).select(F.col("subject_id").alias("child"), F.col("object_id").alias("parent"))
    return me.merge_hierarchies([s(["memberOf"]), s(["memberOf", "specializationOf"])])


@query("m16_merge_paged_values", "SELECT node, property, dcid, value, row_number() OVER (PARTITION BY node, property ORDER BY dcid, value) AS position FROM (SELECT DISTINCT object_id AS node, predicate AS property, subject_id AS dcid, '' AS value FROM edges WHERE predicate = 'containedInPlace')")
def m16(spark, d):
    e = Bound(spark, d).edges.filter("predicate = 'containedInPlace'").select(F.col("object_id").alias("node"), F.col("predicate").alias("property"), F.col("subject_id").alias("dcid"), F.lit("").alias("value"))
    return _long(me.merge_paged_values([e, e.filter("dcid < 'd'")]), "position")


@query("m17_intersect_lists", "SELECT variable FROM obs GROUP BY variable HAVING count(DISTINCT entity) = (SELECT count(DISTINCT entity) FROM obs)")
def m17(spark, d):
    return me.intersect_lists(Bound(spark, d).obs.select("entity", "variable").distinct(), "entity", "variable")


@query("m18_merge_dedupe", "SELECT entity, array_to_string(list_sort(list(DISTINCT variable)), ',') AS variables FROM obs GROUP BY entity")
def m18(spark, d):
    o = Bound(spark, d).obs
    lists = o.groupBy("entity", "import_name").agg(F.collect_set("variable").alias("variables"))
    return me.merge_dedupe(lists, "entity", "variables").withColumn("variables", F.array_join("variables", ","))


@query("m19_diff_results", "SELECT CASE WHEN l_linenumber = 1 THEN 'left' ELSE 'right' END AS side, count(*) AS n, l_partkey FROM lineitem WHERE l_linenumber = 7 GROUP BY ALL", base=False)
def m19(spark, d):
    line = Bound(spark, d).raw("lineitem").select("l_partkey", "l_linenumber")
    return me.diff_results(line.filter("l_linenumber < 7").select("l_partkey"), line.select("l_partkey"))


@query("m20_prefer_branch", "b0 AS (SELECT entity, variable, measurement_method, date, value * 2 AS value FROM obs WHERE entity < 'nation/2' AND observation_period = 'P1Y' AND import_name = 'ImportO'), b1 AS (SELECT entity, variable, measurement_method, date, value FROM obs WHERE observation_period = 'P1Y' AND import_name = 'ImportO') FROM b0 UNION ALL SELECT * FROM b1 WHERE (entity, variable, measurement_method) NOT IN (SELECT (entity, variable, measurement_method) FROM b0)")
def m20(spark, d):
    o = Bound(spark, d).obs.filter("observation_period = 'P1Y' AND import_name = 'ImportO'").select("entity", "variable", "measurement_method", "date", "value")
    return me.prefer_branch(o.filter("entity < 'nation/2'").withColumn("value", F.col("value") * 2), o, ["entity", "variable", "measurement_method"]).drop("priority")


@query("m20_prefer_branch_null_facets", "b0 AS (SELECT entity, variable, nullif(measurement_method, 'N') AS measurement_method, date, value * 2 AS value FROM obs WHERE entity < 'nation/2' AND observation_period = 'P1Y' AND import_name = 'ImportO' AND measurement_method <> 'A'), b1 AS (SELECT entity, variable, nullif(measurement_method, 'N') AS measurement_method, date, value FROM obs WHERE observation_period = 'P1Y' AND import_name = 'ImportO'), keys AS (SELECT DISTINCT entity, variable, measurement_method FROM b0) FROM b0 UNION ALL SELECT b1.* FROM b1 LEFT JOIN keys k ON k.entity = b1.entity AND k.variable = b1.variable AND k.measurement_method IS NOT DISTINCT FROM b1.measurement_method WHERE k.entity IS NULL")
def m20_nulls(spark, d):
    o = Bound(spark, d, sparse=True).obs.filter("observation_period = 'P1Y' AND import_name = 'ImportO'").select("entity", "variable", "measurement_method", "date", "value")
    branch = o.filter("entity < 'nation/2' AND measurement_method IS DISTINCT FROM 'A'").withColumn("value", F.col("value") * 2)
    return me.prefer_branch(branch, o, ["entity", "variable", "measurement_method"]).drop("priority")


# --- multi-dimensional series ---
@query("f12_sdmx_where", "SELECT variable_measured, entity1, entity2, date, value FROM flows WHERE variable_measured = 'Trade' AND entity1 IN ('nation/1', 'nation/2') AND facet_id = 'O'")
def f12(spark, d):
    return Bound(spark, d).flows.filter(sd.sdmx_where({"variableMeasured": ["Trade"], "entity1": ["nation/1", "nation/2"], "facetId": ["O"]})).select("variable_measured", "entity1", "entity2", "date", "value")


@query("j23_sdmx_obs_latest", "SELECT variable_measured, entity1, entity2, entity3, facet_id, arg_max(value, date) AS value, max(date) AS date FROM flows WHERE variable_measured = 'TradeByType' AND entity2 = 'nation/3' GROUP BY ALL")
def j23(spark, d):
    return sd.sdmx_obs(Bound(spark, d).flows, {"variableMeasured": ["TradeByType"], "entity2": ["nation/3"], "TIME_PERIOD": ["LATEST"]})


_IN = "(SELECT 'nation/' || n_nationkey FROM nation WHERE n_regionkey = {})"


def _slot(b, region):
    types = b.triples.filter("predicate = 'typeOf'").select(F.col("subject_id").alias("place"), F.col("object_id").alias("type"))
    return sd.slot_places(b.below(region), types, region, "Country")


@query("j24_sdmx_obs_contained", f"SELECT variable_measured, entity1, entity2, facet_id, date, value FROM flows WHERE variable_measured = 'Trade' AND entity1 IN {_IN.format(1)} AND entity2 IN {_IN.format(2)}")
def j24(spark, d):
    b = Bound(spark, d)
    slots = {"entity1": _slot(b, "region/1"), "entity2": _slot(b, "region/2")}
    return sd.sdmx_obs_contained(b.flows, {"variableMeasured": ["Trade"]}, slots).select("variable_measured", "entity1", "entity2", "facet_id", "date", "value")


@query("j25_observation_property_values", "SELECT DISTINCT variable_measured AS variable, CASE WHEN variable_measured = 'Trade' THEN 'destination,source' ELSE 'destination,kind,source' END AS slots FROM flows")
def j25(spark, d):
    f = Bound(spark, d).flows.select(F.col("variable_measured").alias("variable"), F.explode(F.array(F.lit("source"), F.lit("destination"), F.when(F.col("entity3").isNotNull(), "kind"))).alias("property")).filter("property IS NOT NULL").distinct()
    return sd.observation_property_values(f).withColumn("slots", F.array_join("slots", ","))


@query("e11_sdmx_availability", "SELECT DISTINCT entity3 AS value FROM flows WHERE variable_measured = 'TradeByType' AND entity1 = 'nation/4' AND date IN ('1996', '1997') AND entity3 IS NOT NULL")
def e11(spark, d):
    return sd.sdmx_availability(Bound(spark, d).flows, "entity3", {"variableMeasured": ["TradeByType"], "entity1": ["nation/4"]}, ["1996", "1997"])


@query("e12_sdmx_availability_contained", f"SELECT DISTINCT entity2 AS value FROM flows WHERE variable_measured = 'Trade' AND entity1 IN {_IN.format(3)}")
def e12(spark, d):
    b = Bound(spark, d)
    return sd.sdmx_availability(b.flows, "entity2", {"variableMeasured": ["Trade"]}, slots={"entity1": _slot(b, "region/3")})


@query("s7_sdmx_csv_rows", "SELECT 'dataflow' AS \"STRUCTURE\", 'DC:TRADE' AS \"STRUCTURE_ID\", 'I' AS \"ACTION\", 'nation/' || a.n_nationkey AS entity1, 'nation/' || b.n_nationkey AS entity2, coalesce(f.entity3, 'NotApplicable') AS entity3, f.date AS \"TIME_PERIOD\", f.value AS \"OBS_VALUE\" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey LEFT JOIN flows f ON f.variable_measured = 'Trade' AND f.facet_id = 'O' AND f.entity1 = 'nation/' || a.n_nationkey AND f.entity2 = 'nation/' || b.n_nationkey")
def s7(spark, d):
    b = Bound(spark, d)
    n = b.raw("nation").select("n_regionkey", F.concat(F.lit("nation/"), "n_nationkey").alias("p"))
    series = n.withColumnRenamed("p", "entity1").join(n.withColumnRenamed("p", "entity2"), "n_regionkey").select("entity1", "entity2", F.lit("").alias("entity3"))
    points = b.flows.filter("variable_measured = 'Trade' AND facet_id = 'O'").select("entity1", "entity2", F.lit("").alias("entity3"), "date", "value")
    return sd.sdmx_csv_rows(series, points, ["entity1", "entity2", "entity3"], "DC:TRADE")


_CUBE = "c1 AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT entity1 AS v FROM flows)), c2 AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT entity2 AS v FROM flows)), c3 AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date AS v FROM flows))"


@query("s8_jsonstat_cube", f"{_CUBE} SELECT ((c1.i * c2.n + c2.i) * c3.n + c3.i) AS flat_index, value FROM flows JOIN c1 ON entity1 = c1.v JOIN c2 ON entity2 = c2.v JOIN c3 ON date = c3.v WHERE variable_measured = 'Trade' AND facet_id = 'O'")
def s8(spark, d):
    flows = Bound(spark, d).flows
    every = flows.select("entity1", "entity2", "date", "value", "variable_measured", "facet_id")
    cells, _ = sd.jsonstat_cube(every.withColumn("value", F.struct("value", "variable_measured", "facet_id")), ["entity1", "entity2", "date"])
    return cells.filter("value.variable_measured = 'Trade' AND value.facet_id = 'O'").select("flat_index", "value.value")


@query("s4_long_to_series", "SELECT entity1, entity2, facet_id, array_to_string(list(date || '=' || value ORDER BY date), ';') AS points FROM flows WHERE variable_measured = 'Trade' GROUP BY ALL")
def s4(spark, d):
    f = Bound(spark, d).flows.filter("variable_measured = 'Trade'")
    s = tables.long_to_series(f, ["entity1", "entity2", "facet_id"])
    return s.withColumn("points", F.array_join(F.transform("points", lambda p: F.concat_ws("=", p["date"], p["value"])), ";"))


@query("s4_series_to_long", "SELECT entity1, entity2, facet_id, date, value FROM flows WHERE variable_measured = 'Trade'")
def s4_long(spark, d):
    f = Bound(spark, d).flows.filter("variable_measured = 'Trade'").groupBy("entity1", "entity2", "facet_id").agg(F.map_from_entries(F.collect_list(F.struct("date", "value"))).alias("points"))
    return tables.series_to_long(f)


@query("s5_entity_slots", "SELECT DISTINCT variable_measured, entity1, entity2, entity3, facet_id AS provenance FROM flows")
def s5(spark, d):
    f = Bound(spark, d).flows.select("variable_measured", "entity1", F.to_json(F.struct("entity1", "entity2", "entity3")).alias("entities"), F.to_json(F.struct(F.col("facet_id").alias("provenance"))).alias("facet")).distinct()
    return tables.entity_slots(f).select("variable_measured", "entity1", "entity2", "entity3", "provenance")


@query("s6_decode_attributes", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", base=False)
def s6(spark, d):
    e = Bound(spark, d).raw("events")
    return e.select("event_id", F.element_at(tables.decode_attributes("props"), F.lit("k")).alias("k"))


@query("s9_recent_imports", "SELECT ts AS imported_at, event_type AS status, props AS metadata FROM events ORDER BY ts DESC, event_type, props LIMIT 100", base=False)
def s9(spark, d):
    return tables.recent_imports(Bound(spark, d).raw("events").select(F.col("ts").alias("imported_at"), F.col("event_type").alias("status"), F.col("props").alias("metadata")))


@query("s3_validate_tables", "SELECT 'observations' AS \"table\", 'missing column' AS problem, 'properties' AS \"column\" FROM (SELECT count(*) FROM lineitem)", base=False)
def s3(spark, d):
    b = Bound(spark, d)
    return tables.validate_tables(spark, {"observations": b.obs, "triples": b.triples}, {"observations": tables.OBSERVATIONS, "triples": tables.TRIPLES})


# --- events ---
@query("v1_event_months", "SELECT DISTINCT event_type, place, substr(date, 1, 7) AS month FROM ev")
def v1(spark, d):
    return ev.event_months(Bound(spark, d).events)


_MONTH = "(SELECT max(substr(date, 1, 7)) FROM ev)"


@query("v2_event_ids", "SELECT event_id, place, date, magnitude FROM ev WHERE event_type = 'click' AND substr(date, 1, 7) = '2024-01'")
def v2(spark, d):
    return ev.event_ids(Bound(spark, d).events, "click", "2024-01")


@query("v3_event_collection", "SELECT event_id, place AS places, date AS dates, json_extract_string(props, '$.k') AS k FROM ev")
def v3(spark, d):
    c = ev.event_collection(Bound(spark, d).events)
    return c.select("event_id", F.array_join("places", ",").alias("places"), F.array_join("dates", ",").alias("dates"), F.element_at("props", F.lit("k")).alias("k"))


@query("f13_keep_event", "SELECT event_id FROM ev WHERE substr(magnitude, 6)::DOUBLE BETWEEN 10 AND 50")
def f13(spark, d):
    return ev.keep_event(Bound(spark, d).events, "magnitude", "Unit", 10.0, 50.0).select("event_id")


@query("k6_top_events", "SELECT event_id, event_type, position FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY substr(magnitude, 6)::DOUBLE DESC, event_id) AS position FROM ev) WHERE position <= 100")
def k6(spark, d):
    return _long(ev.top_events(Bound(spark, d).events, "Unit", 100, ["event_type"]).select("event_id", "event_type", "position"), "position")


@query("v4_affected_places", "SELECT 'nation/' || n_nationkey AS place FROM nation WHERE n_regionkey = 2", base=False)
def v4(spark, d):
    b = Bound(spark, d)
    types = b.triples.filter("predicate = 'typeOf'").select(F.col("subject_id").alias("place"), F.col("object_id").alias("type"))
    return ev.affected_places("region/2", types, b.below("region/2"))


# --- topics: nations by region, with the regions below one topic ---
def _members(b):
    n = b.raw("nation").select(F.concat(F.lit("dc/topic/r"), "n_regionkey").alias("topic"), F.concat(F.lit("v"), "n_nationkey").alias("member"), F.col("n_nationkey").alias("position"))
    r = b.raw("region").select(F.lit("dc/topic/root").alias("topic"), F.concat(F.lit("dc/topic/r"), "r_regionkey").alias("member"), F.col("r_regionkey").alias("position"))
    empty = b.raw("region").select(F.lit("dc/topic/root").alias("topic"), F.concat(F.lit("dc/topic/none"), "r_regionkey").alias("member"), (F.col("r_regionkey") + 100).alias("position"))
    return n.unionByName(r).unionByName(empty)


@query("t1_topic_members", "SELECT 'dc/topic/r' || n_regionkey AS topic, 'v' || n_nationkey AS member, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS position FROM nation", base=False)
def t1(spark, d):
    n = Bound(spark, d).raw("nation")
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list("n_nationkey")), lambda k: F.concat(F.lit("v"), k)), ",")
    peers = n.groupBy("n_regionkey").agg(ordered.alias("members")).select(F.concat(F.lit("svpg/"), "n_regionkey").alias("group_id"), "members")
    lists = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k")).select(F.concat(F.lit("dc/topic/r"), "n_regionkey").alias("topic"), F.concat(F.lit("svpg/none,svpg/"), "n_regionkey", F.lit(",v"), "k").alias("members"))
    return _long(ev.topic_members(lists, peers), "position")


@query("t2_prune_empty_topics", "SELECT 'dc/topic/r' || n_regionkey AS topic, 'v' || n_nationkey AS member FROM nation UNION ALL SELECT 'dc/topic/root', 'dc/topic/r' || r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)", base=False)
def t2(spark, d):
    return ev.prune_empty_topics(_members(Bound(spark, d))).select("topic", "member")


@query("t3_topic_roots", "SELECT 'dc/topic/root' AS topic FROM region LIMIT 1", base=False)
def t3(spark, d):
    return ev.topic_roots(_members(Bound(spark, d)), "dc/topic/curated")


@query("t4_expand_topic", "SELECT 'dc/topic/root' AS topic, 'v' || n_nationkey AS variable, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS position FROM nation", base=False)
def t4(spark, d):
    root = spark.createDataFrame([("dc/topic/root",)], "topic string")
    return _long(ev.expand_topic(_members(Bound(spark, d)), root), "position")
