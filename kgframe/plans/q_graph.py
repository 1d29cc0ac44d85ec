"""Queries on graph traversal, hierarchy, existence and summaries (survey J, H, E, A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgframe.operators import existence as ex
from kgframe.operators import graph, labels
from kgframe.operators import hierarchy as hi
from kgframe.operators import summary as su
from kgframe.operators.observations import places_below
from kgframe.plans.common import PAIRS, VARIABLES, Bound
from kgframe.plans.registry import query


def _long(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _list(spark, column, *values):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


@query("j2_places_in", "SELECT p.object_id AS parent, p.subject_id AS child FROM triples p JOIN triples t ON t.subject_id = p.subject_id AND t.predicate = 'typeOf' AND t.object_id = 'Supplier' WHERE p.predicate = 'containedInPlace' AND p.object_id IN (SELECT 'nation/' || n_nationkey FROM nation)")
def j2(spark, d):
    b = Bound(spark, d)
    return graph.places_in(b.triples, b.places().withColumnRenamed("entity", "parent"), "Supplier")


@query("j3_entities_of_type", "SELECT DISTINCT subject_id FROM triples WHERE predicate = 'typeOf' AND object_id = 'Customer'")
def j3(spark, d):
    return graph.entities_of_type(Bound(spark, d).triples, "Customer")


@query("j4_below_by_labels", "SELECT DISTINCT ancestor AS place, child AS node FROM closure WHERE ancestor LIKE 'region/%' OR ancestor IN ('nation/7', 'Earth')")
def j4_labels(spark, d):
    """What lies below the regions, one nation and the whole, by reachability labels."""
    b = Bound(spark, d)
    wanted = b.regions().union(spark.createDataFrame([("nation/7",), ("Earth",)], "node string")).select(F.col("node").alias("place"))
    return labels.below(labels.containment_labels(b.edges, "containedInPlace"), wanted)


@query("j4_linked_containment", "SELECT DISTINCT child, ancestor FROM closure")
def j4(spark, d):
    return graph.closure(Bound(spark, d).edges, "containedInPlace").select("child", "ancestor")


@query("j6_merge_child_places", "SELECT subject_id AS child FROM triples WHERE predicate = 'containedInPlace'")
def j6(spark, d):
    e = Bound(spark, d).edges.filter("predicate = 'containedInPlace'").select(F.col("subject_id").alias("child"))
    return graph.merge_child_places(e.filter("child < 'n'"), e.filter("child > 'd'"))


@query("j7_node_properties_out", "SELECT DISTINCT subject_id AS node, predicate FROM edges WHERE subject_id LIKE 'nation/%'")
def j7(spark, d):
    b = Bound(spark, d)
    return graph.node_properties(b.edges, b.places().withColumnRenamed("entity", "node"))


@query("j7_node_properties_in", "SELECT DISTINCT object_id AS node, predicate FROM edges WHERE object_id LIKE 'nation/%'")
def j7_in(spark, d):
    b = Bound(spark, d)
    return graph.node_properties(b.edges, b.places().withColumnRenamed("entity", "node"), outward=False)


@query("j8_node_edges", "SELECT e.subject_id AS node, e.predicate, e.object_id AS object, e.provenance, coalesce(n.name, '') AS name, coalesce(array_to_string(n.types, ','), 'Thing') AS types FROM edges e LEFT JOIN nodes n ON n.subject_id = e.object_id WHERE e.subject_id LIKE 'nation/%'")
def j8(spark, d):
    b = Bound(spark, d)
    return graph.node_edges(b.edges, b.nodes, b.places().withColumnRenamed("entity", "node")).withColumn("types", F.array_join("types", ","))


@query("j9_node_edges_filtered", "SELECT e.object_id AS node, e.predicate, e.subject_id AS object FROM edges e WHERE e.predicate = 'containedInPlace' AND e.object_id LIKE 'nation/%' AND e.subject_id IN (SELECT subject_id FROM edges WHERE predicate = 'typeOf' AND object_id = 'Customer')")
def j9(spark, d):
    b = Bound(spark, d)
    return graph.node_edges_filtered(b.edges, b.nodes, b.places().withColumnRenamed("entity", "node"), "containedInPlace", {"typeOf": ["Customer"]}, outward=False).select("node", "predicate", "object")


@query("j10_node_chain", "SELECT DISTINCT child AS node, ancestor AS object FROM closure WHERE child LIKE 'customer/%'")
def j10(spark, d):
    b = Bound(spark, d)
    ids = b.raw("customer").select(F.concat(F.lit("customer/"), F.col("c_custkey")).alias("node"))
    return graph.node_chain(b.edges, ids, "containedInPlace", max_hops=4)


@query("j11_sql_node_triples", "SELECT DISTINCT t.subject_id AS node, t.predicate, t.object_id AS object, t.object_value AS value, n.name, CASE WHEN t.object_id IS NOT NULL THEN coalesce(n.types[1], 'Thing') END AS type FROM triples t LEFT JOIN nodes n ON n.subject_id = t.object_id WHERE t.predicate IN ('name', 'containedInPlace') AND t.subject_id LIKE 'nation/%'")
def j11(spark, d):
    b = Bound(spark, d)
    return graph.sql_node_triples(b.triples, b.nodes, b.places().withColumnRenamed("entity", "node"), ["name", "containedInPlace"])


@query("j12_match_patterns", "SELECT DISTINCT a.subject_id AS s, nn.object_id AS name, a.object_id AS n FROM edges a JOIN edges b ON b.subject_id = a.object_id AND b.predicate = 'containedInPlace' AND b.object_id = 'region/1' JOIN edges nn ON nn.subject_id = a.object_id AND nn.predicate = 'name' JOIN edges t ON t.subject_id = a.subject_id AND t.predicate = 'typeOf' AND t.object_id = 'Supplier' WHERE a.predicate = 'containedInPlace'")
def j12(spark, d):
    patterns = [("?s", "typeOf", "Supplier"), ("?s", "containedInPlace", "?n"), ("?n", "containedInPlace", "region/1"), ("?n", "name", "?name")]
    return graph.match_patterns(Bound(spark, d).edges, patterns, ["?s", "?n", "?name"])


@query("j13_schema_mapped_select", "SELECT DISTINCT c_custkey::VARCHAR AS c, c_name AS who, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'", base=False)
def j13(spark, d):
    b = Bound(spark, d)
    mapping = {"?c": ("customer", "c_custkey", {"name": "c_name", "segment": "c_mktsegment", "inCountry": "c_nationkey"}), "?n": ("nation", "n_nationkey", {"name": "n_name"})}
    patterns = [("?c", "segment", "BUILDING"), ("?c", "name", "?who"), ("?c", "inCountry", "?n"), ("?n", "name", "?country")]
    return graph.schema_mapped_select({"customer": b.raw("customer"), "nation": b.raw("nation")}, mapping, patterns, ["?c", "?who", "?country"])


@query("j14_resolve_ids", "SELECT DISTINCT a.object_id AS id, b.object_id AS out FROM edges a JOIN edges b ON a.subject_id = b.subject_id AND b.predicate = 'containedInPlace' WHERE a.predicate = 'name' AND a.object_id IN (SELECT n_name FROM nation)")
def j14(spark, d):
    b = Bound(spark, d)
    return graph.resolve_ids(b.edges, b.raw("nation").select(F.col("n_name").alias("id")), "name", "containedInPlace")


@query(
    "j15_resolve_entities",
    "SELECT s.entity, m.dcid, m.probability FROM (SELECT 's' || s_suppkey AS entity, s_suppkey, s_nationkey FROM supplier) s LEFT JOIN (SELECT s_suppkey, 'nation/' || n_nationkey AS dcid, 1.0::DOUBLE / count(*) OVER (PARTITION BY s_suppkey) AS probability FROM supplier JOIN nation ON n_regionkey = s_nationkey % 7) m USING (s_suppkey)",
)
def j15(spark, d):
    b = Bound(spark, d)
    s = b.raw("supplier")
    ids = s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("entity"), F.lit("regionId").alias("prop"), (F.col("s_nationkey") % 7).cast("string").alias("value")).unionByName(
        s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("entity"), F.lit("unknownId").alias("prop"), F.col("s_nationkey").cast("string").alias("value"))
    )
    id_map = b.raw("nation").select(F.lit("regionId").alias("prop"), F.col("n_regionkey").cast("string").alias("value"), F.concat(F.lit("nation/"), F.col("n_nationkey")).alias("dcid"))
    return graph.resolve_entities(ids, id_map, ["isoCode", "regionId"])


@query("j20_hydrate_names", "SELECT e.object_id AS dcid, n.name FROM (SELECT DISTINCT object_id FROM edges WHERE predicate = 'containedInPlace') e LEFT JOIN nodes n ON n.subject_id = e.object_id")
def j20(spark, d):
    b = Bound(spark, d)
    bare = b.edges.filter("predicate = 'containedInPlace'").select(F.col("object_id").alias("dcid")).distinct().withColumn("name", F.lit(None).cast("string")).withColumn("types", F.lit(None).cast("array<string>"))
    return graph.hydrate_names(bare, b.nodes).select("dcid", "name")


@query("j21_hydrate_provenance_urls", "SELECT entity, variable, date, measurement_method, observation_period, o.provenance, (SELECT max(object_value) FROM triples t WHERE t.predicate = 'url' AND t.subject_id = o.provenance) AS provenance_url FROM obs o WHERE date = '1997'")
def j21(spark, d):
    b = Bound(spark, d)
    obs = b.obs.filter("date = '1997'").withColumn("provenance_url", F.lit(""))
    return graph.hydrate_provenance_urls(obs, b.triples).select("entity", "variable", "date", "measurement_method", "observation_period", "provenance", "provenance_url")


@query("j22_all_provenances", "SELECT t.subject_id AS id, max(CASE WHEN f.predicate = 'name' THEN f.object_value END) AS name, max(CASE WHEN f.predicate = 'url' THEN f.object_value END) AS url FROM triples t JOIN triples f ON f.subject_id = t.subject_id WHERE t.predicate = 'typeOf' AND t.object_id = 'Provenance' GROUP BY 1")
def j22(spark, d):
    return graph.all_provenances(Bound(spark, d).triples)


# --- hierarchy ---
LINKS = """links AS (SELECT DISTINCT subject_id AS child, object_id AS parent, CASE WHEN predicate = 'memberOf' THEN 'variable' ELSE 'group' END AS kind FROM triples WHERE predicate IN ('memberOf', 'specializationOf')),
below AS (SELECT parent AS group_id, child AS variable FROM links WHERE kind = 'variable' UNION SELECT 'g/Root', child FROM links WHERE kind = 'variable'),
counts AS (SELECT group_id, count(*) AS n FROM below GROUP BY 1)"""


def _links(spark, d):
    return hi.parent_links(Bound(spark, d).triples)


@query("h1_all_groups", "SELECT t.subject_id AS id, n.name, p.object_id AS parent FROM triples t LEFT JOIN nodes n USING (subject_id) LEFT JOIN triples p ON p.subject_id = t.subject_id AND p.predicate = 'specializationOf' WHERE t.predicate = 'typeOf' AND t.object_id = 'StatVarGroup'")
def h1_groups(spark, d):
    return hi.all_groups(Bound(spark, d).triples)


@query("h1_all_variables", "SELECT t.subject_id AS id, n.name, t.object_id AS group_id, NULL::VARCHAR AS description FROM triples t LEFT JOIN nodes n USING (subject_id) WHERE t.predicate = 'memberOf'")
def h1_variables(spark, d):
    return hi.all_variables(Bound(spark, d).triples)


@query("h2_build_hierarchy", f"{LINKS} SELECT parent, child, kind, CASE WHEN kind = 'group' THEN coalesce(n, 0) ELSE -1 END AS n FROM links LEFT JOIN counts ON group_id = child")
def h2(spark, d):
    return _long(hi.build_hierarchy(_links(spark, d)), "n")


@query("h3_parents_from_root", f"{LINKS} SELECT DISTINCT child, parent FROM links")
def h3(spark, d):
    return hi.parents_from_root(_links(spark, d), "g/Root")


@query("h4_ancestors", f"{LINKS} SELECT child AS node, parent AS ancestor, 1 AS depth FROM links WHERE kind = 'variable' UNION ALL SELECT DISTINCT child, 'g/Root', 2 FROM links WHERE kind = 'variable'")
def h4(spark, d):
    links = _links(spark, d)
    return hi.ancestors(links, links.filter("kind = 'variable'").select(F.col("child").alias("node")).distinct())


@query("h5_prune_hierarchy", f"{LINKS}, {VARIABLES}, wanted AS (SELECT variable FROM variables WHERE variable LIKE '%1') SELECT child, parent, kind FROM links WHERE child IN (FROM wanted) OR (kind = 'group' AND child IN (SELECT group_id FROM below JOIN wanted USING (variable)))")
def h5(spark, d):
    b = Bound(spark, d)
    return hi.prune_hierarchy(_links(spark, d), b.variables().filter("variable LIKE '%1'")).select("child", "parent", "kind")


@query("h6_remove_subtree", f"{LINKS}, first AS (SELECT min(parent) AS g FROM links WHERE kind = 'variable'), gone AS (SELECT child FROM links, first WHERE parent = g) SELECT child, parent, kind FROM links, first WHERE parent <> g AND child <> g AND child NOT IN (FROM gone)")
def h6(spark, d):
    links = _links(spark, d)
    first = links.filter("kind = 'variable'").agg(F.min("parent")).first()[0]
    return hi.remove_subtree(links, first)


@query("a8_descendant_variables", f"{LINKS} SELECT group_id, variable FROM below")
def a8(spark, d):
    return hi.descendant_variables(_links(spark, d))


@query("a9_descendant_counts", f"{LINKS} SELECT group_id, n FROM counts")
def a9(spark, d):
    return hi.descendant_counts(_links(spark, d))


_SEEN = "seen AS (SELECT DISTINCT variable, entity FROM obs WHERE entity IN (SELECT 'nation/' || n_nationkey FROM nation WHERE n_regionkey = 1))"


def _seen(b):
    e = b.raw("nation").filter("n_regionkey = 1").select(F.concat(F.lit("nation/"), F.col("n_nationkey")).alias("entity"))
    return ex.entity_variables(b.obs, e)


@query("a10_group_children", f"{LINKS}, data AS (SELECT DISTINCT variable FROM obs WHERE variable LIKE '%2'), kids AS (SELECT parent AS group_id, child, kind, CASE WHEN kind = 'group' THEN coalesce(n, 0) ELSE -1 END AS n FROM links LEFT JOIN counts ON group_id = child UNION ALL SELECT g, g, 'self', coalesce(n, 0) FROM (SELECT DISTINCT parent AS g FROM links) LEFT JOIN counts ON group_id = g) SELECT k.group_id, k.child, k.kind, nodes.name, k.n, (k.child IN (FROM data) OR k.child IN (SELECT group_id FROM below JOIN data USING (variable))) AS has_data FROM kids k LEFT JOIN nodes ON subject_id = k.child")
def a10(spark, d):
    b = Bound(spark, d)
    links = _links(spark, d)
    data = b.obs.filter("variable LIKE '%2'").select("variable").distinct()
    return _long(hi.group_children(links, b.nodes, data, links.select(F.col("parent").alias("group_id")).distinct()), "n")


@query("a11_filtered_group_children", f"{LINKS}, {_SEEN}, kept AS (SELECT variable FROM seen GROUP BY 1 HAVING count(DISTINCT entity) >= 4) SELECT l.child, l.kind, count(*) AS n FROM links l JOIN below b ON b.group_id = l.child JOIN kept USING (variable) WHERE l.parent = 'g/Root' GROUP BY ALL")
def a11(spark, d):
    return _long(hi.filtered_group_children(_links(spark, d), _seen(Bound(spark, d)), "g/Root", 4), "n")


@query("a12_filtered_topic", f"{LINKS}, {_SEEN} SELECT group_id, count(DISTINCT variable) AS n FROM below JOIN seen USING (variable) GROUP BY 1")
def a12(spark, d):
    return hi.filtered_topic(_links(spark, d), _seen(Bound(spark, d)))


@query("a13_group_node_for_entities", f"{LINKS}, {_SEEN}, per AS (SELECT group_id, entity, count(*) AS c FROM below JOIN seen USING (variable) GROUP BY ALL) SELECT child, kind, coalesce((SELECT c FROM (SELECT c, row_number() OVER (ORDER BY c DESC, entity) AS r FROM per WHERE group_id = child) WHERE r = 3), 0) AS n FROM links WHERE parent = 'g/Root'")
def a13(spark, d):
    b = Bound(spark, d)
    e = b.raw("nation").filter("n_regionkey = 1").select(F.concat(F.lit("nation/"), F.col("n_nationkey")).alias("entity"))
    return _long(hi.group_node_for_entities(_links(spark, d), b.obs, "g/Root", e, 3), "n")


@query("c9_specialized_entity", "WITH k AS (SELECT DISTINCT 'dc/g/Root' AS group_id, 'dc/g/' || CASE WHEN p_size % 2 = 0 THEN 'Person' ELSE 'Household' END || '_' || replace(p_type, ' ', '_') AS child, split_part(p_type, ' ', 1) AS e, CASE WHEN p_size % 2 = 0 THEN 'Individual' ELSE 'Household' END AS pop FROM part) SELECT group_id, child, CASE WHEN count(*) OVER (PARTITION BY e) > 1 THEN e || ' (' || pop || ')' ELSE e END AS specialized_entity FROM k", base=False)
def c9(spark, d):
    p = Bound(spark, d).raw("part")
    child = F.concat(F.lit("dc/g/"), F.when(F.col("p_size") % 2 == 0, "Person").otherwise("Household"), F.lit("_"), F.replace("p_type", F.lit(" "), F.lit("_")))
    return hi.specialized_entities(p.select(F.lit("dc/g/Root").alias("group_id"), child.alias("child"), F.col("p_type").alias("name")).distinct()).select("group_id", "child", "specialized_entity")


@query("k8_sort_group_children", f"{LINKS} SELECT parent AS group_id, child, row_number() OVER (PARTITION BY parent ORDER BY child) AS position FROM links")
def k8(spark, d):
    return _long(hi.sort_group_children(_links(spark, d).select(F.col("parent").alias("group_id"), "child"), "child"), "position")


# --- existence ---
@query("e1_entity_variables", "SELECT DISTINCT entity, variable FROM obs")
def e1(spark, d):
    return ex.entity_variables(Bound(spark, d).obs)


@query("e2_variables_by_slot", "SELECT DISTINCT variable_measured AS variable, entity1 AS entity, 1 AS slot FROM flows UNION ALL SELECT DISTINCT variable_measured, entity2, 2 FROM flows WHERE entity2 IS NOT NULL UNION ALL SELECT DISTINCT variable_measured, entity3, 3 FROM flows WHERE entity2 IS NOT NULL AND entity3 IS NOT NULL")
def e2(spark, d):
    return ex.variables_by_slot(Bound(spark, d).flows)


_VS = "vs AS (SELECT DISTINCT variable, t.object_id AS source FROM obs JOIN triples t ON t.subject_id = obs.provenance AND t.predicate = 'source')"


@query("e3_existence", f"{LINKS}, {_SEEN}, {_VS} SELECT variable AS item, entity AS target FROM seen UNION ALL SELECT DISTINCT group_id, entity FROM below JOIN seen USING (variable) UNION ALL SELECT variable, source FROM vs UNION ALL SELECT DISTINCT group_id, source FROM below JOIN vs USING (variable)")
def e3(spark, d):
    b = Bound(spark, d)
    links, seen = _links(spark, d), _seen(b)
    sources = _list(spark, "source", "source/O", "source/F")
    variables = b.obs.select("variable").distinct()
    items = variables.select(F.col("variable").alias("item")).union(links.select("parent")).distinct()
    targets = seen.select(F.col("entity").alias("target")).distinct().union(sources)
    return ex.existence_by_kind(items, targets, b.obs, links, b.edges)


@query("e4_variable_source_existence", f"{_VS}, {VARIABLES} SELECT variable, source FROM vs WHERE source = 'source/O' AND variable IN (FROM variables)")
def e4(spark, d):
    b = Bound(spark, d)
    return ex.variable_source_existence(b.obs, b.edges, b.variables(), _list(spark, "source", "source/O"))


@query("e5_group_source_existence", f"{LINKS}, {_VS} SELECT DISTINCT group_id, source FROM below JOIN vs USING (variable) WHERE source = 'source/F'")
def e5(spark, d):
    b = Bound(spark, d)
    return ex.group_source_existence(b.obs, b.edges, _links(spark, d), _list(spark, "source", "source/F"))


@query("e6_group_place_existence", f"{LINKS}, s AS (SELECT DISTINCT variable, entity FROM obs) SELECT DISTINCT group_id, entity FROM below JOIN s USING (variable)")
def e6(spark, d):
    b = Bound(spark, d)
    return ex.group_place_existence(b.obs, _links(spark, d), b.places())


@query("e7_count_sv_svg", f"{LINKS}, {_SEEN} SELECT variable AS item, entity, 0 AS n FROM seen UNION ALL SELECT group_id, entity, count(*) FROM below JOIN seen USING (variable) GROUP BY ALL")
def e7(spark, d):
    b = Bound(spark, d)
    links = _links(spark, d)
    items = b.obs.select(F.col("variable").alias("item")).union(links.select("parent")).distinct()
    return ex.count_sv_svg(_seen(b), links, items, b.places())


@query("e8_count_with_formulas", f"{PAIRS}, formulas AS (SELECT 'Ratio_' || p_brand AS output, 'Qty_' || p_brand AS input FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'Ratio_' || p_brand, 'Qty_Brand#11' FROM (SELECT DISTINCT p_brand FROM part)), s AS (SELECT DISTINCT variable, entity FROM obs), wanted AS (SELECT variable, entity FROM pairs UNION ALL SELECT replace(variable, 'Qty_', 'Ratio_'), entity FROM pairs) SELECT variable, entity, 'data' AS how FROM wanted JOIN s USING (variable, entity) UNION ALL SELECT w.variable, w.entity, 'formula' FROM wanted w WHERE w.variable LIKE 'Ratio_%' AND (w.entity, replace(w.variable, 'Ratio_', 'Qty_')) IN (SELECT (entity, variable) FROM s) AND (w.entity, 'Qty_Brand#11') IN (SELECT (entity, variable) FROM s)")
def e8(spark, d):
    b = Bound(spark, d)
    ratio = F.replace(F.col("variable"), F.lit("Qty_"), F.lit("Ratio_"))
    wanted = b.pairs().unionByName(b.pairs().withColumn("variable", ratio))
    v = b.pairs().select("variable").distinct()
    formulas = v.select(ratio.alias("output"), ratio.alias("formula_id"), F.explode(F.array("variable", F.lit("Qty_Brand#11"))).alias("input"))
    return ex.count_with_formulas(b.obs, wanted, formulas)


@query("e9_filter_variables_by_entity", f"{VARIABLES} SELECT variable FROM variables WHERE variable IN (SELECT variable FROM obs WHERE entity = 'nation/7')")
def e9(spark, d):
    b = Bound(spark, d)
    return ex.filter_variables_by_entity(b.obs, b.variables(), _list(spark, "entity", "nation/7"))


@query("e10_existing_groups", f"{LINKS} SELECT DISTINCT 'g/' || p_type AS id FROM part WHERE 'g/' || p_type IN (SELECT subject_id FROM triples WHERE predicate = 'typeOf' AND object_id = 'StatVarGroup')")
def e10(spark, d):
    b = Bound(spark, d)
    ids = b.raw("part").select(F.explode(F.array(F.concat(F.lit("g/"), F.col("p_type")), F.concat(F.lit("x/"), F.col("p_type")))).alias("id")).distinct()
    return ex.existing_groups(b.triples, ids)


@query("e13_place_availability", f"{PAIRS} SELECT variable, entity, (variable, entity) IN (SELECT (variable, entity) FROM obs WHERE date = '1996-02') AS available FROM pairs")
def e13(spark, d):
    b = Bound(spark, d)
    return ex.place_availability(b.obs.filter("date = '1996-02'"), b.pairs())


# --- summaries ---
_TYPED = "typed AS (SELECT o.*, t.object_id AS entity_type FROM obs o JOIN triples t ON t.subject_id = o.entity AND t.predicate = 'typeOf')"
_KEYS = "variable, provenance, measurement_method, observation_period, scaling_factor, unit"
_A2 = f"{_TYPED}, a2 AS (SELECT {_KEYS}, entity_type, min(date) AS earliest, max(date) AS latest, min(value) AS min_value, max(value) AS max_value, count(*) AS obs_count, count(DISTINCT entity) AS entities, array_to_string(list_slice(list_sort(list(DISTINCT entity)), 1, 3), ',') AS sample FROM typed GROUP BY ALL)"


@query("a1_statvar_place_type_summary", f"{_TYPED} SELECT variable, entity_type, count(DISTINCT entity) AS entities, min(value) AS min_value, max(value) AS max_value, array_to_string(list_slice(list_sort(list(DISTINCT entity)), 1, 3), ',') AS sample FROM typed GROUP BY ALL")
def a1(spark, d):
    b = Bound(spark, d)
    return su.statvar_place_type_summary(b.obs, b.triples)


@query("a2_statvar_provenance_summary", f"{_A2} SELECT a2.*, n.name AS provenance_name FROM a2 LEFT JOIN nodes n ON n.subject_id = a2.provenance")
def a2(spark, d):
    b = Bound(spark, d)
    return su.statvar_provenance_summary(b.obs, b.triples)


_ROLL = "min(earliest) AS earliest, max(latest) AS latest, min(min_value) AS min_value, max(max_value) AS max_value, sum(obs_count)::BIGINT AS obs_count, sum(entities)::BIGINT AS entities, array_to_string(list_sort(list(DISTINCT entity_type)), ',') AS entity_types"


@query("a2_statvar_provenance_summary_null_facets", f"{_A2} SELECT a2.*, n.name AS provenance_name FROM a2 LEFT JOIN nodes n ON n.subject_id = a2.provenance", sparse=True)
def a2_nulls(spark, d):
    b = Bound(spark, d, sparse=True)
    return su.statvar_provenance_summary(b.obs, b.triples)


@query("a3_series_rollup", f"{_A2} SELECT {_KEYS}, {_ROLL} FROM a2 GROUP BY ALL")
def a3(spark, d):
    b = Bound(spark, d)
    return su.series_rollup(su.statvar_provenance_summary(b.obs, b.triples))


@query("a14_provenance_summary_by_variable", f"{_A2} SELECT variable, provenance, {_ROLL} FROM a2 GROUP BY ALL")
def a14(spark, d):
    b = Bound(spark, d)
    return su.series_rollup(su.statvar_provenance_summary(b.obs, b.triples), "provenance")


@query("a4_entity_count_by_date", "SELECT variable, date, provenance, count(DISTINCT entity) AS entities FROM obs GROUP BY ALL")
def a4(spark, d):
    return su.entity_count_by_date(Bound(spark, d).obs)


_F = "import_name, provenance_url, measurement_method, observation_period, scaling_factor, unit"


@query("a5_observation_dates_in", f"SELECT *, row_number() OVER (PARTITION BY variable, date ORDER BY entities DESC, {_F}) AS position FROM (SELECT variable, date, {_F}, count(DISTINCT entity) AS entities FROM obs WHERE entity IN (SELECT child FROM closure WHERE ancestor = 'region/2') GROUP BY ALL)")
def a5(spark, d):
    b = Bound(spark, d)
    inside = places_below(b.edges, "region/2")
    return _long(su.observation_dates(b.obs.join(inside, "entity", "left_semi")), "position")


@query("a6_facet_stats", f"SELECT variable, entity, {_F}, obs_count, earliest, latest, facet_rank FROM ranked")
def a6(spark, d):
    return _long(Bound(spark, d).ranked.select("variable", "entity", *_F.split(", "), "obs_count", "earliest", "latest", "facet_rank"), "facet_rank")


@query("a7_facet_stats_contained", f"SELECT variable, {_F}, count(*) AS obs_count, min(date) AS earliest, max(date) AS latest, count(DISTINCT entity) AS entities FROM obs WHERE entity IN (SELECT child FROM closure WHERE ancestor = 'region/2') GROUP BY ALL")
def a7(spark, d):
    from kgframe.operators.facets import facet_stats_contained

    b = Bound(spark, d)
    return facet_stats_contained(b.obs.join(places_below(b.edges, "region/2"), "entity", "left_semi"))


@query("a15_variable_facet_metadata", f"SELECT variable, {_F}, count(*) AS obs_count, min(date) AS earliest, max(date) AS latest, count(DISTINCT entity) AS entities, 'Country' AS place_types FROM obs GROUP BY ALL")
def a15(spark, d):
    b = Bound(spark, d)
    return su.variable_facet_metadata(b.obs, b.triples)


@query("a15_variable_facet_metadata_null_facets", f"SELECT variable, {_F}, count(*) AS obs_count, min(date) AS earliest, max(date) AS latest, count(DISTINCT entity) AS entities, 'Country' AS place_types FROM obs GROUP BY ALL", sparse=True)
def a15_nulls(spark, d):
    b = Bound(spark, d, sparse=True)
    return su.variable_facet_metadata(b.obs, b.triples)


@query("a16_facet_usage_log", f"SELECT variable, {_F}, count(DISTINCT entity) AS series, min(substr(date, 1, 4)) AS first_year, max(substr(date, 1, 4)) AS last_year FROM obs GROUP BY ALL")
def a16(spark, d):
    return su.facet_usage_log(Bound(spark, d).obs)


@query("a17_ingestion_low_water_mark", "SELECT min(ts) AS low_water_mark FROM events WHERE ts > (SELECT max(ts) FROM events WHERE user_id % 50 = 3)", base=False)
def a17(spark, d):
    e = Bound(spark, d).raw("events")
    return su.ingestion_low_water_mark(e.select(F.col("ts").alias("created"), F.when(F.col("user_id") % 50 == 3, "SUCCESS").otherwise("FAILED").alias("status")))
