"""Queries on the column functions (survey C) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgframe.functions import scalars as sc
from kgframe.plans.common import Bound
from kgframe.plans.registry import query

_BYTES = "list_transform(range(octet_length(encode({0})) ), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)"
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, " + _BYTES + "), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@query("c1_facet_id", "SELECT DISTINCT import_name, measurement_method, observation_period, " + _FNV.format("import_name || '-' || measurement_method || '-' || observation_period || '--'") + "::VARCHAR AS facet_id FROM obs")
def c1(spark, d):
    o = Bound(spark, d).obs.select("import_name", "measurement_method", "observation_period", "scaling_factor", "unit").distinct()
    return o.select("import_name", "measurement_method", "observation_period", sc.facet_id(*[F.col(c) for c in ("import_name", "measurement_method", "observation_period", "scaling_factor", "unit")]).alias("facet_id"))


@query("c2_literal_id", "SELECT item_id, left(text, list_max(list_filter(range(0, 17), lambda n: octet_length(encode(left(text, n))) <= 16))) || ':' || base64(unhex(sha256(text))) AS id FROM benchmark", base=False)
def c2(spark, d):
    t = Bound(spark, d).raw("benchmark")
    return t.select("item_id", sc.literal_id(F.col("text")).alias("id"))


@query("c3_date_bounds", "SELECT DISTINCT date, (date || CASE WHEN length(date) = 4 THEN '-01-01' ELSE '-01' END)::DATE AS start_date, CASE WHEN length(date) = 4 THEN (date || '-12-31')::DATE ELSE last_day((date || '-01')::DATE) END AS end_date FROM obs")
def c3(spark, d):
    b = sc.date_bounds(F.col("date"))
    return Bound(spark, d).obs.select("date").distinct().select("date", b["start"].alias("start_date"), b["end"].alias("end_date"))


@query("c4_month_and_year", "SELECT DISTINCT date, substr(date, 1, 7) AS month, substr(date, 1, 4) AS year FROM ev")
def c4(spark, d):
    return Bound(spark, d).events.select("date", sc.month_of(F.col("date")).alias("month"), sc.year_of(F.col("date")).alias("year")).distinct()


@query("c5_domain_of", "SELECT page_id, regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '([^.]+[.][^.]+)$', 1) AS domain FROM pages", base=False)
def c5(spark, d):
    return Bound(spark, d).raw("pages").select("page_id", sc.domain_of(F.col("url")).alias("domain"))


@query("c6_dominant_type", "SELECT subject_id, CASE WHEN list_contains(types, 'Continent') THEN 'Continent' WHEN list_contains(types, 'Country') THEN 'Country' WHEN list_contains(types, 'Supplier') THEN 'Supplier' WHEN list_contains(types, 'Customer') THEN 'Customer' WHEN list_contains(types, 'Place') THEN 'Place' ELSE '' END AS dominant FROM nodes")
def c6(spark, d):
    return Bound(spark, d).nodes.select("subject_id", sc.dominant_type(F.col("types")).alias("dominant"))


@query("c7_preferred_type", "SELECT subject_id, coalesce(types[1], '') AS preferred FROM nodes")
def c7(spark, d):
    return Bound(spark, d).nodes.select("subject_id", sc.preferred_type(F.col("types")).alias("preferred"))


@query("c8_split_pascal", "SELECT DISTINCT p_brand, regexp_replace(regexp_replace(replace(replace(p_brand, '#', ''), ' ', ''), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g') AS words FROM part", base=False)
def c8(spark, d):
    return Bound(spark, d).raw("part").select("p_brand").distinct().select("p_brand", sc.split_pascal(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("words"))


@query("c10_names", "SELECT event_type, 'n_' || event_type AS snake, 'n' || array_to_string(list_transform(string_split(event_type, '_'), lambda x: upper(left(x, 1)) || substr(x, 2)), '') AS camel FROM (SELECT DISTINCT event_type FROM events)", base=False)
def c10(spark, d):
    e = Bound(spark, d).raw("events").select("event_type").distinct()
    snake = F.concat(F.lit("n_"), F.col("event_type"))
    return e.select("event_type", sc.camel_to_snake(sc.snake_to_camel(snake)).alias("snake"), sc.snake_to_camel(snake).alias("camel"))


@query("c11_recon_name", "SELECT n_name, n_nationkey, trim(lower(replace(n_name || ', X^y', ',', ''))) AS almost FROM nation WHERE false UNION ALL SELECT n_name, n_nationkey, lower(n_name) || ' xy' FROM nation", base=False)
def c11(spark, d):
    n = Bound(spark, d).raw("nation")
    return n.select("n_name", "n_nationkey", sc.recon_name(F.concat("n_name", F.lit(", X^y"))).alias("almost"))


@query("c12_complex_value_id", "SELECT p_partkey, 'Years' || p_size AS one, 'YearsUpto' || p_size AS upto, 'Years' || p_size || 'Onwards' AS onwards, 'Years' || p_size || 'To' || (p_size + 5) AS span FROM part", base=False)
def c12(spark, d):
    size = F.col("p_size").cast("string")
    of = lambda *parts: sc.complex_value_id(F.concat(F.lit("["), F.concat_ws(" ", *parts), F.lit("]")))
    return Bound(spark, d).raw("part").select(
        "p_partkey", of(size, F.lit("Years")).alias("one"), of(F.lit("Years"), F.lit("-"), size).alias("upto"), of(F.lit("Years"), size, F.lit("-")).alias("onwards"), of(F.lit("Years"), size, (F.col("p_size") + 5).cast("string")).alias("span")
    )


_COORD = "(c_custkey % 180 - 90)::DOUBLE + 0.25 AS lat, (c_custkey * 7 % 360 - 180)::DOUBLE + 0.5 AS lng"


def coordinates(b: Bound):
    c = F.col("c_custkey")
    return b.raw("customer").select("c_custkey", ((c % 180 - 90).cast("double") + 0.25).alias("lat"), ((c * 7 % 360 - 180).cast("double") + 0.5).alias("lng"))


@query("c13_latlong_id", f"SELECT c_custkey, 'latLong/' || (lat * 100000)::BIGINT || '_' || (lng * 100000)::BIGINT AS id, lat, lng FROM (SELECT c_custkey, {_COORD} FROM customer)", base=False)
def c13(spark, d):
    rows = coordinates(Bound(spark, d)).select("c_custkey", sc.latlong_id(F.col("lat"), F.col("lng")).alias("id"))
    return rows.select("c_custkey", "id", sc.parse_latlong_id(F.col("id")).alias("p")).select("c_custkey", "id", "p.lat", "p.lng")


@query("c14_magnitude", "SELECT event_id, printf('%.2f', value)::DOUBLE AS number FROM (SELECT 'event/' || event_id AS event_id, value FROM events)", base=False)
def c14(spark, d):
    return Bound(spark, d).events.select("event_id", sc.magnitude(F.col("magnitude"), "Unit").alias("number"))


@query("c15_grid_key", f"SELECT c_custkey, printf('%.1f', floor(lat / 2) * 2) || '^' || printf('%.1f', floor(lng / 2) * 2) AS tile FROM (SELECT c_custkey, {_COORD} FROM customer)", base=False)
def c15(spark, d):
    return coordinates(Bound(spark, d)).select("c_custkey", sc.grid_key(F.col("lat"), F.col("lng"), 2.0).alias("tile"))


@query("c16_parse_coordinate", f"SELECT c_custkey, lat, lng FROM (SELECT c_custkey, {_COORD} FROM customer)", base=False)
def c16(spark, d):
    rows = coordinates(Bound(spark, d)).select("c_custkey", F.concat_ws("#", "lat", "lng").alias("s"))
    return rows.select("c_custkey", sc.parse_coordinate(F.col("s")).alias("p")).select("c_custkey", "p.lat", "p.lng")


@query("c17_tokenize", "SELECT p_partkey, array_to_string(list_concat(list_filter(string_split(replace(p_name, ',', ' , '), ' '), lambda x: x <> ''), [',', 'x']), '|') AS tokens FROM part", base=False)
def c17(spark, d):
    p = Bound(spark, d).raw("part")
    return p.select("p_partkey", F.array_join(sc.tokenize(F.concat("p_name", F.lit(", x"))), "|").alias("tokens"))


@query("c18_ngrams", "SELECT p_partkey, ngram FROM (SELECT p_partkey, unnest(list_transform(range(len(w)), lambda i: array_to_string(w[i + 1 : i + n], ' '))) AS ngram, unnest(range(len(w))) AS i, n, len(w) AS len FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, n FROM part, range(1, 4) t(n))) WHERE i + n <= len", base=False)
def c18(spark, d):
    return Bound(spark, d).raw("part").select("p_partkey", F.explode(sc.word_ngrams(F.col("p_name"), 3)).alias("ngram"))


@query("c19_split_by_span", "SELECT n_nationkey, n_name || '|b c' AS parts FROM nation", base=False)
def c19(spark, d):
    n = Bound(spark, d).raw("nation")
    q = F.concat(F.col("n_name"), F.lit(" in "), F.lit("b c"))
    return n.select("n_nationkey", F.array_join(sc.split_by_span(q, F.lit("in")), "|").alias("parts"))


@query("c20_entity_kind", "SELECT subject_id, CASE WHEN subject_id LIKE 'g/%' THEN 'group' ELSE 'place' END AS kind FROM nodes")
def c20(spark, d):
    return Bound(spark, d).nodes.select("subject_id", sc.entity_kind(F.col("subject_id")).alias("kind"))


@query("c21_containment_paths", "SELECT DISTINCT child, ancestor, depth FROM (SELECT 'Country' AS child, 'Continent' AS ancestor, 1 AS depth UNION ALL SELECT 'Customer', 'Country', 1 UNION ALL SELECT 'Supplier', 'Country', 1 UNION ALL SELECT 'Customer', 'Continent', 2 UNION ALL SELECT 'Supplier', 'Continent', 2 UNION ALL SELECT 'Continent', 'Place', 1 UNION ALL SELECT 'Country', 'Place', 2 UNION ALL SELECT 'Customer', 'Place', 3 UNION ALL SELECT 'Supplier', 'Place', 3)", base=False)
def c21(spark, d):
    from kgframe.operators.graph import closure

    b = Bound(spark, d)
    t = b.triples
    types = t.filter("predicate = 'typeOf'").select("subject_id", F.col("object_id").alias("type"))
    inside = t.filter("predicate = 'containedInPlace'").select("subject_id", F.col("object_id").alias("outer"))
    links = inside.join(types, "subject_id").join(types.select(F.col("subject_id").alias("outer"), F.col("type").alias("outer_type")), "outer")
    return closure(links.select(F.col("type").alias("subject_id"), F.lit("in").alias("predicate"), F.col("outer_type").alias("object_id")).distinct(), "in")


@query("c22_convert_units", "SELECT l_orderkey, l_linenumber, l_quantity * 1000000 AS value, 'KilowattHour' AS unit FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, 'Tonne' FROM lineitem WHERE l_returnflag = 'A'", base=False)
def c22(spark, d):
    from kgframe.operators.formula import convert_units

    rows = Bound(spark, d).raw("lineitem").filter("l_returnflag IN ('R', 'A')").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("value"), F.when(F.col("l_returnflag") == "R", "GigawattHour").otherwise("Tonne").alias("unit"))
    mapping = spark.createDataFrame([("GigawattHour", "KilowattHour", 1e6)], "unit string, new_unit string, factor double")
    return convert_units(rows, mapping).select("l_orderkey", "l_linenumber", "value", "unit")


@query("c23_default_provenance", "SELECT DISTINCT entity, variable, CASE WHEN measurement_method = 'R' THEN 'dc/base/' || import_name ELSE provenance END AS provenance FROM obs")
def c23(spark, d):
    o = Bound(spark, d).obs.withColumn("provenance", F.when(F.col("measurement_method") == "R", "").otherwise(F.col("provenance")))
    return o.select("entity", "variable", sc.default_provenance(F.col("provenance"), F.col("import_name")).alias("provenance")).distinct()
