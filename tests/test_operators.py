"""Cases that the test tables don't hold: cycles, ties, empty tables, nulls."""

import pytest
from pyspark.sql import functions as F

from kgframe.functions import scalars as sc
from kgframe.operators import events, formula, graph, merge, observations, sdmx, search
from kgframe.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_closure_ends_on_cycles_and_empty_tables(spark):
    edges = spark.createDataFrame([("a", "in", "b"), ("b", "in", "c"), ("c", "in", "a")], "subject_id string, predicate string, object_id string")
    assert len(graph.closure(edges, "in", 10).collect()) == 9
    assert graph.closure(edges.filter("false"), "in", 10).count() == 0


def test_chain_is_bounded_by_hops(spark):
    edges = spark.createDataFrame([(f"n{i}", "in", f"n{i + 1}") for i in range(8)], "subject_id string, predicate string, object_id string")
    ids = spark.createDataFrame([("n0",)], "node string")
    assert graph.node_chain(edges, ids, "in", max_hops=3).count() == 3


def test_patterns_without_a_shared_variable_are_refused(spark):
    edges = spark.createDataFrame([("a", "p", "b")], "subject_id string, predicate string, object_id string")
    with pytest.raises(ValueError):
        graph.match_patterns(edges, [("?x", "p", "?y"), ("?z", "p", "?w")], ["?x"])


def test_fnv_and_dates(spark):
    df = spark.createDataFrame([("é1", "2024-02"), ("", "2023"), (None, "x")], "s string, d string")
    got = df.select(sc.fnv1a(F.col("s")), sc.date_bounds(F.col("d"))["end"].cast("string")).collect()
    assert got[0][0] == 580235728 and got[0][1] == "2024-02-29"
    assert got[1][0] == 2166136261 and got[1][1] == "2023-12-31"
    assert got[2][1] is None


def test_literal_id_is_cut_between_characters(spark):
    got = spark.createDataFrame([("ä" * 20,)], "s string").select(sc.literal_id(F.col("s"))).first()[0]
    assert got.startswith("ä" * 8 + ":")


def test_split_pascal_and_kinds(spark):
    df = spark.createDataFrame([("CountPersonUSA2020Total", "dc/topic/x")], "s string, i string")
    assert df.select(sc.split_pascal(F.col("s")), sc.entity_kind(F.col("i"))).first() == ("Count Person USA 2020 Total", "topic")


def test_division_by_zero(spark):
    cols = ", ".join(f"{c} string" for c in ["variable", "entity", *observations.FACET, "date"]) + ", value double"
    one = spark.createDataFrame([("a", "e", *["f"] * 6, "2020", 1.0)], cols)
    zero = one.withColumn("value", F.lit(0.0))
    with pytest.raises(Exception):
        formula.eval_formula({"a": one, "b": zero}, lambda a, b: a / b, "r").collect()
    assert formula.eval_formula({"a": one, "b": zero}, lambda a, b: F.try_divide(a, b), "r", "null").count() == 0


def test_interleave_stops_where_a_round_adds_nothing(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3), ("z", 4)], "dcid string, rank int")
    b = spark.createDataFrame([("y", 1), ("w", 2), ("y", 3)], "dcid string, rank int")
    assert [r["dcid"] for r in merge.merge_search_interleave([a, b]).collect()] == ["x", "y", "w"]


def test_sdmx_constraints(spark):
    with pytest.raises(ValueError):
        sdmx.sdmx_where({"entity1": ["a"]})
    with pytest.raises(ValueError):
        sdmx.sdmx_where({"variableMeasured": ["v"], "TIME_PERIOD": ["LATEST", "2020"]})


def test_point_in_polygon_with_hole_and_bad_json(spark):
    square = '{"type":"Polygon","coordinates":[[[0,0],[9,0],[9,9],[0,9],[0,0]],[[3,3],[6,3],[6,6],[3,6],[3,3]]]}'
    df = spark.createDataFrame([(1, 1.0, 1.0, square), (2, 4.0, 4.0, square), (3, 1.0, 1.0, "{"), (4, 1.0, 1.0, None)], "id int, lat double, lng double, geojson string")
    assert rows(search.point_in_polygon(df, ["id"])) == [(1,)]


def test_topics_with_a_cycle(spark):
    m = spark.createDataFrame([("dc/topic/a", "dc/topic/b", 0), ("dc/topic/b", "dc/topic/a", 0), ("dc/topic/b", "v", 1), ("dc/topic/c", "dc/topic/d", 0)], "topic string, member string, position int")
    got = events.expand_topic(m, spark.createDataFrame([("dc/topic/a",)], "topic string"))
    assert rows(got) == [("dc/topic/a", "v", 1)]
    assert rows(events.prune_empty_topics(m).select("topic").distinct()) == [("dc/topic/a",), ("dc/topic/b",)]


def test_decode_attributes(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x", "c": {"d": 1}}',), ("[1]",), (None,)], "j string")
    got = [r[0] for r in df.select(tables.decode_attributes("j")).collect()]
    assert got[0] == {"a": "1", "b": "x"} and not got[2]


def test_validate_tables_reports_what_is_missing(spark):
    got = rows(tables.validate_tables(spark, {"triples": spark.createDataFrame([], "subject_id string")}, {"triples": tables.TRIPLES, "nodes": tables.NODES}))
    assert ("nodes", "missing table", None) in got and len(got) == 4


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("geoId/01", "v", "2023", 1.0, "p", "", "", "m", "P1Y", "")], tables.OBSERVATIONS)
    df.write.option("header", True).csv(str(tmp_path / "o"))
    assert tables.load_observations(spark, str(tmp_path / "o"), "csv").select("entity", "value").collect() == [("geoId/01", 1.0)]


def test_recognize_places_keeps_populous_places_and_long_names(spark):
    from kgframe.operators import search

    rows = [("spring field", f"p{i:02d}", 5000 - i) for i in range(18)] + [("spring field", f"q{i}", 1999 - i) for i in range(3)] + [("one two three four five six seven eight", "long", 7)]
    queries = spark.createDataFrame([(1, "In Spring Field now"), (2, "see one two three four five six seven eight")], "query_id int, query string")
    found = search.recognize_places(queries, spark.createDataFrame(rows, "name string, dcid string, population long")).collect()
    assert sorted(r["dcid"] for r in found if r["query_id"] == 1) == [f"p{i:02d}" for i in range(18)]
    assert [(r["dcid"], r["n_words"]) for r in found if r["query_id"] == 2] == [("long", 8)]
    few = spark.createDataFrame([("spring field", f"p{i:02d}", 10 + i) for i in range(20)], "name string, dcid string, population long")
    assert search.recognize_places(queries, few).count() == 15
    assert search.recognize_places(queries, few.filter("false")).count() == 0


def test_loops_reach_the_end_of_long_chains(spark):
    from kgframe.operators import events, graph, hierarchy

    n = 14
    edges = spark.createDataFrame([(f"n{i}", "in", f"n{i + 1}") for i in range(n)] + [(f"n{n}", "in", f"n{n - 1}")], "subject_id string, predicate string, object_id string")
    assert graph.closure(edges, "in").filter("child = 'n0'").count() == n
    links = spark.createDataFrame([("v", "g0", "variable")] + [(f"g{i}", f"g{i + 1}", "group") for i in range(n)], "child string, parent string, kind string")
    assert hierarchy.descendant_variables(links).count() == n + 1
    members = [(f"dc/topic/{i}", f"dc/topic/{i + 1}", 0) for i in range(n)] + [(f"dc/topic/{n}", "v", 0), ("dc/topic/0", "dc/topic/empty", 1)]
    topics = spark.createDataFrame(members, "topic string, member string, position int")
    assert events.prune_empty_topics(topics).count() == n + 1
    assert [r["variable"] for r in events.expand_topic(topics, spark.createDataFrame([("dc/topic/0",)], "topic string")).collect()] == ["v"]


def test_null_facets_meet(spark, tmp_path):
    from kgframe.operators import agent, facets, formula, summary

    (tmp_path / "o.csv").write_text("entity,variable,date,value,provenance,unit,scaling_factor,measurement_method,observation_period,properties\ngeoId/01,v,2023,1,p,,,,,\ngeoId/01,v,2024,3,p,,,,,\ngeoId/02,v,2023,2,p,,,,,\ngeoId/01,w,2023,4,p,,,,,\n")
    obs = tables.load_observations(spark, str(tmp_path / "o.csv"), "csv").withColumns({"import_name": F.lit("i"), "provenance_url": F.lit(None).cast("string")})
    assert obs.filter("unit is null and measurement_method is null").count() == 4
    rules = spark.createDataFrame([("i", None, None, None, 5), ("i", "m", None, None, 1)], "import_name string, measurement_method string, observation_period string, unit string, score int")
    ranked = facets.facet_stats(obs, rules)
    assert {r["score"] for r in ranked.collect()} == {5}
    assert rows(facets.best_value(obs, ranked)) == [("v", "geoId/01", "2024", 3.0, 1), ("v", "geoId/02", "2023", 2.0, 1), ("w", "geoId/01", "2023", 4.0, 1)]
    assert rows(facets.best_value(obs, ranked, "2023")) == [("v", "geoId/01", "2023", 1.0, 1), ("v", "geoId/02", "2023", 2.0, 1), ("w", "geoId/01", "2023", 4.0, 1)]
    assert facets.bulk_series(obs, rules).count() == 4
    assert formula.eval_formula({"a": formula.operand(obs, "v"), "b": formula.operand(obs, "w")}, lambda a, b: a + b, "s").select("entity", "value").collect() == [("geoId/01", 5.0)]
    types = spark.createDataFrame([("geoId/01", "typeOf", "State", None), ("geoId/02", "typeOf", "State", None)], tables.TRIPLES)
    assert [(r["variable"], r["obs_count"], r["sample"]) for r in summary.statvar_provenance_summary(obs, types).orderBy("variable").collect()] == [("v", 3, "geoId/01,geoId/02"), ("w", 1, "geoId/01")]
    assert {r["place_types"] for r in summary.variable_facet_metadata(obs, types).collect()} == {"State"}
    points = facets.ranked_points(obs, rules)
    assert agent.get_observations_table(points).count() == 4
    assert rows(agent.get_observations_table(points, end="2023", mode="latest")) == [("v", "geoId/01", "2023", 1.0), ("v", "geoId/02", "2023", 2.0), ("w", "geoId/01", "2023", 4.0)]
    assert facets.select_primary_source(points, override="none").count() == 2


def test_sdmx_csv_has_crlf_lines(spark, tmp_path):
    df = spark.createDataFrame([("dataflow", "id", "I", "a", None)], "STRUCTURE string, STRUCTURE_ID string, ACTION string, entity1 string, OBS_VALUE string").coalesce(1)
    sdmx.write_sdmx_csv(df, str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("*.csv"))
    assert text == b"STRUCTURE,STRUCTURE_ID,ACTION,entity1,OBS_VALUE\r\ndataflow,id,I,a,\r\n"


def test_languages_by_property(spark):
    df = spark.createDataFrame([("name", "Haus@DE"), ("name", "house@en"), ("label", "x@fr"), ("label", None)], "predicate string, object_value string")
    assert rows(graph.filter_lang(df, ["en"], {"label": ["fr"]})) == [("label", "x@fr"), ("name", "house@en")]
    assert graph.filter_lang(df).count() == 4 and graph.filter_lang(df, ["de"]).count() == 1


def test_specialized_names(spark):
    from kgframe.operators import hierarchy

    cases = [
        ("dc/g/Root", "dc/g/Person_Gender", "n", "Gender"), ("dc/g/Person_Gender", "dc/g/Person_Gender-Female", "n", "Female (Individual)"), ("dc/g/Person_Gender", "dc/g/Household_Female", "n", "Household"),
        ("dc/g/Person_Gender", "dc/g/Person_Female-x", "n", "Female (Individual)"), ("dc/g/Root", "dc/g/SDG_1", "Goal 1", "Goal 1"), ("dc/g/Root", "dc/g/Farm", "Farms", "Farms"), ("dc/g/Root", "dc/g/MortalityEvent_CauseOfDeath", "n", "Mortality Event"),
    ]
    df = spark.createDataFrame([(p, c, n) for p, c, n, _ in cases], "group_id string, child string, name string")
    got = {r["child"]: r["specialized_entity"] for r in hierarchy.specialized_entities(df).collect()}
    assert got == {c: want for _, c, _, want in cases}


def test_abbreviations_zip_codes_and_bogus_names(spark):
    d = search.place_dictionary(
        spark.createDataFrame([("p/1", "Reading", 100), ("p/2", "Utah", 50)], "dcid string, name string, population long"), spark.createDataFrame([("p/1", "England")], "dcid string, container_name string"),
        spark.createDataFrame([("p/1", "Redinges")], "dcid string, name string"), spark.createDataFrame([("p/2", "Utahn")], "dcid string, adjective string"), ["people"],
    )
    assert {r["name"] for r in d.collect()} == {"reading", "redinges", "reading england", "redinges england", "utah", "utahn people"}
    q = spark.createDataFrame([(1, "jobs in UT for Utahn people"), (2, "ut 94043 reading England"), (3, None), (4, " , ")], "query_id int, query string")
    short = spark.createDataFrame([("UT", "p/2", 50)], "name string, dcid string, population long")
    codes = spark.createDataFrame([("94043", "zip/94043", 1)], "name string, dcid string, population long")
    got = [r[:4] for r in search.recognize_places(q, d, abbreviations=short, zip_codes=codes).orderBy("query_id", "start").collect()]
    assert got == [(1, 2, 1, "p/2"), (1, 4, 2, "p/2"), (2, 1, 1, "zip/94043"), (2, 2, 2, "p/1")]
    assert search.recognize_places(q, d, bogus=["Reading England", "reading", "utahn people"]).count() == 0


def test_places_merge_with_what_contains_them(spark):
    names = spark.createDataFrame([("reading", "rd/uk", 9), ("reading", "rd/us", 5), ("england", "en", 50), ("uk", "uk", 60), ("pa", "pa", 40)], "name string, dcid string, population long")
    inside = spark.createDataFrame([("rd/uk", "en"), ("en", "uk"), ("rd/us", "pa")], "dcid string, container string")
    rows = [(1, "Reading, England, UK"), (2, "reading England uk"), (3, "reading PA"), (4, "England,reading"), (5, "reading in PA"), (6, "reading"), (7, "Reading, PA, UK"), (8, None), (9, "reading, , PA")]
    q = spark.createDataFrame(rows, "query_id int, query string")
    got = [r[:4] for r in search.recognize_places(q, names, containment=inside, bogus=["reading"]).orderBy("query_id", "start", "position").collect()]
    assert got == [(1, 0, 5, "rd/uk"), (2, 0, 2, "rd/uk"), (2, 2, 1, "uk"), (3, 0, 2, "rd/us"), (4, 0, 1, "en"), (5, 2, 1, "pa"), (7, 0, 5, "rd/us"), (9, 3, 1, "pa")]


def test_entities_cover_a_query_without_overlaps(spark):
    names = spark.createDataFrame([("New York", "ny"), ("York City", "yc"), ("New York City", "nyc"), ("Reading", "rd"), ("York", "y")], "name string, dcid string")
    q = spark.createDataFrame([(1, "New York City and York"), (2, "reading in City Reading")], "query_id int, query string")
    common = spark.createDataFrame([("reading", "City")], "name string, type string")
    got = [tuple(r) for r in search.recognize_entities(q, names, common=common).orderBy("query_id", "start").collect()]
    assert got == [(1, 0, 3, "new york city", "nyc"), (1, 4, 1, "york", "y"), (2, 2, 2, "reading", "rd")]


def test_similar_places_and_pages(spark):
    from kgframe.operators import agent

    cohorts = spark.createDataFrame([("c", f"p{i}") for i in range(9)] + [("d", "p0"), ("d", "alone"), ("e", "solo")], "cohort string, place string")
    got = agent.similar_in_cohorts(spark.createDataFrame([("p0",), ("solo",)], "place string"), cohorts, 3).collect()
    assert len(got) == 3 and all(r["place"] == "p0" and r["related"] != "p0" for r in got)


def test_written_tables_are_released(spark):
    import os

    from kgframe.sources import shared

    df = shared.written(spark.range(3), "x")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and shared.release(spark) > 0 and not os.path.exists(path)


def test_ranks_over_ranges(spark):
    """One variable holds most points, with ties across ranges, nulls and repeated rows."""
    import random

    from kgframe.operators import facets

    draw = random.Random(1)
    rows = [("a", f"e{i}", float(draw.randrange(40))) for i in range(2000)] + [("a", "null", None), ("a", "null2", None), ("b", "x", 1.0), ("b", "x", 1.0), (None, "y", 2.0), ("c", "z", None)]
    df = spark.createDataFrame(rows, "variable string, entity string, value double")
    got = {(r["variable"], r["entity"]): (r["rank_from_top"], r["rank_from_bottom"], r["total"]) for r in facets.location_rankings(df).collect()}
    for v, e, x in rows:
        mine = [y for w, _, y in rows if w == v]
        solid = [y for y in mine if y is not None]
        top = 1 + sum(y > x for y in solid) if x is not None else 1 + len(solid)
        bottom = 1 + len(mine) - len(solid) + sum(y < x for y in solid) if x is not None else 1
        assert got[v, e] == (top, bottom, len(mine)), (v, e)
    assert facets.location_rankings(df).count() == len(rows)
    assert facets.location_rankings(df.filter("false")).count() == 0


def test_prefixes_by_ranges(spark):
    from kgframe.operators import search

    tokens = [f"{a}{b}{c}" for a in "abé" for b in "xyz￿" for c in ("", "1", "\U0010ffff", "ab")] + ["a", "", None]
    words = ["a", "ax", "é", "éz", "b￿", "\U0010ffff", "zz", "", "ax1ab", None]
    df = spark.createDataFrame([(t,) for t in tokens * 2], "token string").repartition(5)
    got = sorted(map(tuple, search.prefix_matches(spark.createDataFrame([(w,) for w in words], "word string"), df).collect()))
    assert got == sorted((w, t) for w in words if w is not None for t in set(tokens) if t is not None and t.startswith(w))


def test_runs_are_made_only_where_names_begin(spark):
    from kgframe.operators import search
    from pyspark.sql import functions as F

    names = spark.createDataFrame([("new york city",), ("york",), ("new york",)], "name string")
    words = " ".join(["filler"] * 20_000 + ["new", "york", "city"])
    q = spark.createDataFrame([(1, words)], "query_id int, query string").select("query_id", F.split("query", " ").alias("w"))
    assert sorted((r["start"], r["n_words"]) for r in search.name_runs(q, names, "name").collect()) == [(20000, 2), (20000, 3), (20001, 1)]
    found = search.recognize_places(spark.createDataFrame([(1, words)], "query_id int, query string"), names.selectExpr("name", "name AS dcid", "1 AS population"))
    assert [(r["start"], r["n_words"]) for r in found.collect()] == [(20000, 3)]


def test_derived_series_ties(spark):
    """Of equally long lists of dates the greatest wins; lists that only one operand has don't count."""
    from kgframe.operators import formula
    from kgframe.operators.observations import FACET
    from pyspark.sql import functions as F

    def points(series):
        rows = [("e", d, float(i), name) for name, dates in series.items() for i, d in enumerate(dates)]
        return spark.createDataFrame(rows, "entity string, date string, value double, import_name string").withColumns({c: F.lit(None).cast("string") for c in FACET if c != "import_name"})

    a = {"p": ["2001", "2002", "2005"], "q": ["2001", "2003", "2004"], "r": ["2001", "2003", "2004"], "s": ["2000", "2001", "2002", "2003"], "t": ["2001"]}
    b = {"p": ["2001", "2002", "2005"], "u": ["2001", "2003", "2004"], "s": ["2000", "2001", "2002", "2004"]}
    out = formula.derived_series({"a": points(a), "b": points(b)}, lambda a, b: a * 10 + b, "S").collect()
    assert sorted((r["date"], r["value"]) for r in out) == [("2001", 0.0), ("2003", 11.0), ("2004", 22.0)]
    assert formula.derived_series({"a": points(a).filter("false"), "b": points(b)}, lambda a, b: a + b, "S").collect() == []


def test_ranked_names(spark):
    from kgframe.operators import search

    nodes = spark.createDataFrame([(f"n{i}", f"common name {i}") for i in range(300)] + [("x", "rare thing"), ("y", "rare common thing"), ("z", None), ("w", "")], "subject_id string, name string")
    q = spark.createDataFrame([("rare common",), ("common",), ("",), (None,), ("nothing here",)], "query string")
    got = search.rank_nodes(q, nodes, limit=5).collect()
    assert [r["subject_id"] for r in sorted((r for r in got if r["query"] == "rare common"), key=lambda r: r["position"])] == ["x", "y"] or {r["subject_id"] for r in got if r["query"] == "rare common"} == {"x", "y"}
    assert sum(r["query"] == "common" for r in got) == 5 and {r["query"] for r in got} == {"rare common", "common"}


def test_answers_for_observations(spark):
    from kgframe.operators import agent

    points = spark.createDataFrame(
        [("v", "a", "x", None, "f1", "2001", "1"), ("v", "a", "x", None, "f1", "2002", "n/a"), ("v", "b", "x", None, None, "2003", "3"), ("v", "a", "y", None, "f2", "2001", "5"), ("v", "b", "y", None, "f2", "2001", "6"), ("v", "a", "x", "z", "f2", "2009", "7"), ("w", "a", "x", None, "f2", "2009", "8")],
        "variable_measured string, entity1 string, entity2 string, entity3 string, facet_id string, date string, value string",
    )
    edges = spark.createDataFrame([("a", "containedInPlace", "top"), ("b", "containedInPlace", "a"), ("c", "containedInPlace", "top")], "subject_id string, predicate string, object_id string")
    types = spark.createDataFrame([("a", "T"), ("b", "T"), ("c", "T")], "place string, type string")
    nodes = spark.createDataFrame([("a", "Ay", ["T"])], "subject_id string, name string, types array<string>")
    ask = lambda **how: agent.observations_answer(points, "v", {"entity1": ("top", "T"), "entity2": ["x", "y"]}, edges, types, nodes, **how)
    got = ask()
    assert [tuple(r) for r in got.data.collect()] == [("a", "y", "2001", "5", 5.0), ("b", "y", "2001", "6", 6.0)]
    assert sorted(tuple(r) for r in got.entities.collect()) == [("a", "Ay", ["T"]), ("b", "", []), ("x", "", []), ("y", "", [])]
    assert [(r["facet_id"], r["series"], r["points"]) for r in sorted(got.sources.collect(), key=lambda r: r["source_rank"])] == [("f2", 2, 2), ("f1", 1, 2), ("unknown", 1, 1)]
    assert [tuple(r) for r in ask(override="f1", mode="latest").data.collect()] == [("a", "x", "2002", "n/a", None)]
    assert [tuple(r) for r in ask(start="2003").data.collect()] == [("b", "x", "2003", "3", 3.0)]
    assert ask(start="2030").data.collect() == ask(start="2030").sources.collect() == []
    for bad in ({}, {"entity1": []}, {"entity1": ("", "T")}):
        with pytest.raises(ValueError):
            agent.observations_answer(points, "v", bad, edges, types, nodes)


def test_written_tables_are_released(spark):
    import os

    from kgframe.sources import shared

    since = shared.mark()
    a = shared.written(spark.range(5), "a")
    b = shared.written(a.filter("id > 2"), "b")
    paths = list(shared._written[since:])
    assert shared.release(spark, since, keep=b) == 1
    assert [os.path.exists(p) for p in paths] == [False, True] and b.count() == 2
    assert shared.release(spark, since) == 1 and not os.path.exists(paths[1])
