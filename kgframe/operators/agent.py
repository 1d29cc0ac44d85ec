"""Flat tables that answer whole questions: places, indicators, observations, metadata, pages."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgframe.operators.facets import select_primary_source
from kgframe.operators.graph import reached
from kgframe.operators.joins import join_on
from kgframe.operators.observations import FACET, filter_by_date_interval, latest
from kgframe.sources.shared import written


def resolve_places_table(queries: DataFrame, names: DataFrame, nodes: DataFrame) -> DataFrame:
    """query, dcid, name, type: every place of a query's name, and a blank row for a query that none has."""
    found = queries.join(names.select(F.lower("name").alias("k"), "dcid"), F.lower("query") == F.col("k"), "left").select("query", "dcid")
    return found.join(nodes.select(F.col("subject_id").alias("dcid"), "name", F.get("types", F.lit(0)).alias("type")), "dcid", "left").select("query", *[F.coalesce(c, F.lit("")).alias(c) for c in ("dcid", "name", "type")])


def get_observations_table(points: DataFrame, override: str | None = None, start: str | None = None, end: str | None = None, mode: str = "all") -> DataFrame:
    """variable, entity, date, value: the points of each variable's primary source. points carry facet_rank and score.

    ``start`` and ``end`` bound the dates; mode: all, or latest (of each entity). The other sources with their counts of
    places are ``select_primary_source`` with the same arguments.
    """
    points = filter_by_date_interval(points, start, end) if start or end else points
    primary = select_primary_source(points, override=override).filter("source_rank = 1").select("variable", *FACET)
    found = join_on(points, primary, ["variable", *FACET], "left_semi").select("variable", "entity", "date", "value")
    return latest(found, ["variable", "entity"]).select("variable", "entity", "date", "value") if mode == "latest" else found


class Answer(NamedTuple):
    """What a question for observations gets: its points, the entities in them, and the sources that have any."""

    data: DataFrame
    entities: DataFrame
    sources: DataFrame


def observations_answer(
    points: DataFrame, variable: str, entities: dict[str, list[str] | tuple[str, str]], edges: DataFrame, types: DataFrame, nodes: DataFrame, scores: DataFrame | None = None,
    start: str | None = None, end: str | None = None, mode: str = "all", override: str | None = None,
) -> Answer:
    """Points of one variable (variable_measured, a column for each slot, facet_id, date, value) for wanted entities.

    ``entities``: of each slot a list of ids, or (parent, type) for all places of a type below a parent; a slot that is not
    named must be empty. data: the slots, date, value and number (null for a value that is none) of the primary
    source, sorted by slots and date; mode all, or latest (of each series). entities: dcid, name, types of whatever the
    wanted slots hold, from all sources. sources: facet_id, series, points, latest, source_rank; the most series come
    first, then the most points, the latest date, the highest score (scores: facet_id, score), the least id; a source
    ``override`` comes before all. Points without a facet have the facet unknown.
    """
    slots = sorted(entities)
    if not slots or not variable:
        raise ValueError("a variable and the entities of one slot at least are required")
    found = points.filter(F.col("variable_measured") == variable).withColumn("facet_id", F.coalesce(F.expr("nullif(facet_id, '')"), F.lit("unknown")))
    for slot, wanted in entities.items():
        if isinstance(wanted, tuple):
            parent, type_ = wanted
            if not parent or not type_:
                raise ValueError("a parent and a type are required")
            start_at = edges.sparkSession.createDataFrame([(parent,)], "node string")
            inside = reached(edges, start_at, "containedInPlace", False).select(F.col("object").alias("place"))
            inside = inside.join(types.filter(F.col("type") == type_).select("place"), "place", "left_semi")
            found = found.join(inside.select(F.col("place").alias(slot)).distinct(), slot, "left_semi")
        elif not wanted or "" in wanted:
            raise ValueError(f"the ids of {slot} are empty")
        else:
            found = found.filter(F.col(slot).isin(wanted))
    for slot in (c for c in points.columns if c.startswith("entity") and c not in entities):
        found = found.filter(F.col(slot).isNull())
    found = filter_by_date_interval(found, start, end) if start or end else found
    found = written(found.select(*slots, "facet_id", "date", "value"), "asked-points")
    per = found.groupBy("facet_id").agg(F.count_distinct(*slots).alias("series"), F.count("*").alias("points"), F.max("date").alias("latest"))
    per = per.withColumn("score", F.lit(0)) if scores is None else per.join(scores.select("facet_id", "score"), "facet_id", "left")
    first = [F.desc(F.col("facet_id") == override)] if override else []
    order = Window.orderBy(*first, F.desc("series"), F.desc("points"), F.desc("latest"), F.desc_nulls_last("score"), "facet_id")  # a row for each source
    sources = written(per.withColumn("source_rank", F.row_number().over(order)).drop("score"), "asked-sources")
    data = found.join(sources.filter("source_rank = 1").select("facet_id"), "facet_id", "left_semi")
    data = latest(data, slots).select(*slots, "date", "value") if mode == "latest" else data.select(*slots, "date", "value")
    data = data.withColumn("number", F.col("value").try_cast("double")).orderBy(*slots, "date")
    held = found.select(F.explode(F.array(*slots)).alias("dcid")).distinct()
    names = held.join(nodes.select(F.col("subject_id").alias("dcid"), "name", "types"), "dcid", "left")
    return Answer(data, names.select("dcid", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("types", F.array().cast("array<string>")).alias("types")), sources)


def _top(df: DataFrame, item: str, limit: int) -> DataFrame:
    """The ``limit`` rows of each query with the highest score; ties by ``item``."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), item)
    return df.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit).drop("r")


def _candidates(candidates: DataFrame, limit: int | None) -> DataFrame:
    """Candidates once for each item; twice as many as wanted, for some have no data."""
    best = candidates.groupBy("query", "item").agg(F.max("score").alias("score"))
    return best if limit is None else _top(best, "item", 2 * limit)


def search_indicators(candidates: DataFrame, members: DataFrame, seen: DataFrame, limit: int | None = None) -> DataFrame:
    """query, variable, places, score: candidates (query, item, score), topics replaced by their members (topic, member),
    without variables that no wanted place has (seen: variable, entity); a variable keeps its best score. With ``limit``
    the best twice as many candidates of a query are looked at and so many variables returned."""
    found = _candidates(candidates, limit)
    topics = found.join(members.withColumnRenamed("topic", "item"), "item").select("query", F.col("member").alias("variable"), "score")
    plain = found.join(members.select(F.col("topic").alias("item")), "item", "left_anti").select("query", F.col("item").alias("variable"), "score")
    best = topics.unionByName(plain).groupBy("query", "variable").agg(F.max("score").alias("score"))
    places = seen.groupBy("variable").agg(F.countDistinct("entity").alias("places"))
    found = best.join(places, "variable").select("query", "variable", "places", "score")
    return found if limit is None else _top(found, "variable", limit)


def search_topics(candidates: DataFrame, descendants: DataFrame, seen: DataFrame, limit: int | None = None) -> DataFrame:
    """query, topic, variables, places, score: candidate topics with how many variables below them, at any depth
    (descendants: topic, variable), some wanted place has, and the number of these places; topics without any are left out."""
    below = descendants.select("topic", "variable").distinct().join(seen.select("variable", "entity").distinct(), "variable")
    counts = below.groupBy("topic").agg(F.countDistinct("variable").alias("variables"), F.countDistinct("entity").alias("places"))
    found = _candidates(candidates, limit).withColumnRenamed("item", "topic").join(counts, "topic").select("query", "topic", "variables", "places", "score")
    return found if limit is None else _top(found, "topic", limit)


def variable_metadata(facets: DataFrame, triples: DataFrame, properties: list[str] | None = None) -> DataFrame:
    """variable, name, facet facts, source: facet metadata with the variable's name and its provenance's source.

    Each of ``properties`` adds a column of its distinct values in order, joined by commas; null without any.
    """
    names = triples.filter("predicate = 'name'").groupBy(F.col("subject_id").alias("variable")).agg(F.max("object_value").alias("name"))
    source = triples.filter("predicate = 'source'").groupBy(F.col("subject_id").alias("provenance")).agg(F.max("object_id").alias("source"))
    found = facets.join(names, "variable", "left").join(source, "provenance", "left")
    if not properties:
        return found
    value = F.coalesce("object_id", "object_value")
    joined = lambda p: F.array_join(F.sort_array(F.collect_set(F.when(F.col("predicate") == p, value))), ",")
    facts = triples.filter(F.col("predicate").isin(properties)).groupBy(F.col("subject_id").alias("variable")).agg(*[F.nullif(joined(p), F.lit("")).alias(p) for p in properties])
    return found.join(facts, "variable", "left")


def observation_node_triples(obs: DataFrame, nodes: DataFrame, properties: list[str]) -> DataFrame:
    """subject, predicate, object, name: an observation's columns as triples, with names where the object is a node."""
    subject = F.concat_ws("/", F.lit("obs"), *[F.col(c) for c in ("variable", "entity", "date", "measurement_method", "observation_period", "provenance")])
    pairs = F.array(*[F.struct(F.lit(p).alias("predicate"), F.col(p).cast("string").alias("object")) for p in properties])
    rows = obs.select(subject.alias("subject"), F.explode(pairs).alias("p")).select("subject", "p.*").filter("object IS NOT NULL AND object <> ''")
    return rows.join(nodes.select(F.col("subject_id").alias("object"), "name"), "object", "left").select("subject", "predicate", "object", "name")


def node_triples(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """node, direction, predicate, object: all edges out of and into the wanted nodes (column node)."""
    out = edges.select(F.col("subject_id").alias("node"), F.lit("out").alias("direction"), "predicate", F.col("object_id").alias("object"))
    into = edges.select(F.col("object_id").alias("node"), F.lit("in").alias("direction"), "predicate", F.col("subject_id").alias("object"))
    return out.unionByName(into).join(ids, "node", "left_semi").distinct()


def place_page_related(places: DataFrame, ancestors: DataFrame, children: DataFrame, population: DataFrame, similar: DataFrame | None = None, nearby: DataFrame | None = None, k: int = 5) -> DataFrame:
    """place, relation (parent, child, similar, nearby), related: what a page on each wanted place (column place) links to.

    ancestors: child, ancestor; children and population as in ``child_places_by_type``; similar: cohort, place (k others of
    a place's cohorts); nearby as in ``nearby_places``.
    """
    own = lambda df, relation, related: df.join(places, "place", "left_semi").select("place", F.lit(relation).alias("relation"), F.col(related).alias("related"))
    parts = [own(ancestors.withColumnRenamed("child", "place"), "parent", "ancestor"), own(child_places_by_type(children, population, k).drop("position").select(F.col("parent").alias("place"), F.col("place").alias("child")), "child", "child")]
    if similar is not None:
        parts.append(own(similar_in_cohorts(places, similar, k), "similar", "related"))
    if nearby is not None:
        parts.append(own(nearby_places(nearby, population, k=k), "nearby", "near"))
    return reduce(DataFrame.unionByName, parts)


def similar_in_cohorts(places: DataFrame, cohorts: DataFrame, k: int = 5, seed: str = "0") -> DataFrame:
    """place, related, position: for each wanted place k other members of its cohorts (cohort, place), in hashed order.

    A cohort's members are ordered once, by a digest of the seed and the id, and a place takes those that follow its own
    position, round the end: no pairs of a cohort are made.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), "place"))
    ring = cohorts.select("cohort", "place").distinct().withColumns({"at": F.row_number().over(Window.partitionBy("cohort").orderBy(key, "place")) - 1, "n": F.count("*").over(Window.partitionBy("cohort"))})
    steps = F.when(F.col("n") > 1, F.sequence(F.lit(1), F.least(F.lit(k), F.col("n") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    wanted = ring.join(places, "place", "left_semi").select("cohort", "place", F.explode(F.transform(steps, lambda i: ((F.col("at") + i) % F.col("n")).cast("int"))).alias("at"))
    found = wanted.join(ring.select("cohort", "at", F.col("place").alias("related")), ["cohort", "at"]).select("place", "related").distinct()
    order = Window.partitionBy("place").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "related")), "related")
    return found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def place_metadata(places: DataFrame, closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """place, member, depth, name: the place itself (depth 0) and all its ancestors, nearest first."""
    own = places.select("place", F.col("place").alias("member"), F.lit(0).alias("depth"))
    up = closure.select(F.col("child").alias("place"), F.col("ancestor").alias("member"), "depth").join(places, "place", "left_semi")
    return own.unionByName(up).join(nodes.select(F.col("subject_id").alias("member"), "name"), "member", "left").select("place", "member", "depth", "name")


def similar_places(place: str, cohort: DataFrame, k: int = 5, seed: str = "0") -> DataFrame:
    """Up to k members of a cohort (column place) other than the place, in an order hashed from the seed."""
    return cohort.filter(F.col("place") != place).orderBy(F.md5(F.concat_ws(":", F.lit(seed), "place")), "place").limit(k)


def child_places_by_type(children: DataFrame, population: DataFrame, k: int = 5) -> DataFrame:
    """parent, type, place, position: of the type with the most children (ties: the first by name) the k most populous.

    children: parent, place, type; population: place, people.
    """
    counts = children.groupBy("parent", "type").agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("n"), "type"))).filter("r = 1").select("parent", "type")
    rows = children.join(best, ["parent", "type"], "left_semi").join(population, "place", "left")
    order = Window.partitionBy("parent").orderBy(F.desc_nulls_last("people"), "place")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).select("parent", "type", "place", "position")


def nearby_places(nearby: DataFrame, population: DataFrame, least: int = 10_000, k: int = 5) -> DataFrame:
    """place, near, distance, position: entries ``dcid@distance`` of each place with more than ``least`` people, k most populous.

    Rows are dealt by place before they are sorted: what one task reads may hold many times as many entries.
    """
    parts = F.split("entry", "@")
    rows = nearby.select("place", F.get(parts, F.lit(0)).alias("near"), F.get(parts, F.lit(1)).try_cast("double").alias("distance"))
    rows = rows.join(population.select(F.col("place").alias("near"), "people"), "near").filter(F.col("people") > least).repartition("place")
    order = Window.partitionBy("place").orderBy(F.desc("people"), "near")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).select("place", "near", "distance", "position")
