"""Traversal of triples and edges: containment, neighbours, chains, patterns, ids."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgframe.sources.shared import Rounds, written

#: Predicates that the graph materialises for itself.
INTERNAL = ["linkedContainedInPlace", "linkedMemberOf", "linkedMember"]
DEFAULT_TYPE = "Thing"


def entities_of_type(triples: DataFrame, type_: str) -> DataFrame:
    """subject_id of every entity of a type."""
    return triples.filter((F.col("predicate") == "typeOf") & (F.col("object_id") == type_)).select("subject_id").distinct()


def places_in(triples: DataFrame, parents: DataFrame, child_type: str) -> DataFrame:
    """parent, child: direct containment of places of a type in the wanted parents (column parent)."""
    inside = triples.filter("predicate = 'containedInPlace'").select(F.col("object_id").alias("parent"), F.col("subject_id").alias("child"))
    return inside.join(parents, "parent", "left_semi").join(entities_of_type(triples, child_type).withColumnRenamed("subject_id", "child"), "child", "left_semi").select("parent", "child").distinct()


def _reach(first: DataFrame, hop: DataFrame, max_hops: int | None, name: str) -> DataFrame:
    """start, end, depth: what 1 to ``max_hops`` hops (via, next), or any number, reach from the first pairs (start, end).

    A frontier loop: each round joins only the pairs that the last one found and leaves out those met before, so
    cycles end it. Each round is a written table and all of them are read by one scan, so plans don't grow with the
    rounds, and an empty one ends the loop.
    """
    rounds = Rounds(name)
    frontier = rounds.add(first.distinct().withColumn("depth", F.lit(1)))
    for depth in count(2) if max_hops is None else range(2, max_hops + 1):
        pairs = frontier.join(hop, F.col("end") == F.col("via")).select("start", F.col("next").alias("end")).distinct()
        met = rounds.all().select("start", "end")
        frontier = rounds.add(pairs.join(met, ["start", "end"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
    return rounds.all()


def closure(edges: DataFrame, predicate: str, max_hops: int | None = None) -> DataFrame:
    """child, ancestor, depth: what a chain of edges (1 to ``max_hops``, if given) reaches, each pair once at its least depth.

    Depths are doubled: a pair at a depth between h and 2h is one at depth h followed by one that is known, so there are
    about as many rounds as the logarithm of the greatest depth.
    """
    rounds = Rounds("closure")
    last = rounds.add(edges.filter(F.col("predicate") == predicate).select(F.col("subject_id").alias("start"), F.col("object_id").alias("end"), F.lit(1).alias("depth")).distinct())
    reach = 1
    while (max_hops is None or reach < max_hops) and not last.isEmpty():
        known = rounds.all()
        onward = known.select(F.col("start").alias("end"), F.col("end").alias("next"), F.col("depth").alias("more"))
        pairs = last.filter(F.col("depth") == reach).join(onward, "end").groupBy("start", F.col("next").alias("end")).agg((F.min("more") + reach).cast("int").alias("depth"))
        last = rounds.add(pairs.join(known, ["start", "end"], "left_anti"))
        reach *= 2
    found = rounds.all().select(F.col("start").alias("child"), F.col("end").alias("ancestor"), "depth")
    return found if max_hops is None else found.filter(F.col("depth") <= max_hops)


def tagged(edges: DataFrame, seeds: DataFrame, prop: str, outward: bool = True) -> DataFrame:
    """tag, node, depth: what edges of one predicate reach from nodes with a tag (seeds: tag, node), each node once for each tag.

    So all that a set of nodes reaches takes a row for each node, not for each pair.
    """
    here, there = ("subject_id", "object_id") if outward else ("object_id", "subject_id")
    hop = written(edges.filter(F.col("predicate") == prop).select(F.col(here).alias("via"), F.col(there).alias("next")).distinct(), "hops")
    first = seeds.join(hop, F.col("node") == F.col("via")).select(F.col("tag").alias("start"), F.col("next").alias("end"))
    return _reach(first, hop, None, "tagged").select(F.col("start").alias("tag"), F.col("end").alias("node"), "depth")


def numbered_by(df: DataFrame, column: str, number: str) -> DataFrame:
    """Add ``number``, from 0 in the order of a column of distinct values: partitions by range number their own rows and
    add what the partitions before them hold."""
    dealt = written(df.repartitionByRange(column).withColumn("part", F.spark_partition_id()), "numbered")
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1)
    return own.join(before, "part").withColumn(number, (F.col("before") + F.col("own")).cast("int")).drop("part", "own", "before")  # one row for each partition


def node_properties(edges: DataFrame, ids: DataFrame, outward: bool = True) -> DataFrame:
    """node, predicate: the distinct predicates out of, or into, the wanted nodes (column node)."""
    end = "subject_id" if outward else "object_id"
    return edges.select(F.col(end).alias("node"), "predicate").join(ids, "node", "left_semi").distinct()


def hide_internal_predicates(edges: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Edges without the materialised predicates, but for those that are asked for by name."""
    return edges.filter(~F.col("predicate").isin([p for p in INTERNAL if p not in (wanted or [])]))


def filter_nodes_by_type(nodes: DataFrame, types: list[str]) -> DataFrame:
    """Nodes that have one of the types at least, with ``matched``, those that they have; nodes without types go."""
    wanted = F.array(*[F.lit(t) for t in types])
    return nodes.filter(F.arrays_overlap("types", wanted)).withColumn("matched", F.array_intersect("types", wanted))


def filter_lang(values: DataFrame, langs: list[str] | None = None, by_property: dict[str, list[str]] | None = None, value_col: str = "object_value", predicate_col: str = "predicate") -> DataFrame:
    """Rows whose literal ends with ``@lang`` (lower-cased) for one of the languages; none given matches all.

    A property in ``by_property`` has languages of its own, which stand in for the global ones. Null literals go where
    a language is asked for.
    """

    def ends(wanted: list[str] | None) -> F.Column:
        return reduce(lambda a, b: a | b, [F.lower(value_col).endswith(f"@{lang.lower()}") for lang in wanted]) if wanted else F.lit(True)

    good = ends(langs)
    for p, wanted in (by_property or {}).items():
        good = F.when(F.col(predicate_col) == p, ends(wanted)).otherwise(good)
    return values.filter(good)


def node_edges(edges: DataFrame, nodes: DataFrame, ids: DataFrame, properties: list[str] | None = None, outward: bool = True) -> DataFrame:
    """node, predicate, object, provenance, name, types: one hop from the wanted nodes (column node).

    An object that is no node is a value of the default type.
    """
    here, there = ("subject_id", "object_id") if outward else ("object_id", "subject_id")
    hop = hide_internal_predicates(edges, properties).select(F.col(here).alias("node"), "predicate", F.col(there).alias("object"), "provenance").join(ids, "node", "left_semi")
    if properties:
        hop = hop.filter(F.col("predicate").isin(properties))
    return hop.join(nodes.select(F.col("subject_id").alias("object"), "name", "types"), "object", "left").select(
        "node", "predicate", "object", "provenance", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("types", F.array(F.lit(DEFAULT_TYPE))).alias("types")
    )


def node_edges_filtered(edges: DataFrame, nodes: DataFrame, ids: DataFrame, prop: str, wanted: dict[str, list[str]], outward: bool = True) -> DataFrame:
    """``node_edges`` whose objects have, for each predicate of ``wanted``, an edge to one of its values."""
    hop = node_edges(edges, nodes, ids, [prop], outward)
    for p, values in wanted.items():
        good = edges.filter((F.col("predicate") == p) & F.col("object_id").isin(values)).select(F.col("subject_id").alias("object"))
        hop = hop.join(good, "object", "left_semi")
    return hop.dropDuplicates(["node", "predicate", "object", "provenance"])


def node_chain(edges: DataFrame, ids: DataFrame, prop: str, outward: bool = True, max_hops: int = 10) -> DataFrame:
    """node, object: the distinct nodes that 1 to ``max_hops`` edges of one predicate reach from the wanted nodes."""
    return reached(edges, ids, prop, outward, max_hops).select("node", "object")


def reached(edges: DataFrame, ids: DataFrame, prop: str, outward: bool = True, max_hops: int | None = None) -> DataFrame:
    """node, object, depth: what edges of one predicate reach from the wanted nodes (column node), at its least depth.

    The frontier starts at the wanted nodes, so the rest of the graph is never closed over.
    """
    step = edges.filter(F.col("predicate") == prop)
    step = step if outward else step.select(F.col("object_id").alias("subject_id"), F.col("predicate"), F.col("subject_id").alias("object_id"))
    hop = written(step.select(F.col("subject_id").alias("via"), F.col("object_id").alias("next")).distinct(), "hops")
    first = hop.join(ids.select(F.col("node").alias("via")), "via", "left_semi").select(F.col("via").alias("start"), F.col("next").alias("end"))
    return _reach(first, hop, max_hops, "chain").select(F.col("start").alias("node"), F.col("end").alias("object"), "depth")


def sql_node_triples(triples: DataFrame, nodes: DataFrame, ids: DataFrame, properties: list[str], outward: bool = True) -> DataFrame:
    """node, predicate, object, value, name, type: wanted nodes x properties with the name and first type of the other end."""
    here, there = ("subject_id", "object_id") if outward else ("object_id", "subject_id")
    rows = triples.filter(F.col("predicate").isin(properties)).join(ids, F.col(here) == F.col("node"), "left_semi")
    rows = rows.select(F.col(here).alias("node"), "predicate", F.col(there).alias("object"), F.col("object_value").alias("value")).distinct()
    ends = nodes.select(F.col("subject_id").alias("object"), "name", F.get("types", F.lit(0)).alias("type"))
    return rows.join(ends, "object", "left").select("node", "predicate", "object", "value", "name", F.when(F.col("object").isNotNull(), F.coalesce("type", F.lit(DEFAULT_TYPE))).alias("type"))


def match_patterns(edges: DataFrame, patterns: list[tuple[str, str, str]], select: list[str], distinct: bool = True) -> DataFrame:
    """Bindings of a basic graph pattern. A term that begins with ``?`` is a variable; ``dcid`` binds a node to itself.

    Patterns are folded into equi-joins on the variables they share with those before; one that shares none with any
    other is an error, for its bindings would have to be crossed.
    """
    facts = edges.select("subject_id", "predicate", "object_id").distinct()
    left = list(patterns)
    out: DataFrame | None = None
    while left:
        pick = next((p for p in left if out is None or any(t[0] == "?" and t[1:] in out.columns for t in (p[0], p[2]))), None)
        if pick is None:
            raise ValueError(f"{left[0]} shares no variable with the other patterns")
        left.remove(pick)
        s, p, o = pick
        rows = facts.select(F.col("subject_id"), F.col("subject_id").alias("object_id")).distinct() if p == "dcid" else facts.filter(F.col("predicate") == p)
        for term, column in ((s, "subject_id"), (o, "object_id")):
            if term[0] != "?":
                rows = rows.filter(F.col(column) == term)
        names = {}
        for term, column in ((s, "subject_id"), (o, "object_id")):
            if term[0] == "?":
                if term[1:] in names:
                    rows = rows.filter(F.col("subject_id") == F.col("object_id"))
                names[term[1:]] = F.col(column).alias(term[1:])
        rows = rows.select(*names.values()) if names else rows.select(F.lit(1).alias("__any")).limit(1)
        if out is None:
            out = rows
        else:
            out = out.join(rows, [v for v in names if v in out.columns])
    out = out.select(*[v.removeprefix("?") for v in select])
    return out.distinct() if distinct else out


def schema_mapped_select(tables: dict[str, DataFrame], mapping: dict[str, tuple[str, str, dict[str, str]]], patterns: list[tuple[str, str, str]], select: list[str]) -> DataFrame:
    """``match_patterns`` over tables in place of triples. ``mapping``: entity variable -> (table, id column, {property: column}).

    The joins follow from variables that patterns share; the entity with the most constants comes first.
    """
    by_entity: dict[str, list[tuple[str, str]]] = {}
    for s, p, o in patterns:
        by_entity.setdefault(s, []).append((p, o))
    frames = []
    for entity, props in by_entity.items():
        name, id_col, columns = mapping[entity]
        df = tables[name]
        chosen = {entity.removeprefix("?"): F.col(id_col)}
        for p, o in props:
            column = id_col if p == "dcid" else columns[p]
            if o[0] == "?":
                chosen[o[1:]] = F.col(column)
            else:
                df = df.filter(F.col(column) == o)
        frames.append((sum(o[0] != "?" for _, o in props), df.select(*[c.cast("string").alias(v) for v, c in chosen.items()])))
    frames = [df for _, df in sorted(frames, key=lambda f: -f[0])]
    out = frames.pop(0)
    while frames:
        nxt = next((f for f in frames if set(f.columns) & set(out.columns)), None)
        if nxt is None:
            raise ValueError("the patterns' tables share no variable")
        frames.remove(nxt)
        out = out.join(nxt, sorted(set(out.columns) & set(nxt.columns)))
    return out.select(*[v.removeprefix("?") for v in select]).distinct()


def resolve_ids(edges: DataFrame, ids: DataFrame, in_prop: str, out_prop: str) -> DataFrame:
    """id, out: ids of one property (or dcid) resolved to those of another; ids has column id."""
    prop = lambda p: edges.filter(F.col("predicate") == p).select(F.col("subject_id").alias("dcid"), F.col("object_id").alias("v")).distinct()
    found = ids.select("id", F.col("id").alias("dcid")) if in_prop == "dcid" else ids.join(prop(in_prop).withColumnRenamed("v", "id"), "id")
    found = found.select("id", F.col("dcid").alias("out")) if out_prop == "dcid" else found.join(prop(out_prop), "dcid").select("id", F.col("v").alias("out"))
    return found.distinct()


def resolve_entities(entity_ids: DataFrame, id_map: DataFrame, ranking: list[str]) -> DataFrame:
    """entity, dcid, probability: each source entity's candidates under its highest-ranked id property that resolves.

    entity_ids: entity, prop, value; id_map: prop, value, dcid. Candidates share the probability evenly; an entity
    that nothing resolves keeps a row with null.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in ranking]), F.col("prop"))
    hits = entity_ids.join(id_map, ["prop", "value"]).withColumn("r", rank).filter("r > 0")
    best = hits.withColumn("least", F.min("r").over(Window.partitionBy("entity"))).filter("r = least").select("entity", "dcid").distinct()
    best = best.withColumn("probability", 1 / F.count("*").over(Window.partitionBy("entity")))
    return entity_ids.select("entity").distinct().join(best, "entity", "left")


def hydrate_names(df: DataFrame, other: DataFrame, id_col: str = "dcid") -> DataFrame:
    """Fill missing name and types of ``df`` from another source's nodes (subject_id, name, types)."""
    more = other.select(F.col("subject_id").alias(id_col), F.col("name").alias("__name"), F.col("types").alias("__types"))
    return df.join(more, id_col, "left").withColumn("name", F.coalesce("name", "__name")).withColumn("types", F.coalesce("types", "__types")).drop("__name", "__types")


def hydrate_provenance_urls(obs: DataFrame, triples: DataFrame) -> DataFrame:
    """Fill a missing or empty provenance_url from the provenance node's url."""
    urls = triples.filter("predicate = 'url'").groupBy(F.col("subject_id").alias("provenance")).agg(F.max("object_value").alias("__url"))
    return obs.join(urls, "provenance", "left").withColumn("provenance_url", F.coalesce(F.expr("nullif(provenance_url, '')"), "__url")).drop("__url")


def all_provenances(triples: DataFrame) -> DataFrame:
    """id, name, url of every provenance."""
    known = entities_of_type(triples, "Provenance")
    facts = triples.filter(F.col("predicate").isin("name", "url")).join(known, "subject_id", "left_semi")
    return facts.groupBy(F.col("subject_id").alias("id")).agg(*[F.max(F.when(F.col("predicate") == p, F.col("object_value"))).alias(p) for p in ("name", "url")])


def merge_child_places(*sources: DataFrame) -> DataFrame:
    """The children that any source knows."""
    return reduce(DataFrame.unionByName, sources).distinct()
