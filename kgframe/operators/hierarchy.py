"""Groups of variables: parents, descendants, counts, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgframe.functions.scalars import split_pascal
from kgframe.operators.bitmaps import counts_below
from kgframe.operators.graph import reached, tagged


def parent_links(triples: DataFrame) -> DataFrame:
    """child, parent, kind (variable or group) of the whole hierarchy."""
    links = triples.filter(F.col("predicate").isin("memberOf", "specializationOf"))
    return links.select(F.col("subject_id").alias("child"), F.col("object_id").alias("parent"), F.when(F.col("predicate") == "memberOf", "variable").otherwise("group").alias("kind")).distinct()


def _named(triples: DataFrame) -> DataFrame:
    return triples.filter("predicate = 'name'").groupBy("subject_id").agg(F.max("object_value").alias("name"))


def all_groups(triples: DataFrame) -> DataFrame:
    """id, name, parent (null for a root) of every group."""
    groups = triples.filter("predicate = 'typeOf' AND object_id = 'StatVarGroup'").select("subject_id").distinct()
    parents = triples.filter("predicate = 'specializationOf'").select("subject_id", F.col("object_id").alias("parent")).distinct()
    return groups.join(_named(triples), "subject_id", "left").join(parents, "subject_id", "left").select(F.col("subject_id").alias("id"), "name", "parent")


def all_variables(triples: DataFrame) -> DataFrame:
    """id, name, group_id, description (null without one) of every variable in a group."""
    members = triples.filter("predicate = 'memberOf'").select("subject_id", F.col("object_id").alias("group_id")).distinct()
    described = triples.filter("predicate = 'description'").groupBy("subject_id").agg(F.max("object_value").alias("description"))
    return members.join(_named(triples), "subject_id", "left").join(described, "subject_id", "left").select(F.col("subject_id").alias("id"), "name", "group_id", "description")


def _as_edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("child").alias("subject_id"), F.lit("up").alias("predicate"), F.col("parent").alias("object_id"))


def _below(links: DataFrame, node: str, max_hops: int | None) -> DataFrame:
    """child: all that lies below one node."""
    start = links.sparkSession.createDataFrame([(node,)], "node string")
    return reached(_as_edges(links), start, "up", False, max_hops).select(F.col("object").alias("child"))


def descendant_variables(links: DataFrame, max_hops: int | None = None) -> DataFrame:
    """group_id, variable: all distinct variables below each group, found by walking up from the variables."""
    variables = links.filter("kind = 'variable'").select(F.col("child").alias("node")).distinct()
    return reached(_as_edges(links), variables, "up", True, max_hops).select(F.col("object").alias("group_id"), F.col("node").alias("variable"))


def variables_below(links: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, variable: the distinct variables below the wanted groups (column group_id) alone, found by walking down from them."""
    down = reached(_as_edges(links), groups.select(F.col("group_id").alias("node")), "up", False)
    variables = links.filter("kind = 'variable'").select(F.col("child").alias("object")).distinct()
    return down.join(variables, "object", "left_semi").select(F.col("node").alias("group_id"), F.col("object").alias("variable"))


def links_below(links: DataFrame, group: str) -> DataFrame:
    """The links whose parent is a group or lies below it."""
    below = _below(links, group, None).union(links.sparkSession.createDataFrame([(group,)], "child string")).distinct()
    return links.join(below.select(F.col("child").alias("parent")), "parent", "left_semi").select("child", "parent", "kind")


def descendant_counts(links: DataFrame, max_hops: int | None = None) -> DataFrame:
    """group_id, n: distinct descendant variables; one that is reached twice counts once. Without ``max_hops`` by bitmaps."""
    if max_hops is None:
        return counts_below(links)
    return descendant_variables(links, max_hops).groupBy("group_id").agg(F.count("*").alias("n"))


def filtered_topic(links: DataFrame, seen: DataFrame, max_hops: int | None = None) -> DataFrame:
    """group_id, n: of each topic or group the descendant variables that are seen (variable, ...) for a wanted entity."""
    if max_hops is None:
        return counts_below(links, seen)
    return descendant_variables(links, max_hops).join(seen.select("variable").distinct(), "variable", "left_semi").groupBy("group_id").agg(F.count("*").alias("n"))


def _with_counts(links: DataFrame, counts: DataFrame) -> DataFrame:
    counts = counts.withColumnRenamed("group_id", "child")
    return links.join(counts, "child", "left").select("parent", "child", "kind", F.when(F.col("kind") == "group", F.coalesce("n", F.lit(0))).otherwise(-1).alias("n"))


def build_hierarchy(links: DataFrame, max_hops: int | None = None) -> DataFrame:
    """parent, child, kind, n: the children of each group; n is a group's count and -1 for a variable."""
    return _with_counts(links, descendant_counts(links, max_hops))


def parents_from_root(links: DataFrame, root: str, max_hops: int | None = None) -> DataFrame:
    """child, parent: only parents that are the root or lie below it."""
    below = _below(links, root, max_hops).select(F.col("child").alias("parent"))
    reachable = below.union(links.sparkSession.createDataFrame([(root,)], "parent string")).distinct()
    return links.join(reachable, "parent", "left_semi").select("child", "parent").distinct()


def ancestors(links: DataFrame, nodes: DataFrame, max_hops: int | None = None) -> DataFrame:
    """node, ancestor, depth of the wanted nodes (column node)."""
    return reached(_as_edges(links), nodes, "up", True, max_hops).select("node", F.col("object").alias("ancestor"), "depth")


def prune_hierarchy(links: DataFrame, variables: DataFrame, max_hops: int | None = None) -> DataFrame:
    """The links that lead to wanted variables (column variable)."""
    wanted = variables.select(F.col("variable").alias("node"))
    kept = ancestors(links, wanted, max_hops).select(F.col("ancestor").alias("child")).union(wanted.select(F.col("node").alias("child"))).distinct()
    return links.join(kept, "child", "left_semi")


def remove_subtree(links: DataFrame, group: str, max_hops: int | None = None) -> DataFrame:
    """The links without a group and all that lies below it."""
    gone = _below(links, group, max_hops).distinct()
    return links.filter((F.col("parent") != group) & (F.col("child") != group)).join(gone, "child", "left_anti").join(gone.withColumnRenamed("child", "parent"), "parent", "left_anti").select("child", "parent", "kind")


def group_children(links: DataFrame, nodes: DataFrame, with_data: DataFrame, groups: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """group_id, child, kind, name, n, has_data: children of the wanted groups (column group_id), and a row for each itself.

    with_data: column variable. n is -1 for a variable; a group has data where one of its variables has. definitions
    (variable, definition) add the column definition, null for groups.
    """
    names = nodes.select(F.col("subject_id").alias("child"), "name")
    counts = counts_below(links)
    has = with_data.select("variable").distinct()
    above = tagged(_as_edges(links), has.select(F.lit(1).alias("tag"), F.col("variable").alias("node")), "up").select(F.col("node").alias("child"))
    groups_with = above.union(has.select(F.col("variable").alias("child"))).distinct().withColumn("has_data", F.lit(True))
    children = _with_counts(links, counts).withColumnRenamed("parent", "group_id").join(groups, "group_id", "left_semi")
    own = groups.select("group_id").distinct().join(counts, "group_id", "left").select("group_id", F.col("group_id").alias("child"), F.lit("self").alias("kind"), F.coalesce("n", F.lit(0)).alias("n"))
    rows = children.select("group_id", "child", "kind", "n").unionByName(own)
    rows = rows.join(names, "child", "left").join(groups_with, "child", "left").select("group_id", "child", "kind", "name", "n", F.coalesce("has_data", F.lit(False)).alias("has_data"))
    return rows if definitions is None else rows.join(definitions.withColumnRenamed("variable", "child"), "child", "left").select(*rows.columns, "definition")


# Population types that a group's name leaves out, and the two that are shown by another word.
BASIC_POPULATIONS = ["Person", "BLSWorker", "USCWorker", "Thing", "Household", "HousingUnit", "Place", "Energy"]
SHOWN_POPULATIONS = {"Person": "Individual", "Place": "Location"}
CURATED = r"^(dc/g/UN|dc/g/SDG|undata/g)"


def specialized_entities(children: DataFrame) -> DataFrame:
    """Add ``specialized_entity`` to children (group_id, child, name) of groups: what a child's id adds to its parent's.

    Curated ids and ids of one piece keep their name. Children of one parent with equal results get the population type
    in brackets, unless it says the same.
    """
    pieces = lambda c: F.filter(F.split(F.regexp_replace(c, "^dc/g/", ""), "[_-]"), lambda x: x != "")
    rows = children.withColumns({"own pieces": pieces("child"), "parent pieces": pieces("group_id")})
    own, parent = F.col("own pieces"), F.col("parent pieces")
    first = F.get(own, F.lit(0))
    basic = first.isin(BASIC_POPULATIONS)
    curated = ~F.col("child").contains("_") | F.col("child").rlike(CURATED) | (F.size(own) == 0)
    shown = F.when(~basic, first)
    for name, word in SHOWN_POPULATIONS.items():
        shown = shown.when(first == name, word)
    shown = shown.otherwise(split_pascal(first))
    apart = F.filter(F.arrays_zip(own.alias("own"), parent.alias("parent")), lambda x: x["own"].isNotNull() & x["parent"].isNotNull() & (x["own"] != x["parent"]))
    first_apart = F.get(apart, F.lit(0))["own"]
    piece = (
        F.when(F.size(own) == 1, first)
        .when((F.size(parent) == 1) & (F.get(parent, F.lit(0)) != first), F.when(basic, F.get(own, F.lit(1))).otherwise(first))
        .otherwise(F.coalesce(first_apart, F.element_at(own, -1)))
    )
    rows = rows.withColumns({"entity": F.when(curated, F.col("name")).otherwise(split_pascal(piece)), "population": F.when(curated, "").otherwise(shown)})
    same = F.count("*").over(Window.partitionBy("group_id", "entity"))
    full = F.when((same > 1) & (F.col("population") != "") & (F.col("population") != F.col("entity")), F.concat("entity", F.lit(" ("), "population", F.lit(")"))).otherwise(F.col("entity"))
    return rows.withColumn("specialized_entity", full).select(*children.columns, "specialized_entity")


def filtered_group_children(links: DataFrame, seen: DataFrame, group: str, min_entities: int = 1) -> DataFrame:
    """child, kind, n: children of a group restricted to variables seen (variable, entity) for ``min_entities`` entities at least."""
    kept = seen.groupBy("variable").agg(F.countDistinct("entity").alias("e")).filter(F.col("e") >= min_entities).select("variable")
    below = counts_below(links_below(links, group), kept).withColumnRenamed("group_id", "child")
    children = links.filter(F.col("parent") == group).select("child", "kind").distinct()
    groups = children.filter("kind = 'group'").join(below, "child")
    variables = children.filter("kind = 'variable'").join(kept.withColumnRenamed("variable", "child"), "child", "left_semi").withColumn("n", F.lit(-1).cast("long"))
    return groups.unionByName(variables)


def group_node_for_entities(links: DataFrame, seen: DataFrame, group: str, entities: DataFrame, k: int) -> DataFrame:
    """child, kind, n: of each child group the k-th largest count of variables over the wanted entities, 0 with fewer than k
    entities; of each variable the number of entities that have it if k at least, else 0."""
    wanted = seen.join(entities, "entity", "left_semi").select("variable", "entity").distinct()
    starts = links.filter((F.col("parent") == group) & (F.col("kind") == "group")).select(F.col("child").alias("group_id")).distinct()
    below = variables_below(links, starts).join(wanted, "variable").groupBy(F.col("group_id").alias("child"), "entity").agg(F.count("*").alias("c"))
    kth = below.withColumn("r", F.row_number().over(Window.partitionBy("child").orderBy(F.desc("c"), "entity"))).filter(F.col("r") == k).select("child", F.col("c").alias("n"))
    own = wanted.groupBy(F.col("variable").alias("child")).agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    children = links.filter(F.col("parent") == group).select("child", "kind").distinct()
    return children.join(kth.unionByName(own), "child", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sort_group_children(children: DataFrame, order_col: str = "name") -> DataFrame:
    """Add ``position`` within each group: curated names by their leading number, then by name."""
    number = F.get(F.split(order_col, ":"), F.lit(0)).try_cast("int")
    order = Window.partitionBy("group_id").orderBy(number.asc_nulls_last(), order_col, "child")
    return children.withColumn("position", F.row_number().over(order))
