"""Set operations and merges of several sources in order of priority (0 comes first)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgframe.operators.joins import join_on


def stacked(sources: list[DataFrame]) -> DataFrame:
    """All sources' rows with their ``priority``."""
    return reduce(DataFrame.unionByName, [df.withColumn("priority", F.lit(i)) for i, df in enumerate(sources)])


def first_by_priority(rows: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    """Of each key the rows of the source that comes first (or last) and has any. Keys may be null: nulls are equal."""
    pick = F.max("priority") if last else F.min("priority")
    return join_on(rows, rows.groupBy(*keys).agg(pick.alias("priority")), [*keys, "priority"], "left_semi")


def merge_observations(sources: list[DataFrame], rank_col: str = "facet_rank") -> DataFrame:
    """Facets of each (variable, entity) appended in order of source, without removing any: ``position`` from 1."""
    order = Window.partitionBy("variable", "entity").orderBy("priority", rank_col)
    return stacked(sources).withColumn("position", F.row_number().over(order))


def merge_nodes(sources: list[DataFrame], key: str = "dcid", value: str = "value") -> DataFrame:
    """Values of each (node, property), each once, from the source that comes first.

    A value is told by its ``key``; one without a key (null or empty) is a literal and told by ``value``, if there is
    such a column.
    """
    rows = stacked(sources)
    own = F.expr(f"nullif(`{key}`, '')")
    rows = rows.withColumns({"own key": own, "literal": F.when(own.isNull(), F.col(value)) if value in rows.columns else F.lit(None).cast("string")})
    return first_by_priority(rows, ["node", "property", "own key", "literal"]).drop("priority", "own key", "literal").distinct()


def merge_resolve(sources: list[DataFrame]) -> DataFrame:
    """Candidates of each node, each dcid once, sorted by score: unscored ones last. A null dcid says that nothing was found and stays."""
    return sort_candidates_by_score(first_by_priority(stacked(sources), ["node", "dcid"]))


def sort_candidates_by_score(candidates: DataFrame, order_col: str = "priority") -> DataFrame:
    """Add ``position`` within each node: numeric scores descending, then unscored in their order."""
    order = Window.partitionBy("node").orderBy(F.col("score").try_cast("double").desc_nulls_last(), order_col, "dcid")
    return candidates.withColumn("position", F.row_number().over(order))


def merge_events(sources: list[DataFrame]) -> DataFrame:
    """Events, each dcid once, from the source that comes first."""
    return first_by_priority(stacked(sources), ["event_id"])


def merge_dates(sources: list[DataFrame]) -> DataFrame:
    """variable, date: the dates that any source has."""
    return reduce(DataFrame.unionByName, [s.select("variable", "date") for s in sources]).distinct()


def merge_summaries(sources: list[DataFrame]) -> DataFrame:
    """All rows of a variable from the first source that has it."""
    return first_by_priority(stacked(sources), ["variable"])


def merge_variable_info(sources: list[DataFrame]) -> DataFrame:
    """Rows of each (variable, provenance) from the last source that has it; a null provenance is one of its own."""
    return first_by_priority(stacked(sources), ["variable", "provenance"], last=True)


def merge_group_info(sources: list[DataFrame]) -> DataFrame:
    """group_id: counts added, the first non-empty name, children counted together."""
    rows = stacked(sources)
    return rows.groupBy("group_id").agg(F.sum("n").alias("n"), F.min_by("name", F.when(F.coalesce("name", F.lit("")) != "", F.col("priority"))).alias("name"))


def merge_search_interleave(sources: list[DataFrame], limit: int = 100) -> DataFrame:
    """Round robin over sources (dcid, rank from 1): each dcid once, up to ``limit``, until a round adds nothing.

    A round that adds nothing ends the merge, so rows of later rounds go. Sources are short result lists.
    """
    rows = stacked(sources)
    once = rows.groupBy("dcid").agg(F.min(F.struct("rank", "priority")).alias("at")).select("dcid", "at.rank", "at.priority")
    rounds = rows.select("rank").distinct()
    added = once.select("rank").distinct().withColumn("added", F.lit(1))
    empty = rounds.join(added, "rank", "left_anti").agg(F.min("rank").alias("stop"))
    kept = once.crossJoin(F.broadcast(empty)).filter("stop IS NULL OR rank < stop")  # one row
    return kept.orderBy("rank", "priority", "dcid").limit(limit).select("dcid", "rank", "priority")


def merge_query_rows(sources: list[DataFrame], order: str | None = None, limit: int | None = None) -> DataFrame:
    """Whole rows once; if asked, sorted by a column as a string, and cut."""
    rows = reduce(DataFrame.unionByName, sources).distinct()
    rows = rows.orderBy(F.col(order).cast("string"), *rows.columns) if order else rows
    return rows.limit(limit) if limit else rows


def merge_statvar_search(sources: list[DataFrame]) -> DataFrame:
    """The matches that any source has, equal rows once."""
    return reduce(DataFrame.unionByName, sources).distinct()


def merge_sdmx(sources: list[DataFrame]) -> DataFrame:
    """All series; the component lists must be the same."""
    if len({tuple(s.columns) for s in sources}) > 1:
        raise ValueError("the sources have different components: " + "; ".join(",".join(s.columns) for s in sources))
    return reduce(DataFrame.unionByName, sources)


def merge_availability(sources: list[DataFrame], column: str) -> DataFrame:
    """Distinct non-empty values."""
    return reduce(DataFrame.unionByName, [s.select(column) for s in sources]).filter(F.coalesce(column, F.lit("")) != "").distinct()


def distinct_source_series(series: DataFrame, keys: list[str]) -> DataFrame:
    """The same facet from several sources once: the later latest date, then the source that comes first."""
    order = Window.partitionBy(*keys).orderBy(F.desc("latest"), "priority")
    return series.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def merge_hierarchies(sources: list[DataFrame]) -> DataFrame:
    """The links that any source has, equal rows once."""
    return reduce(DataFrame.unionByName, sources).distinct()


def merge_paged_values(sources: list[DataFrame]) -> DataFrame:
    """Values (dcid, value) that any source has, once, in order: ``position`` within each node and property."""
    rows = reduce(DataFrame.unionByName, sources).distinct()
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("node", "property").orderBy("dcid", "value")))


def intersect_lists(rows: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """The values that every group has."""
    groups = rows.agg(F.countDistinct(group_col).alias("groups"))
    counts = rows.groupBy(value_col).agg(F.countDistinct(group_col).alias("n"))
    return counts.crossJoin(F.broadcast(groups)).filter("n = groups").select(value_col)  # one row


def merge_dedupe(lists: DataFrame, key: str, column: str) -> DataFrame:
    """Arrays of each key as one sorted array without repeats."""
    return lists.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(column))


def diff_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n, and the row: rows of either result that the other lacks, with multiplicity."""
    columns = a.columns
    signed = a.withColumn("__s", F.lit(1)).unionByName(b.select(*columns).withColumn("__s", F.lit(-1)))
    d = signed.groupBy(*columns).agg(F.sum("__s").alias("__s")).filter("__s <> 0")
    return d.select(F.when(F.col("__s") > 0, "left").otherwise("right").alias("side"), F.abs("__s").alias("n"), *columns)


def prefer_branch(branch: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """The branch's rows, and the base's where the branch lacks the key; columns of the key may be null."""
    return first_by_priority(stacked([branch, base]), keys)
