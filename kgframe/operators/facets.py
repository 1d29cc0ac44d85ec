"""Ranking sources of the same statistic, and what follows from the ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgframe.functions.scalars import facet_id, host_ends_with
from kgframe.operators.joins import join_on
from kgframe.operators.observations import FACET, SERIES, filter_by_date_interval
from kgframe.sources.shared import written

INFERIOR = 1000
DEFAULT_SCORE = 100
LAST = ["measurement_method", "observation_period", "scaling_factor", "unit", "provenance_url", "import_name"]


def series_of(obs: DataFrame) -> DataFrame:
    """One row for each (variable, entity, facet): obs_count, earliest, latest, latest_value. Facet columns may be null."""
    return obs.groupBy(*SERIES).agg(F.count("*").alias("obs_count"), F.min("date").alias("earliest"), F.max("date").alias("latest"), F.max_by("value", "date").alias("latest_value"))


def facet_score(series: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``score``: that of the import's rule with the most exact matches, then the least score; 100 without one.

    Rules are a small table; a null in one matches everything. The best rule is found for the distinct facets, not for
    every series, and with an aggregation in place of a sort. A null of a facet fits only rules that leave it open.
    """
    keys = ["import_name", "measurement_method", "observation_period", "unit"]
    facets = series.select(*keys).distinct()
    r = rules.select(*[F.col(c).alias(f"r_{c}") for c in keys], F.col("score").alias("r_score"))
    fits = F.col("import_name") == F.col("r_import_name")
    exact = F.lit(0)
    for c in keys[1:]:
        fits &= F.col(f"r_{c}").isNull() | F.col(f"r_{c}").eqNullSafe(F.col(c))
        exact += F.col(f"r_{c}").isNotNull().cast("int")
    best = facets.join(r, fits).groupBy(*keys).agg(F.min(F.struct((-exact).alias("e"), F.col("r_score").alias("s"))).alias("best"))
    scored = join_on(series, best, keys, "left").withColumn("score", F.coalesce(F.col("best.s"), F.lit(DEFAULT_SCORE)))
    return scored.select(*series.columns, "score")


def rank_facets(scored: DataFrame, keys: list[str] = ["variable", "entity"]) -> DataFrame:
    """Add ``facet_rank`` from 1: score, then the latest date and the count descending, then the facet's columns."""
    order = Window.partitionBy(*keys).orderBy("score", F.desc("latest"), F.desc("obs_count"), *LAST)
    return scored.withColumn("facet_rank", F.row_number().over(order))


def rank_series(scored: DataFrame, keys: list[str] = ["variable", "entity"]) -> DataFrame:
    """As ``rank_facets``, with the import before the other columns."""
    order = Window.partitionBy(*keys).orderBy("score", F.desc("latest"), F.desc("obs_count"), "import_name", *[c for c in LAST if c != "import_name"])
    return scored.withColumn("series_rank", F.row_number().over(order))


def rank_cohorts(cohorts: DataFrame, keys: list[str] = ["variable"]) -> DataFrame:
    """As ``rank_facets`` by score and the facet's columns only."""
    return cohorts.withColumn("cohort_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("score", *LAST)))


def drop_inferior_facets(ranked: DataFrame) -> DataFrame:
    """Without the facets of a score beyond 1000 that come after another."""
    return ranked.filter((F.col("score") <= INFERIOR) | (F.col("facet_rank") == 1))


def filter_facets(df: DataFrame, facet_ids: list[str] | None = None, domains: list[str] | None = None) -> DataFrame:
    """Rows whose facet id is listed and whose URL's host ends with one of the domains; an empty list matches all."""
    if facet_ids:
        df = df.filter(with_facet_id(df)["facet_id"].isin(facet_ids) if "facet_id" in df.columns else facet_id_of().isin(facet_ids))
    return df.filter(host_ends_with(F.col("provenance_url"), domains)) if domains else df


def facet_id_of() -> F.Column:
    """The id of a row's facet, from its five columns."""
    return facet_id(*[F.col(c) for c in ("import_name", "measurement_method", "observation_period", "scaling_factor", "unit")])


def with_facet_id(df: DataFrame) -> DataFrame:
    """``df`` with the id of each row's facet as ``facet_id``."""
    return df.withColumn("facet_id", facet_id_of())


def facet_stats(obs: DataFrame, rules: DataFrame) -> DataFrame:
    """Ranked facets of each (variable, entity) with counts and date ranges, without points."""
    return rank_facets(facet_score(series_of(obs), rules))


def facet_stats_contained(obs: DataFrame) -> DataFrame:
    """Of each (variable, facet) over all its entities: counts add up, dates are least and greatest."""
    return obs.groupBy("variable", *FACET).agg(F.count("*").alias("obs_count"), F.min("date").alias("earliest"), F.max("date").alias("latest"), F.countDistinct("entity").alias("entities"))


def best_value(obs: DataFrame, ranked: DataFrame, date: str | None = None) -> DataFrame:
    """variable, entity, date, value, facet_rank: with a date, of the first-ranked series that has it; else the latest.

    The latest point over the ranked series, ties going to the higher rank; an inferior series counts only where it is
    the first.
    """
    keys = ["variable", "entity"]
    if date:
        points = join_on(obs.filter(F.col("date") == date), ranked.select(*SERIES, "score", "facet_rank"), SERIES)
        best = points.groupBy(*keys).agg(F.min_by(F.struct("date", "value", "facet_rank"), "facet_rank").alias("b"))
    else:
        newest = drop_inferior_facets(ranked).select(*keys, F.col("latest").alias("date"), F.col("latest_value").alias("value"), "facet_rank")  # obs is not read again
        best = newest.groupBy(*keys).agg(F.max_by(F.struct("date", "value", "facet_rank"), F.struct(F.col("date"), -F.col("facet_rank"))).alias("b"))
    return best.select(*keys, "b.*")


def best_series(ranked: DataFrame, import_name: str | None = None, use_latest: bool = False) -> DataFrame:
    """One series for each (variable, entity): the first of an import, the top-ranked, or the first with the latest date."""
    rows = ranked.filter(F.col("import_name") == import_name) if import_name else ranked
    order = [F.desc("latest"), "facet_rank"] if use_latest else ["facet_rank"]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("variable", "entity").orderBy(*order))).filter("__n = 1").drop("__n")


def wanted_points(obs: DataFrame, requests: DataFrame | None) -> DataFrame:
    """The points of the wanted pairs (columns variable, entity), or all."""
    return obs if requests is None else obs.join(requests, ["variable", "entity"], "left_semi")


def bulk_point(obs: DataFrame, rules: DataFrame, requests: DataFrame | None = None, date: str | None = None, all_facets: bool = False) -> DataFrame:
    """The best value of each wanted pair (columns variable, entity), or the latest point of every facet.

    Only wanted series are ranked: a rank depends on the series of its own pair alone.
    """
    wanted = wanted_points(obs, requests)
    ranked = facet_stats(wanted, rules)
    if not all_facets:
        return best_value(wanted, ranked, date)
    if not date:
        return ranked.select("variable", "entity", F.col("latest").alias("date"), F.col("latest_value").alias("value"), "facet_rank")
    return join_on(wanted.filter(F.col("date") == date), ranked.select(*SERIES, "facet_rank"), SERIES).select("variable", "entity", "date", "value", "facet_rank")


def bulk_series(obs: DataFrame, rules: DataFrame, requests: DataFrame | None = None, all_facets: bool = False) -> DataFrame:
    """The points of the top-ranked series, or of all, of each wanted pair. Only wanted series are ranked."""
    wanted = wanted_points(obs, requests)
    chosen = facet_stats(wanted, rules)
    chosen = chosen if all_facets else chosen.filter("facet_rank = 1")
    return join_on(wanted, chosen.select(*SERIES, "facet_rank"), SERIES).select("variable", "entity", "facet_rank", "date", "value")


def ranked_points(obs: DataFrame, rules: DataFrame) -> DataFrame:
    """The points with the score and facet_rank of their series."""
    return join_on(obs, facet_stats(obs, rules).select(*SERIES, "score", "facet_rank"), SERIES)


def select_primary_source(points: DataFrame, score_desc: bool | None = None, override: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """variable, facet columns, places, points, latest of every source, by source_rank (1: the primary one, then the alternatives).

    Most places, most points, the latest date, then the least average facet rank, or the static score; ties by facet.
    Points are counted from ``start`` to ``end`` if given. A source whose facet id is ``override`` comes first, if it
    has any point.
    """
    points = filter_by_date_interval(points, start, end) if start or end else points
    per = points.groupBy("variable", *FACET).agg(
        F.countDistinct("entity").alias("places"), F.count("*").alias("points"), F.max("date").alias("latest"), F.avg("facet_rank").alias("avg_rank"), F.max("score").alias("score")
    )
    fourth = F.asc("avg_rank") if score_desc is None else F.desc("score") if score_desc else F.asc("score")
    first = [F.desc(facet_id_of() == override)] if override else []
    order = Window.partitionBy("variable").orderBy(*first, F.desc("places"), F.desc("points"), F.desc("latest"), fourth, *LAST)
    return per.withColumn("source_rank", F.row_number().over(order))


def sample_per_group(df: DataFrame, keys: list[str], by: str, n: int = 3) -> DataFrame:
    """Up to n rows of each group, in the order of ``by``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).filter(F.col("__n") <= n).drop("__n")


def order_by_type_priority(candidates: DataFrame, priority: list[str]) -> DataFrame:
    """Add ``position`` within each node: listed types first, then by type and id (columns node, type, dcid)."""
    at = F.array_position(F.array(*[F.lit(t) for t in priority]), F.col("type"))
    order = Window.partitionBy("node").orderBy(F.when(at > 0, at).otherwise(len(priority) + 1), "type", "dcid")
    return candidates.withColumn("position", F.row_number().over(order))


def location_rankings(points: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """variable, entity, value, rank_from_top, rank_from_bottom, total; values for each head where population (entity, people) is given.

    Distinct values are sorted into ranges over all variables; a rank is what the ranges before hold of the variable,
    and what comes before in its own range. So a variable that holds most points is ranked by many tasks. Equal values
    have equal ranks; null values come after all others from the top and before them from the bottom.
    """
    if population is not None:
        points = points.join(population, "entity").withColumn("value", F.try_divide("value", "people"))
    points = points.select("variable", "entity", "value")
    counts = points.groupBy("variable", "value").agg(F.count("*").alias("same"))
    order = [F.col("variable"), F.col("value").asc_nulls_first()]
    dealt = written(counts.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranked-values")
    sums = dealt.groupBy("variable", "part").agg(F.sum("same").alias("sum"))
    all_parts = Window.partitionBy("variable")  # a row for each range that holds the variable
    earlier = F.coalesce(F.sum("sum").over(all_parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("variable", "part", earlier.alias("before"), F.sum("sum").over(all_parts).alias("total"))
    upto = F.sum("same").over(Window.partitionBy("variable", "part").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranks = join_on(dealt.withColumn("upto", upto), sums, ["variable", "part"])
    ranks = ranks.select("variable", "value", (F.col("total") - F.col("before") - F.col("upto") + 1).alias("rank_from_top"), (F.col("before") + F.col("upto") - F.col("same") + 1).alias("rank_from_bottom"), "total")
    return join_on(points, ranks, ["variable", "value"]).select("variable", "entity", "value", "rank_from_top", "rank_from_bottom", "total")


def limit_per_type(neighbours: DataFrame, n: int) -> DataFrame:
    """Up to n neighbours for each (node, predicate, type), by id and then value."""
    order = Window.partitionBy("node", "predicate", "type").orderBy("object", "value")
    return neighbours.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")


def systematic_sample(df: DataFrame, keys: list[str], by: str, n: int) -> DataFrame:
    """Of each group about n rows: every ceil(size / n)-th, counted from the end."""
    group = Window.partitionBy(*keys)
    step = F.ceil(F.count("*").over(group) / n)
    rows = df.withColumn("__step", step).withColumn("__back", F.row_number().over(group.orderBy(F.desc(by))) - 1)
    return rows.filter(F.col("__back") % F.col("__step") == 0).drop("__step", "__back")
