"""Derived statistics: formulas over series, and filling gaps with them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgframe.functions.scalars import facet_id
from kgframe.operators.joins import join_on
from kgframe.operators.observations import FACET, filter_series_by_props
from kgframe.sources.shared import written

KEYS = ["entity", *FACET, "date"]


def operand(obs: DataFrame, variable: str, **props: str | None) -> DataFrame:
    """The points of one variable whose facet has the given properties."""
    return filter_series_by_props(obs.filter(F.col("variable") == variable), **props)


def eval_formula(operands: dict[str, DataFrame], expr: Callable[..., Column], output: str, on_zero: str = "error") -> DataFrame:
    """Points of ``output``: the expression over operands that share entity, facet (nulls are equal) and date.

    ``expr`` takes a column for each operand by name. A division by zero fails (``error``, ANSI arithmetic) or drops
    the point (``null``, for expressions that divide with ``F.try_divide``).
    """
    frames = [df.select(*KEYS, F.col("value").alias(f"v_{name}")) for name, df in operands.items()]
    joined = reduce(lambda a, b: join_on(a, b, KEYS), frames)
    out = joined.select(F.lit(output).alias("variable"), *KEYS, expr(**{n: F.col(f"v_{n}") for n in operands}).alias("value"))
    return out if on_zero == "error" else out.filter("value IS NOT NULL")


def mark_derived_facets(points: DataFrame) -> DataFrame:
    """Add ``facet_id`` of the facet as an aggregate of its own."""
    cols = [F.col(c) for c in ("import_name", "measurement_method", "observation_period", "scaling_factor", "unit")]
    return points.withColumn("is_dc_aggregate", F.lit(True)).withColumn("facet_id", facet_id(*cols, F.lit(True)))


def fill_holes(requests: DataFrame, obs: DataFrame, derived: list[DataFrame]) -> DataFrame:
    """Points of wanted pairs (variable, entity) that have none, from the first formula (in order) that gives any."""
    holes = requests.join(obs.select("variable", "entity").distinct(), ["variable", "entity"], "left_anti")
    made = reduce(DataFrame.unionByName, [d.withColumn("formula_order", F.lit(i)) for i, d in enumerate(derived)]).join(holes, ["variable", "entity"], "left_semi")
    first = made.groupBy("variable", "entity").agg(F.min("formula_order").alias("formula_order"))
    return made.join(first, ["variable", "entity", "formula_order"], "left_semi")


def load_formulas(triples: DataFrame) -> DataFrame:
    """output, expressions (sorted) of every statistical calculation."""
    calc = triples.filter("predicate = 'typeOf' AND object_id = 'StatisticalCalculation'").select("subject_id")
    outs = triples.filter("predicate = 'outputProperty'").select("subject_id", F.coalesce("object_id", "object_value").alias("output"))
    ins = triples.filter("predicate = 'inputPropertyExpression'").select("subject_id", F.coalesce("object_value", "object_id").alias("expression"))
    return calc.join(outs, "subject_id").join(ins, "subject_id").groupBy("output").agg(F.sort_array(F.collect_set("expression")).alias("expressions"))


def derived_series(operands: dict[str, DataFrame], expr: Callable[..., Column], output: str) -> DataFrame:
    """entity, date, value by the older rule: of the facets whose exact list of dates all operands have, the longest list wins.

    Ties go to the greatest list and then, in each operand, to the greatest facet; then arithmetic point by point. Lists
    are told by digests (count, length, sum and xor of the dates' hashes), so no list is collected; a winner whose
    operands turn out to have different dates is left out.
    """
    key = F.concat_ws("^", *[F.coalesce(c, F.lit("\u0001")) for c in FACET])  # a null is no empty string
    digest = ["n", "length", "sum", "xor"]
    marked = {}
    for name, df in operands.items():
        points = df.withColumn("facet", key).select("entity", "facet", "date", "value")
        hashed = F.xxhash64("date")
        series = points.select("entity", "facet", "date").distinct().groupBy("entity", "facet").agg(F.count("date").alias("n"), F.sum(F.length("date") + 1).alias("length"), F.sum(hashed.cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "date")).alias("xor"))
        marked[name] = (points, written(series, "series-digests"))
    common = reduce(lambda a, b: a.join(b, ["entity", *digest]), [s.select("entity", *digest).distinct() for _, s in marked.values()])
    longest = common.groupBy("entity").agg(F.max("length").alias("length"))
    best = written(common.join(longest, ["entity", "length"], "left_semi"), "longest-lists")
    points, series = next(iter(marked.values()))
    while True:  # of equally long lists the greatest is the one that lacks the least date which they don't share
        tied = best.groupBy("entity").agg(F.count("*").alias("lists")).filter("lists > 1")
        if tied.isEmpty():
            break
        one = series.join(best.join(tied, "entity"), ["entity", *digest]).groupBy("entity", "lists", *digest).agg(F.max("facet").alias("facet"))
        dates = written(points.join(one, ["entity", "facet"]).select("entity", "lists", *digest, "date").distinct(), "tied-dates")
        least = dates.groupBy("entity", "lists", "date").agg(F.count("*").alias("have")).filter("have < lists").groupBy("entity").agg(F.min("date").alias("date"))
        best = written(best.join(dates.join(least, ["entity", "date"]).select("entity", *digest), ["entity", *digest], "left_anti"), "longest-lists")
    frames = []
    for name, (points, series) in marked.items():
        facet = series.join(best, ["entity", *digest]).groupBy("entity").agg(F.max("facet").alias("facet"), F.first("n").alias("n"))
        frames.append(points.join(facet, ["entity", "facet"]).select("entity", "date", "n", F.col("value").alias(f"v_{name}")))
    joined = reduce(lambda a, b: a.join(b.drop("n"), ["entity", "date"]), frames)
    same = joined.groupBy("entity", "n").agg(F.count_distinct("date").alias("met")).filter("met = n").select("entity")
    return joined.join(same, "entity", "left_semi").select(F.lit(output).alias("variable"), "entity", "date", expr(**{n: F.col(f"v_{n}") for n in operands}).alias("value"))


def convert_units(obs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename units and scale values by a small table (unit, new_unit, factor)."""
    return obs.join(mapping, "unit", "left").withColumns({"value": F.col("value") * F.coalesce("factor", F.lit(1.0)), "unit": F.coalesce("new_unit", "unit")}).drop("new_unit", "factor")
