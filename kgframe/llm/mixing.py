"""Mix sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the target rows over the rows it has. Each document's count is the
inverse of that Poisson distribution at a number hashed from the seed and the document's id; the document is exploded
by its count and all copies are shuffled globally by a hash. A high rate is a sum of Poisson numbers of rate WHOLE and
a rest, each inverted at a hashed number of its own, so no plan grows with a rate. Only DataFrame functions are used: there is no join, so
a source that holds a third of all rows costs no more than others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgframe.llm.common import free_name, table

#: The stratum of every source without a weight of its own.
REST = "*"
#: Hashed numbers have this many bits, so that SQL engines can hold them exactly.
BITS = 52
#: Rates above this are cut into parts of it and a rest.
WHOLE = 128

#: Production weights: shares of the mix.
WEIGHTS = {"src0": 0.10, "src1": 0.08, "src2": 0.08, "src3": 0.06, "src4": 0.06, "src5": 0.12, REST: 0.50}
SEED = "mix-1"


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) hashed from the seed and the parts; the same on every run and engine."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("double") + 0.5) / float(2**BITS)


def stratum(source: Column, weights: dict[str, float]) -> Column:
    """A source's own name if it has a weight, else ``*`` (null sources too)."""
    named = [w for w in weights if w != REST]
    return F.when(source.isin(named), source).otherwise(F.lit(REST))


def poisson_steps(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... until it is 1 to within a hashed number's precision."""
    if rate <= 0:
        return [1.0]
    steps, k = [], 0
    while not steps or steps[-1] < 1 - 2.0**-BITS and k <= rate + 40 * math.sqrt(rate + 1) + 40:
        steps.append(min(1.0, (steps[-1] if steps else 0.0) + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))))
        k += 1
    return steps


def poisson_count(rate: float, seed: str, name: Column) -> Column:
    """The Poisson count of a row whose hash is of ``name``: the inverted rest of the rate, plus its inverted whole parts."""

    def inverted(r: float, u: Column) -> Column:
        return F.size(F.filter(F.array(*[F.lit(x) for x in poisson_steps(r)]), lambda step: u >= step))

    parts = max(0, math.ceil(rate / WHOLE) - 1)
    rest = inverted(rate - parts * WHOLE, uniform(seed, name))
    if not parts:
        return rest
    return F.aggregate(F.sequence(F.lit(1), F.lit(parts)), rest, lambda n, i: n + inverted(float(WHOLE), uniform(seed, F.lit("part"), i, name)))


def rates(docs: DataFrame, weights: dict[str, float], total: int | None = None, source_col: str = "source") -> dict[str, float]:
    """The mean repetition rate of each weighted stratum. ``total``: rows of the mix, as many as ``docs`` has by default.

    All rows are counted; the driver gets one row for each weight. Weights are taken relative to the strata that have rows.
    """
    counts = {r[0]: r[1] for r in docs.groupBy(stratum(F.col(source_col), weights).alias("s")).agg(F.count("*")).collect()}
    there = {s: w for s, w in weights.items() if counts.get(s)}
    whole = sum(there.values())
    total = sum(counts.values()) if total is None else total
    return {s: total * w / whole / counts[s] for s, w in there.items()} if whole > 0 else {}


def replicate(docs: DataFrame, weights: dict[str, float], seed: str, total: int | None = None, id_col: str = "doc_id", source_col: str = "source", copy_col: str = "copy_no") -> DataFrame:
    """``docs`` with every row repeated by its Poisson count, in global random order; ``copy_col`` counts from 1.

    A source without a weight belongs to ``*``; where ``*`` has none either, its rows have rate 0 and go. Null ids and
    null sources hash as the word null. Rows with equal ids get equal counts; the order is the same for the same partitions of ``docs``. An empty table gives an empty table.
    All columns of ``docs`` are kept; ``copy_col`` must not be one of them.
    """
    if copy_col in docs.columns:
        raise ValueError(f"docs has a column {copy_col}; name another copy_col")
    found = rates(docs, weights, total, source_col)
    own = stratum(F.col(source_col), weights)
    count = F.lit(0)
    for s, rate in found.items():
        count = F.when(own == s, poisson_count(rate, seed, F.col(id_col))).otherwise(count)
    count_col, key_col, from_col = free_name(docs, "copies"), free_name(docs, "place"), free_name(docs, "read_in")
    copies = docs.withColumn(count_col, count).filter(F.col(count_col) > 0).withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(count_col)))).drop(count_col)
    # the partition that a row is read in parts rows that repeat an id, however many they are
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(copy_col), F.col(from_col))
    copies = copies.withColumn(from_col, F.spark_partition_id()).withColumn(key_col, key).drop(from_col)
    return copies.repartition(key_col).sortWithinPartitions(key_col).drop(key_col)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to the production weights: doc_id, source, copy_no, text, in shuffled order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return replicate(docs, WEIGHTS, SEED).withColumn("copy_no", F.col("copy_no").cast("long"))


_NAMED = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in WEIGHTS.items())


def mixing_sql(docs: str, seed: str, columns: str) -> str:
    """DuckDB SQL for ``replicate`` over the relation ``docs``: ``columns`` and copy_no."""
    return f"""
WITH weights(stratum, weight) AS (VALUES {_NAMED}),
strata AS (SELECT d.*, CASE WHEN source IN (SELECT stratum FROM weights WHERE stratum <> '{REST}') THEN source ELSE '{REST}' END AS stratum FROM {docs} d),
counts AS (SELECT stratum, count(*) AS n FROM strata GROUP BY stratum),
rates AS (
  SELECT stratum, (SELECT sum(n) FROM counts) * weight / sum(weight) OVER () / n AS rate
  FROM counts JOIN weights USING (stratum)
),
parts AS (SELECT stratum, greatest(0, ceil(rate / {WHOLE}) - 1)::BIGINT AS parts, rate - {WHOLE} * greatest(0, ceil(rate / {WHOLE}) - 1) AS rest FROM rates),
terms AS (
  SELECT stratum, k, exp(k * ln(rest) - rest - lgamma(k + 1)) AS p
  FROM (SELECT stratum, rest FROM parts UNION ALL SELECT '-', {WHOLE}.0 WHERE EXISTS (FROM parts WHERE parts > 0)), range(0, 400) AS t(k)
  WHERE k <= rest + 40 * sqrt(rest + 1) + 40
),
steps AS (SELECT stratum, k, sum(p) OVER (PARTITION BY stratum ORDER BY k) AS upto FROM terms),
whole AS (
  SELECT stratum, name, count(*) AS copies
  FROM (SELECT stratum, name, ((('0x' || substr(md5('{seed}:part:' || i || ':' || name), 1, {BITS // 4}))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS u
        FROM (SELECT stratum, name, unnest(range(1, parts + 1)) AS i
              FROM (SELECT DISTINCT stratum, coalesce(doc_id::VARCHAR, 'null') AS name FROM strata) JOIN parts USING (stratum) WHERE parts > 0)) n
  JOIN (SELECT upto FROM steps WHERE stratum = '-') w ON w.upto <= n.u
  GROUP BY ALL
),
numbered AS (
  SELECT *, (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, {BITS // 4}))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM strata
),
counted AS (
  SELECT n.*, (SELECT count(*) FROM steps s WHERE s.stratum = n.stratum AND s.upto <= n.u) + coalesce(w.copies, 0) AS copies
  FROM numbered n LEFT JOIN whole w ON w.stratum = n.stratum AND w.name = coalesce(n.doc_id::VARCHAR, 'null')
)
SELECT {columns}, c AS copy_no FROM (SELECT *, unnest(range(1, copies + 1)) AS c FROM counted WHERE copies > 0)
"""


OP10_MIXING_SQL = mixing_sql("documents", SEED, "doc_id, source, lang, text")
