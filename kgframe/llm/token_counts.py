"""Token counts of a corpus for every context limit, from one exact histogram of encoded lengths.

Documents are aggregated by encoded length; running sums of that histogram answer, for every limit, how many
documents fit, how many tokens there are, and how many are left when longer documents are cut at the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgframe.llm.bpe import default_path, encoded_lengths
from kgframe.llm.common import table, written

BLOCK = 1024


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens``, ``n_docs``: one row for each encoded length; null lengths count as 0."""
    return lengths.groupBy(F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def limit_table(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each encoded length L as a context limit: documents and tokens up to L, beyond L, and with texts cut at L.

    Sums run within blocks of ``block`` lengths and then over the blocks' totals, so that no task holds all lengths.
    Columns: n_tokens (the limit), n_docs (of just that length), docs_at_most, docs_longer, tokens_at_most,
    tokens_longer (whole lengths of the longer ones), truncated_total, share_at_most (the quantile that L is).
    An empty histogram gives an empty table.
    """
    rows = written(histogram.withColumn("block", F.floor(F.col("n_tokens") / block)), "length-histogram")
    weight = F.col("n_tokens") * F.col("n_docs")
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum(weight).alias("block_tokens"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("block_docs").over(every).alias("all_docs"),
        F.sum("block_tokens").over(every).alias("all_tokens"),
    )
    upto = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("docs_own", F.sum("n_docs").over(upto)).withColumn("tokens_own", F.sum(weight).over(upto))
    docs, tokens = F.col("docs_before") + F.col("docs_own"), F.col("tokens_before") + F.col("tokens_own")
    return own.join(totals, "block").select(
        "n_tokens",
        "n_docs",
        docs.alias("docs_at_most"),
        (F.col("all_docs") - docs).alias("docs_longer"),
        tokens.alias("tokens_at_most"),
        (F.col("all_tokens") - tokens).alias("tokens_longer"),
        (tokens + F.col("n_tokens") * (F.col("all_docs") - docs)).alias("truncated_total"),
        (docs / F.col("all_docs")).alias("share_at_most"),
    )


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """For each share the least limit under which at least that share of the documents fits: share, n_tokens."""
    found = limits.agg(*[F.min(F.when(F.col("share_at_most") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)])
    return found.select(F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])).alias("q")).select("q.*")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit table of all ``documents`` under the public word-end vocabulary; null and empty texts have length 0."""
    lengths = encoded_lengths(table(spark, sf_dir, "documents"), default_path())
    return limit_table(length_histogram(lengths))
