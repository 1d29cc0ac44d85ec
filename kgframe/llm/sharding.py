"""Contiguous shards of nearly equal bytes: global prefix sums from per-partition totals, cut at equal targets.

Rows are range-partitioned by id once, with their sizes only. Each partition's total is a row of a small table whose
running sum gives every partition its offset; a running sum inside the partition completes the global prefix sum.
Only DataFrame functions are used, and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgframe.llm.common import table, written


def prefix_sums(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add to slim rows, in the order of ``order``: ``row_index`` (from 0), ``bytes_before``, ``all_bytes``."""
    dealt = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-rows")
    totals = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_offset"),
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_offset"),
        F.sum("b").over(every).alias("all_bytes"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    own = dealt.withColumn("own_row", F.row_number().over(within) - 1).withColumn(
        "own_bytes", F.coalesce(F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    # one row for each partition of the range exchange: far below any broadcast limit, and Spark checks it
    return (
        own.join(offsets, "part")
        .withColumn("row_index", F.col("rows_offset") + F.col("own_row"))
        .withColumn("bytes_before", F.col("bytes_offset") + F.col("own_bytes"))
        .drop("part", "own_row", "own_bytes", "rows_offset", "bytes_offset")
    )


def balanced_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` contiguous shards of nearly equal bytes, in the order of the id.

    A row's size is its UTF-8 bytes plus 1 (1 for a null text). It goes to the shard in which its middle byte lies,
    so a shard's bytes differ from the target by at most one row's. Rows with equal or null ids are ordered by
    checksum and size and all are kept; a shard may be empty if one text is larger than the target. An empty table
    gives no rows. Returns id, size, text_crc32 (a null text's is that of the empty one), shard, slot (gapless from 0).
    """
    slim = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")).alias("text_crc32"),
    )
    placed = prefix_sums(slim, [id_col, "text_crc32", "size"], "size").withColumn(
        "shard",
        F.least(F.expr(f"((2 * bytes_before + size) * {shards}) div (2 * all_bytes)"), F.lit(shards - 1)).cast("int"),
    )
    placed = written(placed.select(id_col, "size", "text_crc32", "shard", "row_index"), "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("row_index").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(  # at most one row for each shard
        id_col, "size", "text_crc32", "shard", (F.col("row_index") - F.col("first_row")).cast("long").alias("slot")
    )


def op3_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in eight contiguous shards of nearly equal bytes."""
    placed = balanced_shards(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", "size", F.coalesce("text_crc32", F.lit(0)).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: DuckDB has no CRC-32; its table follows from the polynomial.
OP3_BALANCED_SHARDS_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t
),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc_table
),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before, (sum(size) OVER ())::BIGINT AS total FROM sized
),
placed AS (SELECT *, least(((2 * before + size) * 8) // (2 * total), 7)::INT AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard
FROM placed
"""
