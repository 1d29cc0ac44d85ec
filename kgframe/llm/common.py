"""What the operators of this subpackage share: reading tables, cutting lineage, slicing Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from kgframe.sources.shared import ship as send
from kgframe.sources.shared import written

__all__ = ["free_name", "ship", "slices", "table", "written"]

#: Bytes of an Arrow batch: text goes to Python in pieces that any executor can hold many of.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, and have Arrow batches bounded by their bytes."""
    send(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be no column of ``df`` (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``max_bytes`` of text, one row at least, so that a task's memory is bounded."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()
