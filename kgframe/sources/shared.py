"""Tables in the folder that all executors share, to cut lineage between rounds of a loop."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_shipped: set[str] = set()
_written: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, for they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    path = f"{tempfile.mkdtemp(prefix='spark-')}/{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where that is unset, a temporary one in local mode and an error on a
    cluster, whose executors would not see one another's files."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: computed once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of one schema that the rounds of a loop write; ``all`` reads them as one scan, so plans don't grow."""

    def __init__(self, name: str):
        self.name, self.paths, self.last = name, [], None

    def add(self, df: DataFrame) -> DataFrame:
        """The round's rows as a written table."""
        self.last = written(df, self.name)
        self.paths.append(_written[-1])
        return self.last

    def all(self) -> DataFrame:
        """The rows of all rounds so far."""
        return self.last.sparkSession.read.schema(self.last.schema).parquet(*self.paths)


def mark() -> int:
    """How many tables are written so far; ``release`` takes it."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the tables that ``written`` made after the first ``since``, once no result that reads them is wanted any more;
    how many there were. Tables that ``keep`` reads stay."""
    from urllib.parse import urlparse

    kept = {urlparse(f).path for f in keep.inputFiles()} if keep is not None else set()
    gone = [p for p in _written[since:] if not any(f.startswith(urlparse(p).path.rstrip("/") + "/") for f in kept)]
    _written[since:] = [p for p in _written[since:] if p not in gone]
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)
