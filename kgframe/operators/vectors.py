"""Exact search of vectors in blocks, and an inverted file: lists around k-means centres, of which a query reads the nearest."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgframe.sources.shared import shared_dir, ship, written

#: Vectors that the centres are fitted on, and lists, at most.
SAMPLE, LISTS = 50_000, 1024
#: Vectors of the sample in a task of the fit.
FITTED = 4096
#: Numbers in the vectors of a shard, queries that meet it at once, and numbers that are multiplied at once to score pairs.
SHARD_VALUES, BLOCK, SLICE = 1 << 19, 256, 1 << 21


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has a direction, with the vector as doubles of length one."""
    v = F.transform(column, lambda x: x.cast("double"))
    size = F.sqrt(_dot(v, v))
    units = F.transform(F.array(size), lambda n: F.transform(v, lambda x: x / n))  # else Spark works the size out for each entry
    return df.filter((size > 0) & (size < float("inf"))).withColumn(column, F.get(units, F.lit(0)))


def _running(products: np.ndarray) -> np.ndarray:
    """Sums of rows, added from left to right as ``_dot`` does, so that equal vectors get equal scores."""
    return np.add.accumulate(products, axis=1)[:, -1]


@dataclass
class _Group:
    """Vectors of one length, of one list if there are lists: their rows in the shard, ascending, entries and sizes."""

    rows: np.ndarray
    v: np.ndarray
    size: np.ndarray
    unit: np.ndarray


def _hard(size: np.ndarray) -> np.ndarray:
    """Where squares of entries are beyond what doubles hold in full."""
    return ~((size > 1e-140) & (size < 1e140))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _held(shard: pa.Table) -> dict[tuple[int, int], _Group]:
    """The vectors of a shard by list (-1 without lists) and length."""
    lists = shard.column("list").combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
    v = shard.column("v").combine_chunks()
    lengths = v.value_lengths().to_numpy(zero_copy_only=False)
    sizes = shard.column("size").to_numpy()
    order = np.lexsort((lengths, lists))
    cuts = np.flatnonzero((np.diff(lists[order]) != 0) | (np.diff(lengths[order]) != 0)) + 1
    out = {}
    for rows in np.split(order, cuts):
        m = _matrix(v.take(pa.array(rows)))
        out[int(lists[rows[0]]), int(lengths[rows[0]])] = _Group(rows, m, sizes[rows], m / sizes[rows][:, None])
    return out


def _best(group: _Group, q: np.ndarray, size: np.ndarray, threshold: float, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row of the group and score of each query's ``limit`` best at least: one product of matrices tells which pairs
    can be among them, and those are scored by ``_running``."""
    near = (q / size[:, None]) @ group.unit.T
    hard = _hard(size)[:, None] | _hard(group.size)  # of these only the score itself tells
    near[hard] = -np.inf
    least = np.full(len(q), float(threshold))
    if near.shape[1] > limit:
        least = np.maximum(least, np.partition(near, -limit, axis=1)[:, -limit])
    at, row = np.nonzero((near >= (least - 1e-12 * (8 + q.shape[1]))[:, None]) | hard)
    step = max(1, SLICE // q.shape[1])
    parts = [_running(q[at[k : k + step]] * group.v[row[k : k + step]]) for k in range(0, len(at), step)]
    score = np.concatenate(parts or [np.zeros(0)]) / (size[at] * group.size[row])
    kept = (score >= threshold) | np.isnan(score)
    return at[kept], row[kept], score[kept]


def best_pairs(queries: DataFrame, vectors: DataFrame, shards: int, threshold: float, limit: int) -> DataFrame:
    """query_id, vec_id, score, position: the ``limit`` best vectors of each query among those in the same shards, by the
    inner product over both sizes, at least ``threshold``.

    queries: shard (int, from 0 to ``shards`` - 1), query_id, q, size and lists (array, null for all); vectors: shard, vec_id,
    v, size and list (or null).
    Exact: each pair is worked out, in blocks of 256 queries with the vectors of a shard, as products of matrices; a
    task holds one shard and one block, and sends on ``limit`` rows for each query. Equal scores go by vec_id.
    """
    spark = queries.sparkSession
    ship(spark)
    ids = T.StructType([T.StructField(c, df.schema[c].dataType) for c, df in (("query_id", queries), ("vec_id", vectors))])
    null = lambda kind: F.lit(None).cast(kind)
    there = vectors.select("shard", F.lit(0).alias("kind"), null(ids["query_id"].dataType).alias("query_id"), "vec_id", "v", "size", F.col("list").cast("int").alias("list"), null("array<int>").alias("lists"))
    asked = queries.select("shard", F.lit(1).alias("kind"), "query_id", null(ids["vec_id"].dataType).alias("vec_id"), F.col("q").alias("v"), "size", null("int").alias("list"), F.col("lists").cast("array<int>").alias("lists"))

    def search(held: dict[tuple[int, int], _Group], names: pa.Array, block: pa.RecordBatch) -> pa.RecordBatch:
        v, sizes, lists = block.column("v"), block.column("size").to_numpy(), block.column("lists")
        lengths = v.value_lengths().to_numpy(zero_copy_only=False)
        every = lists.is_null().to_numpy(zero_copy_only=False)
        flat, of = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(block)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        found = []
        for dim in np.unique(lengths):
            same = np.flatnonzero(lengths == dim)
            q, place = _matrix(v.take(pa.array(same))), np.full(len(block), -1)
            place[same] = np.arange(len(same))
            for (name, length), group in held.items():
                if length == dim:
                    at = same if every.all() else np.intersect1d(np.union1d(np.flatnonzero(every), of[flat == name]), same)
                    if len(at):
                        mine, row, score = _best(group, q[place[at]], sizes[at], threshold, limit)
                        found.append((at[mine], group.rows[row], score))
        at, row, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        order = np.lexsort((row, -np.where(np.isnan(score), np.inf, score), at))
        at, row, score = at[order], row[order], score[order]
        first = np.searchsorted(at, at)  # where the query's rows begin
        top = np.arange(len(at)) - first < limit
        return pa.RecordBatch.from_arrays([block.column("query_id").take(pa.array(at[top])), names.take(pa.array(row[top])), pa.array(score[top], pa.float64())], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, held, names = None, [], {}, None
        for batch in batches:
            key = batch.column("shard").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)] if len(key) else []
            for a, b in zip(cuts, cuts[1:]):
                if key[a] // 2 != shard:
                    shard, waiting, held, names = key[a] // 2, [], {}, None
                if key[a] % 2 == 0:
                    waiting.append(batch.slice(a, b - a))
                elif waiting or held:
                    if waiting:
                        table = pa.Table.from_batches(waiting)
                        with np.errstate(all="ignore"):
                            held, names, waiting = _held(table), table.column("vec_id").combine_chunks(), []
                    for k in range(a, b, BLOCK):
                        with np.errstate(all="ignore"):
                            found = search(held, names, batch.slice(k, min(BLOCK, b - k)))
                        yield found

    both = there.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "vec_id")
    found = both.mapInArrow(run, T.StructType([*ids.fields, T.StructField("score", T.DoubleType())]))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def sized(df: DataFrame, column: str) -> DataFrame:
    """Rows with a vector that has no null and is not zero, as doubles, and its length as ``size``."""
    v = F.transform(column, lambda x: x.cast("double"))
    return df.withColumn(column, v).withColumn("size", F.sqrt(_dot(F.col(column), F.col(column)))).filter("size > 0")


def shards_for(values: int) -> int:
    """Shards that hold ``SHARD_VALUES`` numbers each."""
    return max(1, math.ceil(values / SHARD_VALUES))


@dataclass
class VectorIndex:
    """Unit vectors as a table partitioned by ``list``, the centres of the lists and the number of vectors in each."""

    table: DataFrame
    centres: np.ndarray
    sizes: dict[int, int]


def build_vector_index(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> VectorIndex:
    """Index vectors (vec_id, v, and what else is to be kept) by direction.

    Centres are fitted by k-means on at most ``sample`` vectors, those with the least hash of their id, by tasks of 4,096
    each; every vector is indexed, in the list of its nearest centre. ``lists`` is the square root of the number of vectors if not given, at
    most 1,024. The table is written to the shared folder by list and id, so a list that most vectors are in is
    written and read by many tasks. Vectors without a direction (null, zero, non-finite entries) are left out.
    """
    spark = vectors.sparkSession
    units = _unit(vectors, "v")
    chosen = units.select(array_to_vector("v").alias("features"), F.xxhash64("vec_id").alias("order")).orderBy("order").limit(sample)
    chosen = written(chosen.repartition(math.ceil(sample / FITTED)).select("features"), "index-sample")  # else one file and one task hold it whole
    n = units.count()
    if not n:
        return VectorIndex(written(units.withColumn("list", F.lit(0)), "vector-index"), np.zeros((0, 0)), {})
    lists = max(1, min(lists or math.ceil(n**0.5), LISTS, chosen.count()))
    if lists == 1:
        placed, centres = units.withColumn("list", F.lit(0)), np.zeros((1, len(units.first()["v"])))
    else:
        model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine", predictionCol="list", solver="block").fit(chosen)
        centres = np.array(model.clusterCenters())
        placed = model.transform(units.withColumn("features", array_to_vector("v"))).drop("features")
    path = f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}"
    placed.repartitionByRange("list", "vec_id").write.partitionBy("list").parquet(path)
    table = spark.read.schema(placed.schema).parquet(path)
    return VectorIndex(table, centres, {r["list"]: r["count"] for r in table.groupBy("list").count().collect()})  # a row for each list


def _shards(index: VectorIndex) -> dict[int, list[int]]:
    """The shards that hold each list: short lists share one, long lists have several."""
    rows = max(1, SHARD_VALUES // max(1, index.centres.shape[1]))
    out, shard, room = {}, -1, 0
    for name, n in sorted(index.sizes.items()):
        parts = math.ceil(n / rows)
        if parts > 1 or n > room:
            out[name] = list(range(shard + 1, shard + 1 + parts))
            shard, room = shard + parts, rows if parts == 1 else 0
        else:
            out[name] = [shard]
        room -= n
    return out


def probed(queries: DataFrame, index: VectorIndex, probes: int | None) -> DataFrame:
    """query_id, q, shard, lists: for each query (query_id, q of length one) the ``probes`` lists whose centres are nearest,
    or all, a row for each shard that holds some of them."""
    centres, lists, shards = index.centres, sorted(index.sizes), _shards(index)
    probes = len(lists) if probes is None else min(probes, len(lists))
    held: dict[int, list[int]] = {}  # places in ``lists`` by shard
    for k, name in enumerate(lists):
        for shard in shards[name]:
            held.setdefault(shard, []).append(k)

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(lists)
        for f in frames:
            if len(f):
                asked = np.zeros((len(f), len(lists)), bool)
                if probes == len(lists):
                    asked[:] = True
                else:
                    near = np.argsort(-(np.vstack(f["q"].to_list()) @ centres[lists].T), axis=1, kind="stable")[:, :probes]
                    np.put_along_axis(asked, near, True, axis=1)
                for shard, own in held.items():
                    part = asked[:, own]
                    some = part.any(axis=1)
                    yield f[some].assign(shard=shard, lists=[names[own][row] for row in part[some]])

    schema = T.StructType([*queries.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("lists", T.ArrayType(T.IntegerType()))])
    return queries.mapInPandas(nearest, schema) if lists else queries.withColumns({"shard": F.lit(0), "lists": F.array(F.lit(0))}).limit(0)


def search_vector_index(queries: DataFrame, index: VectorIndex, threshold: float, limit: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
    """query_id, vec_id, score, position: the ``limit`` best vectors of each query (query_id, q) by cosine similarity of at
    least ``threshold``, among those in the ``probes`` nearest lists; exact if ``probes`` is None. ``where`` restricts vectors.

    Only files of lists that some query probes are read. Equal scores go by vec_id. Lists are put together, or cut where
    they are long, to shards of at most half a million numbers; a query goes once to each shard that it probes a list of.
    """
    spark, shards = queries.sparkSession, _shards(index)
    asked = written(probed(_unit(queries.select("query_id", "q"), "q"), index, probes), "probed-lists")
    wanted = sorted(index.sizes) if probes is None else [r["list"] for r in asked.select(F.explode("lists").alias("list")).distinct().collect()]  # at most LISTS
    vectors = index.table.filter(F.col("list").isin(wanted)) if wanted else index.table.limit(0)
    vectors = vectors if where is None else vectors.filter(where)
    placed = spark.createDataFrame([(name, at) for name, at in shards.items()], "list int, shards array<int>")  # at most LISTS
    number = F.pmod(F.monotonically_increasing_id(), F.size("shards").cast("long")).cast("int")  # whatever the id: one may be in most rows
    vectors = vectors.select("vec_id", "v", "list", F.lit(1.0).alias("size")).join(F.broadcast(placed), "list").withColumn("shard", F.get("shards", number))
    if probes is None:  # then a shard is searched as one
        asked, vectors = asked.withColumn("lists", F.lit(None).cast("array<int>")), vectors.withColumn("list", F.lit(None).cast("int"))
    return best_pairs(asked.withColumn("size", F.lit(1.0)), vectors, max([0, *(x for at in shards.values() for x in at)]) + 1, threshold, limit)


def share_read(queries: DataFrame, index: VectorIndex, probes: int | None) -> float:
    """The share of all pairs of a query and a vector that a search works out."""
    n, shards = sum(index.sizes.values()), _shards(index)
    met = probed(_unit(queries.select("query_id", "q"), "q"), index, probes).select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect()  # a row for each list
    asked = _unit(queries.select("query_id", "q"), "q").count()
    return sum(index.sizes[r["list"]] * r["n"] / len(shards[r["list"]]) for r in met) / max(1, n * asked)
