"""The vector index against exact search: on evenly spread directions and on clusters."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from kgframe.operators import search, vectors
from kgframe.plans import q_search
from kgframe.sources import shared
from kgframe.sources.shared import ship


def tables(spark, data, every):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    return df, df.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


def brute(data, every, threshold, limit):
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    found = {}
    for i in range(0, len(data), every):
        s = unit @ unit[i]
        order = sorted(range(len(data)), key=lambda j: (-round(s[j], 12), j))
        found[i] = [j for j in order if s[j] >= threshold][:limit]
    return found


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["position"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_clusters_need_few_lists(spark):
    ship(spark)
    draw = np.random.default_rng(5)
    data = np.repeat(draw.standard_normal((30, 16)), 40, axis=0) + 0.15 * draw.standard_normal((1200, 16))
    df, q = tables(spark, data, 20)
    index = vectors.build_vector_index(df)
    assert sum(index.sizes.values()) == 1200
    want = brute(data, 20, 0.3, 10)
    assert result(vectors.search_vector_index(q, index, 0.3, 10)) == want
    got = result(vectors.search_vector_index(q, index, 0.3, 10, 6))
    recall = sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.95 and vectors.share_read(q, index, 6) < 0.35


def test_recall_of_the_query(spark, sf_dir):
    exact = {(r["query_id"], r["vec_id"]) for r in q_search.k2_all_lists(spark, "/root/testdata/sf0.1").collect()}
    near = {(r["query_id"], r["vec_id"]) for r in q_search.k2_index(spark, "/root/testdata/sf0.1").collect()}
    assert len(near & exact) >= 0.95 * len(exact)


def test_one_direction_for_most_rows(spark):
    ship(spark)
    data = np.vstack([np.tile([1.0, 2.0, 3.0], (500, 1)), np.random.default_rng(1).standard_normal((100, 3))])
    df, q = tables(spark, data, 50)
    index = vectors.build_vector_index(df, lists=10)
    assert sum(index.sizes.values()) == 600
    assert result(vectors.search_vector_index(q, index, 0.5, 10)) == brute(data, 50, 0.5, 10)


def test_hard_vectors(spark):
    ship(spark)
    rows = [(1, [1.0, 0.0], "a"), (2, None, "a"), (3, [0.0, 0.0], "a"), (4, [float("nan"), 1.0], "b"), (5, [2.0, 0.0], "b"), (5, [0.0, 1.0], None), (None, [1.0, 1.0], "c"), (6, [None, 1.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, list string").drop("list")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, q array<double>")
    index = vectors.build_vector_index(df)
    got = vectors.search_vector_index(q, index, 0.5, 10).collect()
    assert sorted(((r["vec_id"], round(r["score"], 6)) for r in got), key=str) == [(1, 1.0), (5, 1.0), (None, round(1 / math.sqrt(2), 6))]
    assert vectors.search_vector_index(q.filter("query_id = 2"), index, 0.5, 10).collect() == []
    empty = vectors.build_vector_index(df.filter("vec_id = 2"))
    assert empty.sizes == {} and vectors.search_vector_index(q, empty, 0.5, 10).collect() == [] and vectors.share_read(q, empty, 3) == 0


def test_many_pairs_take_little_time(spark):
    entry = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.hash(F.col("id"), k) / F.lit(2.0**31))
    v = spark.range(40_000).select(F.col("id").alias("vec_id"), entry.alias("v"), F.lit(1).alias("label"))
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    began = time.time()
    assert search.vector_search(q, v, 0.1, 10).count() == 20_000
    assert time.time() - began < 40  # 80 million pairs


def test_exact_search_of_hard_vectors(spark):
    inf, nan = math.inf, math.nan
    rows = [
        (7, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [-1.0, -2.0]), (5, [2.0, 1.0]), (1, None), (2, [0.0, 0.0]), (4, [None, 1.0]), (6, [1.0, 2.0, 3.0]),
        (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1e-160, 2e-160]), (11, [1e200, 1.0]), (12, []), *((20 + i, [1.0, float(i)]) for i in range(9)),
    ]
    v = spark.createDataFrame([(i, x, (i or 0) % 3) for i, x in rows], "vec_id long, v array<double>, label int")
    q = v.filter("vec_id IS NULL OR vec_id < 13").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    pairs = q.crossJoin(v.select("vec_id", F.col("v").alias("w"), "label"))
    double = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda c: F.sqrt(double(c, c))
    scored = pairs.filter((size("q") > 0) & (size("w") > 0)).withColumn("score", double("q", "w") / (size("q") * size("w"))).filter("score >= 0.2")
    order = lambda r: (r["query_id"] is not None, r["query_id"] or 0, 0.0 if math.isnan(r["score"]) else 1.0, 0.0 if math.isnan(r["score"]) else -r["score"], r["vec_id"] is not None, r["vec_id"] or 0)
    for labels in (None, [0, 2]):
        want = {}
        for r in sorted(scored.filter(F.col("label").isin(labels)).collect() if labels else scored.collect(), key=order):
            want.setdefault(r["query_id"], []).append((r["vec_id"], str(r["score"])))
        got = {}
        for r in sorted(search.vector_search(q, v, 0.2, 4, labels).collect(), key=lambda r: r["position"]):
            got.setdefault(r["query_id"], []).append((r["vec_id"], str(r["score"])))
        assert got == {k: x[:4] for k, x in want.items()}


def test_a_query_goes_to_shards_not_to_lists(spark):
    ship(spark)
    df, q = tables(spark, np.random.default_rng(3).standard_normal((600, 4)), 10)
    index = vectors.build_vector_index(df, lists=20)
    assert len(index.sizes) > 10 and vectors.probed(q, index, None).count() == 60
    assert abs(vectors.share_read(q, index, None) - 1) < 1e-9


def test_sample_of_the_index_is_not_in_one_task(spark):
    ship(spark)
    df = spark.range(12_000).select(F.col("id").alias("vec_id"), F.array(*[F.hash("id", F.lit(k)).cast("double") for k in range(3)]).alias("v"))
    since = shared.mark()
    index = vectors.build_vector_index(df, lists=4)
    (sample,) = [p for p in shared._written[since:] if "index-sample" in p]
    held = [r["count"] for r in spark.read.parquet(sample).groupBy(F.input_file_name()).count().collect()]
    assert sum(held) == sum(index.sizes.values()) == 12_000 and max(held) <= 3_000
