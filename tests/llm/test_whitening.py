"""Whitening against plain exact sums and a dense eigensolver."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgframe.llm import whitening as W


def matrix(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    v = q * np.array(values, float) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize(
    "values",
    [[5.0], [3, 1], list(range(40, 0, -1)), [100, *[1 + k * 1e-5 for k in range(60)]], [7, 7, 7, 7, 3, 3, 1, 1, 1, 1, 1, 1, 0.5], [2] * 12, [1e9, 1e3, 1, 1e-1], [4, 2, 0, 0, 0], list(np.logspace(4, -4, 30)), [0.0] * 5],
)
def test_components(values):
    v = matrix(values)
    got, vectors = W.components(v, 8)
    want = np.sort(np.linalg.eigvalsh(v))[::-1]
    keep = min(8, int((want > 1e-12 * max(1e-300, want.sum())).sum()))
    assert len(got) == keep
    scale = max(abs(want).max(), 1e-300)
    assert np.allclose(got, want[:keep], rtol=0, atol=1e-13 * scale)
    assert np.abs(vectors.T @ vectors - np.eye(keep)).max(initial=0) < 1e-12
    assert np.abs(v @ vectors - vectors * got).max(initial=0) <= 1e-13 * scale


def test_inertia_counts():
    v = matrix([9, 4, 4, 1, -2, -2, -7])
    d, s = W.tridiagonal(v)
    assert [W.above(d, s, x) for x in (10, 8, 3, 0, -1.5, -3, -8)] == [0, 1, 3, 4, 4, 6, 7]


def test_whole_query(spark, sf_dir):
    given = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(W.op13_whitening(spark, sf_dir).collect(), given, 8)


def check(rows, given, k):
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in given]
    n, d = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x)]
    off = [[n * a - s for a, s in zip(r, sums)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in off), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(rows) == n * k
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    signs = None
    for (i, _), r in zip(given, off):
        mine = by_id[i]
        assert all(mine[c].n == n and mine[c].deviation == sum(a * a for a in r) for c in mine)
        want = (np.array([float(Fraction(a, n)) for a in r]) @ vectors[:, :k]) / np.sqrt(values[:k])
        got = np.array([mine[c].whitened for c in range(1, k + 1)])
        if signs is None:
            signs = np.sign(got * want)
        assert np.allclose(got, want * signs, atol=1e-8)
    assert np.allclose([by_id[given[0][0]][c].explained for c in range(1, k + 1)], values[:k] / v.trace(), rtol=1e-10)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


SCHEMA = "vec_id long, embedding array<double>, component string, n int"


def test_hard_rows(spark):
    draw = np.random.default_rng(2)
    good = [(i, draw.standard_normal(3).tolist(), "x", 1) for i in range(40)]
    bad = [(100, None, "x", 1), (101, [1.0, None, 2.0], "x", 1), (102, [1.0, float("nan"), 2.0], None, 1), (103, [float("inf"), 0.0, 0.0], "x", None), (104, [], "x", 1), (105, [1.0, 2.0], "x", 1)]
    rows = W.whiten(spark.createDataFrame(good + bad, SCHEMA).repartition(5)).collect()
    check(rows, [(i, v) for i, v, *_ in good], 3)
    assert {r.length: r.rows for r in W.length_counts(spark.createDataFrame(good + bad, SCHEMA)).collect()} == {3: 40, 2: 1}


def test_repeats_and_large_entries(spark):
    """Repeated rows and null ids count as often as they are there; entries beyond the exact range of doubles' products."""
    given = [(None, [1e5, 2.0]), (1, [2.0, -3e5]), (1, [2.0, -3e5]), (2, [5e4, 5.0])]
    rows = W.whiten(spark.createDataFrame(given, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.component) for r in rows) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert max(r.identity_error for r in rows) < 1e-9


def test_without_variance_or_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [1.0, 5.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9)) for r in W.whiten(df).collect()) == [(1, 1, 1.0), (2, 1, 1.0)]
    assert W.whiten(df.where(F.col("vec_id") == 1)).collect() == []
    assert W.whiten(df.where(F.lit(False))).collect() == []
