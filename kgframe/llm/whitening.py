"""Embedding whitening: principal components by FEAST contour integration.

Sums and products of the vectors are exact integers, added up in tasks, so results don't depend on how rows are dealt.
Only one d x d matrix reaches the driver. There, bisection on inertia counts (Sturm sequences of the tridiagonal form)
cuts the wanted end of the spectrum into intervals; for each, a quadrature of complex shifted solves around the
interval projects onto its eigenvectors, Rayleigh-Ritz extracts them, and the inertia counts tell whether any is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgframe.llm.common import table

#: Components that are returned.
COMPONENTS = 8
#: The grid of the integers: x = floor(GRID * c) + OFFSET.
GRID, OFFSET = 1024, 100_000
#: Points of the quadrature on the upper half of a contour, and eigenvalues of an interval at most if no cluster forces more.
POINTS, TOGETHER = 8, 8
#: Rounds of projection before an interval is halved.
ROUNDS = 12
#: Components with less than this share of the variance are taken for constant directions, which can't be whitened.
LEAST = 1e-13


# --- eigenvectors of one matrix ---
def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The diagonal and the side of a tridiagonal matrix with the eigenvalues of ``v``, by Householder reflections."""
    t = v.copy()
    for k in range(len(t) - 2):
        u = t[k + 1 :, k].copy()
        size = np.linalg.norm(u)
        if size == 0:
            continue
        u[0] += size if u[0] >= 0 else -size
        u /= np.linalg.norm(u)
        t[k + 1 :, :] -= 2 * np.outer(u, u @ t[k + 1 :, :])
        t[:, k + 1 :] -= 2 * np.outer(t[:, k + 1 :] @ u, u)
    return np.diag(t).copy(), np.diag(t, -1).copy()


def above(diagonal: np.ndarray, side: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: the positive pivots of the shifted matrix (Sylvester's law of inertia)."""
    tiny = np.finfo(float).eps * (np.abs(diagonal).max() + (np.abs(side).max() if len(side) else 0)) + np.finfo(float).tiny
    count, pivot = 0, 1.0
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shift - (side[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return count


def cut(count: Callable[[float], int], want: int, low: float, high: float, margin: float) -> float:
    """A shift with ``want`` eigenvalues above it, in the gap below them and ``margin`` away from any; with as few more
    as clusters closer than that ask for. ``count`` gives the number above a shift."""
    under, over = low, high
    for _ in range(100):
        middle = (under + over) / 2
        if middle in (under, over) or over - under < margin:
            break
        under, over = (middle, over) if count(middle) >= want else (under, middle)
    while under > low:
        n = count(under)
        for k in range(1, 60):
            probe = under - (under - low) / 2**k
            if count(probe) == n:
                if under - probe > 2 * margin:
                    return (under + probe) / 2
                break
        under -= 2 * margin
    return low


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
    """The ``count`` eigenpairs of symmetric ``v`` between ``low`` and ``high``, by falling eigenvalue; none if the filter of
    that interval doesn't part them well from the others."""
    d = len(v)
    size = min(d, max(count + 4, int(1.5 * count) + 2))
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    centre, radius = (low + high) / 2, (high - low) / 2
    angles = np.pi / 2 * (nodes + 1)  # the upper half; the lower one is its conjugate
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, size)))[0]
    scale, last = np.abs(v).sum(axis=1).max(), np.inf
    for _ in range(ROUNDS):
        projected = np.zeros((d, size))
        for angle, weight in zip(angles, weights):
            turn = radius * np.exp(1j * angle)
            projected += weight / 2 * np.real(turn * np.linalg.solve((centre + turn) * np.eye(d) - v, basis.astype(complex)))
        left, sizes, _ = np.linalg.svd(projected, full_matrices=False)
        left = left[:, sizes > sizes[0] * 1e-14]
        values, small = np.linalg.eigh(left.T @ v @ left)
        basis, values = left @ small[:, ::-1], values[::-1]
        inside = (values > low) & (values <= high)
        error = np.linalg.norm(v @ basis[:, inside] - basis[:, inside] * values[inside], axis=0).max(initial=0.0) if inside.sum() >= count else np.inf
        if inside.sum() == count and (error <= 4e-16 * scale or error <= 1e-13 * scale and error >= last / 2):
            return values[inside], basis[:, inside]
        last = min(last, error)
        if basis.shape[1] < size:  # directions that the filter took away are drawn anew
            basis = np.linalg.qr(np.hstack([basis, np.random.default_rng(seed + 1).standard_normal((d, size - basis.shape[1]))]))[0]
    return None


def between(v: np.ndarray, count: Callable[[float], int], low: float, high: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """All eigenpairs between two shifts; an interval that the filter can't part from the rest is halved."""
    n = count(low) - count(high)
    if not n:
        return np.zeros(0), np.zeros((len(v), 0))
    if found := feast(v, low, high, n):
        return found
    if high - low < 4 * margin:
        raise ArithmeticError(f"{n} eigenvalues between {low} and {high} were not found")
    middle = (low + high) / 2
    for k in range(1, 40):  # away from eigenvalues
        if count(middle - margin) == count(middle + margin):
            break
        middle += (-1) ** k * 2 * k * margin
    (upper, a), (lower, b) = (between(v, count, *ends, margin) for ends in ((middle, high), (low, middle)))
    return np.concatenate([upper, lower]), np.hstack([a, b])


def components(v: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvalues and unit eigenvectors (as columns) of a covariance by falling eigenvalue, ``want`` at most.

    Each interval of the spectrum is held against its inertia count, so that none is missed.

    Directions without variance are left out. Equal eigenvalues are found together, with some basis of their space.
    """
    d = len(v)
    trace = np.trace(v)
    if not d or trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    diagonal, side = tridiagonal(v)
    reach = np.abs(v).sum(axis=1).max() * (1 + 1e-9)
    count = lambda shift: above(diagonal, side, shift)
    floor, margin = max(trace * LEAST, d * np.finfo(float).eps * reach), 1e-14 * reach
    want = min(want, count(floor))
    values, vectors, high, have = [], [], reach * 1.01, 0
    while have < want:
        low = cut(count, have + min(TOGETHER, want - have), floor, high, margin)
        found, basis = between(v, count, low, high, margin)
        values.append(found)
        vectors.append(basis)
        have, high = have + len(found), low
    return np.concatenate(values)[:want], np.hstack(vectors)[:, :want]


# --- sums over all rows ---
def clean(vectors: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector is not null, not empty and holds neither null nor non-finite entries."""
    v = F.col(vector_col)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad))


def integers(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of an Arrow list column as integers of the grid."""
    flat = np.floor(GRID * np.asarray(column.flatten(), np.float64)) + OFFSET
    if len(flat) and np.abs(flat).max() >= 2.0**62:
        raise OverflowError("an entry is too large for a long")
    return flat.astype(np.int64).reshape(-1, d)


def products(z: np.ndarray) -> np.ndarray:
    """Exact sums of products of integer rows, as Python integers where machine numbers can't hold them."""
    most = int(np.abs(z).max(initial=0))
    if most * most * max(1, len(z)) < 1 << 53:
        return (z.astype(float).T @ z.astype(float)).astype(np.int64).astype(object)
    z = z.astype(object)
    return z.T @ z


def summed(parts: DataFrame, fan: int) -> list[int]:
    """The sums, entry by entry, of long lists of whole numbers (``blob``, as text), added up in tasks in two steps."""

    def add(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in rows:
            for blob in f["blob"]:
                part = np.array([int(x) for x in blob.split()], object)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"blob": [" ".join(map(str, total))]})

    some = parts.repartition(fan, "deal").select("blob").mapInPandas(add, "blob string")
    total = None
    for r in some.toLocalIterator():
        part = np.array([int(x) for x in r.blob.split()], object)
        total = part if total is None else total + part
    return [] if total is None else list(total)


def partition_sums(rows: DataFrame, vector_col: str, d: int, centre: list[int] | None) -> list[int]:
    """Exact sums over all vectors: their entries, or if there is a ``centre`` the products of what is left of it after that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            x = integers(b.column(0), d)
            for at in range(0, len(x), 4096):
                z = x[at : at + 4096]
                if centre is None:
                    most = int(np.abs(z).max(initial=0))
                    part = (z if most * len(z) < 1 << 62 else z.astype(object)).sum(axis=0).astype(object)
                else:
                    z = z - np.array(centre, np.int64)
                    part = np.concatenate([products(z).ravel(), z.astype(object).sum(axis=0)])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"deal": pa.array([TaskContext.get().partitionId()], pa.int32()), "blob": [" ".join(map(str, total))]})

    parts = rows.select(vector_col).mapInArrow(run, "deal int, blob string")
    return summed(parts, max(1, int(rows.rdd.getNumPartitions() ** 0.5)))


def fit(rows: DataFrame, vector_col: str, d: int) -> tuple[int, list[int], np.ndarray]:
    """Count, sums and covariance of the integer vectors. Products are centred on the nearest whole mean; what is left is taken off exactly."""
    n = rows.count()
    sums = partition_sums(rows, vector_col, d, None)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    both = partition_sums(rows, vector_col, d, centre)
    outer, rest = np.array(both[: d * d], object).reshape(d, d), np.array(both[d * d :], object)
    exact = n * outer - np.outer(rest, rest)
    return n, sums, np.array([[int(c) / (n * n) for c in row] for row in exact], float).reshape(d, d)


def length_counts(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """How many usable vectors there are of each length: length, rows. ``whiten`` fits the commonest, of equals the longest."""
    return clean(vectors, vector_col).groupBy(F.size(vector_col).alias("length")).agg(F.count("*").alias("rows"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates: id, component, n, deviation, whitened, explained, identity_error.

    One row for each usable vector and component (``k`` at most, and fewer where there are fewer directions with
    variance). Null vectors, empty ones and those with null or non-finite entries take no part; nor do vectors of other
    lengths than the commonest, which ``length_counts`` reports. Repeated rows and ids count and come back as often as
    they are there, null ids too; other columns are left out. Without usable vectors the result is empty; where a
    deviation exceeds a long, the job fails.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    lengths = length_counts(vectors, vector_col).orderBy(F.desc("rows"), F.desc("length")).head(1)
    if not lengths:
        return spark.createDataFrame([], schema)
    d = lengths[0].length
    rows = clean(vectors, vector_col).where(F.size(vector_col) == d)
    n, sums, v = fit(rows, vector_col, d)
    values, basis = components(v, k)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    ratio, scales = values / np.trace(v), np.sqrt(values)

    def deviations(x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums)))
        return n * x - np.array(sums, np.int64) if most < 1 << 62 else n * x.astype(object) - np.array(sums, object)

    def coordinates(off: np.ndarray) -> np.ndarray:
        return (off / n).astype(float) @ basis / scales

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k)
        for b in batches:
            w = coordinates(deviations(integers(b.column(0), d)))
            total += np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(total)), pa.int32()), "part": total})

    found = rows.select(vector_col).mapInArrow(spread, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
    flat = np.array([r.part for r in sorted(found, key=lambda r: r.at)]) / n
    error = float(np.abs(flat[: k * k].reshape(k, k) - np.outer(flat[k * k :], flat[k * k :]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = deviations(integers(b.column(1), d))
            exact = off if int(np.abs(off).max(initial=0)) ** 2 * d < 1 << 62 else off.astype(object)
            size = pa.array((exact * exact).sum(axis=1).tolist(), pa.int64())
            each = np.repeat(np.arange(len(off)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(off))),
                    pa.array(np.full(len(each), n, np.int64)),
                    size.take(pa.array(each)),
                    pa.array(coordinates(off).ravel()),
                    pa.array(np.tile(ratio, len(off))),
                    pa.array(np.full(len(each), error)),
                ],
                names=schema.names,
            )

    return rows.select(id_col, vector_col).mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors of ``embeddings`` in their first eight whitened principal components."""
    return whiten(table(spark, sf_dir, "embeddings"))
