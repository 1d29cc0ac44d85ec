"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics of every whole text are taken once. Their random Fourier features approximate a Gaussian kernel; ridge
weights come from normal equations that each partition sums for its own rows, so what is gathered is a matrix of the
number of features squared, whatever the corpus. Scores that other folds' weights give to the labelled rows are
calibrated to probabilities by isotonic regression over a histogram of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgframe.llm.common import slices, table, written

#: What is measured of a text, in this order.
STATISTICS = [
    "log_chars", "log_words", "chars_a_word", "letters", "upper", "digits", "spaces", "signs", "bangs", "bars", "hash_signs", "stops", "commas", "wide",
    "distinct_words", "repeat_next", "repeat_two", "distinct_pairs", "top_word", "marked_words", "upper_words", "plain_words", "distinct_lines", "words_a_line", "words_a_stop", "entropy", "longest_word",
]
FEATURES = 256
BINS = 2000
#: Labelled documents that a filter is fitted on, at most; those with the least hash of their id.
SAMPLE = 20_000


def statistics(text: str) -> list[float]:
    """The statistics of one whole text; all are finite, also of an empty one."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    c = np.bincount(raw, minlength=256)
    upper, lower, digits = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    wide = c[128:].sum()
    spaces = c[32] + c[9:14].sum()
    signs = c[33:127].sum() - upper - lower - digits
    p = c[c > 0] / n
    words = text.split()
    m = max(1, len(words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    near = sum(a == b for a, b in zip(words, words[1:]))
    two = sum(a == b for a, b in zip(words, words[2:]))
    pairs = len(set(zip(words, words[1:])))
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words)
    shouted = sum(w.isupper() for w in words)
    plain = sum(w.isalpha() for w in words)
    lines = [x for x in text.split("\n") if x]
    stops = int(c[46] + c[33] + c[63])
    return [
        math.log1p(len(raw)), math.log1p(len(words)), min(40.0, (n - spaces) / m), (upper + lower + wide) / n, upper / max(1, upper + lower), digits / n, spaces / n, signs / n,
        c[33] / m, c[124] / m, (c[35] + c[36] + c[37] + c[38] + c[42]) / m, c[46] / m, c[44] / m, wide / n,
        len(seen) / m, near / m, two / m, pairs / m, max(seen.values(), default=0) / m, marked / m, shouted / m, plain / m,
        len(set(lines)) / max(1, len(lines)), math.log1p(m / max(1, len(lines))), math.log1p(m / max(1, stops)), float(-(p * np.log2(p)).sum()), math.log1p(max(map(len, words), default=0)),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, stats array<double> of every whole text; a null text counts as empty. One pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            stats = [statistics(t or "") for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(stats, pa.list_(pa.float64()))], [id_col, "stats"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, stats array<double>")


@dataclass
class Model:
    """Scaling, the random features, ridge weights, and the calibrated steps (score edge, probability)."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.waves + self.phase) * math.sqrt(2 / self.waves.shape[1])
        return np.hstack([z, x / 8, np.ones((len(x), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(stats) @ self.weights, self.edges, self.levels), 0, 1)


def _matrix(b: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    flat = b.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(b), -1) if len(b) else np.zeros((0, len(STATISTICS)))


def isotonic(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The non-decreasing levels nearest to ``sums / counts`` by pooling neighbours; bins without rows take the level before."""
    pools: list[list[float]] = []
    for n, s in zip(counts, sums):
        pools.append([n, s, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n2, s2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + n2, pools[-1][1] + s2, pools[-1][2] + k2]
    return np.concatenate([np.full(int(k), s / n if n else 0.0) for n, s, k in pools]) if pools else np.zeros(0)


def fit(labelled: DataFrame, features: int = FEATURES, width: float = 3.0, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Fit to rows (stats array<double>, label 0/1 or null, fold 0/1). Rows without a label are left out.

    With no labelled rows every score is 0.5. The driver gets sums only: two matrices, and two histograms of BINS.
    """
    labelled = labelled.filter("label is not null and stats is not null").select("stats", F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold"))
    d = len(STATISTICS)
    moments = labelled.agg(F.count("*").alias("n"), *[f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    rng = np.random.default_rng(seed)
    mean = np.array([moments[f"avg{i}"] or 0.0 for i in range(d)])
    scale = np.array([max(moments[f"stddev_pop{i}"] or 0.0, 1e-6) for i in range(d)])
    model = Model(mean, scale, rng.normal(size=(d, features)) / width / math.sqrt(d) * 2, rng.uniform(0, 2 * math.pi, features), np.zeros(features + d + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not moments["n"]:
        return model
    size = features + d + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size + 1, size))  # of each fold: the normal matrix, and below it the right side
        for b in batches:
            z, y, fold = model.features(_matrix(b)), b.column("label").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False)
            for f in (0, 1):
                sums[f, :size] += z[fold == f].T @ z[fold == f]
                sums[f, size] += z[fold == f].T @ y[fold == f]
        rows = [(f, i) for f in (0, 1) for i in range(size + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([sums[r].tolist() for r in rows], pa.list_(pa.float64()))], ["fold", "i", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for f, i, v in zip(b.column("fold").to_pylist(), b.column("i").to_pylist(), _matrix(b, "v")):
                held[f, i] = held[f, i] + v if (f, i) in held else v.copy()
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k].tolist() for k in keys], pa.list_(pa.float64()))], ["fold", "i", "v"])

    schema = "fold int, i int, v array<double>"
    gathered = labelled.mapInArrow(partial, schema).repartition("fold", "i").mapInArrow(added, schema)  # each row of the matrices is added up in one task
    sums = np.zeros((2, size + 1, size))
    for r in gathered.collect():
        sums[r["fold"], r["i"]] += np.array(r["v"])

    def solve(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[:size] + np.eye(size) * (ridge * max(1.0, s[size - 1, size - 1])), s[size])

    by_fold = [solve(sums[1]), solve(sums[0])]  # the weights for rows of a fold come from the other
    low, high = -1.0, 2.0

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ones = np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            z, y, fold = model.features(_matrix(b)), b.column("label").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False)
            raw = np.where(fold == 0, z @ by_fold[0], z @ by_fold[1])
            at = np.clip((raw - low) / (high - low) * BINS, 0, BINS - 1).astype(int)
            counts += np.bincount(at, minlength=BINS)
            ones += np.bincount(at, weights=y, minlength=BINS)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full]), pa.array(ones[full])], ["bin", "n", "ones"])

    counts, ones = np.zeros(BINS), np.zeros(BINS)
    for r in labelled.mapInArrow(histogram, "bin int, n double, ones double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect():
        counts[r["bin"]], ones[r["bin"]] = r["n"], r["ones"]
    full = np.flatnonzero(counts)
    model.weights = solve(sums[0] + sums[1])
    model.edges = low + (full + 0.5) * (high - low) / BINS
    model.levels = isotonic(counts[full], ones[full])
    return model


def score(stats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id, score (0 to 1) of each row of statistics."""
    kind = stats.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(model.score(_matrix(b)), pa.float64())], [id_col, "score"])

    return stats.select(id_col, "stats").mapInArrow(run, f"`{id_col}` {kind}, score double")


def remainder(id_col: str = "doc_id"):
    return F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 3


def learning_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, label, fold (0 or 1) of the labels (id, quality) outside the held-out third.

    Contradicting labels of an id count half each; null ids and null labels are not used.
    """
    one = labels.filter(f"quality is not null and `{id_col}` is not null").groupBy(id_col).agg(F.avg("quality").alias("label"))
    return one.filter(remainder(id_col) != 1).withColumn("fold", (remainder(id_col) == 2).cast("int"))


def fitted(stats: DataFrame, learning: DataFrame, id_col: str = "doc_id") -> Model:
    """The model for statistics (id, stats), learnt from ``learning_labels``; labels of unknown ids are not used."""
    return fit(written(stats.join(learning, id_col).select("stats", "label", "fold"), "labelled-statistics"))


def scored_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, held_out, score, predicted of every row of ``docs``, learnt from all labels outside the held-out third.

    Null and empty texts are scored like others. A null id is never labelled; its held_out is false. Repeated rows
    keep their places; an empty table gives an empty one; other columns are left out.
    """
    stats = written(document_statistics(docs, id_col), "document-statistics")
    return score(stats, fitted(stats, learning_labels(labels, id_col), id_col), id_col).select(
        id_col, F.coalesce(remainder(id_col) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``; each row is judged by its own text, without a shuffle.

    Statistics of at most ``sample`` labelled documents are taken to fit the model, those of all others once, to judge
    them. Null and empty texts are judged like others; repeated rows stay or go together.
    """
    learning = written(learning_labels(labels, id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample), "learning-labels")
    few = docs.select(id_col, text_col).join(F.broadcast(learning.select(id_col)), id_col, "left_semi")  # ``sample`` ids at most
    model = fitted(document_statistics(few, id_col, text_col), learning, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            stats = np.array([statistics(t or "") for t in b.column(text_col).to_pylist()]).reshape(len(b), -1)
            yield b.filter(pa.array(model.score(stats) >= least))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scored as ``labels.quality`` marks it."""
    return scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
