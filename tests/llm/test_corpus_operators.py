"""Nearest neighbours, the Jaccard join, the quality classifier and the pipeline: against brute force and held-out rows."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kgframe.llm import components, jaccard, neighbours, quality
from kgframe.llm.common import ship, table


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


# --- nearest neighbours ---
def nearest(vectors, queries, k):
    ids = np.array([i for i, _ in vectors])
    V = np.array([v for _, v in vectors], float)
    out = {}
    for i, v in queries:
        s = V @ np.array(v, float)
        keep = ids != i
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[i] = [int(x) for x in ids[keep][order]]
    return out


def test_factor_one_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6) * rng.uniform(0.1, 3)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # copies of one vector
    bad = [(2000, None), (2001, [0.0] * 6), (2002, [float("nan")] + [1.0] * 5), (2003, [float("inf")] * 6), (2004, [None] + [1.0] * 5), (2005, [1.0]), (2006, [])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + bad], "vec_id long, embedding array<double>, rank int, score double")
    index = neighbours.build_index(df, shard_rows=200)
    assert index.count() > 2
    queries = df.filter("vec_id % 20 = 0")
    got = collections.defaultdict(list)
    for r in neighbours.search(index, queries, 20, factor=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert dict(got) == want


def test_recall_with_the_production_factor(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    vectors = table(spark, d, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    got = neighbours.search(neighbours.build_index(vectors, shard_rows=200), vectors.filter("vec_id % 20 = 0"), 20).collect()
    want = nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert sum(r["vec_id"] in want[r["query_id"]] for r in got) >= 0.9 * 20 * len(want)


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (40, [0.5, 0.5]), (41, [0.1, 0.2])], "vec_id long, embedding array<float>")
    got = neighbours.search(neighbours.build_index(df), df.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(20, 40), (20, 41), (40, 20), (40, 41)]
    empty = df.filter("false")
    assert neighbours.search(neighbours.build_index(empty), df, 3).count() == 0
    assert neighbours.search(neighbours.build_index(df), empty, 3).count() == 0


# --- Jaccard join ---
def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = collections.defaultdict(list)
    for i, s in sets.items():
        shared = collections.Counter(j for h in s for j in having[h])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for h in s:
            having[h].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def hard_documents():
    rng = random.Random(3)
    rows = []
    for k in range(250):  # short texts of few words: many ties and small sets
        rows.append((k, " ".join(f"w{rng.randrange(3)}" if rng.random() < 0.4 else f"W{j % 40}" for j in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30])))))
    base = [f"q{j}" for j in range(120)]
    for k in range(150):  # a large group of near copies, some too far from each other
        t = list(base)
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(len(t))] = f"z{k}x{rng.random()}"
        rows.append((1000 + k, " ".join(t)))
    for k in range(100):  # one passage in unlike texts
        rows.append((2000 + k, " ".join(base[:50]) + " " + " ".join(f"u{k}x{j}" for j in range(rng.randint(20, 200)))))
    rows += [(3000 + k, rows[1000 - 850][1]) for k in range(60)]  # exact copies
    return rows + [(5000, None), (5001, ""), (5002, "  \n "), (5003, "x " * 20000), (5004, "x " * 19000)]


def test_jaccard_components_equal_brute_force(spark):
    rows = hard_documents()
    df = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, n_shingles int, component_id string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(df).collect()}
    assert got == brute_components(rows)


def test_jaccard_on_the_test_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op8_jaccard_join(spark, sf_dir).collect()}
    assert got == brute_components(docs)


def test_jaccard_empty_null_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.similar_documents(df).collect()), key=str)
    assert [r[2] for r in got if r[0]] == [1, 1, 1] and len(got) == 4
    assert jaccard.similar_documents(df.filter("false")).count() == 0


def test_published_segments_meet_at_the_threshold():
    rng = np.random.default_rng(5)
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 13, 21, 34, 63, 64, 65, 100, 300, 1000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            cut = int(len(a) / 7)
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, cut, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            key, ids = jaccard.published([a, b], np.array([1, 2]))
            assert set(key[ids == 1]) & set(key[ids == 2])


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 600)], "u long, v long")
    got = {r["id"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 600: 500}
    assert components.components(links.filter("false")).count() == 0


# --- quality ---
def test_held_out_quality(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    got = {r["doc_id"]: r for r in quality.op9_quality(spark, d).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, d, "labels").collect()}
    held = [i for i in labels if got[i]["held_out"]]
    assert len(held) > 50 and np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "word " * 30000, 1.0), (None, "a", 1.0), (4, "퟿\n\n!!", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (99, 1)], "doc_id long, quality int")
    got = quality.scored_documents(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.scored_documents(docs.filter("false"), labels).count() == 0
    assert all(r["score"] == 0.5 for r in quality.scored_documents(docs, labels.filter("false")).collect())


def test_isotonic_pools_neighbours():
    got = quality.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 1, 1]))
    assert np.allclose(got, [0, 2 / 3, 2 / 3, 1])


# --- pipeline ---
def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    good = corpus_pipeline.keep_good(spark, docs, sf_dir)
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.95
    distinct = corpus_pipeline.keep_distinct(spark, good, sf_dir)
    roots = brute_components([(r["doc_id"], r["text"]) for r in good.collect()])
    assert {r["doc_id"] for r in distinct.select("doc_id").collect()} == {i for i, (_, c) in roots.items() if c == i}
    hidden = corpus_pipeline.hide_persons(spark, distinct, sf_dir)
    assert hidden.columns == docs.columns and hidden.count() == distinct.count()
    mixed = corpus_pipeline.mix_sources(spark, hidden, sf_dir)
    assert mixed.columns == docs.columns
    assert corpus_pipeline.encode(spark, mixed, sf_dir).count() == mixed.count()


def test_pipeline_runs(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_words_of_colliding_letters_are_told_apart(spark):
    """Complementary Thue-Morse words, which polynomial hashes modulo a power of two can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (4, f"{a} {b} c d e f"), (5, f"{b} {a} c d e f")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_sets_whose_names_clash_are_told_apart(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) for _ in range(30)) for _ in range(60)]
    rows = [(i, texts[i // 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(df, bits=4).collect()}  # 16 names for 60 sets
    assert got == {i: i // 2 * 2 for i in range(120)}


def test_a_segment_that_most_documents_share(spark):
    """One passage in unlike documents and in near copies: tasks join what they meet, and no link is lost."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    unlike = [passage + " " + " ".join(word() for _ in range(12 + i % 40)) for i in range(150)]
    base = [word() for _ in range(80)]
    near = [passage + " " + " ".join(w if j != i % 80 else word() for j, w in enumerate(base)) for i in range(80)]
    rows = list(enumerate(unlike + near))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(df).collect()}
    assert got == brute_components(rows)


def test_long_texts_are_hashed_in_windows():
    from kgframe.llm import shingles

    words = [f"Word{i % 9973}" for i in range(400_000)]
    long_text = " \t".join(words).encode()
    a, ends = shingles.word_hashes([b"x y", long_text, b"", b"Z"])
    assert ends.tolist() == [2, 400_002, 400_002, 400_003]
    assert a[2:12].tolist() == [shingles.xxhash.xxh3_64_intdigest(w.lower().encode()) for w in words[:10]] and len(set(a.tolist())) == 9973 + 3


def test_quality_equals_plain_sums(spark, sf_dir):
    """Scores against normal equations, folds and isotonic levels that are worked out in one piece."""
    import zlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["quality"] is not None}
    part = lambda i: zlib.crc32(str(i).encode()) % 3
    ids = sorted(i for i in labels if i in docs and part(i) != 1)
    stats, y, fold = np.array([quality.statistics(docs[i] or "") for i in ids]), np.array([labels[i] for i in ids], float), np.array([part(i) == 2 for i in ids])
    rng, d = np.random.default_rng(7), len(quality.STATISTICS)
    waves, phase = rng.normal(size=(d, quality.FEATURES)) / 3.0 / np.sqrt(d) * 2, rng.uniform(0, 2 * np.pi, quality.FEATURES)
    mean, scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)

    def features(x):
        x = np.clip((x - mean) / scale, -8, 8)
        return np.hstack([np.cos(x @ waves + phase) * np.sqrt(2 / quality.FEATURES), x / 8, np.ones((len(x), 1))])

    def ridge(x, t):
        return np.linalg.solve(x.T @ x + np.eye(x.shape[1]) * 1e-3 * len(x), x.T @ t)

    z = features(stats)
    raw = np.where(fold, z @ ridge(z[~fold], y[~fold]), z @ ridge(z[fold], y[fold]))
    at = np.clip((raw + 1) / 3 * quality.BINS, 0, quality.BINS - 1).astype(int)
    bins = np.unique(at)
    n, s = np.array([(at == b).sum() for b in bins]), np.array([y[at == b].sum() for b in bins])
    levels = [max(min(s[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(bins))) for a in range(i + 1)) for i in range(len(bins))]
    own = ridge(z, y)
    got = {r["doc_id"]: r for r in quality.op9_quality(spark, sf_dir).collect()}
    for i, text in docs.items():
        want = np.interp(features(np.array([quality.statistics(text or "")])) @ own, -1 + (bins + 0.5) * 3 / quality.BINS, levels)[0]
        assert abs(got[i]["score"] - want) < 1e-6 and got[i]["held_out"] == (part(i) == 1) and got[i]["predicted"] == (got[i]["score"] >= 0.5)


def test_good_documents_keep_columns_and_take_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Some plain words here. And more of them.", "x"), (2, None, "y"), (2, "", "z"), (None, "a", "w")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (None, 1), (9, None)], "doc_id long, quality int")
    assert quality.good_documents(docs, labels).columns == docs.columns
    assert quality.good_documents(docs.filter("false"), labels).count() == 0
    assert quality.good_documents(docs, labels.filter("false")).count() == 4


def test_repeated_and_null_ids_of_vectors(spark):
    rows = [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [0.9, 0.1]), (8, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [1.0, 0.2]), (20, [1.0, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(neighbours.build_index(df), df.filter("vec_id % 20 = 0 or vec_id is null"), 20).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(20, 7), (20, 8)]
    assert abs(got[0]["score"] - 0.92) < 1e-12  # the least vector of id 7


def test_an_id_that_most_rows_repeat(spark):
    hot = spark.range(20000).selectExpr("7L as vec_id", "array(1.0D, id / 20000D) as embedding")
    rest = spark.range(100, 140).selectExpr("id as vec_id", "array(id / 200D, 0.1D) as embedding")
    df = hot.unionByName(rest)
    index = neighbours.build_index(df, shard_rows=1000)
    assert sum(len(neighbours.Tree.load(r["tree"]).ids) for r in index.collect()) == 41
    got = neighbours.search(index, df.filter("vec_id = 100"), 1).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(7, 0.5)]  # the least vector of id 7 is (1, 0)


def test_pruning_saves_inner_products(monkeypatch):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(8192, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    tree = neighbours.Tree.build(np.arange(8192), rows, 1.0, 0)
    done, dots = [0], neighbours.dots
    monkeypatch.setattr(neighbours, "dots", lambda q, r: done.__setitem__(0, done[0] + len(q) * len(r)) or dots(q, r))
    exact, _ = tree.search(np.arange(64), rows[:64], 20, 1.0)
    whole, done[0] = done[0], 0
    found, _ = tree.search(np.arange(64), rows[:64], 20, neighbours.FACTOR)
    assert done[0] < 0.95 * whole
    assert sum(len(set(a) & set(b)) for a, b in zip(exact, found)) >= 0.9 * 20 * 64


def test_jaccard_links_through_rows_without_an_id(spark):
    """A row with a null id lends no id but links others; as many rows as like may be without one."""
    words = [f"w{i}" for i in range(40)]
    a, n, b = " ".join(words), " ".join(["x", "y", *words[2:]]), " ".join(["x", "y", *words[2:38], "p", "q"])
    rows = [(1, a), (None, n), (None, n), (2, b), (None, "five other words are here"), (None, None), (3, "nothing like the others at all")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {x for x in got if x[0] is not None} == {(1, 1), (2, 1), (3, 3)}
    named = {(r["doc_id"], r["component_id"]) for r in jaccard.similar_documents(spark.createDataFrame([(5 if t == n else i, t) for i, t in rows], "doc_id long, text string")).collect()}
    assert {(1, 1), (2, 1), (5, 1)} <= named
    assert jaccard.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id is null").count() == 4


def test_vectors_of_every_length_are_searched(spark):
    """Candidates are of the query's length; ties across shards go to the smaller id."""
    rng = np.random.default_rng(4)
    by_length = {d: [(100 * d + i, [float(x) for x in rng.integers(-3, 4, size=d)]) for i in range(60)] for d in (2, 3, 5)}
    rows = [r for some in by_length.values() for r in some if any(r[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = collections.defaultdict(list)
    index = neighbours.build_index(df, shard_rows=20)
    for r in neighbours.search(index, df.filter("vec_id % 20 = 0"), 20, factor=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = {}
    for some in by_length.values():
        some = [r for r in some if any(r[1])]
        want |= nearest(some, [r for r in some if r[0] % 20 == 0], 20)
    assert dict(got) == want


def test_clusters_are_pruned_without_loss(monkeypatch):
    """Where vectors lie in clusters, exact search leaves most of them out."""
    rng = np.random.default_rng(3)
    rows = np.repeat(rng.normal(size=(64, 16)), 128, axis=0) + 0.02 * rng.normal(size=(8192, 16))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    tree = neighbours.Tree.build(np.arange(8192), rows, 1.0, 0)
    done, dots = [0], neighbours.dots
    monkeypatch.setattr(neighbours, "dots", lambda q, r: done.__setitem__(0, done[0] + len(q) * len(r)) or dots(q, r))
    found, _ = tree.search(np.arange(0, 8192, 128), rows[::128], 20, 1.0)
    assert done[0] < 0.25 * 64 * 8192
    for q, ids in zip(range(0, 8192, 128), found):
        s = rows @ rows[q]
        s[q] = -np.inf
        assert set(ids) == set(np.argsort(-s, kind="stable")[:20])
