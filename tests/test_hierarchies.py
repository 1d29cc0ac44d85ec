"""Distinct counts, tags and closures over hierarchies with many paths, cycles and long chains."""

import random

import pytest

from kgframe.operators import bitmaps, graph, hierarchy
from kgframe.sources import shared


@pytest.fixture(scope="module")
def tree(spark):
    """Groups in layers with several parents each, a cycle, a group without variables and variables in many groups."""
    draw = random.Random(8)
    rows = [(f"g{k}", f"g{draw.randrange(k)}", "group") for k in range(1, 60) for _ in range(2)] + [("g3", "g40", "group"), ("empty", "g0", "group")]
    rows += [(f"v{draw.randrange(300)}", f"g{draw.randrange(60)}", "variable") for _ in range(900)]
    return list(set(rows)), spark.createDataFrame(list(set(rows)), "child string, parent string, kind string")


def below(rows):
    children = {}
    for child, parent, kind in rows:
        children.setdefault(parent, set()).add((child, kind))
    found = {}
    for g in {p for _, p, _ in rows} | {"empty"}:
        seen, todo = set(), [g]
        while todo:
            for child, kind in children.get(todo.pop(), ()):
                if (child, kind) not in seen:
                    seen.add((child, kind))
                    todo.append(child)
        found[g] = {c for c, kind in seen if kind == "variable"}
    return found


def test_counts_by_bitmaps(spark, tree):
    rows, df = tree
    want = below(rows)
    assert {r["group_id"]: r["n"] for r in bitmaps.counts_below(df).collect()} == {g: len(v) for g, v in want.items() if v}
    some = spark.createDataFrame([(f"v{k}",) for k in range(0, 300, 7)] * 2, "variable string")
    kept = {f"v{k}" for k in range(0, 300, 7)}
    assert {r["group_id"]: r["n"] for r in hierarchy.filtered_topic(df, some).collect()} == {g: len(v & kept) for g, v in want.items() if v & kept}
    assert bitmaps.counts_below(df.filter("false")).collect() == []


def test_variables_below_wanted_groups(spark, tree):
    rows, df = tree
    want = below(rows)
    groups = spark.createDataFrame([("g1",), ("g40",), ("empty",), ("nowhere",)], "group_id string")
    got = {tuple(r) for r in hierarchy.variables_below(df, groups).collect()}
    assert got == {(g, v) for g in ("g1", "g40") for v in want[g]}


def test_many_numbers_fill_more_than_one_bucket(spark):
    df = spark.range(40_000).selectExpr("concat('v', id) AS child", "concat('g', id % 3) AS parent", "'variable' AS kind")
    df = df.unionByName(spark.createDataFrame([("g0", "top", "group"), ("g1", "top", "group"), ("g2", "g0", "group")], df.schema))
    assert {r["group_id"]: r["n"] for r in bitmaps.counts_below(df).collect()} == {"g0": 26667, "g1": 13333, "g2": 13333, "top": 40000}


def test_tags_go_to_each_node_once(spark, tree):
    rows, df = tree
    seeds = spark.createDataFrame([(t, v) for t, v in (("a", "v1"), ("a", "v2"), ("b", "v2"), ("c", "none"))], "tag string, node string")
    got = [tuple(r)[:2] for r in graph.tagged(hierarchy._as_edges(df), seeds, "up").collect()]
    want = below(rows)
    assert len(got) == len(set(got))
    assert set(got) == {(t, g) for g, v in want.items() for t, mine in (("a", {"v1", "v2"}), ("b", {"v2"})) if v & mine}


def test_a_chain_of_a_thousand_takes_few_rounds(spark, monkeypatch):
    n = 1000
    edges = spark.range(n).selectExpr("id AS subject_id", "'in' AS predicate", "id + 1 AS object_id")
    made = []
    monkeypatch.setattr(shared, "written", lambda df, name, f=shared.written: made.append(name) or f(df, name))
    found = graph.closure(edges, "in")
    assert made.count("closure") <= 12
    assert found.count() == n * (n + 1) // 2 and found.filter("depth <> ancestor - child").isEmpty()
    assert graph.closure(edges, "in", 5).count() == sum(min(5, n - i) for i in range(n))


def test_least_depths_with_shortcuts(spark):
    draw = random.Random(3)
    pairs = {(draw.randrange(40), draw.randrange(40)) for _ in range(90)}
    edges = spark.createDataFrame([(a, "in", b) for a, b in pairs], "subject_id long, predicate string, object_id long")
    want = {}
    for a in range(40):
        ring, depth, seen = {b for x, b in pairs if x == a}, 1, {}
        while ring:
            seen.update(dict.fromkeys(ring, depth))
            ring, depth = {y for x, y in pairs if x in ring} - seen.keys(), depth + 1
        want.update({(a, b): d for b, d in seen.items()})
    assert {(r["child"], r["ancestor"]): r["depth"] for r in graph.closure(edges, "in").collect()} == want


def test_labels_equal_closure(spark):
    """Forests with several parents, cycles, self-loops and a parent that most nodes share."""
    from kgframe.operators import labels

    draw = random.Random(12)
    trees = [(f"n{k}", f"n{draw.randrange(max(0, k - 9), k)}") for k in range(1, 80)]
    for extra, flat in (([], 0), ([(f"n{draw.randrange(80)}", f"n{draw.randrange(80)}") for _ in range(9)], 300), ([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("n0", "n7"), ("s", "s")], 0)):
        rows = [(x, "in", y) for x, y in {*trees, *extra, *((f"leaf{k}", "n5") for k in range(flat))}] + [("x", "other", "y"), ("z", "in", None)]
        edges = spark.createDataFrame(rows, "subject_id string, predicate string, object_id string")
        found = labels.containment_labels(edges, "in")
        nodes = found.nodes.collect()
        assert sorted(r["low"] for r in nodes) == list(range(len(nodes)))
        wanted = spark.createDataFrame([(f"n{k}",) for k in (0, 3, 5, 40)] + [("a",), ("b",), ("s",), ("nowhere",)], "place string")
        want = {(r["ancestor"], r["child"]) for r in graph.closure(edges.filter("object_id IS NOT NULL"), "in").collect()}
        assert {tuple(r) for r in labels.below(found, wanted).collect()} == {(p, c) for p, c in want if p in {"n0", "n3", "n5", "n40", "a", "b", "s"}}
    assert labels.containment_labels(edges.filter("false"), "in").nodes.collect() == []
