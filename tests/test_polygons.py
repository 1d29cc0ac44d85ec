"""Points in polygons and tile covers against counting crossings of all edges."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from kgframe.operators import polygons, search


def in_ring(x, y, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def brute(point, parts):
    return any(in_ring(*point, p[0]) and not any(in_ring(*point, h) for h in p[1:]) for p in parts)


def blob(draw, x, y, r, n):
    ring = [[x + r * draw.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), y + r * draw.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)] for k in range(n)]
    return [*ring, ring[0]]


@pytest.fixture(scope="module")
def shapes(spark):
    """Shapes of few and of many edges, with holes and parts, on both sides of the origin, and one on tile borders."""
    draw = random.Random(2)
    found = {}
    for k in range(12):
        x, y, r = draw.uniform(-60, 60), draw.uniform(-60, 60), draw.uniform(1, 25)
        found[f"s{k}"] = [[blob(draw, x, y, r, draw.choice([3, 7, 400])), blob(draw, x, y, r / 4, 6)]] + ([[blob(draw, x + 2 * r, y, r / 2, 9)]] if k % 3 == 0 else [])
    found["square"] = [[[[0, 0], [8, 0], [8, 8], [0, 8], [0, 0]]]]
    rows = [(k, json.dumps({"type": "MultiPolygon", "coordinates": v} if len(v) > 1 else {"type": "Polygon", "coordinates": v[0]})) for k, v in found.items()]
    return found, spark.createDataFrame(rows, "shape string, geojson string")


def points(n=1500):
    draw = random.Random(3)
    some = [(float(draw.randint(-20, 20)), float(draw.randint(-20, 20))) for _ in range(300)]
    return [(i, lng, lat) for i, (lng, lat) in enumerate(some + [(draw.uniform(-80, 80), draw.uniform(-80, 80)) for _ in range(n)])]


def test_cover_and_edges_equal_brute_force(spark, shapes):
    found, df = shapes
    edges = polygons.edge_table(df, ["shape"])
    given = points()
    pts = spark.createDataFrame(given, "id long, lng double, lat double")
    want = {(i, s) for i, x, y in given for s, parts in found.items() if brute((x, y), parts)}
    pairs = pts.join(df.select("shape"), how="cross")
    assert {tuple(r) for r in polygons.holding(pairs, edges, ["id"], "shape").collect()} == want
    cover = polygons.tile_cover(edges, "shape", 16.0, 5)
    rows = polygons.resolve_by_cover(pts, cover, edges, "id", "shape", 16.0, 5).collect()
    assert {(r["id"], r["shape"]) for r in rows} == want and len(rows) == len(want)
    met = polygons.in_tiles(pts, cover, "shape", 16.0, 5)
    assert sum(r.tested for r in rows) < 0.6 * len(rows) and met.filter("NOT full").count() < 0.1 * len(given) * len(found)


def test_tiles_do_not_overlap_and_full_ones_are_inside(spark, shapes):
    found, df = shapes
    cover = polygons.tile_cover(polygons.edge_table(df, ["shape"]), "shape", 16.0, 4).collect()
    draw = random.Random(1)
    cells = {}
    for t in cover:
        size = 16.0 / 2**t.level
        if t.full:
            at = ((t.x + draw.random()) * size, (t.y + draw.random()) * size)
            assert brute(at, found[t.shape])
        for i in range(2 ** (3 - t.level)):
            for j in range(2 ** (3 - t.level)):
                key = t.shape, t.x * 2 ** (3 - t.level) + i, t.y * 2 ** (3 - t.level) + j
                assert key not in cells
                cells[key] = t.full


def test_no_python_in_the_plan(spark, shapes):
    pairs = spark.createDataFrame(points(5), "id long, lng double, lat double").join(shapes[1], how="cross")
    plan = search.point_in_polygon(pairs, ["id", "shape"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan


def test_hard_shapes(spark):
    square = {"type": "Polygon", "coordinates": [[[0, 0, 9], [4, 0, 9], [4, 4, 9], [0, 4, 9], [0, 0, 9]]]}
    rows = [
        (1, 1.0, 1.0, json.dumps(square)), (1, 1.0, 1.0, json.dumps(square)), (2, None, 1.0, json.dumps(square)), (3, 1.0, 1.0, None), (4, 1.0, 1.0, "{bad"), (5, 1.0, 1.0, '{"type":"Point","coordinates":[1,1]}'), (None, 1.0, 1.0, json.dumps(square)),
        (6, 1.0, 1.0, '{"type":"Polygon","coordinates":[[[0,0],[4,0],[0,0]]]}'), (7, 1.0, 1.0, '{"type":"Polygon","coordinates":[]}'), (8, 1.0, 1.0, '{"type":"Polygon","coordinates":[[[0,0],[4,null],[4,4],[0,4],[0,0]]]}'),
        (9, 1.0, 1.0, '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,2],[1,1]]]}'),
    ]
    df = spark.createDataFrame(rows, "id long, lat double, lng double, geojson string")
    assert sorted((r[0] for r in search.point_in_polygon(df, ["id"]).collect()), key=str) == [1, 9, None]
    assert search.point_in_polygon(df.filter(F.lit(False)), ["id"]).collect() == []
    assert polygons.tile_cover(polygons.edge_table(df.filter("id = 3"), ["id"]), "id", 16.0, 2).collect() == []
