"""Points in polygons as joins: edges in latitude bands, and covers of tiles of several sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgframe.sources.shared import written

#: Bits of a tile's row and column in its key.
_BITS = 29


def rings(shapes: DataFrame, id_cols: list[str], geojson_col: str = "geojson") -> DataFrame:
    """id_cols, part, ring, points: the rings of GeoJSON polygons and multipolygons (part and ring from 0, ring 0 the outer one).

    Null or bad GeoJSON and other kinds have none. A ring of fewer than four points holds nothing and is left out; a part
    whose outer ring is left out has none at all. Each text is parsed once.
    """
    shape = F.from_json(geojson_col, "type string, coordinates string")
    one, many = F.from_json("__g.coordinates", "array<array<array<double>>>"), F.from_json("__g.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("__g.type") == "Polygon", F.array(one)).when(F.col("__g.type") == "MultiPolygon", many)
    rows = shapes.select(*id_cols, shape.alias("__g")).select(*id_cols, F.posexplode(parts).alias("part", "rings"))
    good = F.forall("points", lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    rows = rows.filter(F.size(F.get("rings", F.lit(0))) >= 4).select(*id_cols, "part", F.posexplode("rings").alias("ring", "points"))
    return rows.filter((F.size("points") >= 4) & good)


def edge_table(shapes: DataFrame, id_cols: list[str], geojson_col: str = "geojson") -> DataFrame:
    """id_cols, part, ring, x1, y1, x2, y2: the edges of each ring with x1, y1 the lower end; level ones cross no ray and are kept for covers."""
    points = F.col("points")
    sides = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")))
    rows = rings(shapes, id_cols, geojson_col).select(*id_cols, "part", "ring", F.explode(sides).alias("e"))
    up = F.col("e.ay") <= F.col("e.by")
    end = lambda low, high: F.when(up, F.col(f"e.{low}")).otherwise(F.col(f"e.{high}"))
    return rows.select(*id_cols, "part", "ring", end("ax", "bx").alias("x1"), end("ay", "by").alias("y1"), end("bx", "ax").alias("x2"), end("by", "ay").alias("y2"))


def banded(edges: DataFrame, shape_col: str) -> tuple[DataFrame, DataFrame]:
    """The edges by latitude band (shape, band, part, ring, x1, y1, x2, y2), and south, height of the bands of each shape.

    A shape has about as many bands as the square root of its edges, so a band holds few of them however large the shape.
    """
    slanted = edges.filter("y1 < y2")
    spans = slanted.groupBy(shape_col).agg(F.min("y1").alias("south"), F.max("y2").alias("north"), F.ceil(F.sqrt(F.count("*"))).alias("bands"))
    spans = spans.select(shape_col, "south", ((F.col("north") - F.col("south")) / F.col("bands")).alias("height"))
    band = lambda y: F.floor((F.col(y) - F.col("south")) / F.col("height"))
    rows = slanted.join(spans, shape_col).withColumn("band", F.explode(F.sequence(band("y1"), band("y2"))))
    return rows.select(shape_col, "band", "part", "ring", "x1", "y1", "x2", "y2"), spans


def holding(candidates: DataFrame, edges: DataFrame, id_cols: list[str], shape_col: str) -> DataFrame:
    """id_cols, shape_col: the candidates (id_cols, shape_col, lat, lng) whose point lies in the shape and outside its holes.

    A point meets only the edges of its shape's band; a ring holds it if a ray to the east crosses the ring an odd
    number of times. Crossings are counted with partial sums, so neither many points of one shape nor many edges of one
    meet in a task. Points with a null coordinate are in nothing. Equal rows are judged together and come back once.
    """
    by_band, spans = banded(edges, shape_col)
    points = candidates.filter("lat IS NOT NULL AND lng IS NOT NULL").select(*id_cols, shape_col, "lat", "lng").distinct()
    points = points.join(spans, shape_col).withColumn("band", F.floor((F.col("lat") - F.col("south")) / F.col("height")))
    met = points.join(by_band, [shape_col, "band"]).filter("y1 <= lat AND lat < y2")
    met = met.filter(F.col("lng") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    keys = [*id_cols, shape_col, "lat", "lng"]
    odd = met.groupBy(*keys, "part", "ring").agg((F.count("*") % 2).alias("odd")).filter("odd = 1")
    in_part = odd.groupBy(*keys, "part").agg(F.max("ring").alias("hole"), F.min("ring").alias("outer")).filter("outer = 0 AND hole = 0")
    return in_part.select(*id_cols, shape_col).distinct()


def _tile(level: Column, x: Column, y: Column) -> Column:
    """The key of a tile: its level, then column and row, each shifted to be positive."""
    shifted = lambda c: (c + F.lit(1 << (_BITS - 1))).cast("long")
    return F.shiftleft(level.cast("long"), 2 * _BITS) + F.shiftleft(shifted(x), _BITS) + shifted(y)


def _touched(rows: DataFrame, size: float) -> DataFrame:
    """The rows (tile x, y of a size, and an edge) whose edge meets the closed tile."""
    west, south = F.col("x") * size, F.col("y") * size
    east, north = west + size, south + size
    boxes = (F.least("x1", "x2") <= east) & (F.greatest("x1", "x2") >= west) & (F.col("y1") <= north) & (F.col("y2") >= south)
    side = lambda x, y: (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))
    corners = [side(west, south), side(west, north), side(east, south), side(east, north)]
    return rows.filter(boxes & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0))


def tile_cover(edges: DataFrame, shape_col: str, size: float, levels: int = 4) -> DataFrame:
    """shape_col, level, x, y, full, tile: a cover of each shape by square tiles.

    Level 0 has tiles of ``size`` degrees, each further level a quarter of the area. A tile that no edge meets is full if
    its centre is in the shape, else it is left out; one that an edge meets is cut in four, and at the last level it
    is partial. So the number of tiles grows with the outline, not with the area.
    """
    edges = edges.select(shape_col, "part", "ring", "x1", "y1", "x2", "y2")
    at = lambda c, s: F.floor(F.col(c) / s).cast("long")
    spans = edges.groupBy(shape_col).agg(F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"), F.min("y1").alias("s"), F.max("y2").alias("n"))
    tiles = spans.withColumn("x", F.explode(F.sequence(at("w", size), at("e", size)))).withColumn("y", F.explode(F.sequence(at("s", size), at("n", size)))).select(shape_col, "x", "y")
    boxes = edges.withColumn("x", F.explode(F.sequence(F.floor(F.least("x1", "x2") / size).cast("long") - 1, F.floor(F.greatest("x1", "x2") / size).cast("long"))))
    boxes = boxes.withColumn("y", F.explode(F.sequence(F.floor(F.col("y1") / size).cast("long") - 1, at("y2", size))))
    covers = []
    for level in range(levels):
        touching = written(_touched(boxes, size), "touching-edges")
        touched = touching.select(shape_col, "x", "y").distinct()
        clear = tiles.join(touched, [shape_col, "x", "y"], "left_anti")
        centres = clear.withColumns({"lat": (F.col("y") + 0.5) * size, "lng": (F.col("x") + 0.5) * size})
        full = holding(centres, edges, ["x", "y"], shape_col)
        covers.append(full.select(shape_col, F.lit(level).alias("level"), "x", "y", F.lit(True).alias("full")))
        if level == levels - 1:
            covers.append(touched.select(shape_col, F.lit(level).alias("level"), "x", "y", F.lit(False).alias("full")))
            break
        quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
        finer = {"x": F.col("x") * 2 + F.col("q.i"), "y": F.col("y") * 2 + F.col("q.j")}
        tiles = touched.withColumn("q", quarter).withColumns(finer).drop("q")
        boxes = touching.withColumn("q", quarter).withColumns(finer).drop("q")
        size /= 2
    cover = written(reduce(DataFrame.unionByName, covers), "tile-cover")
    return cover.withColumn("tile", _tile(F.col("level"), F.col("x"), F.col("y")))


def in_tiles(points: DataFrame, cover: DataFrame, shape_col: str, size: float, levels: int = 4) -> DataFrame:
    """Each point (lat, lng) with the shapes whose cover holds it, and whether its tile is ``full``.

    A point has one tile at each level and a shape's tiles don't overlap, so each shape comes once. Null coordinates
    have no tile.
    """
    at = lambda c, k: F.floor(F.col(c) / (size / 2**k)).cast("long")
    keys = F.array(*[_tile(F.lit(k), at("lng", k), at("lat", k)) for k in range(levels)])
    own = points.filter("lat IS NOT NULL AND lng IS NOT NULL").withColumn("tile", F.explode(keys))
    return own.join(cover.select("tile", shape_col, "full"), "tile").drop("tile")


def resolve_by_cover(points: DataFrame, cover: DataFrame, edges: DataFrame, id_col: str, shape_col: str, size: float, levels: int = 4) -> DataFrame:
    """id_col, shape_col, tested: the shapes that hold each point (id_col, lat, lng); only points in partial tiles are tested."""
    met = in_tiles(points.select(id_col, "lat", "lng"), cover, shape_col, size, levels)
    outright = met.filter("full").select(id_col, shape_col, F.lit(False).alias("tested")).distinct()
    tested = holding(met.filter("NOT full"), edges, [id_col], shape_col).withColumn("tested", F.lit(True))
    return outright.unionByName(tested)
