"""Search by text and by vector, coordinates, and recognition of places in queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgframe.functions.scalars import grid_key, recon_name, tokenize
from kgframe.operators import polygons
from kgframe.operators.vectors import best_pairs, shards_for, sized
from kgframe.sources.shared import written


def search_nodes(queries: DataFrame, nodes: DataFrame, types: list[str] | None = None, limit: int = 100) -> DataFrame:
    """query, subject_id, score, position: nodes whose names share words with a query.

    The score is the share of the query's words that the name has, plus 1 for an equal name; up to ``limit`` for each.
    """
    if types:
        nodes = nodes.filter(F.arrays_overlap("types", F.array(*[F.lit(t) for t in types])))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != ""))
    q = queries.select("query", words(F.col("query")).alias("w")).distinct()
    n = nodes.filter("name IS NOT NULL").select("subject_id", "name", F.explode(words(F.col("name"))).alias("word"))
    hits = q.select("query", F.size("w").alias("n"), F.explode("w").alias("word")).join(n, "word").groupBy("query", "n", "subject_id", "name").agg(F.count("*").alias("c"))
    score = F.col("c") / F.col("n") + (F.lower("query") == F.lower("name")).cast("int")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "name", "subject_id")
    return hits.withColumn("score", score).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).select("query", "subject_id", "score", "position")


def rank_nodes(queries: DataFrame, nodes: DataFrame, types: list[str] | None = None, limit: int = 100, common: float = 0.01, least: int = 100) -> DataFrame:
    """query, subject_id, score, position: nodes whose names share words with a query, ranked by how rare these are.

    The score adds for each shared word its weight ln(1 + (N - df + 0.5) / (df + 0.5)), for the df of N names that have it,
    times 2.2 / (1 + 1.2 (0.25 + 0.75 length / mean length)), rounded to six decimals (BM25 of distinct words). A word that
    more than ``common`` of the names and ``least`` have is common: it adds to the scores of names that rarer words find
    but finds none itself, unless it is the query's rarest; so common words don't join all names. Null names and queries
    have no words.
    """
    if types:
        nodes = nodes.filter(F.arrays_overlap("types", F.array(*[F.lit(t) for t in types])))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != ""))
    named = nodes.filter("name IS NOT NULL").select("subject_id", "name", words(F.col("name")).alias("ws")).filter(F.size("ws") > 0)
    posting = named.select("subject_id", F.explode("ws").alias("word"))
    total = named.agg(F.count("*").alias("n"), F.avg(F.size("ws")).alias("mean"))
    asked = queries.select("query", F.explode(words(F.col("query"))).alias("word")).distinct()
    df = posting.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    known = asked.join(df, "word").crossJoin(F.broadcast(total))  # one row
    known = known.withColumn("weight", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    rarest = F.row_number().over(Window.partitionBy("query").orderBy("df", "word"))
    known = written(known.withColumn("leads", (rarest == 1) | (F.col("df") <= F.greatest(F.lit(float(least)), common * F.col("n")))), "query-words")
    found = known.filter("leads").select("query", "word").join(posting, "word").select("query", "subject_id").distinct()
    weights = known.groupBy("query", "mean").agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("weights"))  # a query's words
    rows = found.join(named, "subject_id").join(weights, "query")
    shared = F.aggregate(F.array_sort(F.array_intersect("ws", F.map_keys("weights"))), F.lit(0.0), lambda s, w: s + F.col("weights")[w])
    score = F.round(shared * 2.2 / (1 + 1.2 * (0.25 + 0.75 * F.size("ws") / F.col("mean"))), 6)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "name", "subject_id")
    rows = rows.withColumn("score", score).withColumn("position", F.row_number().over(order))
    return rows.filter(F.col("position") <= limit).select("query", "subject_id", "score", "position")


def vector_search(queries: DataFrame, vectors: DataFrame, threshold: float, limit: int, labels: list[int] | None = None) -> DataFrame:
    """query_id, vec_id, score, position: cosine similarity of at least ``threshold``, the ``limit`` best for each query.

    Exact (``vectors`` has an index). queries (query_id, q) are a stated set that meets all vectors (vec_id, v, label).
    The vectors are dealt evenly, whatever their ids, into shards of about half a million numbers; each query is sent to each
    shard and brings back ``limit`` rows (``vectors.best_pairs``).
    """
    if labels:
        vectors = vectors.filter(F.col("label").isin(labels))
    q, v = sized(queries.select("query_id", "q"), "q"), sized(vectors.select("vec_id", "v"), "v")
    n = shards_for(vectors.agg(F.sum(F.size("v"))).first()[0] or 0)
    q = q.withColumn("lists", F.lit(None).cast("array<int>")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    v = v.repartition(n).withColumn("shard", F.spark_partition_id()).withColumn("list", F.lit(None).cast("int"))
    return best_pairs(q, v, n, threshold, limit)


def vector_candidates(found: DataFrame, subject_col: str, limit: int) -> DataFrame:
    """Each subject once with its best score (4 decimals), the ``limit`` best for each query, from twice as many rows."""
    best = found.filter(F.col("position") <= 2 * limit).groupBy("query_id", subject_col).agg(F.round(F.max("score"), 4).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), subject_col)
    return best.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def build_search_index(variables: DataFrame, synonyms: DataFrame) -> DataFrame:
    """token, variable, matched: words of names (variable, name) and of their synonyms (word, synonym), and the id itself."""
    words = variables.select("variable", F.explode(F.array_distinct(F.split(F.lower("name"), r"\W+"))).alias("matched")).filter("matched <> ''")
    own = words.select(F.col("matched").alias("token"), "variable", "matched")
    more = words.join(synonyms.withColumnRenamed("word", "matched"), "matched").select(F.col("synonym").alias("token"), "variable", "matched")
    ids = variables.select(F.lower("variable").alias("token"), "variable", F.col("variable").alias("matched"))
    return own.unionByName(more).unionByName(ids).distinct()


def prefix_matches(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """word, token: which distinct tokens (column token) begin with which words (column word).

    Tokens are sorted into ranges; a word goes only to the ranges that the tokens with its beginning can lie in (told by
    each range's first and last token) and finds them there by bisection.
    """
    import numpy as np
    import pandas as pd

    dealt = written(tokens.select("token").filter("token IS NOT NULL").distinct().repartitionByRange("token").withColumn("part", F.spark_partition_id()), "tokens")
    bounds = dealt.groupBy("part").agg(F.min("token").alias("first"), F.max("token").alias("last"))
    wanted = words.select("word").filter("word IS NOT NULL").distinct()
    met = wanted.join(F.broadcast(bounds), (F.col("last") >= F.col("word")) & ((F.col("first") <= F.col("word")) | F.col("first").startswith(F.col("word"))))  # one row for each range

    def find(w: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        sorted_tokens = sorted((x.encode() for x in t["token"]))
        held = np.array(sorted_tokens, object)
        out = []
        for word in w["word"]:
            begin = word.encode()
            low, high = np.searchsorted(held, begin), len(held)
            end = begin.rstrip(b"\xff")
            if end:
                high = np.searchsorted(held, end[:-1] + bytes([end[-1] + 1]))
            out += [(word, x.decode()) for x in sorted_tokens[low:high]]
        return pd.DataFrame(out, columns=["word", "token"])

    return met.select(F.col("part").alias("range"), "word").groupBy("range").cogroup(dealt.groupBy("part")).applyInPandas(find, "word string, token string")


def search_variables(queries: DataFrame, index: DataFrame, info: DataFrame, limit: int = 1000, matched: bool = False) -> DataFrame:
    """query, variable, position: every distinct word of a query is a prefix of a token of the variable; with ``matched`` also
    the sorted strings of the index that the words matched.

    Order: fewer properties (info: variable, name, n_props), fewer known ones (n_known, if info has it), name, id. Words
    meet the tokens by ``prefix_matches``.
    """
    q = queries.select("query", F.explode(F.array_distinct(F.split(F.lower("query"), r"\W+"))).alias("word")).filter("word <> ''").distinct()
    needs = q.groupBy("query").agg(F.count("*").alias("needs"))
    rows = q.join(prefix_matches(q, index), "word").join(index.select("token", "variable", *["matched"] * matched).distinct(), "token")
    found = [F.array_sort(F.collect_set("matched")).alias("matched")] * matched
    hits = rows.groupBy("query", "variable").agg(F.count_distinct("word").alias("c"), *found).join(needs, "query").filter("c = needs")
    order = Window.partitionBy("query").orderBy("n_props", *["n_known"] * ("n_known" in info.columns), "name", "variable")
    return hits.join(info, "variable").withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).select("query", "variable", *["matched"] * matched, "position")


def point_in_polygon(pairs: DataFrame, id_cols: list[str]) -> DataFrame:
    """The rows of ``pairs`` (id_cols, lat, lng, geojson) whose point is in the polygon or multipolygon, outside its holes: id_cols, once each.

    Each distinct GeoJSON is parsed once into a table of edges (see ``polygons``). A ring needs four points; bad or null
    GeoJSON holds nothing.
    """
    named = pairs.filter("geojson IS NOT NULL").withColumn("shape", F.sha2("geojson", 256))
    edges = written(polygons.edge_table(named.select("shape", "geojson").dropDuplicates(["shape"]), ["shape"]), "edges")
    return polygons.holding(named.select(*id_cols, "shape", "lat", "lng"), edges, id_cols, "shape").select(*id_cols).distinct()


def rectangle_contains(lat: F.Column, lng: F.Column, south: F.Column, west: F.Column, north: F.Column, east: F.Column) -> F.Column:
    """Whether a point lies in a closed rectangle."""
    return lat.between(south, north) & lng.between(west, east)


def resolve_coordinates_grid(points: DataFrame, tiles: DataFrame, size: float, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(matches outright, pairs to test): points by their grid tile against tiles (tile, place, full)."""
    keyed = points.withColumn("tile", grid_key(F.col("lat"), F.col("lng"), size)).join(tiles, "tile")
    return keyed.filter("full").select(id_col, "place"), keyed.filter("NOT full").select(id_col, "lat", "lng", "place")


def resolve_coordinates_cell(points: DataFrame, cells: DataFrame, nodes: DataFrame, priority: list[str], size: float, id_col: str = "id") -> DataFrame:
    """id, place, type, position: places that contain a point's cell (cell, place), in order of their types."""
    from kgframe.operators.facets import order_by_type_priority

    keyed = points.withColumn("cell", grid_key(F.col("lat"), F.col("lng"), size)).join(cells, "cell").join(nodes.select(F.col("subject_id").alias("place"), F.get("types", F.lit(0)).alias("type")), "place")
    rows = keyed.select(F.col(id_col).alias("node"), F.col("place").alias("dcid"), "type").distinct()
    return order_by_type_priority(rows, priority).select(F.col("node").alias(id_col), F.col("dcid").alias("place"), "type", "position")


def place_dictionary(places: DataFrame, containers: DataFrame, alternates: DataFrame | None = None, adjectives: DataFrame | None = None, suffixes: list[str] | None = None) -> DataFrame:
    """name, dcid, population: each place (dcid, name, population) by its names, and by a name with each container's (dcid, container_name).

    alternates (dcid, name) are further names; each adjective (dcid, adjective) is a name together with each suffix, as in
    "french people". Nulls and names without words are left out.
    """
    people = places.select("dcid", "population").distinct()
    names = places.select("dcid", "name")
    names = names if alternates is None else names.unionByName(alternates.select("dcid", "name"))
    own = names.join(people, "dcid")
    rows = [own.select("name", "dcid", "population"), own.join(containers, "dcid").filter("container_name IS NOT NULL").select(F.concat_ws(" ", "name", "container_name").alias("name"), "dcid", "population")]
    if adjectives is not None and suffixes:
        words = adjectives.select("dcid", F.explode(F.array(*[F.concat_ws(" ", "adjective", F.lit(x)) for x in suffixes])).alias("name"))
        rows.append(words.join(people, "dcid").select("name", "dcid", "population"))
    return reduce(DataFrame.unionByName, rows).filter("name IS NOT NULL").withColumn("name", recon_name(F.col("name"))).filter("name <> ''").distinct()


def _words(query: F.Column) -> F.Column:
    return F.filter(F.split(query, r"\s+"), lambda w: w != "")


def _cover(spans: F.Column) -> F.Column:
    """Of an array of structs with start and n_words those that overlap none kept before, in the order of the array."""
    kept = F.slice(spans, 1, 0)
    apart = lambda a, s: ~F.exists(a, lambda k: (s["start"] < k["start"] + k["n_words"]) & (k["start"] < s["start"] + s["n_words"]))
    return F.aggregate(spans, kept, lambda a, s: F.when(apart(a, s), F.array_append(a, s)).otherwise(a))


def _merged(spans: DataFrame, places: DataFrame, containment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spans with ``merged`` and their whole length, and the places (query_id, start, dcid) of spans that are merged.

    A place next to one that contains it, or before a comma and one that contains it, is one span with it; a comma and
    a further place after these belong to the span too. tokens is the query's array of tokens.
    """
    order = Window.partitionBy("query_id").orderBy("start")
    then = lambda c, n: F.lead(c, n).over(order)
    end = F.col("start") + F.col("n_words")
    spans = spans.withColumns({"end": end, "next": then("start", 1), "next_end": then(end, 1), "third": then("start", 2), "third_end": then(end, 2)})
    comma = lambda a, b: F.coalesce((F.col(b) == F.col(a) + 1) & (F.get("tokens", F.col(a)) == ","), F.lit(False))
    near = F.coalesce(F.col("next") == F.col("end"), F.lit(False)) | comma("end", "next")
    whole = F.when(comma("end", "next") & comma("next_end", "third"), F.col("third_end")).when(near, F.col("next_end"))
    spans = spans.withColumn("whole", whole - F.col("start"))
    first = spans.filter("whole IS NOT NULL").select("query_id", "start", "next").join(places.select("query_id", "start", "dcid"), ["query_id", "start"]).join(containment, "dcid")
    second = places.select("query_id", F.col("start").alias("next"), F.col("dcid").alias("container"))
    inside = first.join(second, ["query_id", "next", "container"], "left_semi").select("query_id", "start", "dcid").distinct()
    starts = inside.select("query_id", "start").distinct().withColumn("merged", F.lit(True))
    spans = spans.join(starts, ["query_id", "start"], "left").withColumn("merged", F.coalesce("merged", F.lit(False)))
    return spans.select("query_id", "start", F.col("n_words").alias("own"), F.when(F.col("merged"), F.col("whole")).otherwise(F.col("n_words")).alias("n_words"), "merged", "name"), inside


def name_runs(queries: DataFrame, names: DataFrame, name_col: str, longest: int | None = None) -> DataFrame:
    """query_id, start, n_words, text: the runs of words of a query (array w) that a name can be.

    A dictionary of two levels: at a word only runs of the lengths are made that names beginning with it have, so words
    that begin no name make none. ``longest`` bounds the lengths.
    """
    words = F.split(name_col, " ")
    lengths = names.select(F.get(words, F.lit(0)).alias("first"), F.size(words).alias("n_words")).distinct()
    lengths = written(lengths if longest is None else lengths.filter(F.col("n_words") <= longest), "name-lengths")
    bound = lengths.agg(F.coalesce(F.max("n_words"), F.lit(1)).alias("most"))
    # a row holds no more words than the longest name has, so a long query takes no room with its square
    ahead = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(i.alias("start"), F.slice(F.col("w"), i + 1, F.col("most")).alias("ahead")))
    at = queries.filter(F.size("w") > 0).crossJoin(F.broadcast(bound)).select("query_id", F.explode(ahead).alias("a")).select("query_id", "a.*")  # one row
    at = at.withColumn("first", F.get("ahead", F.lit(0))).join(lengths, "first").filter(F.col("n_words") <= F.size("ahead"))
    return at.select("query_id", "start", "n_words", F.array_join(F.slice("ahead", F.lit(1), F.col("n_words")), " ").alias("text"))


def recognize_places(
    queries: DataFrame, dictionary: DataFrame, longest: int | None = None, keep: int = 15, populous: int = 2000,
    abbreviations: DataFrame | None = None, zip_codes: DataFrame | None = None, bogus: list[str] | None = None, containment: DataFrame | None = None,
) -> DataFrame:
    """query_id, start, n_words, dcid, position: the places that a query names, the longest name first from the left.

    Words and commas are the tokens that start and n_words count. Every run of tokens is joined with the dictionary by
    equality; a run that begins inside a longer match that began before is left out by one scan over the query's few
    matches. At a word an abbreviation (name, dcid, population; case counts) comes first, then a zip code (name, dcid,
    population), then the longest name. With ``containment`` (dcid, container) a place and the places that contain it,
    named after it with or without a comma, are one span with the places that are so contained. A span whose name is in
    ``bogus`` is no place, unless it is merged. Of one span the ``keep`` most populous places are kept and all others of
    ``populous`` people or more. Names of any length are tried, unless ``longest`` bounds their words. Null and empty
    queries give nothing.
    """
    raw = tokenize(F.regexp_replace(F.regexp_replace("query", r"\^", ""), r"\s+", " "))
    q = queries.select("query_id", raw.alias("raw")).filter(F.size("raw") > 0).withColumn("w", F.transform("raw", F.lower))
    runs = name_runs(q, dictionary, "name", longest).withColumnRenamed("text", "name")
    hits = runs.join(dictionary, "name").withColumn("order", F.lit(2))
    one = q.select("query_id", F.posexplode("raw").alias("start", "name")).select("query_id", "start", F.lit(1).alias("n_words"), "name")
    for order, table in enumerate((abbreviations, zip_codes)):
        if table is not None:
            hits = hits.unionByName(one.join(table.select("name", "dcid", "population"), "name").withColumn("order", F.lit(order)))
    best = hits.groupBy("query_id", "start").agg(F.min(F.struct("order", (-F.col("n_words")).alias("less"), "name")).alias("b")).select("query_id", "start", "b.order", (-F.col("b.less")).alias("n_words"), "b.name")
    covered = lambda df, *more: df.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("start", "n_words", *more))).alias("s")).select("query_id", F.explode(_cover(F.col("s"))).alias("s")).select("query_id", "s.*")
    kept = covered(best, "order", "name")
    found = kept.join(hits.drop("name"), ["query_id", "start", "n_words", "order"]).select("query_id", "start", "n_words", "dcid", "population").distinct()
    good = lambda: ~F.lower("name").isin([b.lower() for b in bogus]) if bogus else F.lit(True)
    if containment is None:
        found = found.join(kept.filter(good()).select("query_id", "start"), ["query_id", "start"], "left_semi")
    else:
        spans, inside = _merged(kept.join(q.select("query_id", F.col("w").alias("tokens")), "query_id"), found, containment.select("dcid", "container").distinct())
        spans = covered(spans, "merged", "name").filter(F.col("merged") | good()).select("query_id", "start", "n_words", "merged")
        found = spans.join(found.drop("n_words"), ["query_id", "start"]).join(inside.withColumn("inside", F.lit(True)), ["query_id", "start", "dcid"], "left")
        found = found.filter(~F.col("merged") | F.col("inside"))
    order = Window.partitionBy("query_id", "start").orderBy(F.desc("population"), "dcid")
    return found.withColumn("position", F.row_number().over(order)).filter((F.col("position") <= keep) | (F.col("population") >= populous)).select("query_id", "start", "n_words", "dcid", "position")


def recognize_entities(queries: DataFrame, names: DataFrame, longest: int = 10, common: DataFrame | None = None) -> DataFrame:
    """query_id, start, n_words, name, dcid: the entities (name, dcid) whose names cover a query.

    Names are matched as runs of words, the longest first, then by their letters; a run that overlaps one taken before
    is left out. A common word (common: name, type) is a name only with one of its types in front, as in "city reading".
    """
    known = names.select(recon_name(F.col("name")).alias("name"), "dcid").filter("name <> ''").distinct().withColumn("text", F.col("name"))
    if common is not None:
        words = common.select(recon_name(F.col("name")).alias("name"), F.lower("type").alias("type"))
        typed = known.join(words, "name").withColumn("text", F.concat_ws(" ", "type", "name")).drop("type")
        known = known.join(words.select("name"), "name", "left_anti").unionByName(typed)
    q = queries.select("query_id", _words(recon_name(F.col("query"))).alias("w")).filter(F.size("w") > 0)
    hits = name_runs(q, known, "text", longest).join(known, "text")
    spans = hits.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct((-F.col("n_words")).alias("less"), "text", "start", "n_words"))).alias("spans"))
    kept = spans.select("query_id", F.explode(_cover(F.col("spans"))).alias("s")).select("query_id", "s.start", "s.n_words")
    return kept.join(hits, ["query_id", "start", "n_words"]).select("query_id", "start", "n_words", "name", "dcid").distinct()


def find_entities(descriptions: DataFrame, names: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """description, dcid: entities whose full name equals a description but for spaces and commas."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[ ,]", "")
    found = descriptions.withColumn("k", bare("description")).join(names.select(bare("name").alias("k"), "dcid"), "k").select("description", "dcid").distinct()
    return found.join(types, "dcid", "left_semi") if types is not None else found


def tokens_of(queries: DataFrame) -> DataFrame:
    """query_id, at, token: the tokens of each query in order; a null query has none."""
    return queries.select("query_id", F.posexplode(tokenize(F.col("query"))).alias("at", "token"))
