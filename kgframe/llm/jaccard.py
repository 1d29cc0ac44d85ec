"""N-gram Jaccard join by parity sketches.

The distinct shingles of a document are dealt by hash to the segments of a sketch and XORed there. A shingle that only
one of two documents has changes one segment, so the number of segments that differ is at most the size of the
symmetric difference d, and d is at most a seventh of the two sizes' sum where the similarity is 3/4 or more. The
sketches of a size band have more segments than that, so two such documents agree in a segment (pigeonhole).

Of its non-empty segments a document needs to publish only the d + 1 first in an order that depends on the segment
alone (prefix filter); the fullest come first, since they are shared least by chance. A document whose non-empty
segments are d or fewer publishes all of them and sketches itself again with another seed, until they are more:
of two documents the one that stops first has more than d at that seed, where the other still publishes.

Documents that publish the same segment are candidates and are verified by their whole sets. In a large bucket all are
first verified against one member; members that this leaves in different components are compared by sketches of single
bits, whose Hamming distance is a lower bound too, before they are verified. So no link is lost and no bucket's pairs
are all written out. What a task finds of a large bucket it joins itself and sends on a few members only, so that a
segment that a third of all documents share is not dealt to one task.

Words are hashed by xxh3, sets are named by 64 bits; a second digest finds names that clash, which are then replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgframe.llm.common import slices, table, written
from kgframe.llm.components import components
from kgframe.llm.shingles import batch_texts, mix, set_names, shingle_sets

#: Buckets of up to this many sets have all their pairs verified at once.
SMALL = 6
#: Published rows that a task looks at together, and how many of one segment it sends on (more than SMALL).
COMBINED, SENT = 1 << 18, 8
#: Names that may clash before a wider name would be needed: 64 bits make some three of 10^10 sets clash.
CLASHES = 100_000
#: Rows of a large bucket that meet in one task.
BLOCK = 4096
#: Keys that a member carries to tell in which bucket it has met another one before.
LOWEST = 8


def _most_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The greatest symmetric difference of linked sets of these sizes."""
    return (a + b) // 7


def published(sets: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment key, set id) of all that the sets must publish. A band holds the sizes from 2^k to 2^(k+1) - 1.

    A pair is found in the band of its larger set, so a set publishes in its own band and, where it has partners of
    the next, there too.
    """
    keys_out, ids_out = [], []
    size = np.array([len(s) for s in sets], np.int64)
    own = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    reach = size * 4 // 3
    who = np.concatenate([np.flatnonzero(size), np.flatnonzero((size > 0) & (reach >= 2 << own))])
    band = np.concatenate([own[size > 0], own[(size > 0) & (reach >= 2 << own)] + 1])
    level = 0
    while len(who):
        parts = np.where(band < 2, 1, np.ceil((2 << band) / 2.5)).astype(np.int64)
        need = _most_apart(size[who], np.minimum(reach[who], (2 << band) - 1)) + 1
        n = size[who]
        h = np.concatenate([sets[i] for i in who])
        entry = np.repeat(np.arange(len(who)), n)
        salt = mix(((band << 20) | level).astype(np.uint64) + np.uint64(1 << 40))
        dealt = mix(h ^ salt[entry])
        start = np.cumsum(parts) - parts
        cell = start[entry] + ((dealt >> np.uint64(32)).astype(np.int64) * parts[entry] >> 32)
        order = np.argsort(cell, kind="stable")
        cell, value = cell[order], mix(dealt[order] + np.uint64(level))
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        parity = np.bitwise_xor.reduceat(value, first)
        filled = np.diff(np.append(first, len(cell)))
        cell = cell[first]
        entry = np.searchsorted(start, cell, side="right") - 1
        key = mix(parity + mix((cell - start[entry]).astype(np.uint64) ^ salt[entry])).view(np.int64)
        order = np.lexsort((key, -filled, entry))
        entry, key = entry[order], key[order]
        begin = np.searchsorted(entry, np.arange(len(who)))
        kept = np.arange(len(entry)) - begin[entry] < need[entry]
        keys_out.append(key[kept])
        ids_out.append(ids[who[entry[kept]]])
        short = np.diff(np.append(begin, len(entry))) < need
        who, band, level = who[short], band[short], level + 1
    return (np.concatenate(keys_out), np.concatenate(ids_out)) if keys_out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def bit_sketch(s: np.ndarray, size: int) -> bytes:
    """Parities of the shingles that fall on each of 2^k bits, 2 to 4 for each shingle (64 at least)."""
    bits = max(64, 4 << (max(size, 1).bit_length() - 1))
    at = (mix(s + np.uint64(99)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(sketch: np.ndarray, width: int) -> np.ndarray:
    """A row of sketches of more bits as one of fewer: parities add up. Bits are numbered modulo a power of two."""
    while sketch.shape[1] > width:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


class Naming:
    """How sets are named: by ``bits`` of a digest, but for the names that are known to clash."""

    def __init__(self, bits: int = 64, clashing: frozenset[int] = frozenset()):
        self.bits, self.clashing = bits, clashing

    def named(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return set_names(sets, np.array(sorted(self.clashing), np.int64), self.bits)


def _sets_of(docs: DataFrame, columns: str, of_slice, id_col: str, text_col: str, naming: Naming) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            sets = shingle_sets(batch_texts(b.column(text_col)))
            yield of_slice(b, sets, *naming.named(sets))

    return docs.select(id_col, text_col).mapInArrow(run, columns)


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", naming: Naming = Naming()) -> DataFrame:
    """id, n_shingles, set_id, digest and sketch (null for an empty set) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(b, sets, ids, digests):
        n = np.array([len(s) for s in sets], np.int64)
        sketches = pa.array([bit_sketch(s, len(s)) if len(s) else None for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n), pa.array(ids, mask=n == 0), pa.array(digests), sketches], [id_col, "n_shingles", "set_id", "digest", "sketch"])

    return _sets_of(docs, f"`{id_col}` {kind}, n_shingles long, set_id long, digest long, sketch binary", rows, id_col, text_col, naming)


def combined(key: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """key, set_id, other, kind of published rows (key, id): segments (0) that go to their bucket, pairs (1), members (2).

    Of a segment with more than SENT rows the first SENT go on as such; each further one is paired with the least and
    with the one before it, and is a member of a large bucket.
    """
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]) if len(key) else np.zeros(0, bool)
    key, ids = key[new], ids[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    least = np.repeat(first, size)
    more = np.flatnonzero(np.arange(len(key)) - least >= SENT)
    few = np.arange(len(key)) - least < SENT
    zero = np.zeros(2 * len(more), np.int64)
    keys = np.concatenate([key[few], zero, key[more]])
    own = np.concatenate([ids[few], ids[more], ids[more], ids[more]])
    other = np.concatenate([np.zeros(int(few.sum()), np.int64), ids[least[more]], ids[more - 1], np.zeros(len(more), np.int64)])
    kinds = np.repeat(np.array([0, 1, 2], np.int8), [int(few.sum()), 2 * len(more), len(more)])
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own), pa.array(other), pa.array(kinds)], ["key", "set_id", "other", "kind"])


def published_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", naming: Naming = Naming()) -> DataFrame:
    """key, set_id, other, kind: what the sets publish, see ``combined``. Copies that a task has met before publish nothing again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in slices(batches, text_col):
            sets = shingle_sets(batch_texts(b.column(text_col)))
            ids, _ = naming.named(sets)
            if len(met) > 100_000:
                met.clear()
            fresh = [i for i, s in enumerate(ids.tolist()) if not (s in met or met.add(s))]
            held.append(published([sets[i] for i in fresh], ids[fresh]))
            if sum(len(k) for k, _ in held) > COMBINED:
                yield combined(*map(np.concatenate, zip(*held)))
                held = []
        if held:
            yield combined(*map(np.concatenate, zip(*held)))

    return docs.select(id_col, text_col).mapInArrow(run, "key long, set_id long, other long, kind tinyint")


def candidates(segments: DataFrame) -> DataFrame:
    """a, b, key: pairs (key null), and the members a of large buckets (b null), from rows sorted by key outside Python.

    A small bucket gives all its pairs; of a large one each set is paired with the least and with its neighbour in
    order. A task holds one batch and at most SMALL rows more, whatever the size of a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        large: tuple[int, int] | None = None  # key and least set of a large bucket that goes on

        def out(pairs: list[tuple[np.ndarray, np.ndarray]], members: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
            if len(a):
                low, high = np.minimum(a, b), np.maximum(a, b)
                order = np.lexsort((high, low))
                low, high = low[order], high[order]
                new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(low[new]), pa.array(high[new]), pa.nulls(int(new.sum()), pa.int64())], ["a", "b", "key"])
            for k, s in members:
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.nulls(len(s), pa.int64()), pa.array(k)], ["a", "b", "key"])

        def buckets(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal key, ids, large
            pairs, members = [], []
            if large:
                on = int(np.searchsorted(key, large[0], side="right"))
                more = ids[:on][ids[:on] != large[1]]
                pairs.append((np.full(len(more), large[1]), more))
                members.append((np.full(len(more), large[0]), more))
                key, ids = key[on:], ids[on:]
                if not len(key):
                    yield from out(pairs, members)
                    return
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]) if len(key) else np.zeros(0, bool)
            key, ids = key[new], ids[new]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(key)))
            done, large = len(first), None
            if len(first) and not last:
                if size[-1] > SMALL:
                    large = (int(key[-1]), int(ids[first[-1]]))
                else:
                    done -= 1
            size_of = np.repeat(size, size)
            upto = first[done] if done < len(first) else len(key)
            for step in range(1, SMALL):
                i = np.flatnonzero((size_of[: upto - step] <= SMALL) & (key[: upto - step] == key[step:upto])) if upto > step else np.zeros(0, np.int64)
                pairs.append((ids[i], ids[i + step]))
            big = np.flatnonzero(size_of[:upto] > SMALL)
            least = np.repeat(ids[first] if len(first) else ids, size)[big]
            pairs.append((least[least != ids[big]], ids[big][least != ids[big]]))
            i = big[:-1][np.diff(big) == 1]
            i = i[key[i] == key[i + 1]]
            pairs.append((ids[i], ids[i + 1]))
            members.append((key[big], ids[big]))
            key, ids = key[upto:], ids[upto:]
            yield from out(pairs, members)

        for b in batches:
            kind, k, s, o = (b.column(c).to_numpy() for c in ("kind", "key", "set_id", "other"))
            if (kind > 0).any():
                yield from out([(s[kind == 1], o[kind == 1])], [(k[kind == 2], s[kind == 2])])
                k, s = k[kind == 0], s[kind == 0]
            key, ids = np.concatenate([key, k]), np.concatenate([ids, s])
            if len(key):
                yield from buckets(False)
        if len(key):
            yield from buckets(True)

    dealt = segments.repartition(F.when(F.col("kind") == 0, F.col("key")).otherwise(F.col("set_id"))).sortWithinPartitions("kind", "key", "set_id")
    return dealt.mapInArrow(run, "a long, b long, key long")


def whole_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, id_col: str, text_col: str, naming: Naming) -> DataFrame:
    """set_id, data (the hashes) of the wanted set ids (column set_id). One document of each set is read again.

    Sets that only rows without an id have are found among the sets of these rows.
    """
    needed = written(sets.filter("set_id is not null").join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min(id_col).alias(id_col)), "needed-documents")

    def rows(b, found, ids, digests):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([s.tobytes() for s in found], pa.binary())], ["set_id", "data"])

    def read(texts: DataFrame) -> DataFrame:
        return _sets_of(texts, "set_id long, data binary", rows, id_col, text_col, naming)

    texts = docs.select(id_col, text_col)
    nameless = needed.filter(F.col(id_col).isNull()).select("set_id")
    found = read(texts.join(needed.select(id_col).distinct(), id_col, "left_semi"))
    if nameless.isEmpty():
        return found
    others = read(texts.filter(F.col(id_col).isNull())).join(nameless, "set_id", "left_semi")
    return found.union(others.groupBy("set_id").agg(F.min("data").alias("data")))


def _paired(pairs: DataFrame, data: DataFrame, test, where: str = "true") -> DataFrame:
    """The pairs (u, v) that pass ``test`` on their sets' ``data`` (set_id, n, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [test(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column("x"), b.column("y"))]
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    x = data.select(F.col("set_id").alias("u"), F.col("n").alias("nx"), F.col("data").alias("x"))
    y = data.select(F.col("set_id").alias("v"), F.col("n").alias("ny"), F.col("data").alias("y"))
    both = pairs.join(x, "u").join(y, "v").filter(where)
    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _is_near(x: pa.Buffer, y: pa.Buffer) -> bool:
    """Whether bit sketches allow a link. Each ends with its set's size."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    most = sum(int.from_bytes(z[-8:].tobytes(), "big") for z in (x, y)) // 7
    width = min(len(x), len(y)) - 8
    x, y = (folded(z[None, :-8], width)[0] for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum()) <= most


def _is_linked(x: pa.Buffer, y: pa.Buffer) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 75 * (len(x) + len(y) - both)


def near_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sizes and bit sketches (set_id, n, data) allow a link."""
    data = sketches.select("set_id", "n", F.concat("data", F.unhex(F.lpad(F.hex("n"), 16, "0"))).alias("data"))
    return _paired(pairs, data, _is_near, "100 * least(nx, ny) >= 75 * greatest(nx, ny)")


def verified(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The pairs (u, v) of set ids whose sets have a similarity of 3/4 or more, by their whole sets."""
    return _paired(pairs, hashes.withColumn("n", F.lit(0)), _is_linked)


def bucket_pairs(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: members (key, set_id, root, n, data) of one bucket with different roots whose sizes and bit sketches allow a link.

    A bucket is cut into blocks of about ``block`` rows and every two blocks meet in one task. Two sets that share many
    buckets are left to the first that both are seen to be in, by the lowest keys that each carries.
    """

    def run(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        order = np.argsort(n, kind="stable")
        n, ids, roots, side = n[order], group.column("set_id").to_numpy()[order], group.column("root").to_numpy()[order], group.column("side").to_numpy()[order]
        data = group.column("data").to_pylist()
        width = min(map(len, data))
        # bits are packed most significant first, so that halves of the bytes are halves of the bits
        bits = np.vstack([folded(np.frombuffer(data[i], np.uint8)[None], width) for i in order]).view(np.uint64)
        one_block, key = group.column("one").to_numpy()[0], group.column("key").to_numpy()[0]
        lowest = np.full((len(n), LOWEST), np.iinfo(np.int64).max)
        for k, x in enumerate(group.column("lowest").to_pylist()):
            lowest[k, : len(x)] = x
        lowest = lowest[order]
        u, v = [], []
        for i in range(len(n)):
            last = int(np.searchsorted(n, n[i] * 4 // 3, side="right"))
            j = np.arange(i + 1, last)
            j = j[(roots[j] != roots[i]) & (one_block | (side[j] != side[i]))]
            if len(j):
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)
                j = j[apart <= (n[j] + n[i]) // 7]
                before = ((lowest[j][:, :, None] == lowest[i]) & (lowest[j] < key)[:, :, None]).any(axis=(1, 2))
                j = j[~before]
                u += [ids[i]] * len(j)
                v += ids[j].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    lows = members.groupBy("set_id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOWEST).alias("lowest"))
    members = members.join(lows, "set_id")
    counts = members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    m = members.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") == F.col("i")).cast("int")).withColumn("one", F.col("i") == F.col("j"))
    pairs = m.select("key", "i", "j", "side", "one", "set_id", "root", "n", "data", "lowest").groupBy("key", "i", "j").applyInArrow(run, "u long, v long")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def named_sets(docs: DataFrame, id_col: str, text_col: str, bits: int) -> tuple[DataFrame, DataFrame, Naming]:
    """The written tables of all rows' sets and of the distinct sets (set_id, n, data), and the naming that tells these apart.

    Sets of one name have different digests; such names are very few (see CLASHES) and are replaced.
    """
    naming = Naming(bits)
    while True:
        sets = written(document_sets(docs, id_col, text_col, naming), "shingle-sets")
        distinct = sets.filter("set_id is not null").groupBy("set_id").agg(F.min("n_shingles").alias("n"), F.min("sketch").alias("data"), F.min("digest").alias("low"), F.max("digest").alias("high"))
        distinct = written(distinct, "sketches")
        clashing = distinct.filter("low <> high").select("set_id").limit(CLASHES + 1).collect()
        if not clashing:
            return sets, distinct.select("set_id", "n", "data"), naming
        if len(clashing) > CLASHES:
            raise ValueError(f"more than {CLASHES} names of sets clash: name sets by more than {bits} bits")
        naming = Naming(bits, naming.clashing | {r["set_id"] for r in clashing})


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """id, n_shingles, component_id of every row: the least id that links of similarity 3/4 or more reach.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, shingles are of five words; a text of fewer words is one
    shingle. Texts that are null, empty or without words have no shingle, no link and their own id. Rows with equal
    texts share a component, rows that repeat an id are each judged by their own text; rows with a null id are kept but
    lend no id to a component. An empty table gives an empty one; extra columns are left out. ``bits``: of a set's name.
    """
    sets, sketches, naming = named_sets(docs, id_col, text_col, bits)
    found = written(candidates(published_segments(docs, id_col, text_col, naming)), "jaccard-candidates")

    def linked(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("u").alias("set_id")).union(pairs.select("v")).distinct()
        return written(verified(pairs, whole_sets(docs, sets, wanted, id_col, text_col, naming)), "jaccard-links")

    pairs = found.filter("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    links = linked(written(near_pairs(pairs, sketches), "jaccard-pairs"))
    roots = written(components(links), "jaccard-roots")
    members = found.filter("b is null").select("key", F.col("a").alias("set_id"))
    if not members.isEmpty():
        rooted = members.join(roots.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
        rooted = written(rooted.join(mixed, "key", "left_semi"), "mixed-buckets")
        near = written(bucket_pairs(written(rooted.join(sketches, "set_id"), "sketched-buckets")), "bucket-pairs")
        if not near.isEmpty():
            links = links.union(linked(near))
            roots = written(components(links), "all-jaccard-roots")
    own = sets.drop("sketch", "digest").join(roots.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    own = written(own.select(id_col, "n_shingles", "root"), "rooted-documents")
    least = own.filter("root is not null").groupBy("root").agg(F.min(id_col).alias("component_id"))
    return own.join(least, "root", "left").select(id_col, "n_shingles", F.coalesce("component_id", F.col(id_col)).alias("component_id"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each component the document of least id stays.

    Rows that repeat an id are one document and stay or go together; rows with a null id stay.
    """
    found = similar_documents(docs, id_col, text_col)
    gone = written(found.filter(F.col("component_id") != F.col(id_col)).select(id_col).distinct(), "removed-documents")
    return docs.join(gone, id_col, "left_anti")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate ``documents``: five words, similarity 0.75 or more, whole texts."""
    return similar_documents(table(spark, sf_dir, "documents"))


OP8_JACCARD_JOIN_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS s FROM words
),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
items AS (SELECT doc_id, hash(x) AS h FROM (SELECT doc_id, unnest(s) AS x FROM sets)),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM items a JOIN items b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * common >= 75 * (a.n + b.n - common)
),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, other) AS (
  SELECT u, v FROM edges
  UNION
  SELECT r.doc_id, e.v FROM reach r JOIN edges e ON e.u = r.other
),
least_of AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(l.other, s.doc_id)) AS component_id
FROM sizes s LEFT JOIN least_of l USING (doc_id)
"""
