"""Canonical exact digests of documents.

A text is normalised (NFKC), case-folded and its white space folded; the wide xxhash of those bytes is its digest.
Documents with equal digests are grouped and their canonical bytes are compared, so that a fingerprint stands for
one canonical text only: a second text in a bucket gets a number of its own.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgframe.llm.common import slices, table, written


#: A digest with more than one in so many rows is hot.
HOT = 1000


def canonical(text: str | None) -> str:
    """A null text counts as empty. Case folding may undo the normal form, so it is applied again."""
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def canonical_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, canonical (the text that is compared), digest."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            texts = [canonical(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(texts, pa.string()), pa.array([digest(t) for t in texts], pa.string())], [id_col, "canonical", "digest"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, canonical string, digest string")


def clashes(docs: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compare bytes inside equal buckets: digest, canonical, number (from 1) of each further text of a bucket.

    Only documents whose digest recurs are read again, and all those without an id. A bucket's least and greatest
    canonical text are found with partial sums before the shuffle, so a bucket with a third of all rows costs one row
    for each task; where they are the same, all of the bucket's bytes are. Where they differ its distinct texts are
    numbered. A digest that more than one row in ``HOT`` has is found without a shuffle of its rows, from a list of fewer
    than ``HOT`` digests.
    """
    recurring = written(digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"), "recurring-digests")
    rows = digests.count()
    hot = F.broadcast(recurring.filter(F.col("n") * HOT > rows).select("digest"))  # fewer than HOT rows
    rest = digests.join(hot, "digest", "left_anti").join(recurring.select("digest"), "digest", "left_semi")
    ids = written(digests.join(hot, "digest", "left_semi").unionByName(rest).select(id_col).distinct(), "recurring-ids")
    again = docs.join(ids, id_col, "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))
    texts = canonical_texts(again, id_col, text_col)
    ends = texts.groupBy("digest").agg(F.min("canonical").alias("low"), F.max("canonical").alias("high"))
    unequal = written(ends.filter("low <> high").select("digest"), "unequal-buckets")
    if unequal.isEmpty():
        return docs.sparkSession.createDataFrame([], "digest string, canonical string, number int")
    distinct = texts.join(unequal, "digest", "left_semi").select("digest", "canonical").distinct()
    return distinct.withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("canonical")) - 1).filter("number > 0")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every row: the digest, with ``-number`` for a further text in the same bucket.

    Null and empty texts share the empty text's fingerprint; rows with null or repeated ids keep their own.
    """
    both = canonical_texts(docs, id_col, text_col)
    digests = written(both.select(id_col, "digest"), "digests")
    more = clashes(docs, digests, id_col, text_col)
    if more.isEmpty():
        return digests.withColumnRenamed("digest", "fingerprint")
    named = both.join(more, ["digest", "canonical"], "left")
    return named.select(id_col, F.concat_ws("-", "digest", F.col("number").cast("string")).alias("fingerprint"))


_PAIR = "n_chars long, edited_sha256 string, digest string, edited_digest string, near_edited double, near_next double"
_CHECKS = ", own_check string, edited_check string"


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _pair_row(text: str, following: str, own: str, checks: bool) -> tuple:
    """What a text and the one that follows give; ``own`` is the text's canonical form."""
    n = len(text)
    k = n // 2
    edited = text[: n - k] + following[:k]
    edited_own = canonical(edited)
    found = n, _sha256(edited), digest(own), digest(edited_own), float(own == edited_own), float(own == canonical(following))
    return (*found, _sha256(own), _sha256(edited_own)) if checks else found


def paired_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", checks: bool = False) -> DataFrame:
    """Digests of each text and of its edited text, whose last half comes from the next document by ascending id.

    One shuffle, by range of the id and the text's hash, brings neighbours together, so that an id that most rows repeat
    is dealt to many tasks; each task holds one row besides its slice. The rows
    at the ends of the partitions, two of each, are matched afterwards. Rows with equal ids follow in the order of
    their text's hash, null ids come first. With ``checks`` the SHA-256 of both canonical texts is added (own_check,
    edited_check).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    pair = _PAIR + _CHECKS * checks
    nothing = (None,) * (8 if checks else 6)
    schema = f"`{id_col}` {kind}, {pair}, part int, head string, tail string"
    ordered = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col(id_col), F.xxhash64("text")]
    ordered = ordered.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        first = True
        for b in slices(batches, "text"):
            out = []
            for i, text, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = canonical(text)
                if first:  # the head of the partition, for the last row of the one before
                    out.append((None, *nothing, part, text, None))
                    first = False
                if held:
                    out.append((held[0], *_pair_row(held[1], text, held[2], checks), None, None, None))
                held = (i, text, own, part)
            yield _rows(out)
        if held:
            yield _rows([(held[0], *nothing, held[3], None, held[1])])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, arrow)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    names = [id_col, "n_chars", "edited_sha256", "digest", "edited_digest", "near_edited", "near_next", *["own_check", "edited_check"] * checks, "part", "head", "tail"]
    arrow = [to_arrow_type(docs.schema[id_col].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), *[pa.string()] * (2 * checks), pa.int32(), pa.string(), pa.string()]
    width = len(names) - 3
    done = written(ordered.mapInArrow(run, schema), "paired-digests")
    heads = done.filter("head is not null").select("part", "head")
    order = Window.orderBy("part")  # one number for each partition
    links = heads.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(order), F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    ends = done.filter("tail is not null").select(id_col, "part", "tail").join(links, "part")
    ends = ends.join(heads.withColumnRenamed("part", "next_part"), "next_part").select(id_col, "tail", "head")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *_pair_row(t, h, canonical(t), checks)) for i, t, h in zip(*(c.to_pylist() for c in b.columns))]
            columns = list(zip(*out)) if out else [[]] * width
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, arrow[:width])], names[:width])

    last = ends.mapInArrow(finish, f"`{id_col}` {kind}, {pair}")
    return done.filter("n_chars is not null").select(names[:width]).unionByName(last)


def paired_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Should texts of one bucket differ, the pairs are made again with checks and a further text's number is joined by
    digest and check, so rows with null or repeated ids keep their own. The bytes of the texts themselves are compared;
    an edited text takes the number of the text that it equals.
    """
    pairs = written(paired_digests(docs, id_col, text_col), "fingerprints")
    more = clashes(docs, pairs.select(id_col, "digest"), id_col, text_col)
    if not more.isEmpty():
        numbers = more.select("digest", F.sha2("canonical", 256).alias("check"), "number")
        pairs = paired_digests(docs, id_col, text_col, checks=True)
        for name, check in (("digest", "own_check"), ("edited_digest", "edited_check")):
            of = numbers.select(F.col("digest").alias(name), F.col("check").alias(check), F.col("number").cast("string").alias("number"))
            pairs = pairs.join(of, [name, check], "left").withColumn(name, F.concat_ws("-", name, "number")).drop("number", check)
    return pairs.select(id_col, "n_chars", "edited_sha256", F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all whole ``documents`` and of their edited texts. Likeness is 1 for equal canonical bytes, else 0."""
    return paired_fingerprints(table(spark, sf_dir, "documents"))
