"""A corpus pipeline: quality, near-duplicates, personal data, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``; other columns are left out. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgframe.llm import bpe, jaccard, mixing, pii, quality
from kgframe.llm.common import ship, table, written
from kgframe.sources.shared import mark, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are judged like others, rows that repeat an id each by its own text."""
    ship(spark)
    return quality.good_documents(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least id. Texts without words and rows with a null id stay; equal rows stay together."""
    ship(spark)
    return jaccard.distinct_documents(docs.select(COLUMNS)).select(COLUMNS)


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values get pseudonyms of their format; null texts stay null, and n_chars is counted again (null for a null text)."""
    return pii.pseudonymise(docs.select(COLUMNS), pii.KEY, found_col=None).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to the production weights. Null sources count as sources without a weight of their own; rows with equal ids are repeated equally often."""
    return mixing.replicate(docs.select(COLUMNS), mixing.WEIGHTS, mixing.SEED).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts are encoded, and decoded again; null and empty texts give no tokens, repeated rows a result each."""
    ship(spark)
    return bpe.encode_documents(docs.select(COLUMNS), bpe.default_path())


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_distinct),
    ("PII", hide_persons),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL cannot express the classifier, the join over whole corpora or the encoding; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what each keeps is a written table, so that a lost executor costs one stage at
    most. A stage's own tables and what it has read are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    since = mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, since, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
