"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, str] = {
    "op1_nearest": "neighbours",
    "op2_token_counts": "token_counts",
    "op3_balanced_shards": "sharding",
    "op4_fingerprints": "fingerprints",
    "op5_bpe_encoding": "bpe",
    "op6_pii": "pii",
    "op7_html_text": "html",
    "op8_jaccard_join": "jaccard",
    "op9_quality": "quality",
    "op10_mixing": "mixing",
    "op11_byte_bpe": "byte_bpe",
    "op12_conversations": "conversations",
    "op13_whitening": "whitening",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"kgframe.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"kgframe.llm.{module}"), f"{name}_SQL".upper(), None) for name, module in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
