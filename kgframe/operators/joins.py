"""Joins on columns that may be null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` by equal keys, where nulls are equal too: units, methods and periods are often left empty.

    The keys come once, then the other columns of both; how: inner, left, left_semi or left_anti.
    """
    right = b.withColumnsRenamed({k: f"right {k}" for k in keys})
    joined = a.join(right, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"`right {k}`")) for k in keys]), how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select(*keys, *[c for c in joined.columns if c not in keys and not c.startswith("right ")])
