"""Every query of the library against its SQL on the smallest test tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from kgframe.plans import registry

registry.load_all()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, Decimal):
        return float(v)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    if name not in registry.SQL:
        assert got
        return
    found = duck.execute(registry.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = ordered(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want
