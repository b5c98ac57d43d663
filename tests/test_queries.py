"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from pairloom.operators import learners
from pairloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    def plain(x):
        if hasattr(x, "isoformat"):
            return x.isoformat()[:19].removesuffix("T00:00:00")
        if isinstance(x, bool) or x is None:
            return x
        if isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 6) + 0.0 if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([columns[i] for i in order], *[repr(plain(v[i])) for i in order]) for v in values)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name, monkeypatch):
    monkeypatch.setattr(learners, "ROUNDS", 5)  # the models' full size is for the queries, not for the tests
    monkeypatch.setattr(learners, "TREES", 5)
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLES:
        assert got
        return
    found = duck.sql(registry.ORACLES[name])
    assert got == rows(found.columns, found.fetchall())


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
