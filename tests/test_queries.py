"""Every query with SQL against DuckDB, on the smallest tables; rows of the others."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from folioloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that may be empty on the smallest tables.
MAY_BE_EMPTY = {"fts_and", "stemmed_fts", "rerank_stub", "page_offset_mode"}


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if isinstance(v, (int, bool, str, type(None))) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows or name in MAY_BE_EMPTY
    if name in registry.ORACLE_SQL:
        got = duck.execute(registry.ORACLE_SQL[name])
        names = [x[0] for x in got.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == Counter(tuple(plain(r[i]) for i in at) for r in got.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
