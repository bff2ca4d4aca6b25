"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def library():
    from tracelake.plans import registry

    return registry.queries(), registry.oracle_sql()


NAMES = sorted(library()[1])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{BASE}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, duck, name):
    queries, sql = library()
    df = queries[name](spark, BASE)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(sql[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert got == want


def test_each_query_has_sql():
    queries, sql = library()
    assert set(queries) == set(sql)
