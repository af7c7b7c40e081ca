"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from tracelake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}"
    return repr(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rel = duck.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == want


def test_every_query_has_a_schema(spark, sf_dir):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)):
        assert catalog.QUERIES[name](spark, sf_dir).columns
