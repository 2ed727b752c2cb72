"""Every registered core query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from cratelake import registry as queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    exp = sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=repr)
    assert len(got) == len(exp) > 0
    bad = [(g, e) for g, e in zip(got, exp, strict=True) if not all(map(same, g, e))]
    assert not bad, bad[:5]
