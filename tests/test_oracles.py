"""Every query with an oracle gives DuckDB's rows at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from shoebox.plans import queries as catalogue
from shoebox.plans import state, whole  # noqa: F401  add their queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(catalogue.ORACLE[name])
    names = [x[0] for x in r.description]
    want = sorted(tuple(norm(dict(zip(names, row))[c]) for c in cols) for row in r.fetchall())
    assert sorted(names) == cols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_without_oracle(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "taken", "bytes", "rn"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
