"""Every query with an oracle against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from rankflow.plans import catalogue

DIR = "/root/testdata/sf0.001"


def rows(data, columns, names):
    at = [columns.index(n) for n in names]
    return sorted(tuple("%.6g" % r[i] if isinstance(r[i], float) else str(r[i]) for i in at) for r in data)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, db, name):
    df, q = catalogue.QUERIES[name](spark, DIR), db.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(q.columns)
    names = sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns, names) == rows(q.fetchall(), q.columns, names)
