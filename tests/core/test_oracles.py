"""Every query with SQL, but those of the training-data subpackage, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from marginalia.plans import catalog  # noqa: E402

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return x if isinstance(x, bool) else round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "as_tuple") else str(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(SF))
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert a == b


def test_queries_run_without_sql(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLES)):
        assert catalog.QUERIES[name](spark, str(SF)).columns
