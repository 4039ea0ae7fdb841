"""Every query against its DuckDB counterpart at the smallest scale."""

import datetime
import math
import os

import duckdb
import pytest

from loomquery.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.oracle_sql():
        assert rows
        return
    want = con.sql(catalogue.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr([plain(r[c]) for c in cols]) for r in rows) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
