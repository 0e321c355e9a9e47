"""Every registered query, against its SQL where it has one."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from larderflow import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in queries.SQL:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        r = con.execute(queries.SQL[name])
        cols = [c[0] for c in r.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(repr([cell(x[c]) for c in cols]) for x in got) == sorted(repr([cell(v) for v in x]) for x in r.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "extractor", "name", "metadata", "text"]
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
