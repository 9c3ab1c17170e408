import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=str)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["population", "states", "moves"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    made = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in made.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, made.fetchall())
