import os

import duckdb
import pytest

from foliosift import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(names, data):
    order = [names.index(c) for c in sorted(names)]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_sample_is_reproducible(spark):
    assert queries.random_sample(spark, SF).collect() == queries.random_sample(spark, SF).collect()
