"""Every query that has SQL gives the rows that DuckDB gives on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lumenframe import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted(repr([plain(v[i]) for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(plans.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got == want


def test_means_on_a_rounding_edge_are_those_of_the_sql(spark):
    """All six digits: on sf0.01 the brightness of clip 29 is 0.0640625."""
    sf = "/root/testdata/sf0.01"
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        want = c.execute(plans.ORACLE_SQL["frame_quality"])
        columns, values = [d[0] for d in want.description], want.fetchall()
    got = plans.QUERIES["frame_quality"](spark, sf).select(*columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(values)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["split", "n"] and df.count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
