"""Every registered query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    out = entry.queries()[name](spark, FOLDER)
    columns = sorted(out.columns)
    got = sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr)
    rows = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in rows.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "score"]


@pytest.mark.parametrize("name", ["chunk_markdown"])
def test_chunks_cover_their_sources(spark, name):
    out = entry.queries()[name](spark, FOLDER).toPandas()
    sizes = out.groupby("id").size()
    assert (out.groupby("id").position.max() + 1 == sizes).all() and (out.content.str.strip() == out.content).all()
