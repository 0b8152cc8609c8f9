import re

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = entry.SMALL
TABLES = "region nation customer supplier part orders lineitem documents embeddings pages benchmark labels".split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # Queries of the text operators are checked by the tests of their own folder.
    own = {name for name in entry.queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert own <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() > 2000


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    df = entry.queries()[name](spark, FOLDER)
    order = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    answer = database.sql(entry.oracle_sql()[name])
    assert sorted(answer.columns) == order
    at = [answer.columns.index(c) for c in order]
    assert mine == sorted((tuple(r[i] for i in at) for r in answer.fetchall()), key=repr)
