"""Every registered query against its SQL twin, over whole small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from postlane.plans.catalog import QUERIES
from postlane.plans.oracle import ORACLE

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return "\0" if value is None else value


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    frame = entry_points.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = [tuple(normal(r[c]) for c in columns) for r in frame.collect()]
    cursor = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(normal(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert expected


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() == 20


def test_every_query_has_a_twin():
    assert set(ORACLE) == set(QUERIES)
