"""Every registered query against its SQL counterpart in DuckDB."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from queuelens.plans import tables
from queuelens.plans.oracles import ORACLES
from queuelens.plans.queries import all_queries

# Spark type -> the DuckDB type it has to meet.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def _cell(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", list(all_queries()))
def test_matches_sql(spark, duck, sf_dir, name):
    df = all_queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    answer = duck.sql(ORACLES[name])
    assert columns == sorted(answer.columns)
    kinds = dict(zip(answer.columns, map(str, answer.types)))
    assert {c: TYPES[kind] for c, kind in df.dtypes} == kinds
    got = Counter(tuple(_cell(row[c]) for c in columns) for row in df.collect())
    at = [answer.columns.index(c) for c in columns]
    want = Counter(tuple(_cell(row[i]) for i in at) for row in answer.fetchall())
    assert sum(want.values()) > 0
    assert got == want, f"extra {list((got - want).items())[:3]}, missing {list((want - got).items())[:3]}"


def test_every_query_has_sql():
    assert set(all_queries()) == set(ORACLES)
    assert set(all_queries()) <= set(queries()) and set(ORACLES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    first, last = tables.grid(spark, "/root/testdata/sf0.001")
    assert entry(spark).count() == 5 * (last - first + 1)
