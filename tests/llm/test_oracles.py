"""The queries of this package against their SQL."""

import os
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from millrace.llm.oracles import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tables, name):
    found = queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    cursor = tables.execute(oracle_sql()[name])
    place = {d[0]: k for k, d in enumerate(cursor.description)}
    assert columns == sorted(place)
    expected = sorted((tuple(r[place[c]] for c in columns) for r in cursor.fetchall()), key=repr)
    actual = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    assert len(actual) == len(expected) > 0
    assert actual == expected
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: kinds[found.schema[c].dataType.simpleString()] for c in columns} == types
