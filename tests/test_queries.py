"""Every registered query against its SQL on the same tables."""

import datetime
import math
import os
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry
from millrace.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SMALL = "/root/testdata/sf0.001"
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def value(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v if not math.isnan(v) else "nan"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cursor = tables.execute(ORACLES[name])
    positions = {d[0]: i for i, d in enumerate(cursor.description)}
    assert columns == sorted(positions)

    expected = [tuple(value(row[positions[c]]) for c in columns) for row in cursor.fetchall()]
    actual = [tuple(value(row[c]) for c in columns) for row in df.collect()]
    assert expected
    assert len(actual) == len(expected)
    assert sorted(actual, key=repr) == sorted(expected, key=repr)

    types = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: TYPES[df.schema[c].dataType.simpleString()] for c in columns} == types


@pytest.fixture(scope="module")
def zoned_folders(spark, tmp_path_factory):
    """The smallest tables again, each a folder of files, with timestamps that have a zone."""
    folder = tmp_path_factory.mktemp("zoned")
    for file in Path(SMALL).glob("*.parquet"):
        df = spark.read.parquet(str(file))
        for field in df.schema:
            if field.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(field.name, df[field.name].cast("timestamp"))
        df.repartition(3).write.parquet(f"{folder}/{file.name}")
    return str(folder)


@pytest.mark.parametrize(
    "name",
    [
        "alert_recipients",
        "rate_limit_audit_daily",
        "rate_limit_stream",
        "read_topic",
        "run_application",
        "throttled_requests",
        "write_stream",
    ],
)
def test_folders_of_files_and_zoned_timestamps(spark, rows, zoned_folders, name):
    query = QUERIES[name]
    assert rows(query(spark, zoned_folders)) == rows(query(spark, SMALL))
