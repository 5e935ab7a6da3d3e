"""Bulk writes to an object log, a catalog table ``key, seq, op, content`` that only grows.

A job that is run again appends the same ``key, seq`` pairs; readers count them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sinks.tables import write_table


def _given(column: str) -> Column:
    """The column; a null in it fails the job, as its row would name no object or no order."""
    missing = F.raise_error(F.lit(f"An operation of an object log needs a {column}"))
    return F.when(F.col(column).isNull(), missing).otherwise(F.col(column))


def put_objects(
    objects: DataFrame, database: str, table: str, fmt: str = "iceberg", path: str | None = None
) -> None:
    """Put ``key, seq, content`` rows; a higher ``seq`` replaces what the key held before."""
    puts = objects.select(
        _given("key").alias("key"),
        _given("seq").cast("bigint").alias("seq"),
        F.lit("put").alias("op"),
        F.col("content").cast("binary").alias("content"),
    )
    write_table(puts, database, table, fmt, "append", path)


def delete_objects(
    keys: DataFrame, database: str, table: str, fmt: str = "iceberg", path: str | None = None
) -> None:
    """Delete the objects of ``key, seq`` rows; a key that holds nothing is no error."""
    deletes = keys.select(
        _given("key").alias("key"),
        _given("seq").cast("bigint").alias("seq"),
        F.lit("delete").alias("op"),
        F.lit(None).cast("binary").alias("content"),
    )
    write_table(deletes, database, table, fmt, "append", path)
