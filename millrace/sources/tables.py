from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession, database: str, table: str, streaming: bool = False
) -> DataFrame:
    """Read a catalog table, as a batch or as a stream of its appended rows."""
    reader = spark.readStream if streaming else spark.read
    return reader.table(f"`{database}`.`{table}`")
