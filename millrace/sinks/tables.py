from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.shared import Folder

#: How a folder of one overwrite begins, below the place of its table.
VERSION = "_version-"


def write_table(
    df: DataFrame,
    database: str,
    table: str,
    fmt: str = "iceberg",
    mode: str = "append",
    path: str | None = None,
    partition_by: Sequence[str] = (),
) -> None:
    """Write ``df`` to a catalog table, creating it on first use.

    ``path`` places a new table outside the database's own location, and ``partition_by`` cuts
    it into folders by the values of columns; a table that exists keeps its place, its partition
    columns and its properties, also when it is overwritten. Iceberg goes through the v2 writer,
    whose commits are atomic; any other format through ``saveAsTable``, or if its rows are
    replaced through ``replace_rows``.
    """
    spark = df.sparkSession
    name = f"`{database}`.`{table}`"
    exists = spark.catalog.tableExists(name)
    if fmt == "iceberg":
        if mode not in ("append", "overwrite"):
            raise ValueError(f"Unsupported write mode for iceberg: {mode}")
        writer = df.writeTo(name).using(fmt)
        if exists and mode == "append":
            writer.append()
        elif exists:
            writer.overwrite(F.lit(True))
        else:
            if path is not None:
                writer = writer.tableProperty("location", path)
            if partition_by:
                writer = writer.partitionedBy(*map(F.col, partition_by))
            writer.create()
        return
    columns = list(partition_by)
    if exists:
        columns = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    if exists and mode == "overwrite":
        replace_rows(df, name, fmt, columns)
        return
    writer = df.write.format(fmt).mode(mode)
    if columns:
        writer = writer.partitionBy(*columns)
    if path is not None and not exists:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def replace_rows(df: DataFrame, name: str, fmt: str, partition_by: Sequence[str]) -> None:
    """Replace the rows of a table of files, and its columns by those of ``df``.

    The new rows are written to a folder of their own first. Only when all are there is the
    table pointed to them, so a job that fails leaves the old rows, and ``df`` may read the table
    itself. An external table's new folder is in the place of the table; a managed table's files
    are moved to its place. The old files go last.
    """
    spark = df.sparkSession
    described = {
        row["col_name"]: row["data_type"]
        for row in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    }
    properties = [
        (row["key"], row["value"])
        for row in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()
        if not row["key"].startswith(("transient_", "spark."))
    ]
    place, external = described["Location"].rstrip("/"), described["Type"] == "EXTERNAL"
    base = place.split(f"/{VERSION}", 1)[0]
    version = f"{VERSION}{uuid.uuid4().hex}"
    staged = f"{base}/{version}" if external else f"{base}-{version}"
    writer = df.write.format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(staged)

    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    ordered = [f for f in df.schema if f.name not in partition_by]
    ordered += [df.schema[c] for c in partition_by]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered)
    parts = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else ""
    location = f" LOCATION {quoted(staged)}" if external else ""
    own = ", ".join(f"{quoted(k)} = {quoted(v)}" for k, v in properties)
    settings = f" TBLPROPERTIES ({own})" if properties else ""
    spark.sql(f"DROP TABLE {name}")  # of a managed table, with its files
    spark.sql(f"CREATE TABLE {name} ({fields}) USING {fmt}{parts}{location}{settings}")
    if not external:
        Folder(spark, staged).move_all(place)
    if partition_by:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    spark.catalog.refreshTable(name)
    if external:
        folder = Folder(spark, base)
        for entry in folder.names():
            if entry != version and (not entry.startswith(VERSION) or place.endswith(entry)):
                folder.delete(entry)
