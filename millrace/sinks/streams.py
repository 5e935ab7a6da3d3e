from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.shared import Folder

AVAILABLE_NOW = {"availableNow": True}

#: Batches of a table of updates between two of its snapshots.
SNAPSHOT_EVERY = 50


def write_stream(
    df: DataFrame,
    table: str,
    checkpoint: str,
    trigger: Mapping[str, object] = AVAILABLE_NOW,
    fmt: str = "iceberg",
    path: str | None = None,
    partition_by: Sequence[str] = (),
) -> StreamingQuery:
    """Append a stream to a catalog table; a restart on ``checkpoint`` adds no row twice.

    The default trigger takes what the source holds now and then ends. ``partition_by`` cuts a
    new table into folders by the values of columns.
    """
    writer = df.writeStream.format(fmt).option("checkpointLocation", checkpoint)
    if path is not None:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(**trigger).toTable(table)


def _batches(folder: Folder) -> dict[int, str]:
    """The folders of batches by number."""
    return {int(name.split("=")[1]): name for name in folder.names() if name.startswith("batch_id=")}


def _newest(updates: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    values = [c for c in updates.columns if c not in (*keys, order)]
    newest = F.max(F.struct(order, *values)).alias("newest")
    return updates.groupBy(*keys).agg(newest).select(*keys, *(f"newest.{c}" for c in values))


def write_updates(
    df: DataFrame,
    path: str,
    checkpoint: str,
    trigger: Mapping[str, object] = AVAILABLE_NOW,
    keys: Sequence[str] | None = None,
    snapshot_every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Write the changed rows of each micro-batch of an aggregation below ``path``.

    Every batch has its own folder and replaces it when replayed, so a restart leaves no
    duplicates. Read the result with :func:`read_updates`.

    The folders belong to the query that ``checkpoint`` names. A new checkpoint starts the table
    anew: its batches have a folder of their own, which takes the place of the old one's with
    the first batch that is written. With ``keys`` each ``snapshot_every``-th batch is written
    together with the newest rows of all batches before it, whose folders go when the next
    batch begins, that is, when the snapshot's batch is committed. So reading costs one
    snapshot and less than ``snapshot_every`` batches, however many there have been.
    """
    spark, top = df.sparkSession, Folder(df.sparkSession, path)
    if top.read("_query") is None:
        top.write("_schema", df.schema.json())  # for readers before the first batch

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # The checkpoint has its query's name since before the first batch.
        query = json.loads(Folder(spark, checkpoint).read("metadata"))["id"]
        own = top.below(f"query={query}")
        if own.read("_schema") is None:
            own.write("_schema", df.schema.json())
        before = {k: name for k, name in _batches(own).items() if k < batch_id}
        snapshots = [k for k, name in before.items() if own.below(name).read("_snapshot") is not None]
        if snapshots:
            for k in [k for k in before if k < max(snapshots)]:
                own.delete(before.pop(k))
        target = own.below(f"batch_id={batch_id}")
        if keys is not None and (batch_id + 1) % snapshot_every == 0 and before:
            updates = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
            for k, name in before.items():
                rows = spark.read.schema(df.schema).parquet(own.below(name).path)
                updates = updates.unionByName(rows.withColumn("batch_id", F.lit(k).cast("long")))
            _newest(updates, keys, "batch_id").write.mode("overwrite").parquet(target.path)
            target.write("_snapshot", "")
        else:
            batch.write.mode("overwrite").parquet(target.path)
        if top.read("_query") != query:
            top.write("_query", query)
            for name in top.names():
                if name.startswith("query=") and name != f"query={query}":
                    top.delete(name)

    return (
        df.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(write_batch)
        .start()
    )


def read_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key among those written by :func:`write_updates`.

    Without a batch so far there is no row.
    """
    top = Folder(spark, path)
    query = top.read("_query")
    own = top.below(f"query={query}")
    described = own.read("_schema") if query else top.read("_schema")
    if described is None:
        raise FileNotFoundError(f"No table of updates: {path}")
    schema = StructType.fromJson(json.loads(described))
    batches = _batches(own) if query else {}
    if not batches:
        return _newest(spark.createDataFrame([], schema.add("batch_id", "long")), keys, "batch_id")
    snapshots = [k for k, name in batches.items() if own.below(name).read("_snapshot") is not None]
    first = max(snapshots, default=0)
    paths = [own.below(name).path for k, name in batches.items() if k >= first]
    updates = spark.read.schema(schema.add("batch_id", "long")).option("basePath", own.path)
    return _newest(updates.parquet(*paths), keys, "batch_id")
