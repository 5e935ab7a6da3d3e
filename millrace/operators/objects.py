"""What an object log holds. The log has ``key, seq, op, content`` with op put or delete.

The highest ``seq`` of a key counts, a delete beats a put of the same ``seq``, and rows of the
same ``key, seq`` are replays of one operation. Any other ``op``, or none, counts as a delete, and
a row without ``seq`` comes before all others of its key.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.shared import Folder
from millrace.sources.objects import objects_at


def object_state(log: DataFrame) -> DataFrame:
    """The objects after all operations of the log, as ``key, content``.

    One aggregation that also runs ahead of the shuffle: however often a key was written or
    replayed, each task sends on one row of it.
    """
    deleted = (~F.col("op").eqNullSafe("put")).alias("deleted")
    last = F.max(F.struct("seq", deleted, "content")).alias("last")
    return (
        log.groupBy("key").agg(last).filter("not last.deleted").select("key", "last.content")
    )


def object_keys(log: DataFrame) -> DataFrame:
    """The keys of :func:`object_state`, found without reading any content."""
    deleted = (~F.col("op").eqNullSafe("put")).alias("deleted")
    last = F.max(F.struct("seq", deleted)).alias("last")
    return log.groupBy("key").agg(last).filter("not last.deleted").select("key")


def objects_exist(keys: DataFrame, state: DataFrame | str) -> DataFrame:
    """Whether each distinct key has an object, as ``key, exists``.

    ``state`` is anything with one row per existing ``key``; use :func:`object_keys` for a log
    or a listing for files, which both leave the content unread. It may also be the root of a
    store: then each key is looked up there, and nothing is listed
    (:func:`millrace.sources.objects_at`).
    """
    if isinstance(state, str):
        return objects_at(keys.sparkSession, state, keys).select("key", "exists")
    found = state.select("key", F.lit(True).alias("found"))
    return (
        keys.select("key")
        .distinct()
        .join(found, "key", "left")
        .select("key", F.coalesce("found", F.lit(False)).alias("exists"))
    )


def _last(log: DataFrame) -> DataFrame:
    """The last operation of each key: ``key, seq, deleted, content``."""
    deleted = (~F.col("op").eqNullSafe("put")).alias("deleted")
    last = F.max(F.struct("seq", deleted, "content")).alias("last")
    return log.groupBy("key").agg(last).select("key", "last.*")


def _later(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """The later one of a key's operations in a snapshot and after it.

    One row per key on either side. The snapshot's buckets are kept: only the tail is dealt anew.
    """
    own = snapshot.select("key", F.struct("seq", "deleted", "content").alias("own"))
    new = tail.select("key", F.struct("seq", "deleted", "content").alias("new"))
    joined = own.join(new.hint("merge"), "key", "full_outer")
    # Null if both are; a key has one of them.
    return joined.select("key", F.greatest("own", "new").alias("last")).select("key", "last.*")


def _files(folder: Folder) -> list[str]:
    """The files of a log, without those that a writer has for itself."""
    return [n for n in folder.names() if not n.startswith(("_", "."))]


def compact_log(
    spark: SparkSession, database: str, log: str, pointer: str, buckets: int = 200
) -> None:
    """Fold an object log of Parquet files into a snapshot of each key's last operation.

    ``pointer`` is a folder for the small file that names the snapshot, a catalog table bucketed
    and sorted by key, and the files of the log that it holds. A new snapshot is made of the old one
    and the files that have come since; only when it is whole is the pointer changed, so readers
    see the old or the new one. Files that come meanwhile are left for the next time.
    The last operations of deleted keys stay, so a put that comes late finds them. Nothing is
    deleted: the log's files in a snapshot may go when no reader needs them.
    """
    folder = Folder(spark, pointer)
    state = json.loads(folder.read("snapshot.json") or '{"table": null, "files": []}')
    name = f"`{database}`.`{log}`"
    place = Folder(spark, _location(spark, name))
    files = _files(place)
    new = sorted(set(files) - set(state["files"]))
    if not new:
        return
    rows = spark.read.schema(spark.table(name).schema).parquet(*(f"{place.path}/{f}" for f in new))
    last = _last(rows)
    if state["table"]:
        last = _later(spark.table(f"`{database}`.`{state['table']}`"), last)
    table = f"{log}_snapshot_{uuid.uuid4().hex}"
    (
        last.write.format("parquet")
        .bucketBy(buckets, "key")
        .sortBy("key")
        .saveAsTable(f"`{database}`.`{table}`")
    )
    folder.write("snapshot.json", json.dumps({"table": table, "files": files}))


def compacted_state(spark: SparkSession, database: str, log: str, pointer: str) -> DataFrame:
    """:func:`object_state` of a log, from its snapshot and the files that have come since.

    The snapshot is not shuffled. Without a snapshot so far the whole log is read.
    """
    state = json.loads(Folder(spark, pointer).read("snapshot.json") or '{"table": null}')
    name = f"`{database}`.`{log}`"
    if not state["table"]:
        return object_state(spark.table(name))
    place = Folder(spark, _location(spark, name))
    new = sorted(set(_files(place)) - set(state["files"]))
    last = spark.table(f"`{database}`.`{state['table']}`")
    if new:
        schema = spark.table(name).schema
        rows = spark.read.schema(schema).parquet(*(f"{place.path}/{f}" for f in new))
        last = _later(last, _last(rows))
    return last.filter("not deleted").select("key", "content")


def _location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"]
