"""Objects kept as files under a root: the key is the path below the root.

Every file is an object, whatever its name; links to folders are left out. Keys are listed in
ranges and objects are read by the executors, through the file system that serves the root, with
the session's settings for it. Of a store with few objects, and where ranges are cut, the driver
looks at some thousand keys.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.shared import materialize
from millrace.sources.stores import opener, session_place

#: Objects that a task lists of its range before it hands the rest back to be cut again.
LISTED = 200_000
#: The length of a part of an object, in bytes, for :func:`read_object_ranges`.
PART_BYTES = 64 << 20
_LISTING = "key string, length long, modified timestamp, after string, until string"


def _listed(spark: SparkSession, open_store, ranges: list[tuple], most: int | None) -> DataFrame:
    """The objects of ranges of keys, each listed by a task; what is left is a row of its own."""

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import islice

        store = open_store()
        names = ["key", "length", "modified", "after", "until"]
        types = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for after, until in zip(*(batch.column(c).to_pylist() for c in ("after", "until"))):
                found = store.entries(after, until)
                listed = 0
                while rows := list(islice(found, 10_000)):
                    listed += len(rows)
                    yield batch_of([(*row, None, None) for row in rows])
                    if most is not None and listed >= most:
                        yield batch_of([(None, None, None, rows[-1][0], until)])
                        break

    rows = [(part, *range_) for part, range_ in enumerate(ranges)]
    dealt = spark.createDataFrame(rows, "part int, after string, until string")
    return dealt.repartitionById(len(rows), "part").mapInArrow(entries, _LISTING)


def _cut(cuts: list[str], after: str = "", until: str | None = None) -> list[tuple]:
    bounds = [after, *(c for c in cuts if c > after and (until is None or c < until)), until]
    return list(zip(bounds, bounds[1:]))


def _from_spark(spark: SparkSession, root: str) -> DataFrame:
    """The files below a root of a store that only Spark's readers open."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    base = store.makeQualified(path).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.withColumn("key", F.substring("path", len(base) + 2, 1 << 20))


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """List every object below ``root`` as ``key, length, modified`` without reading content.

    The space of keys is cut into ranges, which are listed by a task each: a flat store, or one
    folder with very many names, is spread over the cluster too. A task that meets more than
    ``LISTED`` objects hands the rest of its range back; these are cut again and listed by the
    next job, and what is listed so far is kept in the shared folder. A store with few objects takes one job, when the result
    is used. A missing root fails the call. Schemes of Hadoop's are served by ``pyarrow``'s file
    systems, buckets with keys of access in the settings by pages of the service's list; any
    other store by Spark's file reader, which leaves out names with ``_`` or ``.`` in front.
    """
    place = session_place(spark, root)
    if place is None:
        return _from_spark(spark, root).select("key", "length", F.col("modificationTime").alias("modified"))
    open_store = opener(place)
    store, parts = open_store(), 4 * spark.sparkContext.defaultParallelism
    cuts, complete = store.cuts(parts)
    ranges = _cut(cuts)
    if complete:
        return _listed(spark, open_store, ranges, None).drop("after", "until")
    levels = []
    while ranges:
        level = materialize(_listed(spark, open_store, ranges, LISTED))
        levels.append(level.filter("key is not null").drop("after", "until"))
        # One row per range that was not listed to its end.
        rest = level.filter("key is null").select("after", "until").collect()
        each = max(2, parts // max(1, len(rest)))
        ranges = [
            range_
            for after, until in rest
            for range_ in _cut(store.cuts(each, after, until)[0], after, until)
        ]
    return reduce(DataFrame.unionByName, levels)


def _checked(key: str) -> str:
    """A key that names one place below the root."""
    if not key or any(part in ("", ".", "..") for part in key.split("/")):
        raise ValueError(f"Not a key of an object: {key!r}")
    return key


def _wanted(spark: SparkSession, keys: Sequence[str] | DataFrame) -> DataFrame:
    """The distinct keys of a list or a table, and its column ``length`` if it has one."""
    if isinstance(keys, DataFrame):
        bad = F.col("key").isNull() | F.rlike("key", F.lit(r"^$|(^|/)(\.{0,2})(/|$)"))
        named = F.concat(F.lit("Not a key of an object: "), F.coalesce("key", F.lit("null")))
        checked = F.when(bad, F.raise_error(named)).otherwise(F.col("key")).alias("key")
        if "length" in keys.columns:
            return keys.select(checked, "length").groupBy("key").agg(F.max("length").alias("length"))
        return keys.select(checked).distinct()
    if isinstance(keys, str):
        raise TypeError("keys must be a sequence of keys, not one string")
    rows = [(_checked(key),) for key in dict.fromkeys(keys)]
    return spark.createDataFrame(rows, "key string")


def _dealt(sizes: Iterable[tuple], parts: int) -> list[tuple]:
    """Each key with the part it goes to: the largest first, to the part with the fewest bytes."""
    load = [(0, part) for part in range(parts)]
    out = []
    for key, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        bytes_, part = heapq.heappop(load)
        out.append((part, key))
        heapq.heappush(load, (bytes_ + size + 4096, part))  # opening an object costs as well
    return out


def _packed(listing: DataFrame, parts: int) -> DataFrame:
    """Keys in partitions of about as many bytes.

    Objects with more than a sixteenth of a part's share are ``16 * parts`` at the most: these are
    dealt one by one. All others fall into as many slots by their hash, and the slots are dealt
    as if each held an equal part of their bytes.
    """
    spark, slots = listing.sparkSession, 16 * parts
    total = listing.agg(F.sum("length")).first()[0] or 0
    rows = listing.filter(F.col("length") > total / slots).select("key", "length").collect()
    large = {row["key"]: row["length"] for row in rows}
    each = (total - sum(large.values())) // slots
    dealt = _dealt([*large.items(), *((slot, each) for slot in range(slots))], parts)
    own = spark.createDataFrame([(k, p) for p, k in dealt if k in large], "key string, own int")
    shared = spark.createDataFrame([(k, p) for p, k in dealt if k not in large], "slot int, part int")
    slot = F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int")
    packed = listing.select("key", slot.alias("slot")).join(F.broadcast(shared), "slot")
    packed = packed.join(F.broadcast(own), "key", "left").withColumn("part", F.coalesce("own", "part"))
    return packed.repartitionById(parts, "part").select("key")


def read_objects(
    spark: SparkSession, root: str, keys: Sequence[str] | DataFrame | None = None
) -> DataFrame:
    """Read whole objects as ``key, content``: all below ``root``, or those named by ``keys``.

    ``keys`` are names, or a table with a column ``key`` for a large set, of which each distinct
    one is read once. Named keys are opened directly, so nothing else is listed or read. A key
    without an object, also one that is a folder, fails the job with ``PATH_NOT_FOUND``; ask
    :func:`objects_at` first for a set that may have gaps. An empty key, or one with a segment
    that is empty, ``.`` or ``..``, is an error.

    Objects are packed by their bytes into partitions, as many as the session has cores, or 128 MB
    each where that is more; so are those of a table with a column ``length``, such as a listing.
    An object is one row, so one of 2 GB or more fails: :func:`read_object_ranges` reads any.
    """
    place = session_place(spark, root)
    if place is None:
        files = _from_spark(spark, root).select("key", "content")
        return files if keys is None else files.join(_wanted(spark, keys).select("key"), "key")
    open_store = opener(place)
    parts = spark.sparkContext.defaultParallelism
    if keys is None:
        store = open_store()
        if store.cuts(1)[1]:
            sizes = [(key, size) for key, size, _ in store.entries()]
            parts = max(parts, sum(size for _, size in sizes) >> 27)
            dealt = spark.createDataFrame(_dealt(sizes, parts), "part int, key string")
            wanted = dealt.repartitionById(parts, "part").select("key")
        else:
            wanted = _by_bytes(list_objects(spark, root), parts)
    else:
        wanted = _wanted(spark, keys)
        if "length" in wanted.columns:
            wanted = _by_bytes(materialize(wanted), parts)

    def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = open_store()
        for batch in batches:
            for key in batch.column(0).to_pylist():
                found = store.info(key)
                if found is None:
                    raise FileNotFoundError(f"PATH_NOT_FOUND: {key}")
                if found[0] >= (1 << 31) - 4096:
                    raise ValueError(f"Larger than a row can be, read it in ranges: {key}")
                with store.open(key) as file:
                    content = file.read()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.string()), pa.array([content], pa.binary())],
                    names=["key", "content"],
                )

    return wanted.mapInArrow(contents, "key string, content binary")


def _by_bytes(listing: DataFrame, parts: int) -> DataFrame:
    total = listing.agg(F.sum("length")).first()[0] or 0
    return _packed(listing, max(parts, total >> 27))


def read_object_ranges(
    spark: SparkSession,
    root: str,
    keys: Sequence[str] | DataFrame | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Read objects in parts, as ``key, offset, content``, so that one object is read by many tasks.

    Each part but an object's last has ``part_bytes``; an empty object is one empty part. Keys are
    as in :func:`read_objects`. Parts are dealt evenly over as many partitions as the session has
    cores, or one per 128 MB where that is more.
    """
    place = session_place(spark, root)
    if place is None:
        raise ValueError(f"No file system here reads ranges of objects of {root}")
    open_store = opener(place)
    if keys is None:
        listing = list_objects(spark, root)
    else:
        missing = F.raise_error(F.concat(F.lit("PATH_NOT_FOUND: "), F.col("key")))
        listing = objects_at(spark, root, keys).withColumn(
            "length", F.when(F.col("exists"), F.col("length")).otherwise(missing)
        )
    listing = materialize(listing.select("key", "length"))
    total = listing.agg(F.sum("length")).first()[0] or 0
    last = F.greatest(F.col("length") - 1, F.lit(0))
    offsets = F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(part_bytes).cast("long")))
    wanted = listing.select("key", offsets.alias("offset"))
    wanted = wanted.repartition(max(spark.sparkContext.defaultParallelism, total >> 27))

    def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = open_store()
        for batch in batches:
            for key, offset in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open(key) as file:
                    file.seek(offset)
                    content = file.read(part_bytes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key], pa.string()),
                        pa.array([offset], pa.int64()),
                        pa.array([content], pa.binary()),
                    ],
                    names=["key", "offset", "content"],
                )

    return wanted.mapInArrow(contents, "key string, offset long, content binary")


def objects_at(
    spark: SparkSession, root: str, keys: Sequence[str] | DataFrame
) -> DataFrame:
    """Look keys up in a store, one by one: ``key, exists, length, modified``, each key once.

    Executors ask for each key itself, so nothing is listed. A folder is no object. Only a key
    that the store knows nothing of is absent: if access is denied, or anything else is wrong,
    the job fails with that error.
    """
    place = session_place(spark, root)
    if place is None:
        raise ValueError(f"No file system here looks up objects of {root}")
    open_store = opener(place)
    # By range, so that neighbours in the store are asked for by one task.
    wanted = _wanted(spark, keys).select("key")
    wanted = wanted.repartitionByRange(spark.sparkContext.defaultParallelism, "key")

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = open_store()
        for batch in batches:
            keys = batch.column(0)
            found = [store.info(key) for key in keys.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array([x is not None for x in found], pa.bool_()),
                    pa.array([x and x[0] for x in found], pa.int64()),
                    pa.array([x and x[1] for x in found], pa.timestamp("us", "UTC")),
                ],
                names=["key", "exists", "length", "modified"],
            )

    return wanted.mapInArrow(look, "key string, exists boolean, length long, modified timestamp")
