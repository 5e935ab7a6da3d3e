"""Small helpers of the operators of this package."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import shared

#: What a task's memo of results may take, in bytes.
MEMO_BYTES = 16 << 20
#: Rows that travel to Python and back at once, in bytes; a task holds several such batches.
BATCH_BYTES = "8m"


def kept_by_worker(key: str, make: Callable):
    """An object of bounded size, such as a vocabulary, that lives as long as the Python worker.

    It is kept in a module of its own, as functions sent with their code have new globals in
    each task.
    """
    kept = sys.modules.setdefault("_millrace_worker", ModuleType("_millrace_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Memo(dict):
    """Results of a function by argument; emptied when they take ``most`` bytes, about."""

    def __init__(self, function, most: int = MEMO_BYTES):
        super().__init__()
        self.function, self.most, self.held = function, most, 0

    def __missing__(self, key):
        value = self.function(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        """Remember a result that was found otherwise."""
        self.held += 100 + sys.getsizeof(key) + sys.getsizeof(value)
        if isinstance(value, tuple):
            self.held += sum(map(sys.getsizeof, value))
        if self.held > self.most:
            self.clear()
            self.held = 0
        self[key] = value


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed meanwhile goes to Python workers in batches of ``BATCH_BYTES``.

    Rows with packed arrays are large, and a batch is held several times over: by Spark, as it
    arrives and as Python's own values.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles meanwhile is deleted when the query has ended.

    Otherwise it stays on the executors' disks until the driver happens to collect its garbage,
    so that the shuffles of all steps of an operator add up. For steps that write a table or
    collect rows, and whose shuffles no later query reads.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame) -> DataFrame:
    """``millrace.shared.materialize`` with small batches."""
    with small_batches(df.sparkSession):
        return shared.materialize(df)


class Scratch:
    """Tables in the shared folder that an operator needs only until its result is written.

    What is still to be computed when they are dropped must not come from them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        """Compute ``df`` once; as ``materialize``, but for a time."""
        path = shared.shared_folder(self.spark)
        self.paths.append(path)
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the tables; the folders are new ones of this operator alone."""
        for name in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []


def hash_words(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` consecutive words, which takes their order in."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix(out)


def binaries(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def batches_of(
    batches: Iterable[pa.RecordBatch], column: str, size: int
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of ``column`` in one have about ``size`` bytes."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(lengths, np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, end - start)
            start = end


def by_stretch(
    texts: list[bytes],
    starts: Callable[[np.ndarray], np.ndarray],
    ids_of: Callable[[list[str]], tuple[np.ndarray, bytes]],
) -> list[np.ndarray]:
    """The ids of UTF-8 texts, put together from those of the stretches that they consist of.

    ``starts`` tells of each of all bytes whether a stretch starts there, which must be at the
    first byte of a sign; a text starts one in any case. ``ids_of`` gives, of different
    stretches, how many ids each has and all ids as packed 32-bit numbers: each stretch is asked
    for once, however often it occurs.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    begins = starts(data)
    begins[bounds[bounds < len(data)]] = True
    places = np.append(np.flatnonzero(begins), len(data)).astype(np.int64)
    buffers = [None, pa.py_buffer(places), pa.py_buffer(data)]
    stretches = pa.Array.from_buffers(pa.large_string(), len(places) - 1, buffers).dictionary_encode()
    sizes, found = ids_of(stretches.dictionary.to_numpy(zero_copy_only=False).tolist())
    first, which = np.cumsum(sizes) - sizes, np.asarray(stretches.indices)
    ends = np.append(0, np.cumsum(sizes[which]))
    # An id's place among those of the different stretches, for each stretch as it occurs.
    moved = np.repeat(first[which] - ends[:-1], sizes[which])
    ids = np.frombuffer(found, np.uint32)[moved + np.arange(ends[-1])]
    cuts = ends[np.searchsorted(places, bounds)]
    return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches one by one, for rows so large that only one is made at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """The bytes of all texts, by which operators choose how many parts they make."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).collect()[0]["b"]
    return int(total or 0)


def numbered(
    docs: DataFrame, name: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Documents with a whole number each, in the column ``name``, in the order of their ids.

    For operators that take an id to name one text: where ids are whole numbers and do so, they
    are the numbers. Otherwise each different text of an id gets its own, by a sort over the
    cluster; a row without an id has none.
    """
    text_hash = F.xxhash64(text_column)
    texts = docs.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id"))
    several = texts.agg(F.min(text_hash).alias("low"), F.max(text_hash).alias("high"))
    whole = docs.schema[id_column].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and several.filter("low != high").isEmpty():
        return docs.withColumn(name, F.col(id_column).cast("long"))
    order = docs.filter(F.col(id_column).isNotNull()).select(
        F.col(id_column).alias(f"{name}_id"), text_hash.alias(f"{name}_text")
    )
    order = order.distinct().repartitionByRange(*order.columns).sortWithinPartitions(*order.columns)
    order = materialize(order.withColumn(name, F.monotonically_increasing_id()))
    same = (docs[id_column] == order[f"{name}_id"]) & (
        F.xxhash64(docs[text_column]) == order[f"{name}_text"]
    )
    return docs.join(order, same, "left").drop(f"{name}_id", f"{name}_text")
