"""Keys of text parts, routed to buckets as packed arrays, and which of them repeat.

A row stands for many keys of one task that fall into one bucket, so that sorting and shuffling
them costs little. Only a key's low 32 bits are kept beside its bucket; keys that agree by
chance only add candidates, which are verified later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def bucket_count(size: int, each: int) -> int:
    """As many buckets as hold ``each`` of ``size`` bytes, and enough to occupy a cluster."""
    return max(16, -(-size // each))


def routed(
    keys: np.ndarray, columns: dict[str, np.ndarray], buckets: int
) -> Iterator[pa.RecordBatch]:
    """A batch with a row per bucket: the keys, and the values of each column, as bytes."""
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    parts = np.split(order, first[1:])
    low = keys.astype(np.uint32)
    arrays = [pa.array(used), pa.array([low[p].tobytes() for p in parts], pa.binary())]
    for values in columns.values():
        arrays.append(pa.array([values[p].tobytes() for p in parts], pa.binary()))
    if len(used):
        yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "keys", *columns])


def repeated_keys(chunks: DataFrame, least: int = 2) -> DataFrame:
    """``bucket, repeated, numbers``: the keys that count at least ``least``, and their counts.

    ``chunks`` has ``bucket, keys, weights`` (a byte per key). The keys of a task are added up
    before the shuffle: what a bucket receives depends on the number of different keys and of
    tasks, and the number of buckets follows that of all keys.
    """

    def shrink(batches):
        for batch in batches:
            out = []
            for keys, weights in zip(*(c.to_pylist() for c in batch.columns[1:])):
                keys, at = np.unique(np.frombuffer(keys, np.uint32), return_inverse=True)
                total = np.bincount(at, np.frombuffer(weights, np.uint8), len(keys))
                out.append((keys.tobytes(), total.astype(np.uint32).tobytes()))
            keys, counts = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                names=["bucket", "keys", "counts"],
            )

    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k, np.uint32) for k in table["keys"].to_pylist()])
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in table["counts"].to_pylist()])
        keys, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, counts, len(keys)).astype(np.int64)
        kept = total >= least
        return pa.table(
            {
                "bucket": pa.array([table["bucket"][0].as_py()], pa.int32()),
                "repeated": pa.array([keys[kept].tobytes()], pa.binary()),
                "numbers": pa.array([total[kept].tobytes()], pa.binary()),
            }
        )

    shrunk = chunks.select("bucket", "keys", "weights").mapInArrow(
        shrink, "bucket int, keys binary, counts binary"
    )
    return shrunk.groupBy("bucket").applyInArrow(
        merge, "bucket int, repeated binary, numbers binary"
    )
