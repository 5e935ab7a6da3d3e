"""Near-duplicate embeddings by hashing to the E8 lattice."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.common import Scratch, materialize


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two ones of any sign, or halves with evenly many minus."""
    pairs = [
        [a if k == i else b if k == j else 0.0 for k in range(8)]
        for i, j in combinations(range(8), 2)
        for a, b in product((1.0, -1.0), repeat=2)
    ]
    halves = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest whole-number points whose components have an even sum."""
    point = np.rint(y)
    rest = y - point
    odd = np.flatnonzero(point.sum(1) % 2)
    worst = np.abs(rest[odd]).argmax(1)
    point[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest E8 points of the rows of ``y``: of D8 or of D8 moved by one half."""
    whole, half = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    nearer = ((y - half) ** 2).sum(1) < ((y - whole) ** 2).sum(1)
    return np.where(nearer[:, None], half, whole)


def cells(unit: np.ndarray, table: int, scale: float, probes: int, seed: int = 7):
    """The lattice cell of each unit vector in a table, and the neighbouring cells nearest to it.

    Returns 64-bit cell hashes of shape (rows, 1 + probes), the own cell first. A table is a
    random projection to eight dimensions, made anew from ``seed`` and its number.
    """
    rng = np.random.default_rng((seed, table, unit.shape[1]))
    projected = unit @ rng.standard_normal((unit.shape[1], 8)) * scale
    own = nearest_e8(projected)
    steps = shortest_vectors()
    nearest = np.argpartition(-((projected - own) @ steps.T), probes, axis=1)[:, :probes]
    points = np.concatenate([own[:, None], own[:, None] + steps[nearest]], axis=1)
    twice = np.ascontiguousarray(np.rint(2 * points).astype(np.int16))
    return np.array(
        [
            [xxhash.xxh3_64_intdigest(p.tobytes(), seed=table) >> 1 for p in row]
            for row in twice
        ],
        np.int64,
    )


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.array(v, np.float64) for v in column.to_pylist()]


def unit_vectors(
    embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``id, vector`` of the vectors that may be linked: with an id, without null, infinite or
    NaN components, and not zero."""
    v = F.col(vector_column)
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    return embeddings.filter(
        F.col(id_column).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    ).select(F.col(id_column).alias("id"), v.cast("array<double>").alias("vector"))


def near_pairs(
    vectors: DataFrame,
    scratch: Scratch,
    threshold: float = 0.95,
    tables: int = 6,
    probes: int = 8,
    scale: float = 1.0,
    block: int = 256,
) -> DataFrame:
    """Pairs ``a < b`` of different vectors with cosine of at least ``threshold``.

    ``vectors`` has ``id, vector``, no two rows alike. Every vector is indexed in its cell of
    every table and looks into its own and the nearest cells; both come in blocks per cell, so
    a full cell is many blocks and never one group. Within blocks a code of one byte per
    component, whose error is bounded, tells which pairs to verify in double precision.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"), np.int64)
            by_width: dict[int, list[int]] = {}
            found = _vectors(batch.column("vector"))
            for k, v in enumerate(found):
                by_width.setdefault(len(v), []).append(k)
            for members in by_width.values():
                some = np.array([found[k] for k in members])
                some = some / np.abs(some).max(1, keepdims=True)
                unit = some / np.linalg.norm(some, axis=1, keepdims=True)
                codes = np.rint(unit * 127).astype(np.int8)
                codes = [c.tobytes() for c in codes]
                for table in range(tables):
                    at = cells(unit, table, scale, probes)
                    for probe in range(1 + probes):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(at[:, probe]),
                                pa.array(np.full(len(members), probe > 0)),
                                pa.array(ids[members]),
                                pa.array(codes, pa.binary()),
                            ],
                            names=["cell", "probing", "id", "code"],
                        )

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, codes = None, [], []

        def packed() -> pa.RecordBatch:
            values = [
                pa.array([key[0]], pa.int64()),
                pa.array([key[1]], pa.bool_()),
                pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                pa.array([b"".join(codes)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(values, names=["cell", "probing", "ids", "codes"])

        for batch in batches:
            for cell, probing, i, code in zip(*(c.to_pylist() for c in batch.columns)):
                if (cell, probing) != key or len(ids) == block or len(code) != len(codes[0]):
                    if ids:
                        yield packed()
                    key, ids, codes = (cell, probing), [], []
                ids.append(i)
                codes.append(code)
        if ids:
            yield packed()

    spread = (
        vectors.mapInArrow(rows, "cell long, probing boolean, id long, code binary")
        # By range, so that a full cell is cut where a task has enough of it.
        .repartitionByRange("cell", "probing", "id")
        .sortWithinPartitions("cell", "probing", "id")
        .mapInArrow(pack, "cell long, probing boolean, ids binary, codes binary")
    )
    spread = scratch.keep(spread)
    indexed = spread.filter("not probing").select(
        "cell", F.col("ids").alias("x_ids"), F.col("codes").alias("x_codes")
    )
    met = spread.join(indexed, "cell").filter("probing or ids <= x_ids")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[c], np.int64) for c in ("ids", "x_ids"))
                width = len(row["codes"]) // len(a)
                if width * len(b) != len(row["x_codes"]):
                    continue
                x, y = (
                    np.frombuffer(row[c], np.int8).astype(np.float32).reshape(-1, width) / 127
                    for c in ("codes", "x_codes")
                )
                # Each code is off by half a step per component at most.
                off = np.sqrt(width) / 254
                i, j = np.nonzero(x @ y.T >= threshold - 2 * off - off * off - 1e-4)
                pair = np.stack([np.minimum(a[i], b[j]), np.maximum(a[i], b[j])], 1)
                out.append(pair[pair[:, 0] < pair[:, 1]])
            pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"]
            )

    candidates = met.mapInArrow(compare, "a long, b long").distinct()
    left = vectors.select(F.col("id").alias("a"), F.col("vector").alias("v"))
    right = vectors.select(F.col("id").alias("b"), F.col("vector").alias("w"))

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w = _vectors(batch.column("v")), _vectors(batch.column("w"))
            near = [len(x) == len(y) and cosine(x, y) >= threshold for x, y in zip(v, w)]
            kept = batch.filter(pa.array(near, pa.bool_()))
            yield kept.select(["a", "b"])

    return candidates.join(left, "a").join(right, "b").mapInArrow(verify, "a long, b long")


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y / np.sqrt((x @ x) * (y @ y)))


def near_vectors(
    embeddings: DataFrame,
    threshold: float = 0.95,
    tables: int = 6,
    probes: int = 8,
    scale: float = 1.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Link near-duplicate vectors; one row per row: ``vec_id, n_links, component_id, kept``.

    Equal vectors form a class and are compared once; a class of n gives n - 1 links to each of
    its members, and a link between classes counts all members. ``n_links`` counts other ids
    linked directly, so a repeated row of one id adds none; ``component_id`` is the smallest id
    reachable, itself included. Vectors that are null, zero or hold null, NaN or infinite
    components, and of another length, link with nothing. A row without an id gets nulls and is
    not kept. Of pairs at the threshold some may be missed (``tables`` and ``probes`` set the
    recall); none below it is found.
    """
    usable = unit_vectors(embeddings, id_column, vector_column).distinct()
    member = materialize(usable.withColumn("class", F.xxhash64("vector")))
    classes = materialize(
        member.groupBy("class", "vector").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    )
    # The smallest id names a class; an id with two vectors takes part with both.
    member = member.join(
        classes.select("class", "vector", F.col("id").alias("head"), "n"), ["class", "vector"]
    ).select("id", "head", "n")
    scratch = Scratch(embeddings.sparkSession)
    pairs = near_pairs(classes.select("id", "vector"), scratch, threshold, tables, probes, scale)
    pairs = materialize(pairs)
    scratch.drop()
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = (
        both.join(classes.select(F.col("id").alias("b"), "n"), "b")
        .groupBy(F.col("a").alias("head"))
        .agg(F.sum("n").alias("others"))
    )
    found = connected_components(pairs)
    per_id = (
        member.join(linked, "head", "left")
        .join(found.withColumnRenamed("node", "head"), "head", "left")
        .groupBy(F.col("id").alias(id_column))
        .agg(
            F.max(F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.min(F.coalesce("component_id", "head")).alias("component_id"),
        )
    )
    own = F.col(id_column)
    return (
        embeddings.select(id_column)
        .join(per_id, id_column, "left")
        .select(
            own.alias("vec_id"),
            F.when(own.isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", own).alias("component_id"),
            F.coalesce(F.coalesce("component_id", own) == own, F.lit(False)).alias("kept"),
        )
    )
