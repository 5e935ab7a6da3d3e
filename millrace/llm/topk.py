"""Exact top-k search by inner product with MaxScore."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize


def usable(embedding: Column | str) -> Column:
    """Neither null nor holding a null or a component that is not finite."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    finite = F.forall(
        e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    return e.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors):
        row[: len(vector)] = vector
    return out


def block_rows(vectors: DataFrame, size: int) -> DataFrame:
    """Rows ``id, terms array<long>`` as blocks of at most ``size`` rows of one partition."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []

        def block() -> pa.RecordBatch:
            width = max(map(len, rows))
            matrix = _matrix(rows, width)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                    pa.array([matrix.tobytes()], pa.binary()),
                    pa.array([width], pa.int32()),
                ],
                names=["ids", "terms", "width"],
            )

        for batch in batches:
            for row in zip(batch.column("id").to_pylist(), batch.column("terms").to_pylist()):
                ids.append(row[0])
                rows.append(row[1])
                if len(ids) == size:
                    yield block()
                    ids, rows = [], []
        if ids:
            yield block()

    return vectors.select("id", "terms").mapInArrow(pack, "ids binary, terms binary, width int")


class Shard:
    """A block of vectors with the bounds of each term's postings."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray):
        self.ids, self.terms = ids, terms
        self.doubles = terms.astype(np.float64)
        self.high, self.low = terms.max(0), terms.min(0)
        self.size = np.maximum(np.abs(self.high.astype(float)), np.abs(self.low.astype(float)))

    def exact(self, query: np.ndarray) -> np.ndarray:
        """The terms in the fastest form in which no sum with this query can be rounded.

        Sums of whole numbers below 2**53 are exact in double precision; larger ones are made
        of whole numbers, and beyond 64 bits there is no score.
        """
        most = float((np.abs(query.astype(float)) * self.size[: len(query)]).sum())
        if most < 2**53:
            return self.doubles
        if most < 2**63 * (1 - 1e-9):
            return self.terms
        raise OverflowError("A score has more than 64 bits")

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None):
        """The ids and scores that may be among the best k, given that k others reach ``floor``.

        Terms go by how much their postings can change a score. The non-essential ones are
        the longest tail that cannot lift a vector to the k-th best score, if it has the least
        of each essential term; without such a score yet, those with half of the whole change.
        The postings of essential terms are traversed for all vectors; of the others, postings
        are probed only for vectors whose bound still reaches the k-th best score.
        """
        width = min(len(query), self.terms.shape[1])
        q = query[:width]
        terms = self.exact(q)
        high = np.maximum(q * self.high[:width], q * self.low[:width])
        low = np.minimum(q * self.high[:width], q * self.low[:width])
        order = np.argsort(-(high - low), kind="stable")
        above = np.concatenate([np.cumsum(high[order][::-1])[::-1], [0]])
        below = np.concatenate([np.cumsum(low[order][::-1])[::-1], [0]])
        slack = above - below
        if floor is None:
            essential = int(np.searchsorted(-slack, -slack[0] / 2))
        else:
            essential = int(np.searchsorted(-slack, below[0] - floor, "right"))
        essential = min(max(1, essential), width)
        first = order[:essential]
        rows = np.flatnonzero(self.ids != own)
        scores = terms[:, first] @ q[first].astype(terms.dtype)
        scores = scores[rows]
        done = essential
        while True:
            certain = scores + below[done]
            limit = floor
            if len(rows) > k:
                kth = np.partition(certain, len(rows) - k)[len(rows) - k]
                limit = kth if limit is None else max(limit, kth)
            if limit is not None:
                keep = scores + above[done] >= limit
                rows, scores = rows[keep], scores[keep]
            if done >= width or not len(rows):
                break
            some = order[done : done + 8]
            scores = scores + terms[np.ix_(rows, some)] @ q[some].astype(terms.dtype)
            done += len(some)
        return self.ids[rows], scores.astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    shard_rows: int = 2_048,
    query_rows: int = 16_384,
    shards_per_task: int = 8,
) -> DataFrame:
    """The k vectors with the highest integer inner product with each query, itself apart.

    Both tables have columns ``id`` (long) and ``terms`` (array of long). Returns ``query_id,
    rank, vec_id, score``; ties go to the smaller id. Vectors of different length count as
    filled with zeros. Scores are exact; one that could have more than 64 bits is an error.

    Vectors come in shards, some of which are a task's, and queries in blocks. A query meets
    every shard once: a task holds its shards and one block of queries, keeps the best k of each
    query from shard to shard, and only these are merged. So a vector travels once per
    ``query_rows`` queries, and a query once per ``shards_per_task`` shards.
    A row with null terms or id takes no part; a repeated row is a candidate once, so ids are
    taken to name one vector each. Without other vectors a query has no row.
    """
    known = "id is not null and terms is not null"
    shards = block_rows(vectors.filter(known).dropDuplicates(["id"]), shard_rows)
    asked = block_rows(queries.filter(known).dropDuplicates(["id"]), min(query_rows, 2_048))
    number = F.monotonically_increasing_id()
    shards, asked = (materialize(df.withColumn("n", F.xxhash64(number))) for df in (shards, asked))
    parts = max(1, -(-shards.count() // shards_per_task))
    blocks = max(1, -(-queries.count() // query_rows))

    def each(name: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    shards = shards.select(
        "ids", "terms", "width", F.pmod("n", F.lit(parts)).cast("int").alias("part"), each("block", blocks)
    )
    asked = asked.select(
        "ids", "terms", "width", F.pmod("n", F.lit(blocks)).cast("int").alias("block"), each("part", parts)
    )

    def rows(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for ids, terms, width in zip(*(table[c].to_pylist() for c in ("ids", "terms", "width"))):
            ids = np.frombuffer(ids, np.int64)
            yield ids, np.frombuffer(terms, np.int64).reshape(len(ids), width)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        held = [Shard(ids, terms) for ids, terms in rows(left)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q_ids, q_terms in rows(right):
            for own, query in zip(q_ids.tolist(), q_terms):
                ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
                for shard in held:
                    floor = int(scores[-1]) if len(scores) == k else None
                    more = shard.search(query, own, k, floor)
                    ids, scores = best(*map(np.concatenate, zip((ids, scores), more)), k)
                found.append((np.full(len(ids), own, np.int64), ids, scores))
        columns = [np.concatenate(c) for c in zip(*found)] or [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))))

    tile = ["part", "block"]
    found = shards.groupBy(*tile).cogroup(asked.groupBy(*tile)).applyInArrow(
        search, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
