"""Packing of token sequences by best fit and bin completion."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import batches_of, binaries
from millrace.llm.tokens import word_encoder
from millrace.llm.common import materialize

#: A filling and how many sequences are filled so: (lengths in order, count).
Filling = tuple[tuple[int, ...], int]


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Cut each document's ids, with ``end_id`` after them, into pieces of ``capacity`` at most.

    Returns ``doc_id, piece, start, length, ids_crc32``. A null or empty text has the end id
    alone; a repeated row gives its pieces again; a null id stays null.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        for batch in batches_of(batches, "text", 1 << 21):
            rows: list[list] = [[], [], [], [], []]
            texts = binaries(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for row, value in zip(
                        rows, (doc_id, k, start, len(part), zlib.crc32(part.tobytes()))
                    ):
                        row.append(value)
            types = (batch.schema.field("doc_id").type, pa.int32(), *[pa.int64()] * 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, kind) for row, kind in zip(rows, types)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing on a histogram of lengths: equal sequences are filled together.

    Each length, from the largest on, goes to the sequences with the least room that takes it.
    Sequences with the same content are one entry with a count, so the work depends on the
    number of different lengths and not on that of documents.
    """
    rooms: dict[int, list[list]] = {}  # free room -> [[lengths], count]
    levels: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(levels, room)
        rooms[room].append([lengths, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(levels, length)
            if k == len(levels):
                each = min(left, capacity // length)
                new = left // each
                put(capacity - each * length, (length,) * each, new)
                left -= new * each
                continue
            room = levels[k]
            lengths, n = rooms[room].pop()
            each = min(room // length, left)
            used = min(n, left // each)
            if n > used:
                rooms[room].append([lengths, n - used])
            if not rooms[room]:
                del rooms[room], levels[k]
            put(room - each * length, lengths + (length,) * each, used)
            left -= used * each
    return [(tuple(lengths), n) for row in rooms.values() for lengths, n in row]


def completions(
    first: int, counts: dict[int, int], capacity: int, limit: int
) -> list[tuple[int, ...]]:
    """Undominated fillings around the length ``first``, those with the least waste first.

    A filling is maximal: no length that is left fits into its room. Of two fillings with as
    many lengths, one that is nowhere shorter dominates, and a single length that fills the room
    exactly dominates all others of that room. ``limit`` bounds the nodes of the search.
    """
    lengths = sorted((x for x in counts if x <= capacity - first), reverse=True)
    found: list[tuple[int, tuple[int, ...]]] = []
    nodes = 0

    def extend(k: int, room: int, taken: tuple[int, ...]) -> None:
        nonlocal nodes
        nodes += 1
        fits = False
        for j in range(k, len(lengths)):
            length = lengths[j]
            if nodes > limit:
                return
            if length <= room and counts[length] - (length == first) > taken.count(length):
                fits = True
                extend(j, room - length, taken + (length,))
                if length == room:
                    return
        smallest = next(
            (x for x in reversed(lengths) if counts[x] - (x == first) > taken.count(x)), None
        )
        if not fits and (smallest is None or smallest > room):
            found.append((room, taken))

    extend(0, capacity - first, ())
    kept: list[tuple[int, tuple[int, ...]]] = []
    for waste, taken in sorted(set(found)):
        if not any(
            len(other) == len(taken) and all(a >= b for a, b in zip(other, taken))
            for _, other in kept
        ):
            kept.append((waste, taken))
    return [taken for _, taken in kept] or [()]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The least number of sequences any packing needs (the larger of two known bounds).

    Besides the sum of lengths: for a threshold t, lengths over ``capacity - t`` are alone, and
    those over half the capacity are in different sequences, whose room the middle ones share.
    """
    number = np.zeros(capacity + 1, np.int64)
    number[list(counts)] = list(counts.values())
    upto = np.cumsum(number)  # documents up to a length, and their ids
    ids = np.cumsum(number * np.arange(capacity + 1))
    half = capacity // 2
    t = np.append(0, np.flatnonzero(number[: half + 1]))
    large = upto[capacity - t] - upto[half]
    room = large * capacity - (ids[capacity - t] - ids[half])
    below = np.maximum(t - 1, 0)
    over = ids[half] - ids[below] - room
    apart = int(upto[-1] - upto[half])
    shared = -(-int(max(0, over.max())) // capacity)
    return max(-(-int(ids[-1]) // capacity), apart + shared)


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 2_000) -> list[Filling]:
    """Fill as few sequences as a bounded search finds.

    The best-fit packing is the first incumbent; the search ends at once where it meets the
    lower bound. Otherwise the largest length left is completed by its undominated fillings, the
    fullest first, each used for as many sequences as its lengths last, and the rest is
    packed by best fit as a new incumbent. A branch ends when its waste so far leaves no way
    below the incumbent. ``nodes`` bounds the branches, and so the quality, never the input.
    """
    counts = {length: n for length, n in counts.items() if n}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    fewest, bound, visited = sum(n for _, n in best), lower_bound(counts, capacity), 0

    def branches(done: list[Filling], left: dict[int, int], used: int):
        first = max(left)
        for taken in completions(first, left, capacity, limit=500):
            need = Counter((first, *taken))
            times = min(left[length] // n for length, n in need.items())
            after = {x: n - times * need.get(x, 0) for x, n in left.items()}
            after = {x: n for x, n in after.items() if n}
            yield done + [((first, *taken), times)], after, used + times

    # Of a branch the next filling is made when it is asked for, so few histograms are held.
    stack = [iter([([], counts, 0)])]
    while stack and fewest > bound and visited < nodes:
        branch = next(stack[-1], None)
        if branch is None:
            stack.pop()
            continue
        done, left, used = branch
        visited += 1
        rest = best_fit(left, capacity)
        total = used + sum(n for _, n in rest)
        if total < fewest:
            best, fewest = done + rest, total
        if left and used + lower_bound(left, capacity) < fewest:
            stack.append(branches(done, left, used))
    return best


def slots(fillings: list[Filling]) -> dict[int, np.ndarray]:
    """Where the documents of each length go: rows of first rank, first sequence, offset."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter[int] = Counter()
    sequence = 0
    for lengths, n in fillings:
        offset = 0
        for length in lengths:
            out.setdefault(length, []).append((taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give each row of ``parts`` (a table that is read again) a sequence and an offset in it.

    The lengths, from 1 to ``capacity``, are counted; this histogram of at most ``capacity``
    rows is all the driver sees, and fillings are found for it. Then the rows of each length
    are numbered, by counts per partition and length and a running number within, and their
    number tells their place. The places are at most a few per filling and length, whose
    number the histogram bounds, not the documents.
    """
    columns = parts.columns
    numbered = parts.withColumn("_part", F.spark_partition_id())
    numbered = materialize(numbered)
    per_part = numbered.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    per_part = materialize(per_part)
    histogram = {
        row["length"]: row["n"]
        for row in per_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()
    }
    places = slots(bin_completion(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    first = per_part.select(
        "length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    )
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = numbered.withColumn("_rank", F.row_number().over(within) - 1).join(
        first.hint("merge"), ["length", "_part"]  # it grows with the parts, so it isn't broadcast
    )
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_first", "_part")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("_rank"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for value in np.unique(length):
                rows = np.flatnonzero(length == value)
                table = places[int(value)]
                k = np.searchsorted(table[:, 0], rank[rows], "right") - 1
                sequence[rows] = table[k, 1] + rank[rows] - table[k, 0]
                offset[rows] = table[k, 2]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in columns),
                    pa.array(sequence),
                    pa.array(offset),
                ],
                names=[*columns, "sequence_id", "offset"],
            )

    schema = numbered.drop("_part").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*columns, "_rank").mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` ids as the search finds.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. An empty table gives none; otherwise as ``pieces`` and ``pack`` say.
    """
    parts = pieces(docs, tokenizer, capacity, end_id, id_column, text_column)
    return pack(parts, capacity)
