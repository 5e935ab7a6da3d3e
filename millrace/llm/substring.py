"""Removal of repeated word sequences by compressed full-text indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import (
    Scratch,
    batches_of,
    binaries,
    hash_words,
    shingle_hashes,
    text_bytes,
)
from millrace.llm.fm_index import FMIndex
from millrace.llm.routing import bucket_count, repeated_keys, routed
from millrace.llm.common import materialize

#: Words of the part of a window that decides where the window goes.
ANCHOR = 6
#: The most windows of a segment, so that a text of one word makes many short segments.
LONGEST = 48
#: Text that fills one index, in bytes, if it is all repeated.
SHARD_BYTES = 8 << 20
#: Distinct segments of one anchor, in bytes, beyond which its windows are dealt one by one.
HOT_BYTES = 1 << 20
#: Runs a task gathers before it sends them on.
BUFFER = 500_000


def window_runs(hashes: np.ndarray, window: int):
    """Cut the windows of a document into runs that share their smallest anchor.

    Returns the runs' keys, first windows, numbers of windows, and a byte that is 2 where the
    anchor stands more than once, so that the run may hold equal windows, else 1. The anchors of
    a window depend on its words alone, so equal windows have equal keys wherever they stand.
    """
    size = min(ANCHOR, window)
    anchors = shingle_hashes(hashes, size)
    width = window - size + 1  # anchors in a window
    n = len(anchors) - width + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, np.empty(0, np.uint8)
    lowest, span = anchors, 1
    while span < width:
        step = min(span, width - span)
        lowest = np.minimum(lowest[: len(lowest) - step], lowest[step:])
        span += step
    new = np.flatnonzero(np.concatenate([[True], lowest[1:] != lowest[:-1]]))
    numbers = np.diff(np.append(new, n))
    # Windows that share their anchor number more than it can reach: it stands twice.
    keys = lowest[new]
    twice = numbers > width
    tied = np.zeros(n, np.int8)
    for k in range(width):
        tied += anchors[k : k + n] == lowest
    twice |= np.maximum.reduceat(tied, new) > 1
    cuts = -(-numbers // LONGEST)
    if (cuts > 1).any():
        part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        new = np.repeat(new, cuts) + part * LONGEST
        ends = np.repeat(new[np.cumsum(cuts) - cuts] + numbers, cuts)
        numbers = np.minimum(LONGEST, ends - new)
        keys, twice = np.repeat(keys, cuts), np.repeat(twice, cuts)
    return keys, new, numbers, np.where(twice, 2, 1).astype(np.uint8)


def _routed_runs(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def send():
            keys, first, number, weight, owner = map(np.concatenate, zip(*held))
            columns = {"owners": owner, "firsts": first, "numbers": number, "weights": weight}
            return routed(keys, columns, buckets)

        for batch in batches_of(batches, "text", 1 << 22):
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, binaries(batch.column("text"))):
                keys, first, number, weight = window_runs(hash_words(text.split()), window)
                if len(keys):
                    owner = np.full(len(keys), doc_id, np.int64)
                    held.append((keys, first.astype(np.int32), number.astype(np.uint8), weight, owner))
                    size += len(keys)
            if size >= BUFFER:
                yield from send()
                held, size = [], 0
        if held:
            yield from send()

    return docs.mapInArrow(
        run,
        "bucket int, keys binary, owners binary, firsts binary, numbers binary, weights binary",
    )


def _repeated_runs(chunks: DataFrame, repeated: DataFrame) -> DataFrame:
    """The runs whose key repeats: ``doc_id, bucket, key, first, number``.

    Each row of chunks meets the one row of its bucket; a bucket with more chunks than others
    can be split, as only the other side has a row per bucket.
    """

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], np.uint32)
                known = np.frombuffer(row["repeated"], np.uint32)
                at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                kept = np.flatnonzero(known[at] == keys) if len(known) else at[:0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(row["owners"], np.int64)[kept]),
                        pa.array(np.full(len(kept), row["bucket"], np.int32)),
                        pa.array(keys[kept].astype(np.int32)),
                        pa.array(np.frombuffer(row["firsts"], np.int32)[kept]),
                        pa.array(np.frombuffer(row["numbers"], np.uint8)[kept].astype(np.int32)),
                    ],
                    names=["doc_id", "bucket", "key", "first", "number"],
                )

    met = chunks.select("bucket", "keys", "owners", "firsts", "numbers").join(
        repeated.select("bucket", "repeated"), "bucket"
    )
    return met.mapInArrow(select, "doc_id long, bucket int, key int, first int, number int")


def _segments(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """The words of repeated runs: ``bucket, key, doc_id, first, number, segment_id, segment``.

    A task gives a segment's words once, with the first of its places that it has met; the other
    places name the segment by a 128-bit hash.
    """
    places = runs.groupBy("doc_id").agg(
        F.collect_list("bucket").alias("buckets"),
        F.collect_list("key").alias("keys"),
        F.collect_list("first").alias("firsts"),
        F.collect_list("number").alias("numbers"),
    )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, tuple[int, int]] = {}
        for batch in batches_of(batches, "text", 1 << 21):
            rows: list[tuple] = []
            for doc_id, text, buckets, keys, firsts, numbers in zip(
                batch.column("doc_id").to_pylist(),
                binaries(batch.column("text")),
                *(batch.column(c).to_pylist() for c in ("buckets", "keys", "firsts", "numbers")),
            ):
                words = text.split()
                for bucket, key, first, number in set(zip(buckets, keys, firsts, numbers)):
                    segment = b" ".join(words[first : first + number + window - 1])
                    name = xxhash.xxh3_128_digest(segment)
                    before = met.get(name)
                    if before is None or (doc_id, first) < before:
                        met[name] = (doc_id, first)
                        rows.append((bucket, key, doc_id, first, number, name, segment))
                    else:
                        rows.append((bucket, key, doc_id, first, number, name, None))
            if len(met) > BUFFER:
                met.clear()
            types = (*[pa.int32()] * 2, pa.int64(), *[pa.int32()] * 2, *[pa.binary()] * 2)
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["bucket", "key", "doc_id", "first", "number", "segment_id", "segment"],
            )

    return (
        docs.join(places, "doc_id")
        .select("doc_id", "text", "buckets", "keys", "firsts", "numbers")
        .mapInArrow(
            cut,
            "bucket int, key int, doc_id long, first int, number int, segment_id binary, "
            "segment binary",
        )
    )


def first_places(
    segments: list[bytes], places: list[tuple[int, int]], window: int
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each window of each segment the first place at which it stands in any of them.

    ``places`` has the document and first word of each segment. Builds the index of the
    segments, streams them through it, and takes of each interval that matches a whole window
    the earliest place.
    """
    rows = [segment.split() for segment in segments]
    alphabet = {word: k for k, word in enumerate(sorted({w for row in rows for w in row}), 1)}
    coded = [np.array([alphabet[w] for w in row], np.int64) for row in rows]
    index = FMIndex(coded, len(alphabet) + 1, window)
    lengths = index.lengths + 1
    offset = np.arange(len(index.text)) - np.repeat(index.begins, lengths)
    document = np.repeat(np.array([p[0] for p in places], np.int64), lengths)
    word = np.repeat(np.array([p[1] for p in places], np.int64), lengths) + offset
    by_place = np.lexsort((word, document))
    number = np.empty(len(by_place), np.int64)
    number[by_place] = np.arange(len(by_place))
    starts = np.flatnonzero(index.class_begin == np.arange(len(index.class_begin)))
    earliest = by_place[np.minimum.reduceat(number[index.order], starts)]
    of_class = np.searchsorted(starts, index.class_begin)
    documents = [np.zeros(max(0, len(c) - window + 1), np.int64) for c in coded]
    words = [np.zeros(max(0, len(c) - window + 1), np.int64) for c in coded]
    ends = np.cumsum([len(d) for d in documents])
    begins = ends - np.array([len(d) for d in documents], np.int64)
    flat = np.zeros((2, int(ends[-1]) if len(ends) else 0), np.int64)
    for which, place, matched, low, _ in index.matching_statistics(coded):
        whole = matched >= window
        at = earliest[of_class[low[whole]]]
        to = begins[which[whole]] + place[whole]
        flat[0, to], flat[1, to] = document[at], word[at]
    for k, (b, e) in enumerate(zip(begins, ends)):
        documents[k], words[k] = flat[0, b:e], flat[1, b:e]
    return documents, words


def _indexed(segments: DataFrame, window: int) -> DataFrame:
    """``segment_id, documents, words``: the first place of each window of a segment.

    One index per bucket; all segments with a window in common are in the same one.
    """

    def search(table: pa.Table) -> pa.Table:
        found: dict[bytes, tuple[int, int]] = {}
        for doc_id, first, segment in zip(
            *(table[c].to_pylist() for c in ("doc_id", "first", "segment"))
        ):
            place = (doc_id, first)
            if segment not in found or place < found[segment]:
                found[segment] = place
        names = [xxhash.xxh3_128_digest(s) for s in found]
        documents, words = first_places(list(found), list(found.values()), window)
        return pa.table(
            {
                "segment_id": pa.array(names, pa.binary()),
                "documents": pa.array([d.tobytes() for d in documents], pa.binary()),
                "words": pa.array([w.tobytes() for w in words], pa.binary()),
            }
        )

    distinct = segments.filter("segment is not null").select(
        "bucket", "doc_id", "first", "segment"
    )
    return distinct.groupBy("bucket").applyInArrow(
        search, "segment_id binary, documents binary, words binary"
    )


def hot_anchors(segments: DataFrame, size: int) -> DataFrame:
    """``bucket, key`` of the anchors whose distinct segments have more than ``size`` bytes."""
    distinct = segments.filter("segment is not null").groupBy("bucket", "key", "segment_id").agg(
        F.first(F.octet_length("segment")).alias("bytes")
    )
    sizes = distinct.groupBy("bucket", "key").agg(F.sum("bytes").alias("bytes"))
    return sizes.filter(F.col("bytes") > size).select("bucket", "key")


def _dealt(segments: DataFrame, window: int) -> DataFrame:
    """As ``_indexed``, for anchors that are too frequent for one index.

    Each window is dealt by a 128-bit hash of its own words, so that an anchor with a segment in
    every document is spread over all tasks; the first place of a window is found by a minimum
    that is taken before the shuffle too.
    """

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "segment", 1 << 20):
            rows = []
            for doc_id, first, name, segment in zip(*(c.to_pylist() for c in batch.columns)):
                words = segment.split()
                for k in range(len(words) - window + 1):
                    own = xxhash.xxh3_128_digest(b" ".join(words[k : k + window]))
                    rows.append((name, k, own, doc_id, first + k))
            types = (pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["segment_id", "k", "window_id", "doc_id", "word"],
            )

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        return pa.table(
            {
                "segment_id": table["segment_id"][:1],
                "documents": pa.array([np.asarray(table["document"]).tobytes()], pa.binary()),
                "words": pa.array([np.asarray(table["word"]).tobytes()], pa.binary()),
            }
        )

    each = segments.select("doc_id", "first", "segment_id", "segment").mapInArrow(
        windows, "segment_id binary, k int, window_id binary, doc_id long, word long"
    )
    earliest = each.groupBy("window_id").agg(F.min(F.struct("doc_id", "word")).alias("at"))
    of_segment = each.select("segment_id", "k", "window_id").distinct().join(earliest, "window_id")
    return (
        of_segment.select("segment_id", "k", F.col("at.doc_id").alias("document"), "at.word")
        .groupBy("segment_id")
        .applyInArrow(packed, "segment_id binary, documents binary, words binary")
    )


def repeated_spans(
    docs: DataFrame,
    window: int = 20,
    id_column="doc_id",
    text_column="text",
    hot_bytes: int = HOT_BYTES,
):
    """The words of each document that are in a window of words that starts earlier too.

    Returns ``doc_id, firsts, lengths`` (arrays of spans of words, which may overlap) of the
    documents that have some. Earlier is in a smaller id, or earlier in the same document.

    Every window is routed by its smallest anchor, a hash of a few consecutive words; runs of
    windows with one anchor stay together. Anchors that stand at one place only are counted out,
    copies of a run within a task count once, and what repeats is indexed bucket by bucket: each
    distinct run once, whatever its copies, which then look up what was found for it. An anchor
    with more than ``hot_bytes`` of distinct runs is not indexed in one place: its windows are
    dealt by all their words.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    source = source.filter("doc_id is not null and text is not null")
    buckets = bucket_count(text_bytes(source), SHARD_BYTES)
    scratch = Scratch(docs.sparkSession)
    chunks = scratch.keep(_routed_runs(source, window, buckets))
    repeated = scratch.keep(repeated_keys(chunks))
    runs = _repeated_runs(chunks, repeated)
    segments = scratch.keep(_segments(source, runs, window))
    hot = scratch.keep(hot_anchors(segments, hot_bytes))
    if hot.isEmpty():
        found = _indexed(segments, window)
    else:
        kept = segments.filter("segment is not null")
        found = _indexed(kept.join(hot, ["bucket", "key"], "left_anti"), window).unionByName(
            _dealt(kept.join(hot, ["bucket", "key"], "left_semi"), window)
        )
    met = segments.select("doc_id", "first", "number", "segment_id").join(found, "segment_id")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id = np.asarray(batch.column("doc_id"), np.int64)
            first = np.asarray(batch.column("first"), np.int64)
            found = batch.column("documents").to_pylist()
            windows = np.array([len(x) // 8 for x in found], np.int64)
            documents = np.frombuffer(b"".join(found), np.int64)
            words = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.int64)
            row = np.repeat(np.arange(len(windows)), windows)
            own = first[row] + np.arange(len(row)) - (np.cumsum(windows) - windows)[row]
            later = np.flatnonzero((documents != doc_id[row]) | (words != own))
            apart = (np.diff(later) > 1) | (np.diff(row[later]) > 0)
            begins = later[np.concatenate([[True], apart])] if len(later) else later
            ends = later[np.concatenate([apart, [True]])] if len(later) else later
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_id[row[begins]]),
                    pa.array(own[begins].astype(np.int32)),
                    pa.array((ends - begins + window).astype(np.int32)),
                ],
                names=["doc_id", "first", "length"],
            )

    spans = met.mapInArrow(compare, "doc_id long, first int, length int")
    spans = materialize(
        spans.groupBy("doc_id").agg(
            F.collect_list("first").alias("firsts"), F.collect_list("length").alias("lengths")
        )
    )
    scratch.drop()
    return spans


def substring_dedup(
    docs: DataFrame,
    window: int = 20,
    id_column: str = "doc_id",
    text_column: str = "text",
    hot_bytes: int = HOT_BYTES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Remove the words covered by a window that also starts earlier; one row per row.

    Words are runs of other than ASCII white space, unchanged. Returns ``doc_id, n_words,
    n_removed, kept_sha256, kept_text, changed``, and the columns named by ``keep`` as fields of
    ``row``. The kept words are joined by one space; a text that loses none is left as it is in
    ``kept_text``. Ids are whole numbers. Windows are judged on the input, so the first copy of a sequence stays whole. A null text
    has no words; a document of fewer words than the window keeps them all. A row without an id
    is compared with none. Repeated rows are one document and are cut alike; ids are taken to
    name one text, and where they don't, a place found in one counts for all texts of the id.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    spans = repeated_spans(source, window, hot_bytes=hot_bytes)
    row = ["row"] if keep else []
    if keep:
        others = F.struct(*(docs[name] for name in keep)).alias("row")
        source = docs.select(
            F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), others
        )

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text", 1 << 22):
            rows = []
            for text, firsts, lengths in zip(
                binaries(batch.column("text")),
                *(batch.column(c).to_pylist() for c in ("firsts", "lengths")),
            ):
                words = (text or b"").split()
                removed = 0
                if firsts:
                    change = np.zeros(len(words) + 1, np.int64)
                    first = np.minimum(np.array(firsts), len(words))
                    np.add.at(change, first, 1)
                    np.add.at(change, np.minimum(first + np.array(lengths), len(words)), -1)
                    kept = np.cumsum(change[:-1]) == 0
                    removed = len(words) - int(kept.sum())
                    left = b" ".join([words[k] for k in np.flatnonzero(kept)])
                else:
                    left = b" ".join(words)
                rows.append(
                    (
                        len(words),
                        removed,
                        hashlib.sha256(left).hexdigest(),
                        left if removed else text,
                        removed > 0,
                    )
                )
            columns = list(zip(*rows)) if rows else [()] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            arrays[3] = arrays[3].cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays, *(batch.column(name) for name in row)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "changed", *row],
            )

    joined = source.join(spans, "doc_id", "left")
    joined = joined.select("doc_id", "text", "firsts", "lengths", *row)
    schema = (
        StructType([source.schema["doc_id"]])
        .add("n_words", "long")
        .add("n_removed", "long")
        .add("kept_sha256", "string")
        .add("kept_text", "string")
        .add("changed", "boolean")
    )
    return joined.mapInArrow(remove, StructType(schema.fields + [source.schema[n] for n in row]))
