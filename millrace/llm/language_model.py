"""Scores of texts by the difference of two n-gram models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import (
    Scratch,
    batches_of,
    binaries,
    materialize,
    mix,
    rows_of,
    text_bytes,
)
from millrace.llm.quotient_filter import CountingQuotientFilter
from millrace.llm.routing import bucket_count

START, OTHER = 0, 1  # ids of the text's start and of words outside the vocabulary
LAST = 0  # what follows the last word of a text
#: Text whose pairs of words beyond the table fill one bucket, in bytes.
BUCKET_BYTES = 6 << 20
#: Words that a task gathers before they are counted.
CHUNK_WORDS = 500_000
#: Different words that a task counts before it sends them on.
COUNTED_WORDS = 200_000
#: Columns of a chunk of texts.
PACKED = ("known", "numbers", "hashes", "lengths", "rows", "targets")


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shared_vocabulary(docs: DataFrame, size: int) -> tuple[list[bytes], int]:
    """The ``size`` words that all documents use most, ties to the smaller word, and how many
    different words there are.

    Every word of every text is counted: first within a task, then by Spark.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())],
                names=["word", "n"],
            )

        for batch in batches_of(batches, "text", 1 << 20):
            for text in binaries(batch.column("text")):
                total.update(_words(text))
            if len(total) > COUNTED_WORDS:
                yield rows()
                total.clear()
        yield rows()

    counts = docs.select("text").mapInArrow(count, "word binary, n long")
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(counts.groupBy("word").agg(F.sum("n").alias("n")))
    most = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    different = counts.count()
    scratch.drop()
    return [bytes(r["word"]) for r in most], different


def _ids(texts: list[list[bytes]], ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words of texts, one after the other, and each text's number of words."""
    lengths = np.array([len(text) for text in texts], np.int64)
    other = OTHER
    words = (ids.get(w, other) for text in texts for w in text)
    return np.fromiter(words, np.int64, lengths.sum()), lengths


def _pairs(words: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """The word pairs of texts, ``before * size + word``."""
    starts = np.cumsum(lengths) - lengths
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts[lengths > 0]] = START
    return before * size + words


def _width(vocabulary: list[bytes]):
    return np.uint16 if len(vocabulary) + 2 <= 1 << 16 else np.uint32


def _joined(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of packed arrays, one after the other, and each one's number of values."""
    rows = column.to_pylist()
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(rows), kind), np.array([len(x) // size for x in rows], np.int64)


def pair_counts(chunks: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """How often each pair of words occurs in the target texts and in all texts.

    Two tables of ``size ** 2`` counts, as the vocabulary has a fixed size: a task adds up its
    own, Spark adds up those of the tasks.
    """
    size, width = len(vocabulary) + 2, _width(vocabulary)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size * size), np.int32)
        for row in rows_of(batches):
            chunk = Chunk.of(row, width)
            pairs = _pairs(chunk.known, chunk.lengths, size)
            np.add.at(total[1], pairs, 1)
            np.add.at(total[0], pairs[np.repeat(chunk.targets, chunk.lengths) > 0], 1)
        used = np.flatnonzero(total[1])
        for k in range(0, len(used), 100_000):
            some = used[k : k + 100_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some.astype(np.int32)),
                    pa.array(total[0, some].astype(np.int64)),
                    pa.array(total[1, some].astype(np.int64)),
                ],
                names=["pair", "target", "background"],
            )

    counts = chunks.mapInArrow(
        count, "pair int, target long, background long"
    )
    counts = counts.groupBy("pair").agg(
        F.sum("target").alias("target"), F.sum("background").alias("background")
    )
    # One row per pair of the vocabulary at most, whatever the number of documents.
    found = counts.toArrow()
    out = np.zeros((2, size * size), np.int64)
    pair = np.asarray(found["pair"])
    out[0, pair], out[1, pair] = np.asarray(found["target"]), np.asarray(found["background"])
    return out


def shares(counts: np.ndarray, size: int, rare: int) -> np.ndarray:
    """The unigram model: each word's share, with a virtual word for each word there is.

    ``rare`` words have counts of their own that are not in the table; OTHER then stands for
    their sum in ``counts``, and for a word that is nowhere in the shares.
    """
    words = counts.reshape(size, size).sum(0) + 1.0
    words[START] = 0.0
    return words / (words.sum() + rare)


def losses(counts: np.ndarray, size: int, weight: float = 10.0, rare: int = 0) -> np.ndarray:
    """The loss of each word after each other one, from a table of pair counts.

    A bigram model that leans on the unigram model with ``weight`` virtual words, which in turn
    leans on equal shares with one virtual word each. With ``rare`` words beside the table, a
    pair with one of them has only the part of its loss that the table's word decides; the other
    part is that of ``rare_losses``.
    """
    pairs = counts.reshape(size, size).astype(np.float64)
    p = pairs + weight * shares(counts, size, rare)
    if rare:
        p[:, OTHER] = 1.0
    p /= pairs.sum(1, keepdims=True) + weight
    if rare:
        p[OTHER] = 1.0
    p[:, START] = 1.0  # never asked for
    return -np.log(p).astype(np.float32).ravel()


class Keys(NamedTuple):
    """Different keys of a chunk in order, sums for each, and the places of words that have it."""

    keys: np.ndarray
    sums: list[np.ndarray]
    number: np.ndarray  # of the key of each place
    places: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, weighed: list[tuple], places: np.ndarray) -> Keys:
        """``weighed`` has for each sum the numbers of keys that count, and their weights."""
        keys, number = np.unique(keys, return_inverse=True)
        sums = [
            np.bincount(number[some], weights, len(keys)).astype(np.int64) for some, weights in weighed
        ]
        return cls(keys, sums, number, places)

    def shards(self, bits: int) -> dict[int, tuple[bytes, bytes]]:
        """For each shard by the first bits of keys: a quotient filter of them with the first sum,
        and the other sums."""
        shard = self.keys >> np.uint64(64 - bits)
        used, first = np.unique(shard, return_index=True)
        ends = np.append(first[1:], len(shard))
        out = {}
        for k, a, b in zip(used.tolist(), first.tolist(), ends.tolist()):
            found = CountingQuotientFilter(
                k << (64 - bits), 64 - bits, self.keys[a:b], self.sums[0][a:b].astype(np.uint64)
            )
            out[k] = found.pack(), _squeezed([x[a:b] for x in self.sums[1:]])
        return out


def _squeezed(sums: list[np.ndarray]) -> bytes:
    return zstandard.compress(np.concatenate(sums).astype(np.int64).tobytes(), 1)


def _sums(data: bytes, n: int) -> list[np.ndarray]:
    return np.split(np.frombuffer(zstandard.decompress(data), np.int64), n)


def _added(filters: list[bytes], others: list[bytes], n: int) -> list[bytes]:
    """The sums of the keys of filters over all of them, for each filter in the order of its own.

    ``others`` has the ``n`` - 1 sums beside that in the filter.
    """
    found = [CountingQuotientFilter.unpack(f) for f in filters]
    keys, number = np.unique(np.concatenate([f.values for f in found]), return_inverse=True)
    ends = np.cumsum([len(f.values) for f in found])[:-1]
    each = [[f.counts.astype(np.int64), *_sums(o, n - 1)] for f, o in zip(found, others)]
    total = []
    for sums in zip(*each):
        whole = np.bincount(number, np.concatenate(sums), len(keys)).astype(np.int64)
        total.append(np.split(whole[number], ends))
    return [_squeezed(list(sums)) for sums in zip(*total)]


class Chunk(NamedTuple):
    """Some whole texts: their words, those beyond the table by their hashes."""

    known: np.ndarray  # the id of each word, OTHER beyond the table
    names: np.ndarray  # the id of each word, or its hash beyond the table
    lengths: np.ndarray  # words of each text
    rows: np.ndarray
    targets: np.ndarray

    @classmethod
    def of(cls, row: dict, width) -> Chunk:
        known = np.frombuffer(zstandard.decompress(row["known"]), width).astype(np.int64)
        names = known.astype(np.uint64)
        numbers = np.frombuffer(zstandard.decompress(row["numbers"]), np.uint32)
        names[known == OTHER] = np.frombuffer(row["hashes"], np.uint64)[numbers]
        lengths, rows = (np.frombuffer(row[c], np.int64) for c in ("lengths", "rows"))
        return cls(known, names, lengths, rows, np.frombuffer(row["targets"], np.uint8))

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """The id and the name of the word before each one."""
        starts = np.cumsum(self.lengths) - self.lengths
        known, names = np.roll(self.known, 1), np.roll(self.names, 1)
        known[starts], names[starts] = START, START
        return known, names

    def counted(self) -> tuple[Keys, Keys]:
        """What is counted beyond the table: pairs with a word beyond it, and these words.

        A word counts twice over, as a word and as one before another.
        """
        known, names = self.before()
        word, first = self.known == OTHER, known == OTHER
        target = np.repeat(self.targets, self.lengths).astype(np.float64)
        pair = np.flatnonzero(word | first)
        key = mix(mix(names[pair] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + self.names[pair])
        pairs = Keys.of(key, [(np.arange(len(pair)), None), (np.arange(len(pair)), target[pair])], pair)
        own, first = np.flatnonzero(word), np.flatnonzero(first)
        key = mix(np.concatenate([self.names[own], names[first]]))
        a, b = np.arange(len(own)), np.arange(len(own), len(key))
        sums = [(a, None), (a, target[own]), (b, None), (b, target[first])]
        return pairs, Keys.of(key, sums, np.concatenate([own, first]))

    def text(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def word_chunks(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Chunks of ``row, text, target``; a task holds ``CHUNK_WORDS`` words or its longest text."""
    ids = {word: k + 2 for k, word in enumerate(vocabulary)}
    width = _width(vocabulary)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        known, rows, targets, lengths = [], [], [], []
        number: dict[bytes, int] = {}
        numbers: list[np.ndarray] = []
        size = 0

        def send() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
            values = (
                chunk,
                zstandard.compress(np.concatenate(known).astype(width).tobytes(), 1),
                zstandard.compress(np.concatenate(numbers).astype(np.uint32).tobytes(), 1),
                hashes.tobytes(),
                np.array(lengths, np.int64).tobytes(),
                np.array(rows, np.int64).tobytes(),
                np.array(targets, np.uint8).tobytes(),
            )
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, (pa.int64(), *[pa.binary()] * 6))],
                names=["chunk", *PACKED],
            )

        for batch in batches_of(batches, "text", 1 << 20):
            texts = [_words(text) for text in binaries(batch.column("text"))]
            found, counts = _ids(texts, ids)
            rare = [w for text in texts for w in text if w not in ids]
            known.append(found)
            numbers.append(np.array([number.setdefault(w, len(number)) for w in rare], np.int64))
            lengths += counts.tolist()
            rows += batch.column("row").to_pylist()
            targets += batch.column("target").to_pylist()
            size += len(found)
            if size >= CHUNK_WORDS:
                yield send()
                chunk += 1
                known, rows, targets, lengths, number, numbers, size = [], [], [], [], {}, [], 0
        if size:
            yield send()

    return docs.filter("text is not null").mapInArrow(
        gather, ", ".join(["chunk long", *(f"{name} binary" for name in PACKED)])
    )


def rare_losses(
    chunks: DataFrame,
    size_of_texts: int,
    vocabulary: list[bytes],
    counts: np.ndarray,
    weight: float,
    rare: int,
    scratch: Scratch,
) -> DataFrame:
    """What the words outside the vocabulary add: ``row, n_rare, target_rare, background_rare``.

    A chunk counts its pairs with such a word, these words, and those that go before another;
    it sends each different one once, with its counts, to the bucket of its 64-bit hash, packed as
    a quotient filter. A bucket
    adds up what chunks have sent and answers each of them with the sums of its own, in the order
    they came, so a frequent word is a few numbers of each chunk and no bucket's size depends on
    it. With the sums the chunk scores its texts.
    """
    size, width = len(vocabulary) + 2, _width(vocabulary)
    bits = (bucket_count(size_of_texts, BUCKET_BYTES) - 1).bit_length()
    shares_of = [shares(table, size, rare) for table in counts]
    totals = [float(table.sum()) + size - 1 + rare for table in counts]
    none = CountingQuotientFilter.of(np.empty(0, np.uint64)).pack()

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            pairs, words = (keys.shards(bits) for keys in Chunk.of(row, width).counted())
            used = sorted({*pairs, *words})
            columns = [
                *zip(*(pairs.get(k, (none, _squeezed([np.empty(0)]))) for k in used)),
                *zip(*(words.get(k, (none, _squeezed([np.empty(0)] * 3))) for k in used)),
            ] or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int64()),
                    pa.array([row["chunk"]] * len(used), pa.int64()),
                    *(pa.array(c, pa.binary()) for c in columns),
                ],
                names=["bucket", "chunk", "pairs", "pair_sums", "words", "word_sums"],
            )

    def add(table: pa.Table) -> pa.Table:
        columns = {name: table[name].to_pylist() for name in table.column_names[2:]}
        return pa.table(
            {
                "bucket": table["bucket"],
                "chunk": table["chunk"],
                "pairs": pa.array(_added(columns["pairs"], columns["pair_sums"], 2), pa.binary()),
                "words": pa.array(_added(columns["words"], columns["word_sums"], 4), pa.binary()),
            }
        )

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk.of(row, width)
            pairs, words = chunk.counted()
            # Buckets are ranges of keys, so their answers follow each other as the keys do.
            answers = sorted(row["answers"], key=lambda answer: answer["bucket"])
            of_pair, of_word = (
                [np.concatenate(x)[keys.number] for x in zip(*(_sums(a[c], n) for a in answers))]
                for c, n, keys in (("pairs", 2, pairs), ("words", 4, words))
            )
            rare_word = chunk.known == OTHER
            n_own = int(rare_word.sum())
            own, first = words.places[:n_own], words.places[n_own:]
            text, n = chunk.text(), len(chunk.lengths)
            sums = []
            for k in (1, 0):  # of the target's texts, of all texts
                # A word beyond the table has its own share, others that of the table.
                share = shares_of[1 - k][chunk.known]
                share[own] = (of_word[k][:n_own] + 1.0) / totals[1 - k]
                loss = np.zeros(len(chunk.known))
                loss[pairs.places] = -np.log(of_pair[k] + weight * share[pairs.places])
                loss[first] += np.log(of_word[2 + k][n_own:] + weight)
                sums.append(np.bincount(text, loss, n))
            n_rare = np.bincount(text, rare_word, n).astype(np.int64)
            some = n_rare > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[some]) for x in (chunk.rows, n_rare, *sums)],
                names=["row", "n_rare", "target_rare", "background_rare"],
            )

    sent = chunks.mapInArrow(
        send,
        "bucket long, chunk long, pairs binary, pair_sums binary, words binary, word_sums binary",
    )
    answers = sent.groupBy("bucket").applyInArrow(
        add, "bucket long, chunk long, pairs binary, words binary"
    )
    answers = scratch.keep(answers).groupBy("chunk").agg(
        F.collect_list(F.struct("bucket", "pairs", "words")).alias("answers")
    )
    # Never broadcast: what a chunk is answered grows with it.
    found = chunks.join(answers.hint("merge"), "chunk").mapInArrow(
        score, "row long, n_rare long, target_rare double, background_rare double"
    )
    return found.groupBy("row").agg(
        *(F.sum(c).alias(c) for c in ("n_rare", "target_rare", "background_rare"))
    )


def cross_entropy_difference(
    docs: DataFrame,
    target: DataFrame,
    vocabulary: int | None = None,
    weight: float = 10.0,
    id_column: str = "doc_id",
    text_column: str = "text",
    table_words: int = 2_046,
) -> DataFrame:
    """Score every whole text: ``doc_id, n_words, target_loss, background_loss, difference``.

    ``target`` lists the ids of the texts that the target model learns from; the background
    model learns from all texts. Both are bigram models over one vocabulary, all words of all
    documents, so their losses per word can be subtracted: the lower the difference the more a
    text is like the target. With ``vocabulary`` only so many words, those used most, are told
    apart, and all others are one.

    Pairs of the ``table_words`` words used most are counted in a table of fixed size, which is
    broadcast (two of (table_words + 2) squared losses of 4 bytes, 34 MB). All other pairs are
    counted in buckets, whose number follows the input; they are named by 64-bit hashes.

    A text without words, or null, has null losses. Repeated rows and null ids give a row each;
    a repeated target id counts once, a null one not at all. Without target texts the target
    model has equal shares. An empty table gives no row.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    words, different = shared_vocabulary(source, table_words if vocabulary is None else vocabulary)
    rare = different - len(words) if vocabulary is None else 0
    size = len(words) + 2
    source = source.withColumn("row", F.xxhash64("doc_id", "text"))
    ids = target.select(F.col(id_column).alias("doc_id")).filter("doc_id is not null").distinct()
    ids = ids.withColumn("target", F.lit(True))

    def marked(rows: DataFrame) -> DataFrame:
        # Never broadcast: the target's ids grow with the corpus, so the plan is one at any size.
        joined = rows.join(ids.hint("merge"), "doc_id", "left")
        return joined.withColumn("target", F.coalesce("target", F.lit(False)))

    scratch = Scratch(spark)
    chunks = scratch.keep(word_chunks(marked(source), words))
    counts = pair_counts(chunks, words)
    models = spark.sparkContext.broadcast(
        np.stack([losses(table, size, weight, rare) for table in counts])
    )

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {word: k + 2 for k, word in enumerate(words)}
        for batch in batches_of(batches, "text", 1 << 20):
            texts = [_words(text) for text in binaries(batch.column("text"))]
            ids, lengths = _ids(texts, known)
            pairs, starts, full = _pairs(ids, lengths, size), np.cumsum(lengths) - lengths, lengths > 0
            columns = []
            for each in (ids == OTHER, *(table[pairs] for table in models.value)):
                sums = np.zeros(len(lengths))
                if full.any():
                    sums[full] = np.add.reduceat(each.astype(np.float64), starts[full])
                columns.append(sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(lengths)]
                + [pa.array(c) for c in columns],
                names=["doc_id", "row", "n_words", "others", "target_sum", "background_sum"],
            )

    rated = source.mapInArrow(
        rate,
        f"doc_id {kind}, row long, n_words long, others double, target_sum double, "
        "background_sum double",
    )
    sums = {name: F.col(f"{name}_sum") for name in ("target", "background")}
    if rare:
        rest = rare_losses(chunks, text_bytes(source), words, counts, weight, rare, scratch)
        rated = rated.join(materialize(rest), "row", "left")
        # Repeated rows are added up; each has as much of the sum as of the words.
        part = F.col("others") / F.col("n_rare")
        sums = {n: c + F.coalesce(F.col(f"{n}_rare") * part, F.lit(0.0)) for n, c in sums.items()}
    scratch.drop()
    full = F.col("n_words") > 0
    return rated.select(
        "doc_id",
        "n_words",
        *(F.when(full, c / F.col("n_words")).alias(f"{n}_loss") for n, c in sums.items()),
    ).withColumn("difference", F.col("target_loss") - F.col("background_loss"))
