"""Phrases whose words stand together more often than chance, counted by quotient filters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, batches_of, binaries, materialize, rows_of, text_bytes
from millrace.llm.quotient_filter import CountingQuotientFilter, permute, restore, shards
from millrace.llm.routing import bucket_count

#: Words of one language that a task gathers before they are counted.
CHUNK_WORDS = 1 << 19
#: Text whose words, and later phrases, are counted in one group, in bytes.
BUCKET_BYTES = 16 << 20
#: What parts pieces becomes a word of its own, as no other word can hold a full stop.
_BREAK = b"."
_BREAKS = bytes.maketrans(b".,;:!?\n\v\f\r", b"\n" * 10)


class _Numbering(dict):
    """Gives each new word the next number; the break has number 0."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def piece_words(text: bytes | None) -> list[bytes]:
    """The words of a text in order, with a break after each piece."""
    cut = (text or b"").lower().translate(_BREAKS)
    return cut.replace(b"\n", b" . ").split()


def _numbers(column, kind) -> np.ndarray:
    return np.frombuffer(column or b"", kind)


def word_chunks(docs: DataFrame) -> DataFrame:
    """``chunk, lang, words, tokens`` of ``lang, text``: texts as numbers of their chunk's words.

    A chunk has the words of some whole texts of one language; number 0 is a break. A task holds
    twice ``CHUNK_WORDS`` words of all languages, or its longest text.
    """

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Numbering, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}
        chunk = TaskContext.get().partitionId() << 32

        def send(lang: str) -> pa.RecordBatch:
            nonlocal chunk
            numbering, parts = held.pop(lang)
            del sizes[lang]
            chunk += 1
            tokens = zstandard.compress(np.concatenate(parts).tobytes(), 1)
            values = (chunk, lang, b" ".join(list(numbering)[1:]), tokens)
            types = (pa.int64(), pa.string(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types)],
                names=["chunk", "lang", "words", "tokens"],
            )

        end = np.zeros(1, np.uint32)
        for batch in batches_of(batches, "text", 1 << 22):
            texts = binaries(batch.column("text"))
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                words = piece_words(text)
                if not words:
                    continue
                if lang not in held:
                    held[lang], sizes[lang] = (_Numbering(), []), 0
                numbering, parts = held[lang]
                parts += [np.fromiter(map(numbering.__getitem__, words), np.uint32, len(words)), end]
                sizes[lang] += len(words) + 1
                if sizes[lang] >= CHUNK_WORDS:
                    yield send(lang)
                elif sum(sizes.values()) >= 2 * CHUNK_WORDS:
                    yield send(max(sizes, key=sizes.get))
        for lang in list(held):
            yield send(lang)

    return docs.select("lang", "text").mapInArrow(
        gather, "chunk long, lang string, words binary, tokens binary"
    )


#: What a group of counters gives: ``entry`` rows hold frequent ones, ``reply`` rows tell a chunk
#: which of its own are, ``total`` rows how many words a language has.
_WORDS = (
    "kind string, bucket long, chunk long, lang string, words binary, locals binary, "
    "indexes binary, counts binary, n long, used long"
)


def counted_words(chunks: DataFrame, least: int, buckets: int) -> DataFrame:
    """The words that a language has at least ``least`` times, and the chunks' own among them.

    A chunk sends each of its words once, with its number of places.
    """

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            words = row["words"].split(b" ") if row["words"] else []
            if not words:
                continue
            tokens = _numbers(zstandard.decompress(row["tokens"]), np.uint32)
            counts = np.bincount(tokens, minlength=len(words) + 1)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            parts = np.split(order, first[1:])
            columns = (
                used,
                [row["chunk"]] * len(used),
                [row["lang"]] * len(used),
                [b" ".join([words[k] for k in p.tolist()]) for p in parts],
                [(p + 1).astype(np.uint32).tobytes() for p in parts],
                [counts[p + 1].astype(np.uint32).tobytes() for p in parts],
            )
            types = (pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["bucket", "chunk", "lang", "words", "locals", "counts"],
            )

    def merge(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        rows = list(zip(*(table[c].to_pylist() for c in ("chunk", "lang", "words", "locals", "counts"))))
        totals: dict[str, dict[bytes, int]] = {}
        for _, lang, words, _, counts in rows:
            total = totals.setdefault(lang, {})
            for word, n in zip(words.split(b" "), _numbers(counts, np.uint32).tolist()):
                total[word] = total.get(word, 0) + n
        out, index = [], {}
        for lang, total in sorted(totals.items()):
            out.append(("total", None, None, lang, None, None, None, None, sum(total.values()), None))
            known = sorted(word for word, n in total.items() if n >= least)
            base = sum(map(len, index.values()))
            index[lang] = {word: base + k for k, word in enumerate(known)}
            if known:
                out.append((
                    "entry", bucket, None, lang, b" ".join(known), None,
                    np.arange(base, base + len(known), dtype=np.uint32).tobytes(),
                    np.array([total[w] for w in known], np.uint64).tobytes(), None,
                    base + len(known),
                ))
        for chunk, lang, words, locals_, _ in rows:
            own = index[lang]
            found = np.fromiter((own.get(w, -1) for w in words.split(b" ")), np.int64)
            kept = found >= 0
            if kept.any():
                out.append((
                    "reply", bucket, chunk, None, None,
                    _numbers(locals_, np.uint32)[kept].tobytes(),
                    found[kept].astype(np.uint32).tobytes(), None, None, None,
                ))
        names = [part.split()[0] for part in _WORDS.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 4, *[pa.int64()] * 2]
        return pa.table(
            {name: pa.array(c, t) for name, t, c in zip(names, types, zip(*out))}
        )

    routed = chunks.mapInArrow(
        route, "bucket long, chunk long, lang string, words binary, locals binary, counts binary"
    )
    return routed.groupBy("bucket").applyInArrow(merge, _WORDS)


def _ids(bucket: np.ndarray, index: np.ndarray, bits: int) -> np.ndarray:
    """The number of an entry: its bucket and its place there, from 1 on."""
    return (bucket.astype(np.uint64) << np.uint64(bits)) + index.astype(np.uint64) + np.uint64(1)


def _squeezed(words: np.ndarray, grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Only places in a frequent phrase of ``size`` words, with one 0 where others were cut out.

    A run of places that is too short for a longer phrase is cut out as well.
    """
    starts = np.flatnonzero(grams)
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + size, -1)
    kept = np.cumsum(inside[:-1]) > 0
    # Places of a run: between its bounds.
    edges = np.flatnonzero(np.diff(np.concatenate(([0], kept.astype(np.int8), [0]))))
    begin, end = edges[::2], edges[1::2]
    long_enough = end - begin > size
    begin, end = begin[long_enough], end[long_enough]
    kept = np.zeros(len(words) + 1, np.int64)
    kept[begin] += 1
    np.add.at(kept, end, -1)
    inside = np.cumsum(kept[:-1]) > 0
    gaps = end[end < len(words)]
    inside[gaps] = True  # the place after a run becomes its break
    words, grams = words.copy(), grams.copy()
    words[gaps] = 0
    grams[gaps] = 0
    return words[inside], grams[inside]


def _state(chunk: int, words: np.ndarray, grams: np.ndarray | None) -> pa.RecordBatch:
    """A row of a chunk; without ``grams`` the words stand for them."""
    values = [
        zstandard.compress(x.tobytes(), 1) if x is not None else b"" for x in (words, grams)
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk]), *(pa.array([v], pa.binary()) for v in values)],
        names=["chunk", "words", "grams"],
    )


def _read_state(row: dict) -> tuple[np.ndarray, np.ndarray]:
    words = _numbers(zstandard.decompress(row["words"]), np.uint64)
    grams = row["grams"]
    return words, _numbers(zstandard.decompress(grams), np.uint64) if grams else words


_STATE = "chunk long, words binary, grams binary"


def _with_replies(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows per chunk with what the counters answered it; a chunk without an answer is done."""
    replies = found.filter("kind = 'reply'").groupBy("chunk").agg(
        F.collect_list(F.struct("bucket", "locals", "indexes")).alias("replies")
    )
    # Never broadcast: what a chunk is answered grows with it.
    return rows.join(replies.hint("merge"), "chunk")


def frequent_word_ids(chunks: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """Chunks as the numbers of frequent words, 0 for breaks and all others."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            tokens = _numbers(zstandard.decompress(row["tokens"]), np.uint32)
            ids = np.zeros(int(tokens.max()) + 1, np.uint64)
            for reply in row["replies"]:
                index = _numbers(reply["indexes"], np.uint32)
                bucket = np.full(len(index), reply["bucket"], np.uint64)
                ids[_numbers(reply["locals"], np.uint32)] = _ids(bucket, index, bits)
            words = ids[tokens]
            words, _ = _squeezed(words, words, 1)
            yield _state(row["chunk"], words, None)

    return _with_replies(chunks.select("chunk", "tokens"), found).mapInArrow(encode, _STATE)


def _phrase_keys(
    words: np.ndarray, grams: np.ndarray, size: int, word_bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of ``size`` words begin whose two shorter parts are frequent, and their keys.

    A key packs the number of the phrase without its last word, and that word.
    """
    at = np.flatnonzero((grams[:-1] > 0) & (grams[1:] > 0)) if len(grams) else np.empty(0, np.int64)
    at = at[at + size <= len(words)]
    return at, (grams[at] << np.uint64(word_bits)) | words[at + size - 1]


_PHRASES = (
    "kind string, bucket long, chunk long, locals binary, indexes binary, filter binary, used long"
)


def counted_phrases(
    state: DataFrame, size: int, word_bits: int, least: int, shard_bits: int
) -> DataFrame:
    """The phrases of ``size`` words with at least ``least`` places, by quotient filters.

    A chunk sends a filter to each shard in which it has phrases; a shard merges them.
    """

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            words, grams = _read_state(row)
            parts = shards(_phrase_keys(words, grams, size, word_bits)[1], shard_bits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard for shard, _ in parts], pa.int64()),
                    pa.array([row["chunk"]] * len(parts), pa.int64()),
                    pa.array([f.pack() for _, f in parts], pa.binary()),
                ],
                names=["bucket", "chunk", "filter"],
            )

    def merge(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        own = [CountingQuotientFilter.unpack(f) for f in table["filter"].to_pylist()]
        total = CountingQuotientFilter.merged(own)
        kept = total.counts >= least
        total = CountingQuotientFilter(total.low, total.bits, total.values[kept], total.counts[kept])
        out = []
        if len(total.values):
            out.append(("entry", bucket, None, None, None, total.pack(), len(total.values)))
        for chunk, found in zip(table["chunk"].to_pylist(), own):
            if not len(total.values):
                break
            at = np.minimum(np.searchsorted(total.values, found.values), len(total.values) - 1)
            known = total.values[at] == found.values
            if known.any():
                out.append((
                    "reply", bucket, chunk, found.values[known].tobytes(),
                    at[known].astype(np.uint32).tobytes(), None, None,
                ))
        names = [part.split()[0] for part in _PHRASES.split(", ")]
        types = (pa.string(), *[pa.int64()] * 2, *[pa.binary()] * 3, pa.int64())
        columns = zip(*out) if out else [()] * len(names)
        return pa.table({name: pa.array(c, t) for name, t, c in zip(names, types, columns)})

    routed = state.mapInArrow(route, "bucket long, chunk long, filter binary")
    return routed.groupBy("bucket").applyInArrow(merge, _PHRASES)


def longer_state(
    state: DataFrame, found: DataFrame, size: int, word_bits: int, bits: int
) -> DataFrame:
    """Chunks with the numbers of their frequent phrases of ``size`` words."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            words, grams = _read_state(row)
            at, keys = _phrase_keys(words, grams, size, word_bits)
            values, ids = [], []
            for reply in row["replies"]:
                index = _numbers(reply["indexes"], np.uint32)
                bucket = np.full(len(index), reply["bucket"], np.uint64)
                values.append(_numbers(reply["locals"], np.uint64))
                ids.append(_ids(bucket, index, bits))
            values, ids = np.concatenate(values), np.concatenate(ids)
            order = np.argsort(values)
            values, ids = values[order], ids[order]
            asked = permute(keys)
            place = np.minimum(np.searchsorted(values, asked), len(values) - 1)
            known = values[place] == asked
            grams = np.zeros(len(words), np.uint64)
            grams[at[known]] = ids[place[known]]
            yield _state(row["chunk"], *_squeezed(words, grams, size))

    return _with_replies(state, found).mapInArrow(encode, _STATE)


def _word_entries(found: DataFrame, bits: int) -> DataFrame:
    """``id, lang, phrase, f`` of the frequent words."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = _numbers(row["indexes"], np.uint32)
                ids = _ids(np.full(len(index), row["bucket"], np.uint64), index, bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids.view(np.int64)),
                        pa.array([row["lang"]] * len(ids), pa.string()),
                        pa.array([w.decode() for w in row["words"].split(b" ")], pa.string()),
                        pa.array(_numbers(row["counts"], np.uint64).view(np.int64)),
                    ],
                    names=["id", "lang", "phrase", "f"],
                )

    entries = found.filter("kind = 'entry'").select("bucket", "lang", "words", "indexes", "counts")
    return entries.mapInArrow(unpack, "id long, lang string, phrase string, f long")


def _phrase_entries(found: DataFrame, word_bits: int, bits: int) -> DataFrame:
    """``id, first, word, f``: a phrase, that without its last word, that word, and its places."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                entries = CountingQuotientFilter.unpack(row["filter"])
                keys = restore(entries.values)
                n = len(keys)
                ids = _ids(np.full(n, row["bucket"], np.uint64), np.arange(n), bits)
                columns = (
                    ids,
                    keys >> np.uint64(word_bits),
                    keys & np.uint64((1 << word_bits) - 1),
                    entries.counts,
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.view(np.int64)) for c in columns],
                    names=["id", "first", "word", "f"],
                )

    entries = found.filter("kind = 'entry'").select("bucket", "filter")
    return entries.mapInArrow(unpack, "id long, first long, word long, f long")


def _index_bits(found: DataFrame) -> tuple[int, int]:
    """Bits for a place in a bucket, and for a whole number; 0 where nothing is frequent."""
    row = found.filter("kind = 'entry'").agg(F.max("used"), F.max("bucket")).collect()[0]
    if row[0] is None:
        return 0, 0
    bits = (row[0] - 1).bit_length()
    return bits, (((row[1] << bits) + row[0])).bit_length()


def frequent_phrases(
    docs: DataFrame, least: int, longest: int, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all phrases with at least ``least`` places, and ``lang, n``.

    ``docs`` has ``lang, text``. Words are counted first, then phrases of two words, and so on; a
    phrase is counted only where its two parts that are a word shorter are frequent, as it can't
    be more frequent than they are. Each round asks the counters for the chunks' own phrases, so
    no chunk ever sees more than its own words need.
    """
    size_of_texts = text_bytes(docs)
    buckets = bucket_count(size_of_texts, BUCKET_BYTES)
    shard_bits = (buckets - 1).bit_length()
    chunks = scratch.keep(word_chunks(docs))
    found = scratch.keep(counted_words(chunks, least, buckets))
    totals = found.filter("kind = 'total'").groupBy("lang").agg(F.sum("n").alias("n"))
    word_index, word_bits = _index_bits(found)
    words = scratch.keep(_word_entries(found, word_index))
    phrases = [words]
    state = scratch.keep(frequent_word_ids(chunks, found, word_index))
    for size in range(2, longest + 1):
        found = scratch.keep(counted_phrases(state, size, word_bits, least, shard_bits))
        index, bits = _index_bits(found)
        if not bits:
            break
        if size < longest:
            if bits + word_bits > 64:
                raise ValueError("More frequent phrases and words than 64 bits tell apart")
            state = scratch.keep(longer_state(state, found, size, word_bits, index))
        entries = _phrase_entries(found, word_bits, index)
        shorter = phrases[-1].select(F.col("id").alias("first"), "lang", F.col("phrase").alias("head"))
        last = words.select(F.col("id").alias("word"), F.col("phrase").alias("tail"))
        named = entries.join(shorter, "first").join(last, "word")
        phrases.append(
            scratch.keep(named.select("id", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "f"))
        )
    rows = [p.select("lang", "phrase", F.lit(k).alias("size"), "f") for k, p in enumerate(phrases, 1)]
    return reduce(DataFrame.unionByName, rows), totals


def _part(first, n):
    return F.array_join(F.slice("words", first, n), " ")


def collocations(
    docs: DataFrame,
    least: int = 100,
    longest: int = 5,
    top: int = 2_000,
    percent: int = 100,
    lang_column: str = "lang",
    text_column: str = "text",
) -> DataFrame:
    """Each language's best phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z are lower-cased; texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words
    at blanks and tabs. A phrase of 2 to ``longest`` words with a >= ``least`` places is a
    candidate. Cut after k words, into parts with l and r places, it scores floor(1000 * a * n /
    (l * r)), n being all words of the language; its lowest score counts, at the smallest such k.
    Candidates inside a longer one with f places are dropped if 100 * f >= ``percent`` * a.
    The ``top`` first by score, a (both descending) and phrase (ascending by bytes) are ranked.

    All texts are counted, exactly: repeated rows count again, a null language is ``und``, a null
    or empty text has no words. Other columns have no part in it; an empty table gives no row.
    """
    source = docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
        F.col(text_column).alias("text"),
    )
    scratch = Scratch(docs.sparkSession)
    phrases, totals = frequent_phrases(source, least, longest, scratch)
    candidates = phrases.filter("size > 1").withColumn("words", F.split("phrase", " "))
    counts = phrases.select("lang", "phrase", "f")
    cuts = candidates.select(
        "lang",
        "phrase",
        F.col("f").alias("a"),
        "words",
        "size",
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"),
    ).select(
        "lang", "phrase", "a", "k",
        _part(F.lit(1), F.col("k")).alias("first"),
        _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    cuts = cuts.join(
        counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]
    ).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    scored = cuts.join(totals, "lang").withColumns({f"wide_{c}": v for c, v in wide.items()})
    score = F.expr("(wide_a * wide_n * 1000) div (wide_l * wide_r)")
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    )
    inner = candidates.filter("size > 2").select(
        "lang",
        "words",
        "size",
        "f",
        F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"),
    )
    inner = inner.select(
        "lang",
        "words",
        "f",
        "length",
        F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("start"),
    )
    around = inner.groupBy("lang", _part(F.col("start"), F.col("length")).alias("phrase")).agg(
        F.max("f").alias("around")
    )
    rest = lowest.join(around, ["lang", "phrase"], "left").filter(
        F.col("around").isNull() | (100 * F.col("around") < percent * F.col("a"))
    )
    # Ranked in parts first, so that no language comes whole to one task.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rest = rest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rest = rest.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(int(parts))))
    in_part = Window.partitionBy("lang", "part").orderBy(*order)
    first = rest.withColumn("rank", F.row_number().over(in_part)).filter(F.col("rank") <= top)
    overall = Window.partitionBy("lang").orderBy(*order)
    ranked = first.withColumn("rank", F.row_number().over(overall)).filter(F.col("rank") <= top)
    ranked = materialize(
        ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
    )
    scratch.drop()
    return ranked
