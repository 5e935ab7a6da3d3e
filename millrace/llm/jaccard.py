"""Similarity join of documents by the Jaccard measure of their word n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import (
    Scratch,
    batches_of,
    binaries,
    freed_shuffles,
    hash_words,
    mix,
    shingle_hashes,
    text_bytes,
)
from millrace.llm.components import connected_components
from millrace.llm.line_runs import may_be_hit
from millrace.llm.routing import bucket_count, repeated_keys, routed
from millrace.llm.common import materialize

#: A token in at most so many different sets is rare, and indexed alone.
RARE = 3
#: Text whose prefix tokens fill a bucket, in bytes.
BUCKET_BYTES = 4 << 20
#: Neighbouring blocks of sets make a tile: two to the power of this.
TILE_BITS = 3


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes.

    A-Z count as a-z. With fewer words than ``size`` all words are one shingle; without words
    there is none.
    """
    hashes = hash_words((text or b"").lower().split())
    if 0 < len(hashes) < size:
        return shingle_hashes(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(shingle_hashes(hashes, size))


class Bounds:
    """What sets of given sizes must share to be similar: all in whole numbers."""

    def __init__(self, percent: int, certain_percent: int):
        self.percent = percent
        self.certain_percent = certain_percent
        self.ratio = 100.0 / (percent - 0.5)  # of sizes; a little more than can be similar

    def overlap(self, n: int) -> int:
        """The least overlap of a set of n with any similar one."""
        return -(-self.percent * n // 100)

    def certain(self, n: int) -> int:
        """How many tokens two similar sets, the smaller of n, share in their prefixes."""
        return max(1, self.certain_percent * n // 100)

    def prefix(self, n: int) -> int:
        """The size of a prefix that is extended so that it shares ``certain(n)`` tokens."""
        return n - self.overlap(n) + self.certain(n)

    def band(self, n: int) -> int:
        """Sizes of similar sets are in one band or in neighbouring ones."""
        return int(math.log(n) / math.log(self.ratio))

    def certain_in_band(self, band: int) -> int:
        return self.certain(max(1, int(self.ratio**band)))

    def similar(self, shared: int, n: int, m: int) -> bool:
        return 100 * shared >= self.percent * (n + m - shared)


def token_keys(tokens: np.ndarray, counts: np.ndarray, n: int, bounds: Bounds) -> np.ndarray:
    """The index keys of a set of size ``n`` with these repeated prefix tokens.

    Two similar sets share ``certain`` tokens of their prefixes. If one of these is rare, both
    have its key. Otherwise they are all frequent. Cut into one class fewer than there are (by
    token), two of them are in one class: so for each class the pairs of frequent tokens are
    keys. Classes follow the band of the smaller set, which is a set's own or the one below.
    Where only one token is certain, frequent tokens are keys by themselves.
    """
    if len(tokens) < bounds.certain(max(1, bounds.overlap(n))):
        return np.empty(0, np.uint64)
    order = np.argsort(tokens)
    tokens, rare = tokens[order], counts[order] <= RARE
    keys = [mix(tokens[rare])]
    frequent = tokens[~rare]
    for band in {bounds.band(n), max(0, bounds.band(n) - 1)}:
        classes = bounds.certain_in_band(band) - 1
        if not classes:
            keys.append(mix(frequent))
            continue
        of_class = frequent % np.uint64(classes)
        by_class = np.argsort(of_class, kind="stable")
        of_class, members = of_class[by_class], mix(frequent[by_class] + np.uint64(2 * band + 3))
        for apart in range(1, len(members)):
            same = of_class[apart:] == of_class[:-apart]
            if not same.any():
                break
            first, second = members[:-apart][same], members[apart:][same]
            keys.append(mix(first * np.uint64(0x9E3779B97F4A7C15) + second))
    return np.unique(np.concatenate(keys))


def document_sets(docs: DataFrame, size: int, bounds: Bounds) -> DataFrame:
    """``doc_id, n, signature, prefix``: a set's size, its 128-bit name and its lowest tokens."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text", 1 << 22):
            sets = [shingle_set(t, size) for t in binaries(batch.column("text"))]
            rows = [
                (len(s), xxhash.xxh3_128_digest(s.tobytes()),
                 s[: bounds.prefix(len(s))].tobytes()) if len(s) else (0, None, None)
                for s in sets
            ]
            columns = list(zip(*rows)) if rows else [()] * 3
            types = (pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n", "signature", "prefix"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        read, f"doc_id {kind}, n long, signature binary, prefix binary"
    )


def _repeated_tokens(
    sets: DataFrame, buckets: int, counted: bool, scratch: Scratch
) -> DataFrame:
    """The tokens of prefixes that are in several of them.

    ``sets`` has ``doc_id, prefix``. Returns ``doc_id, tokens`` (how many), or if ``counted``
    ``doc_id, token``, where the bits from ``count_place(buckets)`` on tell in how many prefixes
    it is: the order of these numbers is that of all tokens from rare to frequent.
    """
    place = count_place(buckets)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            keys, owners = map(np.concatenate, zip(*held))
            weights = np.ones(len(keys), np.uint8)
            return routed(keys, {"owners": owners, "weights": weights}, buckets)

        for batch in batches:
            for doc_id, prefix in zip(
                batch.column("doc_id").to_pylist(), batch.column("prefix").to_pylist()
            ):
                tokens = mix(np.frombuffer(prefix, np.uint64))
                held.append((tokens, np.full(len(tokens), doc_id, np.int64)))
                size += len(tokens)
                if size >= 500_000:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    chunks = scratch.keep(
        sets.select("doc_id", "prefix").mapInArrow(
            route, "bucket int, keys binary, owners binary, weights binary"
        )
    )
    repeated = scratch.keep(repeated_keys(chunks))

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], np.uint32)
                known = np.frombuffer(row["repeated"], np.uint32)
                numbers = np.frombuffer(row["numbers"], np.int64)
                at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                kept = np.flatnonzero(known[at] == keys) if len(known) else at[:0]
                owners = np.frombuffer(row["owners"], np.int64)[kept]
                if not counted:
                    owner, number = np.unique(owners, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(owner), pa.array(number)], names=["doc_id", "tokens"]
                    )
                    continue
                token = (np.int64(row["bucket"]) << 32) | keys[kept].astype(np.int64)
                token |= np.minimum(numbers[at[kept]], (1 << (63 - place)) - 1) << place
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owners), pa.array(token)], names=["doc_id", "token"]
                )

    met = chunks.select("bucket", "keys", "owners").join(repeated, "bucket")
    return met.mapInArrow(
        select, "doc_id long, token long" if counted else "doc_id long, tokens long"
    )


def _survivors(sets: DataFrame, buckets: int, bounds: Bounds, scratch: Scratch) -> DataFrame:
    """``doc_id`` of the sets with enough repeated tokens in their prefix to have a partner."""
    found = _repeated_tokens(sets, buckets, False, scratch).groupBy("doc_id").agg(
        F.sum("tokens").alias("tokens")
    )
    least = F.greatest(
        F.lit(1),
        F.floor(F.ceil(F.col("n") * bounds.percent / 100) * bounds.certain_percent / 100),
    )
    return (
        found.join(sets.select("doc_id", "n"), "doc_id").filter(F.col("tokens") >= least)
        .select("doc_id").distinct()
    )


def count_place(buckets: int) -> int:
    """The bit from which on a number of a token has its count; below are its bucket and key."""
    return 32 + max(1, (buckets - 1).bit_length())


def prefix_keys(tokens: np.ndarray, n: int, place: int, bounds: Bounds) -> np.ndarray:
    """The index keys of a set of ``n`` tokens, of which these are in other sets too.

    Its prefix is that of all its tokens in order from rare to frequent. Those of no other set
    come first, and need no key. A set that is similar to another shares ``overlap(n)`` tokens
    with it; one with fewer that are in others has no key.
    """
    if len(tokens) < bounds.overlap(n):
        return np.empty(0, np.uint64)
    tokens = np.sort(tokens)[: bounds.prefix(n) - (n - len(tokens))]
    counts = tokens >> np.int64(place)
    return token_keys((tokens & np.int64((1 << place) - 1)).view(np.uint64), counts, n, bounds)


def _index(sets: DataFrame, buckets: int, bounds: Bounds, scratch: Scratch) -> DataFrame:
    """``key, doc_id``: the index keys of the sets that may be similar to another.

    ``sets`` has ``doc_id, n, tokens``: whole sets.
    """
    whole = sets.select("doc_id", F.col("tokens").alias("prefix"))
    place = count_place(buckets)

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_sets(owners: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
            """Each set's size stands first, negative."""
            first = np.flatnonzero(tokens < 0)
            found = [
                prefix_keys(own[1:], -int(own[0]), place, bounds)
                for own in np.split(tokens, first[1:])
            ]
            ids = np.repeat(owners[first], [len(keys) for keys in found])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64)), pa.array(ids)],
                names=["key", "doc_id"],
            )

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            owners, tokens = (np.asarray(c, np.int64) for c in batch.columns)
            first = np.flatnonzero(tokens < 0)
            if len(first) and (held or first[-1]):
                held.append((owners[: first[-1]], tokens[: first[-1]]))
                yield of_sets(*map(np.concatenate, zip(*held)))
                held, owners, tokens = [], owners[first[-1] :], tokens[first[-1] :]
            held.append((owners, tokens))
        if held and sum(len(owners) for owners, _ in held):
            yield of_sets(*map(np.concatenate, zip(*held)))

    sizes = sets.filter("n > 0").select("doc_id", (-F.col("n")).alias("token"))
    listed = _repeated_tokens(whole, buckets, True, scratch).union(sizes)
    listed = listed.repartition("doc_id").sortWithinPartitions("doc_id", "token")
    return listed.mapInArrow(index, "key long, doc_id long")


def _verified(pairs: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                similar.append(bounds.similar(shared, len(x), len(y)))
            yield batch.filter(pa.array(similar, pa.bool_())).select(["a", "b"])

    first = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"), F.col("n").alias("m"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"), "n")
    near = (F.col("n") * 100 >= F.col("m") * bounds.percent) & (
        F.col("m") * 100 >= F.col("n") * bounds.percent
    )
    sized = pairs.join(first.select("a", "m"), "a").join(second.select("b", "n"), "b").filter(near)
    met = sized.select("a", "b").join(second.select("b", "y"), "b").join(first.select("a", "x"), "a")
    return met.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def jaccard_components(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Link documents whose sets of ``size``-word shingles are similar; one row per row.

    Two documents link when 100 * intersection >= ``percent`` * union. Returns ``doc_id,
    n_shingles, component_id`` (the smallest id reachable by links, itself included). A null
    text or one without words has no shingles and links with nothing; with fewer than ``size``
    words all of them are one shingle. A row without an id links with nothing and has no
    component. Repeated rows are one document; ids are taken to name one text, and where they
    don't, an id links with what any of its texts links with.

    Documents with equal sets form a class, for which its smallest id stands. Prefixes of
    tokens in order of their hash are extended so that similar sets share several tokens of
    them; tokens of one set only are counted out, and with them most sets. Of the rest all
    tokens are counted: a set whose share of tokens in other sets is below ``percent`` is out
    too, and the rare tokens and pairs of frequent ones in the prefixes by frequency index
    what is left (``prefix_keys``). Of the sets under a key the first is
    compared with each other one. Where these links leave the others in several groups, the others
    of all keys that hang together so are compared in blocks, for links between groups only. So
    most of a group of near copies takes about as many comparisons as it has members, no row is
    made for a pair, and no link between two components is missed.
    """
    with freed_shuffles(docs.sparkSession):
        return _components(docs, size, percent, id_column, text_column)


def _components(
    docs: DataFrame, size: int, percent: int, id_column: str, text_column: str
) -> DataFrame:
    bounds, sharp = Bounds(percent, 5), Bounds(percent, 30)
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    scratch, early = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    prefixes = early.keep(document_sets(source, size, bounds))
    sets = materialize(prefixes.select("doc_id", "n", "signature"))
    known = sets.filter("doc_id is not null and n > 0")
    classes = materialize(known.groupBy("signature").agg(F.min("doc_id").alias("head")))
    heads = prefixes.join(
        classes.select("signature", F.col("head").alias("doc_id")), ["signature", "doc_id"]
    ).select("doc_id", "n", "prefix")
    buckets = bucket_count(text_bytes(source), BUCKET_BYTES)
    survivors = scratch.keep(_survivors(heads, buckets, bounds, early))
    early.drop()
    whole = early.keep(_whole_sets(source, survivors, size))
    index = scratch.keep(_index(whole, buckets, sharp, early))
    indexed = scratch.keep(index.select("doc_id").distinct())
    whole = whole.filter(may_be_hit(indexed, ["doc_id"])).join(indexed, "doc_id", "left_semi")
    whole = scratch.keep(whole)
    early.drop()

    lowest = index.groupBy("key").agg(F.min("doc_id").alias("a"))
    others = scratch.keep(
        index.join(lowest, "key").filter("doc_id != a").select("key", "a", F.col("doc_id").alias("b"))
    )
    tried = scratch.keep(others.select("a", "b").distinct())
    links = materialize(_verified(tried, whole, bounds))

    found = connected_components(links).select(
        F.col("node").alias("b"), F.col("component_id").alias("group")
    )
    grouped = scratch.keep(
        others.join(found, "b", "left").select("key", "b", F.coalesce("group", "b").alias("group"))
    )
    # The first set of a key has met all others: these may still have to meet each other.
    per_key = grouped.groupBy("key").agg(
        F.min("group").alias("low"), F.max("group").alias("high"), F.min("b").alias("a")
    )
    open_keys = per_key.filter("low != high").select("key", "a")
    apart = scratch.keep(grouped.join(open_keys, "key").select("a", "b", "group").distinct())
    pools = connected_components(apart.filter("a != b").select("a", "b"))
    pooled = apart.select(F.col("b").alias("doc_id"), "group").distinct()
    # The first of a pool's documents names it, and is the end of its links only.
    pool_of = pools.select(F.col("node").alias("doc_id"), F.col("component_id").alias("pool"))
    pooled = pooled.join(pool_of, "doc_id", "left").select(
        "doc_id", "group", F.coalesce("pool", "doc_id").alias("pool")
    )
    more = materialize(_between_groups(pooled.join(whole, "doc_id"), bounds, scratch))
    scratch.drop()
    component = connected_components(links.union(more)).withColumnRenamed("node", "head")
    of_row = (
        known.select("doc_id", "signature")
        .distinct()
        .join(classes, "signature")
        .join(component, "head", "left")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("component_id", "head")).alias("component_id"))
    )
    return (
        sets.select("doc_id", F.col("n").alias("n_shingles"))
        .join(of_row, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def _between_groups(
    pooled: DataFrame, bounds: Bounds, scratch: Scratch, rows: int = 128
) -> DataFrame:
    """Links ``a, b`` that join the groups of a pool, found by comparing its sets in blocks.

    ``pooled`` has ``pool, group, doc_id, n, tokens``. A pool is sorted by size over the cluster
    and cut into blocks; two blocks meet if sets of their sizes can be similar. A block pair
    counts what all its pairs share at once, and gives only links between groups that have not
    been joined already, so no row is made for a pair. Blocks meet by tiles of neighbours: one is
    sent to a task once for all blocks of another tile.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            pool, _, _, _ = held[0]
            tokens = [t for *_, t in held]
            values = (
                pool,
                len(tokens[0]) // 8,
                len(tokens[-1]) // 8,
                np.array([d for _, d, _, _ in held], np.int64).tobytes(),
                np.array([g for _, _, g, _ in held], np.int64).tobytes(),
                np.array([len(t) // 8 for t in tokens], np.int64).tobytes(),
                b"".join(tokens),
            )
            types = (*[pa.int64()] * 3, *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types)],
                names=["pool", "low", "high", "ids", "groups", "sizes", "tokens"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0] != held[0][0] or len(held) == rows or size > 1 << 21):
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield block()

    blocks = (
        pooled.repartitionByRange("pool", "n", "doc_id")
        .sortWithinPartitions("pool", "n", "doc_id")
        .select("pool", "doc_id", "group", "tokens")
        .mapInArrow(
            pack,
            "pool long, low long, high long, ids binary, groups binary, sizes binary, "
            "tokens binary",
        )
    )
    blocks = scratch.keep(blocks.withColumn("number", F.monotonically_increasing_id()))
    own = F.shiftright("number", TILE_BITS)
    tiles = blocks.groupBy("pool", own.alias("tile")).agg(
        F.min("low").alias("low"), F.max("high").alias("high")
    )
    tiles = scratch.keep(tiles)
    other = tiles.select("pool", *(F.col(c).alias(f"o_{c}") for c in tiles.columns[1:]))
    can = (F.col("high") * 100 >= F.col("o_low") * bounds.percent) & (
        F.col("o_high") * 100 >= F.col("low") * bounds.percent
    )
    pair = ["pool", "tile", "o_tile"]
    met = tiles.join(other, "pool").filter((F.col("tile") <= F.col("o_tile")) & can).select(pair)
    sides = met.withColumn("own", F.explode(F.array_distinct(F.array("tile", "o_tile"))))
    sent = sides.join(blocks.withColumn("own", own), ["pool", "own"])

    def compare(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda row: row["number"])
        sides = [
            tuple(np.frombuffer(row[k], np.int64) for k in ("ids", "groups", "sizes"))
            + (np.frombuffer(row["tokens"], np.uint64),)
            for row in rows
        ]
        found: list[tuple[int, int]] = []
        parent: dict[int, int] = {}
        for k, row in enumerate(rows):
            for o, other in enumerate(rows[k:], k):
                if (
                    (row["own"], other["own"]) == (row["tile"], row["o_tile"])
                    and row["high"] * 100 >= other["low"] * bounds.percent
                    and other["high"] * 100 >= row["low"] * bounds.percent
                ):
                    found += _links_of_blocks(sides[k], sides[o], bounds, parent)
        return pa.table({c: pa.array([p[k] for p in found], pa.int64()) for k, c in enumerate("ab")})

    return sent.groupBy(*pair).applyInArrow(compare, "a long, b long")


def _shared(x: tuple, y: tuple, width: int = 1 << 15) -> np.ndarray:
    """How many tokens each set of one block shares with each of another."""
    (_, _, n, s), (_, _, m, t) = x, y
    common = np.intersect1d(s, t)
    out = np.zeros((len(n), len(m)), np.float32)
    rows = []
    for sizes, tokens in ((n, s), (m, t)):
        at = np.minimum(np.searchsorted(common, tokens), max(0, len(common) - 1))
        kept = common[at] == tokens if len(common) else np.zeros(len(tokens), bool)
        rows.append((np.repeat(np.arange(len(sizes)), sizes)[kept], at[kept]))
    for begin in range(0, len(common), width):
        matrices = []
        for (owner, column), height in zip(rows, out.shape):
            here = (column >= begin) & (column < begin + width)
            matrix = np.zeros((height, min(width, len(common) - begin)), np.float32)
            matrix[owner[here], column[here] - begin] = 1.0
            matrices.append(matrix)
        out += matrices[0] @ matrices[1].T
    return np.rint(out).astype(np.int64)


def _links_of_blocks(
    x: tuple, y: tuple, bounds: Bounds, parent: dict[int, int]
) -> list[tuple[int, int]]:
    """Links between the groups of two blocks: enough to join those that are joined at all.

    ``parent`` has what was joined so far, and is added to.
    """
    shared = _shared(x, y)
    n, m = x[2][:, None], y[2][None, :]
    similar = 100 * shared >= bounds.percent * (n + m - shared)
    i, j = np.nonzero(similar & (x[1][:, None] != y[1][None, :]))

    def root(g: int) -> int:
        while parent.setdefault(g, g) != g:
            parent[g] = g = parent[parent[g]]
        return g

    out = []
    for p, q in zip(i.tolist(), j.tolist()):
        g, h = root(int(x[1][p])), root(int(y[1][q]))
        if g != h:
            parent[g] = h
            out.append((int(x[0][p]), int(y[0][q])))
    return out


def _whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, tokens`` of the wanted documents."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text", 1 << 22):
            sets = [shingle_set(t, size) for t in binaries(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "tokens"],
            )

    return (
        docs.filter(may_be_hit(wanted, ["doc_id"]))
        .join(wanted, "doc_id", "left_semi")
        .dropDuplicates(["doc_id"])
        .select("doc_id", "text")
        .mapInArrow(read, "doc_id long, n long, tokens binary")
    )
