"""The prefix trie of conversations, found by blocks of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch
from millrace.llm.common import materialize

#: Two 64-bit hashes name a turn, a block or a prefix.
LANES = ("x", "y")
#: Blocks of a conversation whose running digests are summed in one task.
STRETCH = 1024
#: Ids in one piece of a hashed list.
IDS = 2048


def _digest(*columns: Column) -> dict[str, Column]:
    """Both lanes of what the columns hold."""
    return {name: F.xxhash64(F.lit(k), *columns) for k, name in enumerate(LANES, 1)}


def _lanes(prefix: str) -> list[str]:
    return [f"{prefix}_{name}" for name in LANES]


def ordered_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, pos, x, y, bytes``: every turn's place in its conversation, its name and size.

    ``turns`` has ``conv_id, turn, role, text``. Turns are sorted over the cluster, so that a
    long conversation is cut into ranges; a place is that within the range and the lengths of
    the ranges before. Texts are not moved, only their digests.
    """
    named = turns.select(
        "conv_id",
        "turn",
        "role",
        F.octet_length("text").cast("long").alias("bytes"),
        *(c.alias(name) for name, c in _digest(F.col("role"), F.col("text")).items()),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "role", *LANES, "row"]
    ranged = named.repartitionByRange(*order).sortWithinPartitions(*order)
    at = ranged.select("conv_id", "bytes", *LANES, F.monotonically_increasing_id().alias("at"))
    at = scratch.keep(at.withColumn("range", F.shiftright("at", 33)))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranges = at.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    pos = F.col("at") - F.col("first") + F.col("before")
    return at.join(ranges, ["conv_id", "range"]).select(
        "conv_id", pos.alias("pos"), *LANES, "bytes"
    )


def blocks_of(turns: DataFrame, size: int) -> DataFrame:
    """``conv_id, block, turns, x, y, bytes``: blocks of ``size`` turns and their digests.

    ``turns`` in a block is an array of ``size`` structs at most, in order.
    """
    struct = F.struct("pos", *LANES, "bytes")
    gathered = turns.groupBy(
        "conv_id", F.floor(F.col("pos") / size).cast("long").alias("block")
    ).agg(F.sort_array(F.collect_list(struct)).alias("turns"), F.sum("bytes").alias("bytes"))
    return gathered.withColumns(_digest(F.col("block"), _names("turns")))


def _names(turns: str | Column) -> Column:
    """The names of the turns of an array, in their order."""
    return F.transform(turns, lambda t: F.struct(*(t[name] for name in LANES)))


def chained(blocks: DataFrame) -> DataFrame:
    """Blocks with ``start_x, start_y, before``: the digest and the bytes of all turns before.

    A prefix is named by the exclusive or of its blocks' digests, which hold their number. Running
    ones are made within stretches of a conversation, and over the sums of stretches.
    """
    stretch = F.floor(F.col("block") / STRETCH).cast("long")
    blocks = blocks.withColumn("stretch", stretch)
    window = Window.partitionBy("conv_id", "stretch").orderBy("block")
    window = window.rowsBetween(Window.unboundedPreceding, -1)
    inside = {
        **{f"start_{n}": F.coalesce(F.bit_xor(n).over(window), F.lit(0)) for n in LANES},
        "before": F.coalesce(F.sum("bytes").over(window), F.lit(0)),
    }
    sums = blocks.groupBy("conv_id", "stretch").agg(
        *(F.bit_xor(n).alias(n) for n in LANES), F.sum("bytes").alias("bytes")
    )
    window = Window.partitionBy("conv_id").orderBy("stretch")
    window = window.rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(
        "conv_id",
        "stretch",
        *(F.bit_xor(n).over(window).alias(f"earlier_{n}") for n in LANES),
        F.sum("bytes").over(window).alias("earlier"),
    ).filter("stretch > 0")  # nearly all conversations have one stretch
    joined = blocks.withColumns(inside).join(earlier, ["conv_id", "stretch"], "left")
    whole = {
        **{
            f"start_{n}": F.col(f"start_{n}").bitwiseXOR(F.coalesce(f"earlier_{n}", F.lit(0)))
            for n in LANES
        },
        "before": F.col("before") + F.coalesce("earlier", F.lit(0)),
    }
    return joined.withColumns(whole).drop("stretch", "earlier", *_lanes("earlier"))


def _steps(size: int) -> Column:
    """A struct per turn of a block: the nodes that its prefixes lead to.

    ``depth``, the node's name ``x, y``, its parent's ``up_x, up_y``, ``bytes`` of the last turn
    and ``before``, the bytes of the turns above.
    """

    def name(k: Column, lane: str) -> Column:
        number = LANES.index(lane) + 1
        own = F.xxhash64(F.lit(number), F.col("block"), _names(F.slice("turns", 1, k)))
        return F.when(k == 0, F.col(f"start_{lane}")).otherwise(
            F.col(f"start_{lane}").bitwiseXOR(own)
        )

    def step(turn: Column, at: Column) -> Column:
        above = F.aggregate(
            F.slice("turns", 1, at), F.lit(0).cast("long"), lambda sum_, t: sum_ + t["bytes"]
        )
        return F.struct(
            (F.col("block") * size + at + 1).alias("depth"),
            *(name(at + 1, lane).alias(lane) for lane in LANES),
            *(name(at, lane).alias(f"up_{lane}") for lane in LANES),
            turn["bytes"].alias("bytes"),
            (F.col("before") + above).alias("before"),
        )

    return F.transform("turns", step)


def _members(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """What the conversations under a key amount to."""
    return rows.groupBy(*keys).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("length").alias("longest"),
        F.sum("total").alias("total"),
        *more,
    )


def _list_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """``x, y, ends_sha256``: the digest of the conversations that end in each node.

    Ids are sorted over the cluster and joined to pieces there; the pieces of a list are hashed
    one after the other, so that no list is held as a whole.
    """
    kind = ends.schema["conv_id"].dataType.simpleString()

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            values = (*key, ids[0], ",".join(map(str, ids)))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types)], names=[*LANES, "first", "ids"]
            )

        for batch in batches:
            types = [pa.int64(), pa.int64(), batch.schema.field("conv_id").type, pa.string()]
            for x, y, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and ((x, y) != key or len(ids) == IDS):
                    yield piece()
                    ids = []
                key = (x, y)
                ids.append(conv)
        if ids:
            yield piece()

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        types = [pa.int64(), pa.int64(), pa.string()]

        def found(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=[*LANES, "ends_sha256"]
            )

        for batch in batches:
            rows = []
            for x, y, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (x, y) == key:
                    digest.update(b",")
                else:
                    if key:
                        rows.append((*key, digest.hexdigest()))
                    key, digest = (x, y), hashlib.sha256()
                digest.update(ids.encode())
            yield found(rows)
        if key:
            yield found([(*key, digest.hexdigest())])

    order = [*LANES, "conv_id"]
    sorted_ends = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = sorted_ends.mapInArrow(join, f"x long, y long, first {kind}, ids string")
    pieces = scratch.keep(pieces)
    lists = pieces.repartition(*LANES).sortWithinPartitions(*LANES, "first")
    return lists.mapInArrow(hashed, "x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = 4) -> DataFrame:
    """A row per node of the trie of the given conversations, ``conv_id, pos, x, y, bytes``.

    ``pos`` counts from 0 without gaps; a row whose ``pos`` is null stands for a conversation
    without turns. Returns ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversations are grouped by the digests of successive blocks of ``block`` turns. Where all
    that come to a block go on alike, its nodes have the same members and are made from one of
    them; turn by turn only those blocks are grouped in which they part. What a node says about
    its subtree is a sum over its members, so nothing is walked up: a leaf counts with its
    smallest member, and so do the bytes of a node; a member's own nodes are below all of which
    it isn't the smallest member.
    """
    scratch = Scratch(conversations.sparkSession)
    whole = scratch.keep(
        conversations.groupBy("conv_id").agg(
            F.count("pos").alias("length"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total")
        )
    )
    chain = chained(blocks_of(conversations.filter("pos is not null"), block))
    chain = scratch.keep(chain.join(whole, "conv_id"))
    start = ["block", *_lanes("start")]
    groups = _members(
        chain,
        start,
        *(f(n).alias(f"{g}_{n}") for n in LANES for g, f in (("low", F.min), ("high", F.max))),
    )
    groups = scratch.keep(
        groups.withColumn("parts", F.expr(" or ".join(f"low_{n} != high_{n}" for n in LANES)))
    )
    # All come to the first block from the root: its only group is a constant, not a join key.
    alike = groups.filter("not parts").drop("parts", *_lanes("low"), *_lanes("high"))
    parted = groups.filter("parts").select(*start)
    node = ["depth", *LANES, *_lanes("up"), "bytes", "before"]
    steps = F.inline(_steps(block))
    shared = chain.drop("length", "total").join(
        alike.withColumn("own", F.col("conv_id")), [*start, "conv_id"]
    )
    shared = shared.select("conv_id", "n_convs", "longest", "total", steps)
    turned = chain.join(parted, start, "left_semi").select("conv_id", "length", "total", steps)
    turned = scratch.keep(turned)
    root = _members(whole, []).filter("conv_id is not null").select(
        "conv_id",
        "n_convs",
        "longest",
        "total",
        F.lit(0).cast("long").alias("depth"),
        *(F.lit(0).cast("long").alias(n) for n in (*LANES, "bytes", "before")),
        *(F.lit(None).cast("long").alias(n) for n in _lanes("up")),
    )
    nodes = scratch.keep(
        shared.unionByName(_members(turned, node)).unionByName(root)
    )

    # Sums over members of what only some of them stand for.
    own = nodes.groupBy("conv_id").agg(
        F.sum("bytes").alias("owned"),
        F.sum((F.col("depth") == F.col("longest")).cast("long")).alias("leaf"),
    )
    own = scratch.keep(whole.select("conv_id").join(own, "conv_id", "left").na.fill(0))
    sums = [F.sum(c).alias(c) for c in ("owned", "leaf")]
    per_block = (
        chain.join(alike.filter("n_convs > 1").select(*start), start, "left_semi")
        .join(own, "conv_id")
        .groupBy(*start)
        .agg(*sums)
    )
    # A group's nodes are named by its start, so its sums go to each of them by the block.
    named = chain.select("conv_id", "turns", *start, "before").join(
        alike.filter("n_convs > 1").select(*start, "conv_id"), [*start, "conv_id"]
    )
    per_node = (
        named.join(per_block, start)
        .select("owned", "leaf", steps)
        .select(*LANES, "depth", "owned", "leaf")
    )
    several = nodes.filter("n_convs > 1")
    turned_sums = (
        turned.join(several.select(*LANES), list(LANES), "left_semi")
        .join(own, "conv_id")
        .groupBy(*LANES, "depth")
        .agg(*sums)
    )
    root_sums = own.agg(*sums).select(
        *(F.lit(0).cast("long").alias(n) for n in (*LANES, "depth")), "owned", "leaf"
    )
    summed = per_node.unionByName(turned_sums).unionByName(root_sums)

    ends = (
        chain.filter((F.col("block") + 1) * block >= F.col("length"))
        .select("conv_id", *(F.col(f"start_{n}").bitwiseXOR(F.col(n)).alias(n) for n in LANES))
        .unionByName(
            whole.filter("length = 0").select(
                "conv_id", *(F.lit(0).cast("long").alias(n) for n in LANES)
            )
        )
    )
    lists = scratch.keep(_list_digests(ends, scratch))
    children = nodes.filter("depth > 0").groupBy(*_lanes("up")).agg(F.count("*").alias("n_children"))
    children = children.withColumnsRenamed(dict(zip(_lanes("up"), LANES)))
    parents = nodes.select(
        F.col("conv_id").alias("parent_conv_id"),
        *(F.col(n).alias(up) for n, up in zip(LANES, _lanes("up"))),
    )
    # The smallest member's own nodes may begin above the node, so it counts by its bytes below.
    rep = own.select("conv_id", F.col("owned").alias("rep_owned"))
    rep = rep.join(whole.select("conv_id", F.col("total").alias("rep_total")), "conv_id")
    alone = F.col("n_convs") == 1
    all_below = F.col("total") - F.col("n_convs") * F.col("before")
    once_below = F.col("owned") - F.col("rep_owned") + F.col("rep_total") - F.col("before")
    found = (
        nodes.join(summed.drop("depth"), list(LANES), "left")
        .join(rep, "conv_id")
        .join(children, list(LANES), "left")
        .join(lists, list(LANES), "left")
        .join(parents, _lanes("up"), "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.when(alone, 1).otherwise(F.col("leaf")).cast("long").alias("n_leaves"),
            F.when(alone, 0).otherwise(all_below - once_below).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )
    found = materialize(found)
    scratch.drop()
    return found


def rebuilt(turns: DataFrame, conv_ids: DataFrame, every: int, most: int) -> DataFrame:
    """Conversations that begin with turns of another one, as ``prefix_trie`` takes them.

    ``conv_ids`` has the distinct ids. Conversation c takes the first h turns of c - c % ``every``
    (h: the checksum of c modulo ``most`` + 1), and its own after its first h.
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    struct = F.struct("pos", *LANES, "bytes")
    heads = (
        turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most))
        .groupBy(F.col("conv_id").alias("donor"))
        .agg(F.sort_array(F.collect_list(struct)).alias("head"))  # `most` turns at the most
    )
    given = conv_ids.select(
        "conv_id", taken.alias("taken"), (F.col("conv_id") - F.col("conv_id") % every).alias("donor")
    ).join(heads, "donor", "left")
    given = given.withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("taken").cast("int")))
    first = given.select("conv_id", F.inline_outer("head"))
    own = turns.join(
        given.select("conv_id", "taken", F.size("head").alias("given")), "conv_id"
    ).filter("pos >= taken")
    own = own.select(
        "conv_id", (F.col("pos") - F.col("taken") + F.col("given")).alias("pos"), *LANES, "bytes"
    )
    return first.unionByName(own)


def conversation_trie(
    conversations: DataFrame,
    every: int = 5,
    most: int = 8,
    block: int = 4,
    id_column: str = "conv_id",
) -> DataFrame:
    """The prefix trie of rebuilt conversations, from ``conv_id, turn, role, text``.

    Turns are ordered by ``turn`` (null first); those of one number by role, then by a hash
    of role and text, and repeated rows are turns of their own. A null role or text is
    empty. A row without an id is left out; ids are whole numbers. Conversations are rebuilt as
    ``rebuilt`` says, so some have no turns: they are members of the root only. An empty table
    has no root and gives no row; other columns have no part in it.
    """
    source = conversations.select(
        F.col(id_column).alias("conv_id"),
        "turn",
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")),
    ).filter("conv_id is not null")
    scratch = Scratch(conversations.sparkSession)
    turns = scratch.keep(ordered_turns(source, scratch))
    conv_ids = turns.filter("pos = 0").select("conv_id")
    found = prefix_trie(scratch.keep(rebuilt(turns, conv_ids, every, most)), block)
    scratch.drop()
    return found
