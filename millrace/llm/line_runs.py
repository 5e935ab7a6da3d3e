"""Removal of repeated runs of lines, by a suffix array over line ids.

Only DataFrame operations: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, materialize

#: A document is named by its id and the hash of its text.
DOCUMENT = ["doc_id", "text_hash"]
#: Bits of the filter that tells which documents may lose lines: 512 bitmaps of 4 KiB.
FILTER_BITS = 1 << 24
_BITMAP_BITS = 32_768


def _lines(text: str) -> Column:
    """The lines that are not blank, as (hash, place among all lines, words)."""
    every = F.transform(
        F.split(text, "\n", -1),
        lambda line, place: F.struct(
            F.xxhash64(line).alias("name"),
            place.alias("place"),
            F.regexp_count(line, F.lit(r"\S+")).alias("words"),
        ),
    )
    return F.filter(every, lambda line: line["words"] > 0)


def line_sequence(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, text_hash, id, name, place, words`` of the lines of documents with an id.

    ``id`` numbers all lines by document and place: those of a document follow each other, and
    between two documents a number is left out. Documents are sorted over the cluster, and
    numbered by a running sum within each range and over the ranges.
    """
    known = docs.filter("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), _lines("text").alias("lines")
    )
    sizes = known.groupBy(*DOCUMENT).agg(
        F.max(F.size("lines")).cast("long").alias("n"), F.count("*").alias("copies")
    )
    ranged = scratch.keep(
        sizes.repartitionByRange(*DOCUMENT).withColumn("range", F.spark_partition_id())
    )
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.sum(F.col("n") + 1).over(before.partitionBy("range").orderBy(*DOCUMENT))
    # One row per range of the sort.
    ranges = ranged.groupBy("range").agg(F.sum(F.col("n") + 1).alias("n"))
    ranges = ranges.select("range", F.sum("n").over(before.orderBy("range")).alias("earlier"))
    first = F.coalesce(inside, F.lit(0)) + F.coalesce("earlier", F.lit(0))
    bases = ranged.join(ranges, "range").select(*DOCUMENT, first.alias("base"))
    exploded = known.select(*DOCUMENT, F.posexplode("lines")).select(*DOCUMENT, "pos", "col.*")
    lines = exploded.join(bases, DOCUMENT).select(
        *DOCUMENT, (F.col("base") + F.col("pos")).alias("id"), "name", "place", "words"
    )
    # Repeated rows are one document, so each of their lines is a row once.
    unique = ranged.filter("copies > 1").isEmpty()
    return lines if unique else lines.dropDuplicates(["id"])


def _ranked(rows: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    """Sort the suffixes that share a name with another: ``id, rank, first``.

    The different names are sorted over the cluster, and a name's place in that order is its
    rank: equal names have equal ranks, and a smaller name has a smaller one. ``first`` is the
    earliest suffix of the rank. Ranks are written down, as a second sort would cut its ranges
    elsewhere. Names combine before they are shuffled, so one of a third of all lines is one
    row per task; the rows that take their rank are joined, which a hot name may split.
    """
    ends = rows.groupBy(*names).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    order = (
        ends.filter("first != last")
        .drop("last")
        .repartitionByRange(*names)
        .sortWithinPartitions(*names)
        .withColumn("rank", F.monotonically_increasing_id())
    )
    order = scratch.keep(order)
    return scratch.keep(rows.join(order, names).select("id", "rank", "first"))


def _pairs(ranks: DataFrame, ahead: int) -> DataFrame:
    """Each suffix with its rank and that of the suffix ``ahead`` lines on, where both repeat."""
    later = ranks.select((F.col("id") - ahead).alias("id"), F.col("rank").alias("next"))
    return ranks.select("id", F.col("rank").alias("head")).join(later, "id")


def suffix_ranks(lines: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The ranks of suffixes by their first 1, 2, 4, ... lines, up to where none repeats.

    Prefix doubling: two ranks by n lines give one by 2n. The suffixes of a rank are an interval
    of the suffix array with that many lines in common; one that is alone stays alone, so each
    round sorts only what still repeats.
    """
    levels = [_ranked(lines.select("id", "name"), ["name"], scratch)]
    while not levels[-1].isEmpty():
        pairs = _pairs(levels[-1], 1 << (len(levels) - 1))
        levels.append(_ranked(pairs, ["head", "next"], scratch))
    return levels[:-1]


def _later_copies(levels: list[DataFrame], size: int, scratch: Scratch) -> DataFrame:
    """``id`` of the suffixes whose first ``size`` lines start an earlier suffix too."""
    level = size.bit_length() - 1
    if level >= len(levels):
        return None
    ranks = levels[level]
    if size == 1 << level:
        return ranks.filter("id != first").select("id")
    return _ranked(_pairs(ranks, size - (1 << level)), ["head", "next"], scratch).filter(
        "id != first"
    ).select("id")


def repeated_runs(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``id, earlier, lines``: the runs of lines that stand at an earlier place too.

    A suffix is compared with the first one of its last interval, that with the most lines in
    common; where both go on from such a pair one line before, the run is the same and is given
    once. The common prefix is then found line by line of the doubling, from the longest step
    down: it goes on by a step where the ranks of what follows agree.
    """
    last = None
    for k, ranks in enumerate(levels):
        pairs = ranks.filter("id != first").select("id", "first", F.lit(k).alias("level"))
        last = pairs if last is None else last.unionByName(pairs)
    best = last.groupBy("id").agg(F.max(F.struct("level", "first")).alias("best"))
    best = scratch.keep(best.select("id", F.col("best.first").alias("earlier"), "best.level"))
    before = best.select((F.col("id") + 1).alias("id"), (F.col("earlier") + 1).alias("earlier"))
    runs = best.join(before, ["id", "earlier"], "left_anti")
    runs = runs.withColumn("lines", F.expr("shiftleft(1L, level)"))
    for k in reversed(range(len(levels) - 1)):
        ranks = levels[k].select("id", "rank")
        mine = ranks.select(F.col("id").alias("own_next"), F.col("rank").alias("mine"))
        theirs = ranks.select(F.col("id").alias("earlier_next"), F.col("rank").alias("theirs"))
        runs = (
            runs.withColumn("own_next", F.col("id") + F.col("lines"))
            .withColumn("earlier_next", F.col("earlier") + F.col("lines"))
            .join(mine, "own_next", "left")
            .join(theirs, "earlier_next", "left")
        )
        on = (F.col("mine") == F.col("theirs")) & (F.col("level") > k)
        runs = scratch.keep(
            runs.select(
                "id", "earlier", "level", (F.col("lines") + F.when(on, 1 << k).otherwise(0)).alias("lines")
            )
        )
    return runs.select("id", "earlier", "lines")


def may_be_hit(hits: DataFrame, names: Sequence[str] = DOCUMENT) -> Column:
    """A test that holds for every document of ``hits``, and for few others.

    It is a subquery of one value, a bitmap of ``FILTER_BITS`` bits: 2 MiB whatever the number of
    documents. By it the texts that lose no line are told apart where they are read.
    """
    bit = F.pmod(F.xxhash64(*names), F.lit(FILTER_BITS))
    maps = hits.select(bit.alias("bit")).groupBy(
        F.floor(F.col("bit") / _BITMAP_BITS).cast("int").alias("part")
    ).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(_BITMAP_BITS))).alias("bits"))
    # At most FILTER_BITS / _BITMAP_BITS maps.
    maps = maps.agg(F.map_from_entries(F.collect_list(F.struct("part", "bits"))))
    bits = F.try_element_at(maps.scalar(), F.floor(bit / _BITMAP_BITS).cast("int"))
    place = F.pmod(bit, F.lit(_BITMAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.coalesce(F.getbit(byte.cast("int"), F.pmod(place, F.lit(8))) == 1, F.lit(False))


def line_dedup(
    docs: DataFrame,
    min_lines: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_words: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Delete the later copies of repeated runs of lines.

    A run counts if it has ``min_lines`` lines, or, where ``min_words`` is given, so many words in
    however few lines. Lines end at a line feed; blank ones (white space only) are never deleted
    and stand between no two others. A line goes if it is in a run that counts and also starts
    earlier: in a smaller document id, or further up in the same document. So of every maximal
    repeated run the first copy stays. Runs are judged on the input, not on what is left.

    Returns one row per row: ``doc_id, text, n_lines, n_removed, longest_run`` (lines that are
    not blank, deleted lines, and the lines of the longest run that ``repeated_runs`` found to
    stand at an earlier place, 0 if no line was deleted), with the text as it is left, and the
    columns named by ``keep`` as fields of ``row``. Repeated rows are one document, and each is cut alike; two texts under one id are two documents. A row without an
    id is compared with none; a null text stays null, with no lines.

    Texts are shuffled only where they may lose lines, by a filter of fixed size.
    """
    source = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(text_column).alias("text"),
        *([F.struct(*(docs[name] for name in keep)).alias("row")] if keep else []),
    )
    row = ["row"] if keep else []
    scratch = Scratch(docs.sparkSession)
    lines = scratch.keep(line_sequence(source, scratch))
    levels = suffix_ranks(lines, scratch)
    covered = None
    for size in range(1 if min_words else min_lines, min_lines + 1):
        later = _later_copies(levels, size, scratch)
        if later is None:
            break
        if size < min_lines:
            # The words of a run of few lines: those of its lines, added up.
            own = later.select(
                F.col("id").alias("start"), F.explode(F.sequence("id", F.col("id") + (size - 1))).alias("id")
            )
            later = (
                own.join(lines.select("id", "words"), "id")
                .groupBy(F.col("start").alias("id"))
                .agg(F.sum("words").alias("words"))
                .filter(F.col("words") >= min_words)
                .select("id")
            )
        later = later.select(F.explode(F.sequence("id", F.col("id") + (size - 1))).alias("id"))
        covered = later if covered is None else covered.union(later)
    if covered is None:
        covered = lines.select("id").limit(0)
    runs = repeated_runs(levels, scratch) if levels else lines.select("id", F.lit(0).alias("lines")).limit(0)
    places = covered.distinct().join(lines.select(*DOCUMENT, "id", "place"), "id")
    longest = lines.select(*DOCUMENT, "id").join(runs, "id")
    longest = longest.groupBy(*DOCUMENT).agg(F.max("lines").cast("long").alias("longest_run"))
    # One array per document, no longer than its lines.
    removed = places.groupBy(*DOCUMENT).agg(F.collect_set("place").alias("removed"))
    removed = materialize(removed.join(longest, DOCUMENT, "left"))
    scratch.drop()

    marked = source.withColumn("text_hash", F.xxhash64("text"))
    marked = marked.withColumn("hit", may_be_hit(removed))
    split = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("removed"))
    left = F.array_join(F.transform(kept, lambda place: F.get(split, place)), "\n")
    n_lines = F.size(F.filter(split, lambda line: F.rlike(line, F.lit(r"\S"))))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines")
    zero = F.lit(0).cast("long")
    whole = marked.filter("not hit").select(
        "doc_id", "text", n_lines, zero.alias("n_removed"), zero.alias("longest_run"), *row
    )
    # The same join at every size, so that what is shuffled grows evenly with the input.
    cut = marked.filter("hit").join(removed.hint("merge"), DOCUMENT, "left")
    none = F.col("removed").isNull()
    cut = cut.select(
        "doc_id",
        F.when(none, F.col("text")).otherwise(left).alias("text"),
        n_lines,
        F.when(none, 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
        F.coalesce("longest_run", zero).alias("longest_run"),
        *row,
    )
    return whole.unionByName(cut)
