"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batches_of, binaries

#: What is counted in a text, beside ``n_words`` and ``word_chars``.
COUNTS = (
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct",
    "n_capitals",
    "n_digits",
    "n_marks",
)
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b".,;:!?"
_BLANKS = b" \t\n\v\f\r"
#: The bytes that go on with a character begun before.
_CONTINUED = bytes(range(0x80, 0xC0))


def repeated_words(names: np.ndarray, size: int) -> int:
    """How many words are in runs of ``size`` words that stand in the text twice or more.

    ``names`` tells the words apart. Runs are numbered exactly, by doubling: equal numbers of
    two runs that follow each other give equal numbers to the run of both.
    """
    if len(names) <= size:
        return 0
    number, length = names.astype(np.uint64), 1
    while length < size:
        ahead = min(length, size - length)
        pairs = number[:-ahead] * np.uint64(number.max() + np.uint64(1)) + number[ahead:]
        number = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
        length += ahead
    again = np.flatnonzero(np.bincount(number.astype(np.int64))[number.astype(np.int64)] > 1)
    ends = np.zeros(len(names) + 1, np.int64)
    np.add.at(ends, again, 1)
    np.add.at(ends, again + size, -1)
    return int((np.cumsum(ends) > 0).sum())


def text_counts(text: bytes | None, window: int) -> tuple[int, ...]:
    """``n_words, word_chars`` and ``COUNTS`` of a text; a null one has none of anything."""
    text = text or b""
    words = text.split()
    number = {word: k for k, word in enumerate(dict.fromkeys(words))}
    names = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    lines = [line for line in text.split(b"\n") if line.strip()]

    def signs(which: bytes) -> int:
        return len(text) - len(text.translate(None, which))

    return (
        len(words),
        len(text.translate(None, _BLANKS + _CONTINUED)),
        signs(_SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(names, window),
        len(lines),
        len(number),
        signs(_CAPITALS),
        signs(_DIGITS),
        signs(_MARKS),
    )


def text_statistics(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 8
) -> DataFrame:
    """Count every whole text: ``doc_id, n_words, word_chars`` and ``COUNTS``; one row per row.

    Words are parted by white space of ASCII, ``word_chars`` are the code points in them.
    ``n_dup_lines`` are lines with a word that equal an earlier one, ``n_repeat_words`` words in
    runs of ``window`` words found twice or more in the text, the first one included. One map
    over the texts: nothing is shuffled, and a task holds one text at a time besides its batch.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text", 1 << 22):
            rows = [text_counts(text, window) for text in binaries(batch.column("text"))]
            columns = zip(*rows) if rows else [()] * (2 + len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "n_words", "word_chars", *COUNTS],
            )

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    counted = ", ".join(f"{name} long" for name in ("n_words", "word_chars", *COUNTS))
    return source.mapInArrow(count, f"doc_id {kind}, {counted}")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def statistics() -> dict[str, Column]:
    """The columns rules are made of. Shares are of words, of their characters or of lines."""
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": _share("word_chars", "n_words"),
        "symbols": _share("n_symbols", "n_words"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
        "distinct": _share("n_distinct", "n_words"),
        "capitals": _share("n_capitals", "word_chars"),
        "digits": _share("n_digits", "word_chars"),
        "marks": _share("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    """A statistic at or above a threshold (``at_least``), or at or below it."""

    name: str
    at_least: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<='} {self.threshold:.6g}"

    def column(self) -> Column:
        value = statistics()[self.name]
        return value >= self.threshold if self.at_least else value <= self.threshold

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values >= self.threshold if self.at_least else values <= self.threshold


#: A conjunction of conditions.
Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class DecisionList:
    """Rules in order: the first one that holds rejects a text, and one that none fits stays."""

    rules: tuple[Rule, ...]

    def __str__(self) -> str:
        lines = [f"{k}: reject if {' and '.join(map(str, r))}" for k, r in enumerate(self.rules, 1)]
        return "\n".join([*lines, "otherwise: keep"])

    def rule(self) -> Column:
        """The number of the first rule that holds, 0 where none does: one conditional column."""
        if not self.rules:
            return F.lit(0)
        tests = [reduce(Column.__and__, (c.column() for c in rule)) for rule in self.rules]
        chain = F.when(tests[0], 1)
        for k, test in enumerate(tests[1:], 2):
            chain = chain.when(test, k)
        return chain.otherwise(0)

    def keeps(self) -> Column:
        return self.rule() == 0


def _covered(rule: Rule, table: np.ndarray, names: Sequence[str]) -> np.ndarray:
    out = np.ones(len(table), bool)
    for condition in rule:
        out &= condition.holds(table[:, names.index(condition.name)])
    return out


def _information(bad: np.ndarray, all_: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(bad, 1e-9) / np.maximum(all_, 1e-9))


def _best_condition(table: np.ndarray, bad: np.ndarray, names: Sequence[str]):
    """The condition with the largest gain: rows it keeps of the bad, times how much purer."""
    n, total = len(bad), bad.sum()
    best, gain = None, 1e-9
    for j, name in enumerate(names):
        order = np.argsort(table[:, j], kind="stable")
        values, marks = table[order, j], bad[order]
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1  # rows below the cut
        if not len(cuts):
            continue
        below = np.cumsum(marks)[cuts - 1]
        for at_least, some, of in ((False, below, cuts), (True, total - below, n - cuts)):
            gains = some * (_information(some, of) - _information(total, n))
            k = int(np.argmax(gains))
            if gains[k] > gain:
                gain = float(gains[k])
                middle = float(values[cuts[k] - 1] + values[cuts[k]]) / 2
                best = Condition(name, at_least, middle)
    return best


def _grown(table: np.ndarray, bad: np.ndarray, names: Sequence[str], longest: int) -> Rule:
    """Conditions are added, the best one each time, until only bad rows are left."""
    rule: Rule = ()
    while len(rule) < longest and bad.any() and not bad.all():
        condition = _best_condition(table, bad, names)
        if condition is None:
            break
        rule += (condition,)
        kept = condition.holds(table[:, names.index(condition.name)])
        table, bad = table[kept], bad[kept]
    return rule


def _worth(rule: Rule, table: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> float:
    """How many more bad than good rows a rule covers, as a share of what it covers."""
    of = _covered(rule, table, names)
    return float((2 * bad[of].sum() - of.sum()) / of.sum()) if of.any() else -1.0


def _pruned(rule: Rule, table: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> Rule:
    """Conditions are left out, one by one, as long as the rule is worth no less on other rows."""
    while len(rule) > 1:
        shorter = [rule[:k] + rule[k + 1 :] for k in range(len(rule))]
        worth = [_worth(r, table, bad, names) for r in shorter]
        k = int(np.argmax(worth))
        if worth[k] < _worth(rule, table, bad, names):
            break
        rule = shorter[k]
    return rule


def covering(
    table: np.ndarray,
    bad: np.ndarray,
    names: Sequence[str],
    precision: float = 0.95,
    support: int = 5,
    longest: int = 5,
    most: int = 40,
) -> DecisionList:
    """Learn rules for the bad rows of ``table``, a column per name, by sequential covering.

    Two of three rows grow a rule and the others prune it; what it covers is taken away and the
    next one is grown. A rule has to cover ``support`` bad rows in all, and of the rows it
    covers in either part the share ``precision`` must be bad; the first one that fails ends
    the list.
    """
    prune = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most:
        grow = left & ~prune
        rule = _grown(table[grow], bad[grow], names, longest)
        if not rule:
            break
        rule = _pruned(rule, table[left & prune], bad[left & prune], names)
        of = _covered(rule, table, names) & left
        if bad[of].sum() < support or any(
            bad[part].sum() < precision * part.sum() for part in (of & prune, of & ~prune)
        ):
            break
        rules.append(rule)
        left &= ~of
    return DecisionList(tuple(rules))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 20_000,
    id_column: str = "doc_id",
    text_column: str = "text",
    precision: float = 0.95,
) -> DecisionList:
    """Learn a list from ``labels`` (``doc_id, quality``; 0 is bad) and the texts they name.

    ``sample`` bounds the labelled rows that are used: those whose hashes come first, whatever
    the order and number of the input. Only their statistics reach the driver. Labels without
    an id or a quality, and ids without a text, teach nothing; without bad or good rows the
    list is empty and keeps everything.
    """
    label = labels.select(F.col(id_column).alias("doc_id"), F.col("quality")).dropna().distinct()
    chosen = label.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    source = source.filter("text is not null").join(F.broadcast(chosen), "doc_id")
    marked = source.select(F.struct("doc_id", "quality").alias("doc_id"), "text")
    columns = statistics()
    rows = text_statistics(marked).select(
        "doc_id.*", *(column.alias(name) for name, column in columns.items())
    )
    # A repeated id has a row for each of its texts, so the bound is applied to rows as well.
    rows = rows.orderBy(F.xxhash64("doc_id"), *rows.columns).limit(sample).toArrow()
    table = np.column_stack([np.asarray(rows[name]) for name in columns])
    return covering(table, np.asarray(rows["quality"]) == 0, list(columns), precision)


def judge(
    docs: DataFrame,
    rules: DecisionList,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Judge every whole text: its statistics, ``base_failed``, ``rule`` and ``kept``.

    The base rejects texts of fewer than 20 words and those with over 30 percent of their words
    in repeated runs of eight; ``rule`` is the number of the first learned rule that holds, 0 if
    none does. A text is kept if neither rejects it. One row per row: repeated rows, null ids and
    extra columns change nothing; a null or empty text has no words and fails the base. An empty
    table gives no row.
    """
    found = text_statistics(docs, id_column, text_column)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumns({"base_failed": failed, "rule": rules.rule().cast("int")}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )
