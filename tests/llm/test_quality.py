"""Quality rules: counts against plain ones, the list against a plain reading, held-out texts."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from __spark_entry__ import queries
from millrace.llm.quality_rules import (
    Condition,
    DecisionList,
    covering,
    judge,
    learn,
    repeated_words,
    statistics,
    text_statistics,
)

from .conftest import SMALL, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = set()
    for k in range(len(words) - 7):
        if runs[tuple(words[k : k + 8])] > 1:
            covered.update(range(k, k + 8))
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        dup,
        len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


EXTRA = [
    (50, "a\nb\na\n a\n\n\na\n"),
    (51, "#*$%&|<> \x85 　 \x1c\x1d x"),
    (52, " ".join("abcdefgh" * 3)),
    (53, "x y " * 13 + "# $"),
    (54, " ".join(f"w{k % 9}" for k in range(17))),
]


def test_counts(spark, odd, no_documents, rows):
    some = spark.createDataFrame(EXTRA, "doc_id long, text string")
    for df, texts in ((odd, odd_rows()), (some, EXTRA)):
        judged = judge(df, DecisionList(()))
        expected = sorted(((i, *plain_base(t), not plain_base(t)[-1]) for i, t in texts), key=repr)
        assert rows(judged, "doc_id", *BASE, "base_failed", "kept") == expected
    assert judge(no_documents, DecisionList(())).collect() == []


def test_repeated_words_of_any_length():
    rng = np.random.default_rng(1)
    for size in range(1, 10):
        for _ in range(30):
            names = rng.integers(0, 3, rng.integers(0, 30))
            runs = [tuple(names[k : k + size]) for k in range(len(names) - size + 1)]
            again = {k for k, r in enumerate(runs) if runs.count(r) > 1}
            plain = len({k + j for k in again for j in range(size)})
            assert repeated_words(names, size) == plain


def test_covering_finds_the_rules_of_a_made_up_table():
    rng = np.random.default_rng(2)
    table = rng.random((4_000, 3))
    bad = ((table[:, 0] > 0.8) & (table[:, 1] < 0.5)) | (table[:, 2] < 0.1)
    found = covering(table, bad, ["a", "b", "c"])
    marked = np.zeros(len(table), bool)
    for rule in found.rules:
        of = np.ones(len(table), bool)
        for c in rule:
            of &= c.holds(table[:, "abc".index(c.name)])
        marked |= of
    assert (marked == bad).mean() > 0.99
    assert str(found).endswith("otherwise: keep")
    noise = rng.random(4_000) < 0.2  # nothing tells these apart
    assert covering(table, noise, ["a", "b", "c"]).rules == ()
    assert covering(table[:0], bad[:0], ["a", "b", "c"]).rules == ()
    assert covering(table, np.ones(4_000, bool), ["a", "b", "c"]).rules == ()


def test_column_reads_the_list_in_order(spark, odd, rows):
    first = (Condition("words", True, 41.0), Condition("distinct", True, 0.5))
    rules = DecisionList((first, (Condition("mean_word", False, 2.0),), (Condition("words", True, 5.0),)))
    table = text_statistics(odd).select("doc_id", *(c.alias(n) for n, c in statistics().items()),
                                        rules.rule().alias("rule"))
    numbers = set()
    for row in table.collect():
        holds = [
            all(row[c.name] >= c.threshold if c.at_least else row[c.name] <= c.threshold for c in r)
            for r in rules.rules
        ]
        assert row.rule == (holds.index(True) + 1 if any(holds) else 0)
        numbers.add(row.rule)
    assert numbers == {0, 1, 2, 3}


def test_held_out_quality(spark):
    """Learned from four fifths of the ids: junk of the others goes, clean texts stay."""
    sf = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rules = learn(documents, labels.filter(~held_out))
    assert 1 <= len(rules.rules) <= 20
    judged = judge(documents, rules).join(labels.filter(held_out), "doc_id")
    share = F.avg(F.col("kept").cast("int"))
    kept = {q: judged.filter(f"quality = {q}").agg(share).first()[0] for q in (0, 1)}
    assert kept[1] > 0.95 and kept[0] < 0.02
    # Of the clean texts that the base lets pass, the list rejects hardly any.
    passed = judged.filter("quality = 1 and not base_failed")
    assert passed.agg(share).first()[0] > 0.99


def test_learning_from_odd_labels(spark, odd, no_documents):
    labels = [(1, 0), (1, 1), (None, 0), (2, None), (99, 1), (5, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    assert learn(odd, labels) == DecisionList(())
    assert learn(no_documents, labels) == DecisionList(())
    assert learn(odd, labels.limit(0)) == DecisionList(())


def test_quality_query(spark, rows, small_texts):
    found = queries()["op11_quality_rules"](spark, SMALL)
    expected = sorted(((i, *plain_base(t)) for i, t in small_texts), key=repr)
    assert rows(found, "doc_id", *BASE, "base_failed") == expected
    assert found.filter("kept and (base_failed or rule != 0)").isEmpty()
    assert found.filter("not kept and not base_failed and rule = 0").isEmpty()
