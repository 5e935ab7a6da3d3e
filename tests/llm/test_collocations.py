"""Counting quotient filters, and collocations against a plain count."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from __spark_entry__ import queries
from millrace.llm import collocations as collocations_module
from millrace.llm.collocations import collocations
from millrace.llm.quotient_filter import CountingQuotientFilter, permute, restore, shards

MIDDLE = "/root/testdata/sf0.01"


def test_permutation_is_invertible():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 10_000, np.uint64)
    keys[:4] = [0, 1, 2**63, 2**64 - 1]
    assert np.array_equal(restore(permute(keys)), keys)
    assert len(np.unique(permute(np.arange(10_000, dtype=np.uint64)))) == 10_000


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 5_000])
@pytest.mark.parametrize("shard_bits", [0, 3, 9])
def test_filters_count_exactly(n, shard_bits):
    rng = np.random.default_rng(n)
    parts = [rng.integers(0, max(1, n // 3), n, np.uint64) * np.uint64(2**57 + 1) for _ in range(3)]
    parts.append(np.full(1_000 if n else 0, 7, np.uint64))
    plain = Counter(np.concatenate(parts).tolist())
    by_shard = defaultdict(list)
    for part in parts:
        for shard, found in shards(part, shard_bits):
            data = found.pack()
            by_shard[shard].append(CountingQuotientFilter.unpack(data))
            assert len(data) <= 40 + len(found.values) * 10 + (8 if n else 0)
    total = {}
    for found in by_shard.values():
        merged = CountingQuotientFilter.unpack(CountingQuotientFilter.merged(found).pack())
        keys, counts = merged.keys(), merged.counts
        assert np.array_equal(merged.count(keys), counts)
        assert not set(keys.tolist()) & set(total)
        assert merged.count(np.array([3, 5], np.uint64) + np.uint64(2**40)).sum() == 0
        total |= dict(zip(keys.tolist(), counts.tolist()))
    assert total == dict(plain)


def test_filters_are_smaller_than_their_keys():
    keys = np.random.default_rng(3).integers(0, 2**64, 100_000, np.uint64)
    ((_, found),) = shards(keys, 0)
    assert len(found.pack()) < 8 * len(found.values)  # key and count, in less than the key


PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
UPPER = {k: k + 32 for k in range(65, 91)}


def plain_collocations(rows, least, longest=5, top=2_000, percent=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    f[lang][tuple(words[k : k + size])] += 1
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    inner = p[k : k + size]
                    around[inner] = max(around[inner], a)
        best = []
        for p, a in candidates.items():
            if p in around and 100 * around[p] >= percent * a:
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


def texts_of(seed, n, langs=("en", "fr", None)):
    rng = np.random.default_rng(seed)
    stock = [f"w{k}" for k in range(40)] + ["é", "日本", "A", "a", "Z\x85", "x\x00", "\x00", "\xa0"]
    phrases = [[stock[j] for j in rng.integers(0, 48, size)] for size in (2, 3, 4, 5, 6, 9) for _ in range(3)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(1, 40)):
            parts += phrases[rng.integers(0, 18)] if rng.random() < 0.4 else [stock[min(47, rng.geometric(0.08))]]
            if rng.random() < 0.2:
                parts.append(rng.choice([".", "\n", " , ", ";x", "!\t?", "\r\v"]))
        rows.append((langs[rng.integers(0, len(langs))], " ".join(parts)))
    return rows


@pytest.mark.parametrize("chunk_words", [1 << 20, 300])
@pytest.mark.parametrize("least", [3, 20])
def test_collocations(spark, rows, chunk_words, least, monkeypatch):
    monkeypatch.setattr(collocations_module, "CHUNK_WORDS", chunk_words)
    monkeypatch.setattr(collocations_module, "BUCKET_BYTES", 1_000)
    texts = texts_of(least, 400)
    table = spark.createDataFrame([(*t, 1, "x") for t in texts], "lang string, text string, n int, phrase string")
    for percent in (100, 60):
        found = collocations(table.repartition(4), least=least, percent=percent, top=50)
        expected = plain_collocations(texts, least, top=50, percent=percent)
        assert rows(found, *COLUMNS) == expected and len(expected) > 60


def test_collocations_of_odd_rows(spark, rows):
    texts = [
        *[("en", "one two three four five six")] * 5,
        *[(None, "one two. three four")] * 4,
        ("und", "ONE Two"),
        ("en", None),
        (None, ""),
        (None, None),
        ("en", " \t.,;:!?\n\v\f\r. "),
        ("de", "x " * 60_000),
        ("fr", "a a a a a.a a\na"),
        ("", "b c b c b c b c"),
    ]
    table = spark.createDataFrame(texts, "lang string, text string")
    for least in (2, 5):
        assert rows(collocations(table, least=least), *COLUMNS) == plain_collocations(texts, least)
    assert collocations(table.limit(0), least=2).collect() == []
    assert collocations(table.filter("text is null"), least=2).collect() == []
    assert collocations(table, least=10**6).collect() == []


def test_scores_beyond_64_bits(spark):
    """The products in a score need more room than a long has; the result is exact."""
    a, n, left, right = 10**13 + 1, 4 * 10**13 + 3, 3 * 10**13 + 7, 2 * 10**13 + 9
    table = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    wide = table.selectExpr(*(f"cast({c} as decimal(19,0)) as wide_{c}" for c in "alrn"))
    score = wide.selectExpr("(wide_a * wide_n * 1000) div (wide_l * wide_r) as s").first().s
    assert score == 1000 * a * n // (left * right)


def test_collocation_query(spark, rows):
    table = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    texts = [tuple(r) for r in table.select("lang", "text").collect()]
    found = rows(queries()["op12_phrase_collocations"](spark, MIDDLE), *COLUMNS)
    assert found == plain_collocations(texts, 100) and len(found) > 20
