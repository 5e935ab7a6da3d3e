"""Index, blocks and left-overs of the similarity join."""

import os
import random

import numpy as np

from millrace.llm.common import Scratch
from millrace.llm.jaccard import (
    Bounds,
    _between_groups,
    count_place,
    jaccard_components,
    prefix_keys,
    shingle_set,
)

from .conftest import words


def plain_groups(texts, size, percent):
    """The smallest id of each text's group, by comparing all pairs."""
    sets = {i: set(shingle_set(t.encode(), size).tolist()) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_similar_sets_share_a_key_from_rare_to_frequent():
    rng = np.random.default_rng(5)
    bounds, place = Bounds(85, 30), count_place(16)
    counts = {}

    def numbers(tokens):
        """As the index numbers them, without those of one set only."""
        for t in tokens.tolist():
            counts.setdefault(t, int(rng.choice([1, 2, 3, 40, 5000])))
        return np.array([counts[t] << place | t for t in tokens.tolist() if counts[t] > 1], np.int64)

    for n in (1, 3, 8, 20, 47, 200, 900):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 36, n))
            shared = rng.permutation(x)[: -(-85 * len(x) // 100)]
            y = np.unique(shared)
            assert bounds.similar(len(shared), len(x), len(y))
            for t in shared.tolist():
                counts[t] = int(rng.choice([2, 3, 40, 5000]))
            keys = [prefix_keys(rng.permutation(numbers(s)), len(s), place, bounds) for s in (x, y)]
            assert np.intersect1d(*keys).size, n


def test_sets_with_few_tokens_in_others_have_no_key():
    bounds, place = Bounds(85, 30), count_place(1000)
    assert place == 42
    tokens = np.arange(100, dtype=np.int64) | np.int64(2 << place)
    assert len(prefix_keys(tokens[:84], 100, place, bounds)) == 0
    # 16 tokens of 46 in the prefix are in no other set: the others are rare, and keys.
    assert len(prefix_keys(tokens[:85], 100, place, bounds)) == bounds.prefix(100) - 15
    # Of 100 tokens in other sets the most frequent ones are not in the prefix.
    more = tokens + (np.arange(100, dtype=np.int64) << place)
    few, all_keys = prefix_keys(more[:85], 100, place, bounds), prefix_keys(more, 100, place, bounds)
    assert set(few.tolist()) <= set(all_keys.tolist())


def test_common_phrases_make_no_pool(spark, monkeypatch):
    """Texts that share half of their shingles with many others, but not with one."""
    from millrace.llm import jaccard

    rng = random.Random(3)
    phrases = [words(1000 + k, 12, 10**6) for k in range(40)]
    texts = []
    for i in range(120):
        parts = rng.sample(phrases, 12) + [words(i, 12, 10**6) for _ in range(12)]
        rng.shuffle(parts)
        texts.append((i, " ".join(w for p in parts for w in p)))
    base = texts[7][1].split()
    base[20] = "other"
    texts.append((500, " ".join(base)))
    kept = []
    whole = jaccard._between_groups
    monkeypatch.setattr(
        jaccard, "_between_groups", lambda p, *a: (kept.append(p.count()), whole(p, *a))[1]
    )
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, 4, 85).collect()}
    assert got == plain_groups(texts, 4, 85)
    assert got[500] == 7
    assert kept == [0]


def test_pipeline_stage_makes_no_pool_of_common_phrases(spark, monkeypatch):
    from corpus_pipeline import near_duplicates
    from millrace.llm import jaccard

    rng = random.Random(6)
    phrases = [words(2000 + k, 14, 10**6) for k in range(40)]
    texts = []
    for i in range(100):
        parts = rng.sample(phrases, 12) + [words(i, 14, 10**6) for _ in range(12)]
        rng.shuffle(parts)
        texts.append((i, " ".join(w for p in parts for w in p)))
    texts.append((500, texts[7][1] + " more"))
    kept = []
    whole = jaccard._between_groups
    monkeypatch.setattr(
        jaccard, "_between_groups", lambda p, *a: (kept.append(p.count()), whole(p, *a))[1]
    )
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    left = {r.doc_id for r in near_duplicates(spark, docs, "").collect()}
    assert left == set(plain_groups(texts, 5, 80).values()) == set(range(100))
    assert kept == [0]


def test_many_blocks_of_a_pool(spark):
    """Small blocks in several tiles: their links join what is similar, and nothing else."""
    rng = random.Random(4)
    texts = []
    for k in range(90):
        base = words(k % 9, 150 + 10 * (k % 9), 5000)
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = f"new{rng.randrange(10**6)}"
        texts.append((k, " ".join(base)))
    sets = [shingle_set(t.encode(), 4) for _, t in texts]
    rows = [(1 + k % 2, k, k, len(s), bytearray(s.tobytes())) for k, s in enumerate(sets)]
    schema = "pool long, group long, doc_id long, n long, tokens binary"
    scratch = Scratch(spark)
    links = _between_groups(spark.createDataFrame(rows, schema), Bounds(85, 5), scratch, 2)
    found = [(r.a, r.b) for r in links.collect()]
    scratch.drop()
    root = {k: k for k, _ in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in found:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    expected = {}
    for pool in (0, 1):
        expected |= plain_groups([t for t in texts if t[0] % 2 == pool], 4, 85)
    assert {k: find(k) for k in root} == expected
    assert len(set(expected.values())) < 60


def test_shuffles_are_deleted(spark, documents):
    """Of the steps that have ended no shuffle stays on the disk; the setting is as before."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {
            f"{folder}/{f}"
            for top in manager.localDirsString()
            for folder, _, names in os.walk(top)
            for f in names
            if f.startswith("shuffle_")
        }

    before, setting = shuffles(), spark.conf.get(name)
    jaccard_components(documents.repartition(3), 4, 85)
    assert len(shuffles() - before) < 20
    assert spark.conf.get(name) == setting
