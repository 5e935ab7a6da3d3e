"""The prefix trie of conversations against a plain one."""

import hashlib
import random
import zlib

import pytest

from __spark_entry__ import queries
from millrace.llm import prefix_trie
from millrace.llm.prefix_trie import conversation_trie

from .conftest import SMALL

COLUMNS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_conversations(rows, every=5, most=8):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        out[c] = turns.get(c - (abs(c) % every) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    return out


def plain_trie(conversations):
    members, ends = {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        below = children.get(key, [])
        leaves[key] = sum(leaves[k] for k in below) or 1
        size = len(key[-1][1].encode()) if key else 0
        saved[key] = (len(members[key]) - 1) * size + sum(saved[k] for k in below)
    return sorted(
        (
            (
                min(members[key]),
                len(key),
                min(members[key[:-1]]) if key else None,
                len(members[key]),
                len(children.get(key, [])),
                leaves[key],
                saved[key],
                hashlib.sha256(",".join(map(str, sorted(ends.get(key, [])))).encode()).hexdigest(),
            )
            for key in members
        ),
        key=repr,
    )


def branching(seed, n, longest, words=3):
    """Conversations that share beginnings of any length, in any order of their ids."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(10 * n), n):
        for turn in range(rng.randrange(1, longest)):
            text = f"t{rng.randrange(words) if rng.random() < 0.3 else 0} " * (1 + turn % 3)
            rows.append((c, turn, ("user", "assistant")[turn % 2], text))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def odd():
    same = [(k, t, "user", "é" * t) for k in range(100, 140) for t in (2, 1, 3)]
    return [
        *same,
        (0, None, None, "before"),
        (0, 3, "user", None),
        (0, 3, "user", None),
        (0, 1, "", ""),
        (4, 0, "user", "x"),
        (8, 0, "user", "alone"),
        (-7, 5, "a", "b"),
        (-7, 4, "ab", ""),
        (-5, 1, "a", "b"),
        (None, 1, "user", "x"),
        (41, 2**40, "user", "long " * 50_000),
        *((45, t, "user", f"{t % 7}") for t in range(5_000)),
        *((46, t, "user", f"{t % 7}") for t in range(5_000)),
    ]


def test_trie_of_odd_rows(spark, rows, odd):
    wider = [(*r, 1, "y", "z") for r in odd]
    table = spark.createDataFrame(wider, SCHEMA + ", depth int, x string, bytes string")
    expected = plain_trie(plain_conversations(odd))
    assert rows(conversation_trie(table.repartition(5)), *COLUMNS) == expected
    assert conversation_trie(table.limit(0)).collect() == []
    assert conversation_trie(table.filter("conv_id is null")).collect() == []


@pytest.mark.parametrize("block", [1, 3, 4])
def test_trie_of_shared_beginnings(spark, rows, block, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 2)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    texts = branching(block, 150, 14)
    table = spark.createDataFrame(texts, SCHEMA).repartition(4)
    found = conversation_trie(table, block=block)
    assert rows(found, *COLUMNS) == plain_trie(plain_conversations(texts))


def test_turns_of_one_number(spark):
    """Ties are ordered by role, then in an order of their own that never changes."""
    texts = [(5, 1, "b", "x"), (5, 1, "a", "y"), (5, 1, "a", "z"), (5, None, "z", "first")]
    seen = set()
    for parts in (1, 3):
        table = spark.createDataFrame(texts[:: 1 if parts == 1 else -1], SCHEMA).repartition(parts)
        seen.add(tuple(sorted(map(tuple, conversation_trie(table, every=1).collect()))))
    assert len(seen) == 1 and len(next(iter(seen))) == 5


def test_trie_query(spark, rows):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    texts = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    found = rows(queries()["op13_conversation_prefix_trie"](spark, SMALL), *COLUMNS)
    assert found == plain_trie(plain_conversations(texts))
