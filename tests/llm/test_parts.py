"""The parts of the operators against plain searches."""

import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm.fm_index import BitVector, FMIndex, WaveletTree
from millrace.llm.jaccard import Bounds, token_keys
from millrace.llm.near_vectors import nearest_e8, shortest_vectors
from millrace.llm.packing import best_fit, bin_completion, lower_bound, slots
from millrace.llm.substring import first_places, window_runs


def test_bit_vector_and_wavelet_tree():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, 300).astype(np.uint8)
    places = np.arange(301)
    assert BitVector(bits).ones(places).tolist() == [int(bits[:i].sum()) for i in places]
    sequence = rng.integers(0, 11, 500)
    tree = WaveletTree(sequence, 11)
    for symbol in range(11):
        expected = [int((sequence[:i] == symbol).sum()) for i in range(501)]
        assert tree.rank(np.full(501, symbol), np.arange(501)).tolist() == expected


@pytest.mark.parametrize("depth", [2, 3, 4, 5, 20])
def test_matching_statistics(depth):
    rng = random.Random(depth)
    segments = [
        np.array([rng.choice([1, 2, 3]) for _ in range(rng.randrange(1, 40))]) for _ in range(12)
    ]
    index = FMIndex(segments, 4, depth)
    text = index.text.tolist()
    seen = set()
    for which, place, matched, low, high in index.matching_statistics(segments):
        for k, p, m, a, b in zip(which, place, matched, low, high):
            pattern = segments[k][p : p + m].tolist()
            assert m == min(depth, len(segments[k]) - p)
            found = [i for i in range(len(text)) if text[i : i + m] == pattern]
            assert sorted(index.order[a:b].tolist()) == found
            seen.add((k, p))
    assert len(seen) == sum(map(len, segments))


def test_first_places():
    segments = [b"a b c d e", b"x b c d y", b"b c d b c d"]
    documents, words = first_places(segments, [(7, 10), (7, 2), (3, 0)], 3)
    assert [d.tolist() for d in documents] == [[7, 3, 7], [7, 3, 7], [3, 3, 3, 3]]
    assert [w.tolist() for w in words] == [[10, 0, 12], [2, 0, 4], [0, 1, 2, 0]]


def test_window_runs_cover_every_window_once():
    rng = np.random.default_rng(3)
    for n in (0, 5, 20, 21, 500):
        hashes = rng.integers(0, 30, n).astype(np.uint64)
        keys, first, number, weight = window_runs(hashes, 20)
        covered = [i for f, k in zip(first, number) for i in range(f, f + k)]
        assert covered == list(range(max(0, n - 19)))
    _, _, number, weight = window_runs(np.ones(400, np.uint64), 20)
    assert number.sum() == 381 and (weight == 2).all()


def test_nearest_lattice_point():
    steps = shortest_vectors()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    y = np.random.default_rng(4).normal(size=(300, 8)) * 3
    point = nearest_e8(y)
    distance = ((y - point) ** 2).sum(1)
    assert (distance <= 1 + 1e-9).all()  # the covering radius
    around = ((y[:, None] - point[:, None] - steps[None]) ** 2).sum(2)
    assert (distance <= around.min(1) + 1e-9).all()
    assert np.allclose(nearest_e8(point), point)


def fewest(lengths, capacity):
    """The least number of bins, by trying all."""
    best = [len(lengths)]

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= lengths[k] and rooms[i] not in rooms[:i]:
                put(k + 1, rooms[:i] + [rooms[i] - lengths[k]] + rooms[i + 1 :])
        put(k + 1, rooms + [capacity - lengths[k]])

    put(0, [])
    return best[0]


def test_bin_completion():
    rng = random.Random(5)
    better = 0
    for _ in range(60):
        lengths = sorted((rng.randrange(5, 60) for _ in range(11)), reverse=True)
        counts = {x: lengths.count(x) for x in lengths}
        packed = bin_completion(counts, 100)
        total = sum(n for _, n in packed)
        assert all(sum(part) <= 100 for part, _ in packed)
        placed = [x for part, n in packed for x in part for _ in range(n)]
        assert sorted(placed, reverse=True) == lengths
        best = fewest(lengths, 100)
        assert lower_bound(counts, 100) <= best <= total <= best + 1
        better += total < sum(n for _, n in best_fit(counts, 100))
    assert better  # the search improves on best fit somewhere
    assert bin_completion({}, 100) == []


def test_slots_are_disjoint():
    counts = {700: 10**9, 300: 7, 5: 10**6, 2048: 3}
    packed = bin_completion(counts, 2048)
    table = slots(packed)
    assert all((np.diff(rows[:, 0]) > 0).all() for rows in table.values())
    used = {length: sum(n * part.count(length) for part, n in packed) for length in counts}
    assert used == counts


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(6)
    for certain in (5, 30):
        bounds = Bounds(85, certain)
        for n in (1, 3, 8, 20, 39, 47, 60, 200, 900):
            for _ in range(8):
                x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                y = np.array(sorted(x), np.uint64)
                m = int(rng.integers(len(x), len(x) * 100 // 85 + 1))
                while len(y) < m:
                    y = np.unique(np.append(y, rng.integers(0, 2**63, 1).astype(np.uint64)))
                while True:  # take tokens away as long as they stay similar
                    shorter = np.delete(y, rng.integers(0, len(y)))
                    shared = len(np.intersect1d(x, shorter))
                    if not len(shorter) or not bounds.similar(shared, len(x), len(shorter)):
                        break
                    y = shorter
                sides = [s[: bounds.prefix(len(s))] for s in (x, y)]
                common = np.intersect1d(*sides)
                for count in (2, 1000):
                    keys = [
                        token_keys(common, np.full(len(common), count), len(s), bounds)
                        for s in (x, y)
                    ]
                    assert np.intersect1d(*keys).size, (certain, n, count)


def test_pairs_of_equal_tokens_do_not_depend_on_their_order():
    bounds = Bounds(85, 30)
    tokens = np.arange(1, 60, dtype=np.uint64)
    counts = np.full(59, 100)
    keys = token_keys(tokens, counts, 100, bounds)
    assert (keys == token_keys(tokens[::-1].copy(), counts, 100, bounds)).all()


@pytest.mark.parametrize(
    "capacity, counts, least",
    [
        (100, {12: 2, 20: 1, 24: 1, 27: 2, 31: 1, 33: 1, 40: 3, 44: 1, 49: 3}, 5),
        (60, {9: 2, 11: 2, 12: 3, 14: 1, 16: 3, 17: 1, 23: 1, 27: 3, 29: 1, 34: 2}, 6),
    ],
)
def test_bin_completion_goes_on_after_an_exact_filling(capacity, counts, least):
    fillings = bin_completion(counts, capacity)
    assert sum(n for _, n in fillings) == lower_bound(counts, capacity) == least
    assert all(sum(lengths) <= capacity for lengths, _ in fillings)
    used = Counter()
    for lengths, n in fillings:
        for length in lengths:
            used[length] += n
    assert used == counts
