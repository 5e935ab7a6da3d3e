"""A compressed full-text index of word sequences: backward search over a wavelet tree."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits packed in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.uint32)
        self.before = np.concatenate([[0], np.cumsum(ones[:-1])]).astype(np.int64)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """The number of ones before each position."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletTree:
    """Ranks of symbols in a sequence, one bit vector per bit of the alphabet's width.

    The nodes of a level stand one after another in its bit vector: first those that came with
    a zero, then those with a one.
    """

    def __init__(self, sequence: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.levels, self.zeros = [], []
        current = sequence
        for shift in range(self.bits - 1, -1, -1):
            bit = (current >> shift) & 1
            self.levels.append(BitVector(bit.astype(np.uint8)))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        self.first = self._follow(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, zeros, shift in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1)):
            ones = level.ones(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._follow(symbol, i) - self.first[symbol]


def _pair_ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order-keeping numbers of pairs, from 1 on."""
    key = first * (int(second.max(initial=0)) + 1) + second
    return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


def _ahead(ranks: np.ndarray, distance: int) -> np.ndarray:
    out = np.zeros_like(ranks)
    if distance < len(ranks):
        out[: len(ranks) - distance] = ranks[distance:]
    return out


class FMIndex:
    """An index of segments (arrays of symbols from 1 on) for matches of up to ``depth`` words.

    The suffixes are sorted by ``depth`` words at least (by prefix doubling), which is as far
    as matches are followed. What is kept: the wavelet tree of the words before the sorted
    suffixes, and the intervals whose common prefix has ``depth`` or ``depth - 1`` words.
    """

    def __init__(self, segments: list[np.ndarray], alphabet: int, depth: int):
        self.depth = depth
        self.lengths = np.array([len(s) for s in segments], np.int64)
        end = np.zeros(1, np.int64)
        self.text = np.concatenate([x for s in segments for x in (s, end)]).astype(np.int64)
        self.begins = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        ranks, length = self.text.copy(), 1
        while length < depth:
            ahead = min(length, depth - length)
            if length + ahead == depth and depth > 1:
                shorter = ranks, length
            ranks = _pair_ranks(ranks, _ahead(ranks, ahead))
            length += ahead
        order = np.argsort(ranks, kind="stable")
        self.order = order
        at = ranks[order]
        new = np.concatenate([[True], at[1:] != at[:-1]])
        self.class_begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        if depth > 1:
            part, length = shorter
            ahead = depth - 1 - length
            near = _ahead(part, max(ahead, 0))[order]
            far = part[order]
            if ahead < 0:
                near = far
            wide = np.concatenate(
                [[True], (far[1:] != far[:-1]) | (near[1:] != near[:-1])]
            )
        else:
            wide = np.zeros(len(new), bool)
            wide[0] = True
        places = np.arange(len(wide))
        self.wide_begin = np.maximum.accumulate(np.where(wide, places, 0))
        last = np.concatenate([wide[1:], [True]])
        self.wide_end = np.minimum.accumulate(np.where(last, places, len(wide))[::-1])[::-1] + 1
        before = self.text[order - 1]  # of the first suffix: the end sign of the last segment
        self.tree = WaveletTree(before, alphabet)
        self.smaller = np.concatenate(
            [[0], np.cumsum(np.bincount(self.text, minlength=alphabet))]
        ).astype(np.int64)

    def matching_statistics(self, segments: list[np.ndarray]):
        """Stream segments through the index, from their ends on, all side by side.

        Yields, word by word, which segments have a word there, its place, how many words from
        there on match (``depth`` at most), and the interval of suffixes that match so far.
        A match that has reached ``depth`` gives up its last word first: its interval widens to
        that of the next shorter prefix. The segments must be among those of the index, so that
        at least their own place matches.
        """
        lengths = np.array([len(s) for s in segments], np.int64)
        begins = np.cumsum(lengths) - lengths
        words = np.concatenate(segments).astype(np.int64)
        active = np.argsort(-lengths, kind="stable")
        ordered = lengths[active]
        low = np.zeros(len(active), np.int64)
        high = np.full(len(active), len(self.text), np.int64)
        matched = np.zeros(len(active), np.int64)
        for step in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-ordered, -step, "left"))
            active, low, high, matched = active[:n], low[:n], high[:n], matched[:n]
            ordered = ordered[:n]
            place = ordered - 1 - step
            symbol = words[begins[active] + place]
            full = matched == self.depth
            low = np.where(full, self.wide_begin[low], low)
            high = np.where(full, self.wide_end[high - 1], high)
            matched = matched - full
            new = self.smaller[np.tile(symbol, 2)] + self.tree.rank(
                np.tile(symbol, 2), np.concatenate([low, high])
            )
            low, high, matched = new[:n], new[n:], matched + 1
            if (low >= high).any():
                raise ValueError("only segments of the index can be streamed")
            yield active, place, matched, low, high
