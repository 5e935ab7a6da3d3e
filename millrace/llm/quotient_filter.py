"""Counting quotient filters: exact counters of 64-bit keys in little room.

A key is permuted, invertibly, so that keys of any kind spread evenly. Its high bits, the quotient,
are not stored: slots stand in the order of their quotients, an ``occupied`` bit per
quotient says whether it has any and a ``run end`` bit per slot where the next one's begin. The
remainder is stored in full, so a key is got back by inverting the permutation and nothing is lost.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

_U = np.uint64
# The multipliers of the SplitMix64 finalizer, and their inverses modulo 2 ** 64.
_FIRST, _SECOND = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_FIRST_BACK = _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
_SECOND_BACK = _U(pow(0x94D049BB133111EB, -1, 1 << 64))
_HEADER = "<QQBBQ"
#: Counts from here on have a place of their own.
_LARGE = 255


def permute(keys: np.ndarray) -> np.ndarray:
    """A permutation of all 64-bit values that spreads them evenly."""
    x = keys.astype(_U)
    x = (x ^ (x >> _U(30))) * _FIRST
    x = (x ^ (x >> _U(27))) * _SECOND
    return x ^ (x >> _U(31))


def restore(values: np.ndarray) -> np.ndarray:
    """The keys that ``permute`` gave these values."""
    x = values.astype(_U)
    x = (x ^ (x >> _U(31)) ^ (x >> _U(62))) * _SECOND_BACK
    x = (x ^ (x >> _U(27)) ^ (x >> _U(54))) * _FIRST_BACK
    return x ^ (x >> _U(30)) ^ (x >> _U(60))


def _packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other: whole bytes, then bits."""
    whole, rest = divmod(width, 8)
    rows = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(rows[:, whole : whole + 1], axis=1, bitorder="little")[:, :rest]
    return rows[:, :whole].tobytes() + np.packbits(bits, bitorder="little").tobytes()


def _unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    whole, rest = divmod(width, 8)
    rows = np.zeros((n, 8), np.uint8)
    rows[:, :whole] = np.frombuffer(data, np.uint8, n * whole).reshape(n, whole)
    if rest:
        tail = np.frombuffer(data, np.uint8, offset=n * whole)
        bits = np.unpackbits(tail, count=n * rest, bitorder="little").reshape(n, rest)
        rows[:, whole] = np.packbits(bits, axis=1, bitorder="little")[:, 0]
    return rows.view("<u8")[:, 0].astype(_U)


@dataclass
class CountingQuotientFilter:
    """Permuted keys of one shard, sorted, and their counts.

    A shard has the keys whose permuted form is in ``[low, low + 2 ** bits)``; those ``bits`` are
    divided into quotient and remainder when the filter is written.
    """

    low: int
    bits: int
    values: np.ndarray  # permuted keys in order
    counts: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, low: int = 0, bits: int = 64) -> CountingQuotientFilter:
        """Count keys, all of which belong to the shard."""
        values, counts = np.unique(permute(keys), return_counts=True)
        return cls(low, bits, values, counts.astype(_U))

    def keys(self) -> np.ndarray:
        return restore(self.values)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """The counts of the keys, 0 where there is none."""
        if not len(self.values):
            return np.zeros(len(keys), _U)
        values = permute(keys)
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        return np.where(self.values[at] == values, self.counts[at], _U(0))

    @staticmethod
    def merged(filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The filter of all keys of some filters of one shard: sorted runs are merged."""
        filters = list(filters)
        values = np.concatenate([f.values for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(values, kind="stable")  # merges runs that are sorted already
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else []
        return CountingQuotientFilter(
            filters[0].low,
            filters[0].bits,
            values[first],
            np.add.reduceat(counts, first) if len(values) else counts,
        )

    def pack(self) -> bytes:
        """The filter in bytes: occupied bits, run ends, remainders and counts."""
        n = len(self.values)
        quotient_bits = min(self.bits, max(0, n - 1).bit_length())
        width = self.bits - quotient_bits
        inside = self.values - _U(self.low)
        quotients = inside >> _U(width) if width < 64 else np.zeros(n, _U)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients.astype(np.int64)] = True
        ends = np.append(quotients[1:] != quotients[:-1], True)[:n]
        remainders = inside & _U((1 << width) - 1)
        large = self.counts >= _LARGE
        return b"".join(
            (
                struct.pack(_HEADER, n, self.low, self.bits, quotient_bits, int(large.sum())),
                np.packbits(occupied, bitorder="little").tobytes(),
                np.packbits(ends, bitorder="little").tobytes(),
                np.where(large, _LARGE, self.counts).astype(np.uint8).tobytes(),
                self.counts[large].astype("<u8").tobytes(),
                _packed(remainders, width),
            )
        )

    @classmethod
    def unpack(cls, data: bytes) -> CountingQuotientFilter:
        n, low, bits, quotient_bits, n_large = struct.unpack_from(_HEADER, data)
        at = struct.calcsize(_HEADER)

        def take(size: int) -> bytes:
            nonlocal at
            at += size
            return data[at - size : at]

        def flags(n: int) -> np.ndarray:
            part = np.frombuffer(take((n + 7) // 8), np.uint8)
            return np.unpackbits(part, count=n, bitorder="little").astype(bool)

        occupied, ends = flags(1 << quotient_bits), flags(n)
        counts = np.frombuffer(take(n), np.uint8).astype(_U)
        counts[counts == _LARGE] = np.frombuffer(take(8 * n_large), "<u8")
        width = bits - quotient_bits
        # The run of a slot is the number of run ends before it, that of a quotient its rank.
        run = np.cumsum(ends) - ends
        quotients = np.flatnonzero(occupied).astype(_U)[run]
        inside = _unpacked(data[at:], n, width)
        if width < 64:
            inside |= quotients << _U(width)
        return cls(low, bits, inside + _U(low), counts)


def shards(keys: np.ndarray, shard_bits: int) -> list[tuple[int, CountingQuotientFilter]]:
    """The filters of keys by shard: the first ``shard_bits`` bits of the permuted key."""
    values, counts = np.unique(permute(keys), return_counts=True)
    if not len(values):
        return []
    bits = 64 - shard_bits
    shard = (values >> _U(bits)).astype(np.int64) if shard_bits else np.zeros(len(values), np.int64)
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    ends = np.append(first[1:], len(values))
    return [
        (
            int(shard[a]),
            CountingQuotientFilter(
                int(shard[a]) << bits, bits, values[a:b], counts[a:b].astype(_U)
            ),
        )
        for a, b in zip(first.tolist(), ends.tolist())
    ]
