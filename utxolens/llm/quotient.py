"""Counting quotient filters of packed word-id n-grams: exact, compact counters.

An n-gram of word ids (``bits`` bits each) is two halves ``(left, right)``. A
small Feistel network permutes them; it can be undone, so nothing is lost. The
leading bits of the permuted left half are the quotient, everything else the
full remainder. A filter holds, sorted by (quotient, remainder): a bit vector
with each quotient's run length in unary, the remainders in fields of whole
bytes, and one byte a counter, 255 standing for a longer counter kept aside.
As filters are sorted, merging them is a merge of sorted lists, and a filter
can be cut into shards by the quotient's first bits, which spread evenly as
the permutation mixes all words of an n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_U = np.uint64
_ROUNDS = tuple(_U(0x9E3779B97F4A7C15 * k & (2 ** 64 - 1)) for k in (1, 3, 5, 7))
_MUL = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def mix(x: np.ndarray, key: np.uint64 = _U(0)) -> np.ndarray:
    """A 64-bit mixing function (multiply and shift)."""
    x = (x + key) * _MUL[0]
    x ^= x >> _U(29)
    x *= _MUL[1]
    return x ^ (x >> _U(32))


@dataclass(frozen=True)
class Shape:
    """Field widths of n-grams of ``n`` word ids of ``bits`` bits each."""

    n: int
    bits: int

    @property
    def left(self) -> int:
        return self.bits * ((self.n + 1) // 2)

    @property
    def right(self) -> int:
        return self.bits * (self.n // 2)

    def _masks(self) -> tuple[np.uint64, np.uint64]:
        return _U(2 ** self.left - 1), _U(2 ** self.right - 1)

    def pack(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Permuted halves of n-grams given as one column of ids per word."""
        half = (self.n + 1) // 2
        out = []
        for part in (columns[:half], columns[half:]):
            x = np.zeros(len(columns[0]), _U)
            for c in part:
                x = (x << _U(self.bits)) | c.astype(_U)
            out.append(x)
        (left, right), masks = out, self._masks()
        for r, key in enumerate(_ROUNDS):
            if r % 2 == 0:
                left = left ^ (mix(right, key) & masks[0])
            else:
                right = right ^ (mix(left, key) & masks[1])
        return left, right

    def unpack(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        """Columns of ids of permuted halves: the permutation undone."""
        masks = self._masks()
        for r, key in reversed(list(enumerate(_ROUNDS))):
            if r % 2 == 0:
                left = left ^ (mix(right, key) & masks[0])
            else:
                right = right ^ (mix(left, key) & masks[1])
        half, one = (self.n + 1) // 2, _U(2 ** self.bits - 1)
        columns = [(left >> _U(self.bits * (half - 1 - i))) & one for i in range(half)]
        columns += [(right >> _U(self.bits * (self.n - half - 1 - i))) & one
                    for i in range(self.n - half)]
        return [c.astype(np.int64) for c in columns]


@dataclass
class Counts:
    """Sorted distinct permuted keys and their counters."""

    left: np.ndarray
    right: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.left)


def merge(shape: Shape, parts: list[Counts]) -> Counts:
    """One sorted list with the counters of equal keys added up. The stable
    sort finds the sorted runs of the parts and merges those."""
    left = np.concatenate([p.left for p in parts])
    right = np.concatenate([p.right for p in parts])
    count = np.concatenate([p.count for p in parts])
    if not len(left):
        return Counts(left, right, count)
    if shape.left + shape.right <= 64:
        order = np.argsort((left << _U(shape.right)) | right, kind="stable")
    else:
        order = np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.concatenate(
        [[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    return Counts(left[first], right[first], np.add.reduceat(count[order], first))


def _fields(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unfields(blob: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, n * width).reshape(n, width)
    return out.view("<u8").ravel().astype(_U)


def to_filter(shape: Shape, c: Counts, shard_bits: int) -> bytes:
    """The filter of keys that share their first ``shard_bits`` bits."""
    n, free = len(c), shape.left - shard_bits
    q = min(free, max(0, int(n - 1).bit_length()))
    own = c.left & _U(2 ** free - 1)
    quotient = (own >> _U(free - q)).astype(np.int64) if free - q < 64 else np.zeros(n, np.int64)
    runs = np.zeros(2 ** q + n, bool)
    runs[quotient + np.arange(n)] = True          # a run's ones, then a zero for its quotient
    long = c.count >= 255
    return b"".join([
        np.array([n, q, long.sum()], "<i8").tobytes(), np.packbits(runs).tobytes(),
        _fields(own & _U(2 ** (free - q) - 1), -(-(free - q) // 8)), _fields(c.right, -(-shape.right // 8)),
        np.minimum(c.count, 255).astype(np.uint8).tobytes(), c.count[long].astype("<i8").tobytes()])


def from_filter(shape: Shape, blob: bytes, shard: int, shard_bits: int) -> Counts:
    """The keys and counters that a filter holds."""
    view = memoryview(blob)
    n, q, n_long = (int(v) for v in np.frombuffer(view, "<i8", 3))
    free, at = shape.left - shard_bits, 24
    size = (2 ** q + n + 7) // 8
    runs = np.unpackbits(np.frombuffer(view, np.uint8, size, at), count=2 ** q + n)
    quotient = (np.flatnonzero(runs) - np.arange(n)).astype(_U)
    at += size
    wide = [-(-(free - q) // 8), -(-shape.right // 8)]
    low = _unfields(view[at:], n, wide[0])
    at += n * wide[0]
    right = _unfields(view[at:], n, wide[1])
    at += n * wide[1]
    count = np.frombuffer(view, np.uint8, n, at).astype(np.int64)
    count[count == 255] = np.frombuffer(view, "<i8", n_long, at + n)
    head = _U(shard) << _U(free) if free < 64 else _U(0)
    return Counts(head | (quotient << _U(free - q)) | low, right, count)


class Counter:
    """Counts of one task: adds keys, and hands on filters by shard when it
    holds ``most`` keys, so its memory stays bounded."""

    def __init__(self, shape: Shape, shard_bits: int, most: int = 1_000_000):
        self.shape, self.shard_bits, self.most = shape, shard_bits, most
        self.parts: list[Counts] = []
        self.held = 0

    def add(self, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        if len(columns[0]):
            left, right = self.shape.pack(columns)
            self.parts.append(merge(self.shape, [Counts(left, right, np.ones(len(left), np.int64))]))
            self.held += len(self.parts[-1])
        if self.held >= self.most:
            yield from self.shrink()

    def shrink(self) -> Iterator[tuple[int, bytes]]:
        """Merge what is held; hand it on where that freed less than half."""
        self.parts = [merge(self.shape, self.parts)]
        self.held = len(self.parts[0])
        if self.held >= self.most // 2:
            yield from self.filters()

    def filters(self) -> Iterator[tuple[int, bytes]]:
        if not self.parts:
            return
        c = merge(self.shape, self.parts)
        self.parts, self.held = [], 0
        shard = (c.left >> _U(self.shape.left - self.shard_bits)).astype(np.int64)
        cut = np.flatnonzero(np.diff(shard, prepend=-1))
        for s, e in zip(cut, [*cut[1:], len(c)]):
            yield int(shard[s]), to_filter(self.shape, Counts(c.left[s:e], c.right[s:e], c.count[s:e]),
                                           self.shard_bits)
