"""Suffix arrays, common prefixes and FM-indexes over arrays of symbols."""

from __future__ import annotations

import numpy as np


def dense(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct symbols, ascending, and the number of each symbol among them."""
    return np.unique(symbols, return_inverse=True)


def suffix_array(symbols: np.ndarray, kinds: int, levels: list | None = None) -> np.ndarray:
    """Suffixes of ``symbols`` (numbers below ``kinds``) in order, by prefix doubling.

    The first sort takes as many symbols as fit into 62 bits; later ones only order suffixes that still tie. A list
    given as ``levels`` gets (number of symbols, ranks): equal ranks mean equality in so many symbols.
    """
    n = len(symbols)
    bits = max(1, int(kinds).bit_length())
    width = max(1, 62 // bits)
    padded = np.zeros(n + width, np.int64)
    padded[:n] = symbols + 1
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    while True:
        if levels is not None:
            levels.append((width, rank.astype(np.int32)))
        alone = first.copy()
        alone[:-1] &= first[1:]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        suffix = order[tied]
        after = suffix + width
        key = (group[tied] << 32) | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.argsort(key, kind="stable")
        suffix, key = suffix[again], key[again]
        order[tied] = suffix
        first[tied[1:]] |= key[1:] != key[:-1]
        group[tied] = np.maximum.accumulate(np.where(first[tied], tied, 0))
        rank[suffix] = group[tied]
        width *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray, levels: list) -> np.ndarray:
    """How many symbols each suffix shares with the one before it in order."""
    n = len(symbols)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    a, b = order[:-1], order[1:]
    length = np.zeros(n - 1, np.int64)
    for width, rank in reversed(levels):
        x, y = a + length, b + length
        inside = np.maximum(x, y) < n
        equal = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        # Equal ranks near the end may stand for equal remainders that are shorter than the width.
        length += np.where(equal, width, 0)
    for _ in range(levels[0][0] - 1):
        x, y = a + length, b + length
        inside = np.maximum(x, y) < n
        equal = inside & (symbols[np.minimum(x, n - 1)] == symbols[np.minimum(y, n - 1)])
        if not equal.any():
            break
        length += equal
    shared[1:] = length
    return shared


class Bits:
    """A bit array with the number of ones before each place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        ones = np.bitwise_count(words).astype(np.int32)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.int32)
        self.zeros = int(len(bits) - ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Counts and finds patterns in an array of symbols.

    The Burrows-Wheeler transform is kept in a wavelet matrix, one bit array for each bit of a symbol; a rank is a
    walk down its levels. Every ``step``-th suffix position is kept; others are found by walking back to one.
    Symbols are at least 1; the array gets a 0 as its end.
    """

    def __init__(self, symbols: np.ndarray, kinds: int, step: int = 8) -> None:
        text = np.append(symbols, 0)
        self.n, self.kinds = len(text), kinds
        order = suffix_array(text, kinds)
        column = text[order - 1]
        counts = np.bincount(text, minlength=kinds)
        self.smaller = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.levels: list[tuple[int, Bits]] = []
        for bit in reversed(range(max(1, int(kinds - 1).bit_length()))):
            ones = (column >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones)))
            column = np.concatenate((column[~ones], column[ones]))
        everything = np.arange(kinds)
        self.origin = self._walk(everything, np.zeros(kinds, np.int64))
        sampled = order % step == 0
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, level in self.levels:
            ones = level.ones(at)
            at = np.where(symbol >> bit & 1, level.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before its place."""
        return self._walk(symbol, at) - self.origin[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one symbol earlier."""
        symbol, at = np.zeros(len(row), np.int64), row
        for bit, level in self.levels:
            ones, one = level.ones(at), level.get(at)
            symbol |= one.astype(np.int64) << bit
            at = np.where(one, level.zeros + ones, at - ones)
        return self.smaller[symbol] + at - self.origin[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns; one pattern in each row, from its last symbol to its first, then anything."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] if len(patterns) else 0):
            live = live[(lengths[live] > j) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = patterns[live, j]
            low[live] = self.smaller[symbol] + self.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the array the suffixes of these rows begin."""
        out, steps = np.empty(len(rows), np.int64), 0
        open_, at = np.arange(len(rows)), rows
        while len(open_):
            found = self.sampled.get(at)
            out[open_[found]] = self.positions[self.sampled.ones(at[found])] + steps
            open_, at = open_[~found], at[~found]
            at = self.back(at)
            steps += 1
        return out
