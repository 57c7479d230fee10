"""A word-level FM-index over one shard of text: wavelet-tree ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling. Symbol 0 separates passages; each separator is
    a letter of its own, so that comparisons end there."""
    n = len(symbols)
    gaps = symbols == 0
    n_gaps = int(gaps.sum())
    rank = np.where(gaps, np.cumsum(gaps) - 1, symbols.astype(np.int64) + n_gaps)
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + following
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletTree:
    """Bit planes of a sequence, highest bit first, each stably parted into zeros and ones."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.planes: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for bit in range(max(int(values.max(initial=0)).bit_length(), 1) - 1, -1, -1):
            ones = ((values >> bit) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = ones
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]))
            self.planes.append((bit, words, before, self.n - int(ones.sum())))
            values = np.concatenate((values[~ones], values[ones]))

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        low = (np.uint64(1) << rest) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & low)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        for bit, words, before, zeros in self.planes:
            one = ((symbol >> bit) & 1).astype(bool)
            ones_start, ones_end = self._ones(words, before, start), self._ones(words, before, end)
            start = np.where(one, zeros + ones_start, start - ones_start)
            end = np.where(one, zeros + ones_end, end - ones_end)
        return end - start


class FMIndex:
    """symbols: word numbers from 1, passages parted (and ended) by 0."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        order = suffix_array(symbols)
        self.last = symbols[order - 1]  # the column of preceding symbols; position -1 is the final 0
        self.tree = WaveletTree(self.last)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(symbols))))
        kept = (np.arange(len(symbols)) % sample == 0) | (np.roll(symbols, 1) == 0)
        marked = kept[order]
        self.marked, self.place = marked, np.cumsum(marked) - 1
        self.samples = order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of patterns, one row each, by backward search."""
        top = len(self.below) - 2
        known = (patterns <= top).all(axis=1)
        low, high = np.zeros(len(patterns), np.int64), np.where(known, len(self.last), 0)
        live = np.flatnonzero(known)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column]
            low[live] = self.below[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.tree.rank(symbol, high[live])
            live = live[high[live] > low[live]]
        found = np.zeros(len(patterns), bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to a sampled position and add the steps."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.marked[at])
        while len(walking):
            symbol = self.last[at[walking]]
            at[walking] = self.below[symbol] + self.tree.rank(symbol, at[walking])
            steps[walking] += 1
            walking = walking[~self.marked[at[walking]]]
        return self.samples[self.place[at]] + steps
