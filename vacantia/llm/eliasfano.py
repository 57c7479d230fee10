"""Elias-Fano sequences and a trie level over them, read in place from one buffer (a file's memory map, or a table's value)."""

from __future__ import annotations

import numpy as np

SIX = tuple((np.uint64(step), np.uint64((1 << step) - 1)) for step in (32, 16, 8, 4, 2, 1))


def _select(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The place of the nth (from 0) set bit of each 64-bit word, by halving."""
    words, nth, place = words.copy(), nth.copy(), np.zeros(len(words), np.int64)
    for step, low in SIX:
        held = np.bitwise_count(words & low).astype(np.int64)
        above = nth >= held
        nth -= np.where(above, held, 0)
        place += np.where(above, int(step), 0)
        words = np.where(above, words >> step, words)
    return place


def _side_by_side(values: np.ndarray, bits: int) -> bytes:
    """The lowest ``bits`` (under 64) of each number, without gaps, in 64-bit words and one more."""
    out = np.zeros((len(values) * bits + 63) // 64 + 1, np.uint64)
    if len(values) and bits:
        offset = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
        word, shift = (offset >> np.uint64(6)).astype(np.int64), offset & np.uint64(63)
        low = values & np.uint64((1 << bits) - 1)
        begins = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[begins]] = np.bitwise_or.reduceat(low << shift, begins)
        over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))  # at most one a word
        out[word[over] + 1] |= low[over] >> (np.uint64(64) - shift[over])
    return out.tobytes()


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


class EliasFano:
    """A non-decreasing sequence of n numbers below a universe u in about n (2 + log2(u / n)) bits.

    The lower bits lie side by side; the upper ones are a bit vector with a one for each number,
    after as many zeros as the upper bits say. Counts of ones per word make ``access`` and
    ``successor`` a matter of few words. All methods take and return arrays.
    """

    def __init__(self, buffer: memoryview):
        self.n, self.low_bits, n_low, n_high = (int(x) for x in np.frombuffer(buffer, "<u8", 4))
        self.low = np.frombuffer(buffer, "<u8", n_low, 32)
        self.high = np.frombuffer(buffer, "<u8", n_high, 32 + 8 * n_low)
        self.ones = np.frombuffer(buffer, "<u8", n_high + 1, 32 + 8 * (n_low + n_high)).view(np.int64)
        self.zeros = 64 * np.arange(n_high + 1) - self.ones
        self.whole: np.ndarray | None = None

    def read(self) -> None:
        """Decode all numbers in one pass, for as many questions as there are numbers."""
        if self.whole is None:
            places = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
            self.whole = (places - np.arange(self.n)) << self.low_bits | self._low(np.arange(self.n))

    @staticmethod
    def encoded(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low_bytes = _side_by_side(values, bits)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(n + (top >> bits) + 1, np.uint8)
        high[places] = 1
        high_bytes = _padded(np.packbits(high, bitorder="little").tobytes())
        counts = np.bitwise_count(np.frombuffer(high_bytes, "<u8")).astype(np.int64)
        ones = np.concatenate(([0], np.cumsum(counts))).astype("<u8")
        header = np.array([n, bits, len(low_bytes) // 8, len(high_bytes) // 8], "<u8")
        return header.tobytes() + low_bytes + high_bytes + ones.tobytes()

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        offset = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (offset >> np.uint64(6)).astype(np.int64), offset & np.uint64(63)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (value & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        if self.whole is not None:
            return self.whole[i]
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = 64 * word + _select(self.high[word], i - self.ones[word])
        return (place - i) << self.low_bits | self._low(i)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have upper bits below ``high``: ones before the zero of that number."""
        nth = high - 1
        last = self.zeros[-1] - 1
        inside = np.clip(nth, 0, last)
        word = np.searchsorted(self.zeros, inside, side="right") - 1
        place = 64 * word + _select(~self.high[word], inside - self.zeros[word])
        return np.where(nth < 0, 0, np.where(nth > last, self.n, np.minimum(place - inside, self.n)))

    def successor(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first i in [start, end) whose number is at least x, else end; and that number, or -1."""
        if self.whole is not None:
            lo = np.clip(np.searchsorted(self.whole, x), start, end)
            return lo, np.where(lo < end, np.append(self.whole, -1)[np.minimum(lo, self.n)], -1)
        high = x >> self.low_bits
        lo, value = np.clip(self._below(high), start, end), np.full(len(x), -1)
        open_ = np.flatnonzero(lo < end)
        value[open_] = self.access(lo[open_])
        open_ = open_[value[open_] < x[open_]]  # the bucket of its upper bits has smaller numbers
        if len(open_):
            wanted, stop = x[open_], end[open_]
            low = lo[open_] + 1
            top = np.clip(self._below(high[open_] + 1), low, stop)  # the first number beyond the bucket is large enough
            while len(left := np.flatnonzero(low < top)):
                middle = (low[left] + top[left]) // 2
                less = self.access(middle) < wanted[left]
                low[left] = np.where(less, middle + 1, low[left])
                top[left] = np.where(less, top[left], middle)
            lo[open_], value[open_] = low, -1
            inside = np.flatnonzero(low < stop)
            value[open_[inside]] = self.access(low[inside])
        return lo, value


class TrieLevel:
    """The children of contexts: sorted context ids, monotone pointers to their children, children, and a code of each, in as few bytes as the largest needs.

    Children are stored relative to their context: each is its word id plus the last number of the
    context before, so the whole level is one non-decreasing sequence, and a word is found by a
    successor search for its number in the range of its context.
    """

    def __init__(self, buffer: bytes | memoryview):
        buffer = memoryview(buffer)
        sizes = np.frombuffer(buffer, "<u8", 4).astype(int)
        starts = 32 + np.cumsum([0, *sizes])
        parts = [buffer[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.contexts, self.pointers, self.children = map(EliasFano, parts[:3])
        width = int(np.frombuffer(parts[3], "<u8", 1)[0])
        self.codes = np.frombuffer(parts[3], f"<u{width}", self.children.n, 8)

    @staticmethod
    def encoded(context: np.ndarray, word: np.ndarray, code: np.ndarray) -> bytes:
        """Rows sorted by (context, word), each pair once."""
        edges = np.flatnonzero(np.diff(context, prepend=-1))
        ends = np.append(edges[1:], len(context)).astype(np.int64) if len(edges) else edges
        last = np.cumsum(word[ends - 1]) if len(ends) else ends  # of each context
        base = np.concatenate(([0], last[:-1])) if len(ends) else ends
        children = word + np.repeat(base, ends - edges)
        width = next(w for w in (1, 2, 4, 8) if int(code.max(initial=0)) < 1 << 8 * w)
        codes = np.array([width], "<u8").tobytes() + _padded(code.astype(f"<u{width}").tobytes())
        parts = [EliasFano.encoded(context[edges]), EliasFano.encoded(np.concatenate(([0], ends))), EliasFano.encoded(children), codes]
        return np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts)

    @classmethod
    def opened(cls, path: str) -> TrieLevel:
        """A level that was written to a file, memory-mapped."""
        return cls(np.memmap(path, np.uint8, mode="r").data)

    def find(self, context: np.ndarray, word: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
        """The number of each (context, word) among the children, or -1; equal contexts that follow each other are looked up once."""
        if not self.children.n or not len(context):
            return np.full(len(context), -1)
        if 8 * len(context) > self.children.n:
            for sequence in (self.contexts, self.pointers, self.children):
                sequence.read()
        parts = range(0, len(context), at_once)
        return np.concatenate([self._find(context[i : i + at_once], word[i : i + at_once]) for i in parts])

    def _find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        begins = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        once, n = context[begins], self.contexts.n
        at, value = self.contexts.successor(once, np.zeros(len(once), np.int64), np.full(len(once), n))
        known = np.flatnonzero(value == once)
        start, end, base = (np.zeros(len(once), np.int64) for _ in range(3))
        start[known], end[known] = self.pointers.access(at[known]), self.pointers.access(at[known] + 1)
        after = np.flatnonzero(start > 0)
        base[after] = self.children.access(start[after] - 1)
        of = np.repeat(np.arange(len(once)), np.diff(np.append(begins, len(context))))
        asked = np.flatnonzero((end > start)[of])
        of = of[asked]
        wanted = base[of] + word[asked]
        found, value = self.children.successor(wanted, start[of], end[of])
        out = np.full(len(context), -1)
        out[asked] = np.where(value == wanted, found, -1)
        return out
