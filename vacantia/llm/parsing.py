"""A prefix-free style parse of byte texts: rolling-hash triggers cut them into phrases."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

#: Bytes of a match, of a trigger window, and the windows that a match holds.
LENGTH, TRIGGER = 50, 32
CHOICES = LENGTH - TRIGGER + 1
SEGMENT = 1 << 17
BASE = 6364136223846793005
MIX = np.uint64(0x9E3779B97F4A7C15)
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


@cache
def _powers(inverse: bool) -> np.ndarray:
    base = pow(BASE, -1, 1 << 64) if inverse else BASE
    out = np.full(SEGMENT + 2 * LENGTH, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(values: np.ndarray) -> np.ndarray:
    values = values * MIX
    values ^= values >> np.uint64(32)
    values *= MIX
    return values ^ (values >> np.uint64(29))


@dataclass
class Parse:
    """Phrase instances: trigger hash, phrase hash, document, first and last + 1 start of their
    matches in the block's bytes. Every string of LENGTH bytes of a document starts in exactly
    one phrase, that of the trigger which has the least hash in it (the first of equal ones), so
    equal strings lie in phrases with equal triggers wherever they occur."""

    trigger: np.ndarray
    phrase: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    strings: np.ndarray  # hash of the string at each byte, where one starts


def parse(data: np.ndarray, ends: np.ndarray) -> Parse:
    """Phrases of the documents that end at ``ends`` in ``data``, in segments of bounded size.

    A phrase that a segment's border cuts has another hash than whole ones, so that it is
    compared string by string; nothing is lost.
    """
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int8)
    long = ends - begins >= LENGTH
    valid[begins[long]] += 1
    valid[ends[long] - LENGTH + 1] -= 1
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    strings = np.zeros(len(data), np.uint64)
    parts = [_segment(data, valid, a, strings) for a in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT)]
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2
    doc = np.searchsorted(ends, columns[2], side="right")
    return Parse(columns[0], columns[1], doc, columns[2], columns[3], strings)


def _segment(data: np.ndarray, valid: np.ndarray, first: int, strings: np.ndarray) -> tuple[np.ndarray, ...]:
    part = data[first : first + SEGMENT + LENGTH - 1]
    count = len(part) - LENGTH + 1
    letters = part.astype(np.uint64) + np.uint64(1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * _powers(False)[: len(letters)], dtype=np.uint64)))
    inverse = _powers(True)
    rolling = mixed((prefix[TRIGGER:] - prefix[:-TRIGGER]) * inverse[: len(letters) - TRIGGER + 1])
    least = (rolling & HIGH) | np.arange(len(rolling), dtype=np.uint64)
    step = 1
    while 2 * step <= CHOICES:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < CHOICES:
        least = np.minimum(least[: step - CHOICES], least[CHOICES - step :])
    place = (least[:count] & LOW).astype(np.int64)
    strings[first : first + count] = mixed((prefix[LENGTH:] - prefix[:count]) * inverse[:count])
    at = np.flatnonzero(valid[first : first + count])
    if not len(at):
        return rolling[:0], rolling[:0], at, at
    new = np.flatnonzero((np.diff(at) > 1) | (np.diff(place[at]) != 0)) + 1
    start, end = at[np.concatenate(([0], new))], at[np.concatenate((new - 1, [len(at) - 1]))] + 1
    phrase = mixed((prefix[end + LENGTH - 1] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * MIX)
    return rolling[place[start]], phrase, start + first, end + first


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (first one first), and where groups of equal keys begin in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, np.flatnonzero(new)


def suffix_order(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the strings that start at ``starts``, by their first LENGTH bytes, and
    where runs of equal strings begin in it."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    keys = [np.ascontiguousarray(words[starts + o]).view(">u8").reshape(-1).astype(np.uint64) for o in range(0, LENGTH - 7, 8)]
    keys.append(np.ascontiguousarray(words[starts + LENGTH - 8]).view(">u8").reshape(-1).astype(np.uint64))
    return grouped(*keys)


def leading_parts(data: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the strings by a hash of their first 8 bytes, in parts of about ``size``; equal
    strings are in the same part."""
    n = -(-len(starts) // size)
    if n <= 1:
        return [np.arange(len(starts))]
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    number = np.empty(len(starts), np.int32)
    for at in range(0, len(starts), size):
        leading = np.ascontiguousarray(words[starts[at : at + size]]).view("<u8").reshape(-1)
        number[at : at + size] = (mixed(leading) >> np.uint64(33)) % np.uint64(n)
    order = np.argsort(number, kind="stable")
    return [part for part in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(part)]


def expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for counts[i] numbers, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
