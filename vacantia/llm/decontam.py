"""Benchmark decontamination: an FM-index per shard of documents, searched for all test windows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import TEXT, byte_texts, chosen, named, passed_on, text_of
from vacantia.llm.fmindex import FMIndex

#: Letters of a word are 0-9, A-Z (lower-cased), a-z and all beyond ASCII; the rest are gaps.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
MADE = ("n_words", "hit_spans", "item_ids")
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class Windows:
    """Distinct test windows of a block of items: word numbers by length, and the items of each, in packed arrays."""

    vocabulary: dict[bytes, int]
    patterns: dict[int, np.ndarray]
    names: list[str]
    starts: dict[int, np.ndarray]
    numbers: dict[int, np.ndarray]

    @property
    def shortest(self) -> int:
        return min(self.patterns, default=1)

    def items(self, length: int, window: int) -> list[str]:
        starts = self.starts[length]
        return [self.names[i] for i in self.numbers[length][starts[window] : starts[window + 1]]]


def windows_of(pieces: Iterable[tuple[str, list[bytes]]], width: int) -> Windows:
    """Windows of pieces (item, words): all of ``width`` words, or a shorter piece whole."""
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    found: dict[int, list[np.ndarray]] = defaultdict(list)
    owners: dict[int, list[np.ndarray]] = defaultdict(list)
    for item, words in pieces:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32)
        if not len(ids):
            continue
        windows = np.lib.stride_tricks.sliding_window_view(ids, min(width, len(ids)))
        found[windows.shape[1]].append(windows)
        owners[windows.shape[1]].append(np.full(len(windows), names.setdefault(item, len(names)), np.int32))
    out = Windows(vocabulary, {}, list(names), {}, {})
    for n, parts in found.items():
        patterns, at = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
        pairs = np.unique(np.stack((at.reshape(-1), np.concatenate(owners[n]))), axis=1)
        out.patterns[n] = patterns
        out.starts[n], out.numbers[n] = np.searchsorted(pairs[0], np.arange(len(patterns) + 1)), pairs[1].astype(np.int32)
    return out


def _pieces(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[pa.RecordBatch]:
    """Items in pieces of at most ``size`` words that overlap by ``width`` - 1, so that each window lies in one, and their windows."""
    for batch in batches:
        for start, texts in byte_texts(batch.column("text")):
            for item, text in zip(batch.column("item").slice(start, len(texts)).to_pylist(), texts, strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - width + 1), size - width + 1):
                    piece = words[at : at + size]
                    n = max(1, len(piece) - width + 1) if piece else 0
                    yield pa.RecordBatch.from_pydict({"item": [item], "at": [at], "words": pa.array([b" ".join(piece)], pa.binary()), "n": [n]})


@dataclass
class Shard:
    """Passages of documents that consist of benchmark words only, and where they come from.

    A document word that no item has cannot lie in an occurrence, and neither can a run of item
    words shorter than the shortest window: those words separate the passages of the index.
    """

    windows: Windows
    symbols: list[np.ndarray] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)
    places: list[np.ndarray] = field(default_factory=list)
    n_symbols: int = 0

    def add(self, first: int, words: list[list[bytes]]) -> None:
        """Documents with row numbers from ``first``."""
        get, ids = self.windows.vocabulary.get, [0]
        for document in words:
            ids.extend([get(w, 0) for w in document])
            ids.append(0)
        symbols = np.array(ids, np.int64)
        gaps = np.flatnonzero(symbols == 0)
        lengths = np.diff(gaps)  # a passage and the gap after it
        fit = lengths > self.windows.shortest
        if not fit.any():
            return
        starts, lengths = gaps[:-1][fit] + 1, lengths[fit]
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        begins = np.concatenate(([1], 1 + np.cumsum([len(w) + 1 for w in words])[:-1]))
        row = np.searchsorted(begins, at, side="right") - 1
        self.symbols.append(symbols[at])
        self.rows.append(row + first)
        self.places.append(at - begins[row])
        self.n_symbols += len(at)

    def hits(self) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """By row: merged spans of hit words, and the items found."""
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        if not self.symbols:
            return spans, items
        symbols, rows, places = (np.concatenate(x) for x in (self.symbols, self.rows, self.places))
        index = FMIndex(symbols)
        cover = np.zeros(len(symbols) + 1, np.int64)
        for length, patterns in self.windows.patterns.items():
            low, high = index.search(patterns)
            counts = high - low
            which = np.repeat(np.arange(len(patterns)), counts)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            position = index.locate(low[which] + nth)
            np.add.at(cover, position, 1)
            np.add.at(cover, position + length, -1)
            pairs = np.unique(np.stack((rows[position], which), axis=1), axis=0) if len(which) else []
            for row, window in pairs:
                items[int(row)].update(self.windows.items(length, int(window)))
        hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        if len(hit):
            new = (np.diff(hit) > 1) | (np.diff(rows[hit]) != 0) | (np.diff(places[hit]) != 1)
            firsts = np.concatenate(([0], np.flatnonzero(new) + 1))
            lasts = np.concatenate((firsts[1:] - 1, [len(hit) - 1]))
            for a, b in zip(hit[firsts], hit[lasts], strict=True):
                spans[int(rows[a])].append((int(places[a]), int(places[b]) + 1))
        return spans, items


def _search(batches: Iterator[pa.RecordBatch], windows: Windows, last: bool, shard_symbols: int, held: int) -> Iterator[pa.RecordBatch]:
    shard, waiting, n_words, size = Shard(windows), [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        spans, items = shard.hits()
        row = 0
        for batch in waiting:
            at = range(row, row + batch.num_rows)
            before = {name: batch.column(name).to_pylist() for name in MADE if name in batch.schema.names}
            all_spans = [spans.get(r, []) for r in at]
            all_items = [items.get(r, set()) for r in at]
            if before:
                all_spans = [_united(a, [(x["start"], x["end"]) for x in b]) for a, b in zip(all_spans, before["hit_spans"])]
                all_items = [a | set(b) for a, b in zip(all_items, before["item_ids"])]
            made = (
                pa.array([n_words[r] for r in at], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in x] for x in all_spans], ARROW_SPANS),
                pa.array([sorted(x) for x in all_items], pa.list_(pa.string())),
            )
            passed = [n for n in batch.schema.names if n not in MADE and not (last and n == TEXT)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in passed), *made], names=[*passed, *MADE])
            row += batch.num_rows

    for batch in batches:
        carried = passed_on(batch) if last else batch
        for start, slice_ in byte_texts(text_of(batch)):
            words = [words_of(x) for x in slice_]
            shard.add(len(n_words), words)
            n_words.extend(map(len, words))
            waiting.append(carried.slice(start, len(words)))
            size += waiting[-1].nbytes
            if shard.n_symbols >= shard_symbols or size >= held:
                yield from flush()
                shard, waiting, n_words, size = Shard(windows), [], [], 0
    yield from flush()


def _united(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", keep: tuple[str, ...] = (), width: int = 13, shard_symbols: int = 1_000_000,
    held_bytes: int = 64 << 20, block_windows: int = 1 << 19, piece_words: int = 1 << 16,
) -> DataFrame:
    """Documents with n_words, hit_spans (word numbers, end exclusive) and item_ids (sorted texts).

    Each task cuts its documents into shards of bounded size and builds an FM-index of each, so
    nothing is shuffled. Test windows (``width`` consecutive item words, or a whole shorter item)
    are found by backward search, occurrences by sampled suffix positions; overlapping spans are
    merged. Long items are cut into overlapping pieces of ``piece_words``, and the benchmark is
    read in blocks of about ``block_windows`` windows in packed arrays (60 bytes each, and the
    distinct words), each broadcast for one pass over the documents; a larger benchmark takes more
    passes, not larger broadcasts.

    Null or empty texts have no words and no hits; items without words are never found. Repeated
    rows are judged each on its own; repeated item ids count once; a null item id is the text
    "null". A null document id is kept. ``keep`` names columns to pass on; one that has the name
    of a result column is replaced by it. Long texts are read whole.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).cast("binary").alias("text"),
    )
    cut = items.mapInArrow(lambda b: _pieces(b, width, max(piece_words, 2 * width)), "item string, at long, words binary, n long")
    total = cut.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_windows))
    frame = chosen(docs, id_col, text_col, keep, MADE)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    made = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", span), T.StructField("item_ids", T.ArrayType(T.StringType()))]
    given = list(frame.schema.fields)
    for block in range(blocks):
        rows = cut.where(F.pmod(F.xxhash64("item", "at"), F.lit(blocks)) == block) if blocks > 1 else cut
        shared = spark.sparkContext.broadcast(windows_of(((r.item, bytes(r.words).split()) for r in rows.toLocalIterator()), width))
        last = block == blocks - 1

        def search(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            return _search(batches, shared.value, last, shard_symbols, held_bytes)

        frame = frame.mapInArrow(search, T.StructType([*(f for f in given if not (last and f.name == TEXT)), *made]))
    return named(frame, id_col, text_col)


def contaminated() -> Column:
    """The contract's rule over the columns of find_contamination."""
    n_hit = hit_words()
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def hit_words() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
