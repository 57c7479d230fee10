"""Texts in blocks that ask a table of entries about their words and pairs of words, and get one answer a block.

Texts never travel: a block is written once with its rows, the keys that may have entries, and for
each row which of them it holds. Distinct keys of a block meet the entries in a join, and what they
found comes back to the block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.text import folded
from vacantia.session import scratch_path

#: Bytes of text in a block, and in a piece that is looked through at once.
BLOCK_BYTES, PIECE_BYTES = 32 << 20, 1 << 20
#: Bits of the filter that each key sets, bits it has for each at least, and at most in all: with more keys than that asks
#: for, more of the others pass, which the join leaves out.
PLACES, KEY_BITS, MAX_BITS = 3, 24, 1 << 27
BLOCK_SHAPE = "block long, rows binary, held array<string>"
BLOCKS = pa.schema([("block", pa.int64()), ("rows", pa.binary()), ("held", pa.list_(pa.string()))])

_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def spaced_words(text: Column) -> Column:
    """The text's words, each with one sign after it: a blank where one blank parts it from the next, else TAB.

    A word's key is the word, and a pair's key is what lies between the first one's beginning and
    the second one's end. There may be a sign before the first word. Null holds no word.
    """
    parted = F.regexp_replace(F.regexp_replace(folded(text), r"(?U)[^\w ]+", "\t"), "[ \t]{2,}", "\t")
    return F.coalesce(F.concat(parted, F.lit("\t")), F.lit("\t"))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.cumprod(factors)
    return _POWERS[0][:n], _POWERS[1][:n]


def hashes(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each of the byte strings, from running sums over a piece at a time; equal strings have equal ones."""
    out, window = np.empty(len(starts), np.uint64), starts // PIECE_BYTES
    for w in np.unique(window):
        here, at = np.flatnonzero(window == w), w * PIECE_BYTES
        first, last = starts[here] - at, ends[here] - at
        piece = letters[at : at + last.max()]
        up, down = _powers(len(piece) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:-1])))
        out[here] = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(32))


def _place(x: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th bit of each hash in a filter of ``bits``, a power of two."""
    return ((x + np.uint64(i) * ((x >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins, and the end."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    letters = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data else np.zeros(0, np.uint8)
    return letters, edges - edges[0]


def _key_places(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        letters, edges = letters_of(batch.column(0))
        x = hashes(letters, edges[:-1], edges[1:])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_place(x, i, bits) for i in range(PLACES)]))], ["at"])


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bytes of a filter that all keys pass and few others; bits are combined in Spark, only words reach the driver."""
    bits = max(64, min(MAX_BITS, 1 << (KEY_BITS * keys.count()).bit_length()))
    places = keys.select("key").mapInArrow(lambda b: _key_places(b, bits), "at long")
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    made, out = words.toArrow(), np.zeros(bits // 64, "<i8")
    out[made["word"].to_numpy()] = made["bits"].to_numpy()
    return out.view(np.uint8)


def passing_keys(column: pa.Array, passed: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Keys of spaced words that pass the filter: the row of each, in order, and the key; a row may repeat a key."""
    letters, edges = letters_of(column)
    ends = np.flatnonzero((letters == 9) | (letters == 32))
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))[: len(ends)]
    word = ends > starts
    starts, ends = starts[word], ends[word]
    rows = np.searchsorted(edges, starts, "right") - 1
    first = np.flatnonzero(rows[1:] == rows[:-1])
    starts, ends, rows = np.concatenate((starts, starts[first])), np.concatenate((ends, ends[first + 1])), np.concatenate((rows, rows[first]))
    x, here = hashes(letters, starts, ends), np.arange(len(rows))
    for i in range(PLACES):
        at = _place(x[here], i, 8 * len(passed))
        here = here[(passed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    here = here[np.argsort(rows[here], kind="stable")]
    data = letters.tobytes()
    return rows[here], [data[s:e] for s, e in zip(starts[here].tolist(), ends[here].tolist(), strict=True)]


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(bytes, rows) of pieces with at most so many bytes of spaced words; no text is cut."""
    _, edges = letters_of(batch.column(batch.num_columns - 1))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(edges, edges[start] + most, "right")) - 1)
        yield int(edges[end] - edges[start]), batch.slice(start, end - start)
        start = end


class Block:
    """Rows as Arrow data, each with the numbers of the keys that it holds, and the keys by number."""

    def __init__(self):
        self.size, self.numbers = 0, {}
        self.sink, self.out = pa.BufferOutputStream(), None

    def add(self, piece: pa.RecordBatch, passed: np.ndarray) -> None:
        """Rows whose last column has their spaced words, which is not kept."""
        rows, keys = passing_keys(piece.column(piece.num_columns - 1), passed)
        ids = np.array([self.numbers.setdefault(k, len(self.numbers)) for k in keys], np.int64)
        once = np.unique((rows << 32) | ids)
        edges, ids = np.searchsorted(once, np.arange(piece.num_rows + 1) << 32), once & 0xFFFFFFFF
        held = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
        made = pa.RecordBatch.from_arrays([*piece.columns[:-1], held], [*piece.schema.names[:-1], "_keys"])
        self.out = self.out or pa.ipc.new_stream(self.sink, made.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.out.write_batch(made)

    def written(self, number: int) -> pa.RecordBatch:
        self.out.close()
        data, keys = self.sink.getvalue(), pa.array([[k.decode() for k in self.numbers]], BLOCKS.field("held").type)
        rows = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, data.size], np.int32)), data])
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), rows, keys], schema=BLOCKS)


def _blocks(batches: Iterator[pa.RecordBatch], passed: np.ndarray, block_bytes: int) -> Iterator[pa.RecordBatch]:
    number, block = TaskContext.get().partitionId() << 32, Block()
    for batch in batches:
        for size, piece in _pieces(batch, min(PIECE_BYTES, block_bytes)):
            block.add(piece, passed)
            block.size += size
            if block.size >= block_bytes:
                yield block.written(number)
                number, block = number + 1, Block()
    if block.out:
        yield block.written(number)


def _table(blocks: DataFrame, name: str) -> DataFrame:
    """Blocks written once to the shared folder, bucketed so that answers meet them where they lie; the catalog's entry goes at once."""
    spark, table = blocks.sparkSession, f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(buckets, "block").option("path", scratch_path(spark, name)).option("compression", "zstd").saveAsTable(table)
    read = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return read


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block with the entries of their keys."""
    for batch in batches:
        for i in range(batch.num_rows):
            found = batch.column("answers")[i].values
            if found is None:
                found = pa.array([], batch.schema.field("answers").type.value_type)
            numbers, entries = found.field("n").to_numpy(), found.field("entry")
            order = np.argsort(numbers, kind="stable")
            numbers = numbers[order]
            for piece in pa.ipc.open_stream(batch.column("rows")[i].as_buffer()):
                keys = piece.column(piece.num_columns - 1)
                asked, edges = keys.values.to_numpy(), keys.offsets.to_numpy()
                first = np.searchsorted(numbers, asked)
                counts = np.searchsorted(numbers, asked, "right") - first
                ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
                places = np.arange(ends[-1]) + np.repeat(first - ends[:-1], counts)
                given = pa.ListArray.from_arrays(pa.array(ends[edges], pa.int32()), entries.take(pa.array(order[places])))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], given], [*piece.schema.names[:-1], "_candidates"])


def with_candidates(df: DataFrame, text: str, index: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row with the entries of ``index`` (key, entry) whose key is one of its text's words or pairs of words.

    One pass over the texts writes them in blocks, with the keys that pass a filter of the index's;
    each block asks for each of its keys once. What is shuffled grows with blocks times their
    distinct keys that are in the index, not with texts or words. ``_candidates`` may hold an
    entry once for each of its keys, in no order.
    """
    passed = key_filter(index)
    spaced = df.withColumn("_words", spaced_words(F.col(text)))
    blocks = _table(spaced.mapInArrow(lambda b: _blocks(b, passed, block_bytes), BLOCK_SHAPE), "texts")
    sent = blocks.select("block", F.posexplode("held").alias("n", "key"))
    answers = sent.join(index, "key").groupBy("block").agg(F.collect_list(F.struct("n", "entry")).alias("answers"))
    joined = blocks.select("block", "rows").join(answers.hint("shuffle_hash"), "block", "left")
    shape = T.StructType([*df.schema.fields, T.StructField("_candidates", T.ArrayType(index.schema["entry"].dataType))])
    return joined.mapInArrow(_answered, shape)
