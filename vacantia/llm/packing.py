"""Packing: concatenate all token streams and cut them into windows of equal length."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import byte_texts, chosen
from vacantia.session import materialize

Encoder = Callable[[list[bytes]], list[bytes]]


#: Where a full stop or comma follows an ASCII letter or digit, words of the tokenizer end.
#: The sign comes first in the pattern, so that only its places are looked at.
WORD_END = re.compile(rb"[.,](?<=[a-z0-9].)")


@functools.cache
def word_encoder(path: str, end_id: int, cached_words: int = 600_000) -> Encoder:
    """Texts to little-endian uint32 ids, each ended by ``end_id``.

    For tokenizers that lower-case, drop white space and never join across it: a text is the
    sequence of its parts between ASCII white space, so each distinct part is encoded once in a
    worker and remembered, until ``cached_words`` are. New parts are encoded many at a time with
    a mark of one id between them. Texts that hold the mark, or what may be the name of a special
    token, are encoded as they are.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer, mark = Tokenizer.from_file(path), b"\x00"
    known: dict[bytes, bytes] = {}

    def ids_of(text: bytes) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")

    end, mark_id = np.array([end_id], "<u4").tobytes(), ids_of(mark)[0]

    def learn(parts: list[bytes], size: int = 500) -> None:
        for i in range(0, len(parts), size):
            some = parts[i : i + size]
            ids = ids_of(b" \x00 ".join(some))
            cuts = (4 * np.flatnonzero(ids == mark_id)).tolist()
            coded = ids.tobytes()
            known.update(zip(some, (coded[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(coded)], strict=True)), strict=True))

    def encode(texts: list[bytes]) -> list[bytes]:
        plain = [mark not in t and b"<|" not in t for t in texts]
        parts = [WORD_END.sub(rb" \g<0>", t.lower()).split() if p else [] for t, p in zip(texts, plain, strict=True)]
        new = set().union(*parts).difference(known)
        if len(known) + len(new) > cached_words:
            known.clear()
            new = set().union(*parts)
        learn(list(new))
        get = known.__getitem__
        return [b"".join([*(map(get, ps) if p else [ids_of(t).tobytes()]), end]) for t, p, ps in zip(texts, plain, parts, strict=True)]

    return encode


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Callable[[], Encoder]) -> Iterator[pa.RecordBatch]:
    """Ids of each document, and its place in its partition's own token count."""
    encode, part, total = encoder(), TaskContext.get().partitionId(), 0
    for batch in batches:
        for start, texts in byte_texts(batch.column("__text"), 2 << 20):
            ids = encode(texts)
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            places = total + np.cumsum(lengths) - lengths
            total += int(lengths.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), part), pa.int32()), pa.array(places), pa.array(lengths),
                    batch.column("__id").slice(start, len(texts)), pa.array(ids, pa.binary()),
                ],
                names=["part", "place", "n", "__id", "ids"],
            )


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each document: those at the windows' boundaries are its boundary records."""
    for batch in batches:
        rows: list[tuple[int, int, int, int, int, int, bytes]] = []
        size = 0
        for row, (at, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "n", "ids")))):
            edges = [at, *range((at // length + 1) * length, at + n, length), at + n]
            for a, b in zip(edges, edges[1:]):
                rows.append((row, a - at, b - a, n, a // length, a % length, ids[4 * (a - at) : 4 * (b - at)]))
                size += 4 * (b - a)
                if size >= 8 << 20:
                    yield _pieces(batch, rows)
                    rows, size = [], 0
        yield _pieces(batch, rows)


def _pieces(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
    row, *numbers, ids = zip(*rows) if rows else [()] * 7
    return pa.RecordBatch.from_arrays(
        [batch.column("__id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in numbers), pa.array(ids, pa.binary())],
        names=["__id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
    )


def pack(docs: DataFrame, encoder: Callable[[], Encoder], *, id_col: str = "doc_id", text_col: str = "text", length: int = 4096) -> DataFrame:
    """Pieces (id, start, length, doc_tokens, sequence_id, offset, ids) of windows of ``length``.

    First pass: each task encodes its documents, numbers its tokens from 0 and writes both to the
    shared folder. The totals of the tasks, one row each, give every task its global offset by a
    prefix sum. Second pass: windows are cut at multiples of ``length``; a document that crosses
    some gets one piece a window. Only the last window can be short, and nothing is shuffled but
    the totals. Reading the written table makes offsets the same however often a task is repeated.

    A null or empty text has what the encoder gives for it (its end id). Null ids and repeated
    rows are packed like others, other columns are ignored, an empty table has no pieces, and
    long texts are packed whole. ``ids`` are little-endian unsigned 32-bit numbers.
    """
    frame = chosen(docs, id_col, text_col, (), ())
    kind = frame.schema["__id"].dataType.simpleString()
    coded = materialize(
        frame.mapInArrow(lambda batches: _encoded(batches, encoder), f"part int, place long, n long, __id {kind}, ids binary"), "tokens"
    )
    totals = coded.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    placed = coded.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("place")).alias("at"), "n", "__id", "ids")
    pieces = placed.mapInArrow(
        lambda batches: _cut(batches, length), f"__id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    return pieces.withColumnRenamed("__id", id_col)
