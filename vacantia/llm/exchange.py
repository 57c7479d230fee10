"""Blocks of documents that ask shards about their keys: one message per block and shard, one answer back."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.session import materialize, scratch_path

ANSWERS = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("answer", pa.binary())])
ANSWER_SHAPE = "block long, shard long, answer binary"


def squeezed(data: bytes) -> bytes:
    """Compressed, if that makes it shorter."""
    small = pa.compress(data, "zstd", asbytes=True) if len(data) > 128 else data
    return len(data).to_bytes(6, "little") + small if len(small) < len(data) else bytes(6) + data


def unsqueezed(data: bytes) -> bytes:
    size = int.from_bytes(data[:6], "little")
    return pa.decompress(data[6:], size, "zstd", asbytes=True) if size else data[6:]


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers with as many bytes each as the largest needs, plane by plane, compressed."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + squeezed(values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    width, planes = data[0], unsqueezed(data[1:])
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view("<i8").reshape(-1)


def words_array(data: bytes) -> pa.Array:
    """Words joined by single spaces, each an element; no bytes are one empty word."""
    letters = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(letters == 32)
    ends = np.append(gaps, len(letters)) - np.arange(len(gaps) + 1)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(letters[letters != 32].tobytes())])


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.diff(values, prepend=values[:1] - 1) != 0]


def expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... (counts[i] of them), one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """A hash's remainder: keys of any pattern are dealt evenly."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards that keys go to; an order that puts each shard's keys together, as they were; where each shard's begin, and the end."""
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)])) if len(order) else np.array([0])
    return shard[order[edges[:-1]]] if len(order) else edges[:0], order, edges


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def by_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The messages of one shard after the other."""
    for shard, group in groupby(rows_of(batches), key=lambda r: r["shard"]):
        yield shard, list(group)


def answer_rows(shard: int, blocks: list[int], answers: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([shard] * len(blocks), pa.int64()), pa.array(answers, pa.binary())], schema=ANSWERS)


def joined_answers(answers: list[dict] | None, order: np.ndarray, columns: int = 1) -> np.ndarray:
    """For each key that was sent in ``order`` its ``columns`` values, a row of the result each."""
    out = np.empty((columns, len(order)), np.int64)
    out[:, order] = ordered_answers(answers, columns)
    return out


def ordered_answers(answers: list[dict] | None, columns: int = 1) -> np.ndarray:
    """The ``columns`` values of each key, a row of the result each, in the order that keys were sent in."""
    parts = [unpacked(a["answer"]).reshape(columns, -1) for a in sorted(answers or [], key=lambda a: a["shard"])]
    return np.concatenate(parts, axis=1) if parts else np.empty((columns, 0), np.int64)


def partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def block_table(blocks: DataFrame, name: str) -> DataFrame:
    """Blocks written once to the shared folder, bucketed so that answers meet them where they lie.

    The catalog's entry is only needed to resolve the table and goes at once; the files stay.
    """
    spark, table = blocks.sparkSession, f"{name}_{uuid.uuid4().hex}"
    blocks.write.bucketBy(partitions(blocks), "block").option("path", scratch_path(spark, name)).option("compression", "zstd").saveAsTable(table)
    read = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return read


def asked(sent: DataFrame, judge: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str | None) -> DataFrame:
    """Answers (block, shard, answer) of ``judge``, which gets the messages sorted by shard and block; written if named."""
    dealt = sent.repartition(partitions(sent), "shard").sortWithinPartitions("shard", "block")
    answers = dealt.mapInArrow(judge, ANSWER_SHAPE)
    return materialize(answers, name) if name else answers


def with_answers(blocks: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """Each block with the answers that it got; only these are shuffled."""
    held = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias(column))
    return blocks.join(held.hint("shuffle_hash"), "block", "left")
