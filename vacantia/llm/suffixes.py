"""Suffix-array deduplication over a prefix-free style parse."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import byte_texts
from vacantia.llm.parsing import LENGTH, Parse, expanded, grouped, leading_parts, parse, suffix_order
from vacantia.session import materialize, scratch_path

#: What is known of a trigger: nothing smaller elsewhere, the same phrase in a smaller document
#: elsewhere, several phrases, or several phrases in so many blocks that strings go out singly.
ALONE, SMALLER, SEVERAL, SPREAD = 0, 1, 2, 3
SPREAD_BLOCKS = 64
#: Strings that are sorted at once; a bucket with more is cut by their leading bytes.
SORTED_STRINGS = 400_000
NO_ID = np.iinfo(np.int64).max
#: In place of a phrase's hash: a block has several phrases of a trigger, or so many that they go out as strings.
MIXED, MANY, MANY_PHRASES = np.uint64(0), np.uint64(2), 8
TRIGGER_BYTES, PHRASE_BYTES = 5, 6


# ------------------------------------------------------------------ blocks of documents
def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Whole documents put together until they have ``size`` bytes, compressed."""
    part, n, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

    def row() -> pa.RecordBatch:
        data = b"".join(texts)
        return pa.RecordBatch.from_pydict({
            "block": pa.array([(part << 32) + n], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
            "lengths": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), "n_bytes": pa.array([len(data)], pa.int64()),
            "data": pa.array([pa.compress(data, codec="zstd", asbytes=True)], pa.binary()),
        })

    for batch in batches:
        for start, slice_ in byte_texts(batch.column("text"), 1 << 20):
            for id_, text in zip(batch.column("id").slice(start, len(slice_)).to_pylist(), slice_, strict=True):
                ids.append(id_)
                texts.append(text)
                held += len(text) + 1
                if held >= size:
                    yield row()
                    n, ids, texts, held = n + 1, [], [], 0
    if texts:
        yield row()


class Block:
    """A block's texts and their parse, the same whenever it is made anew."""

    def __init__(self, row: dict):
        self.ids, self.lengths = row["ids"], np.array(row["lengths"], np.int64)
        self.order = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        raw = pa.decompress(row["data"], row["n_bytes"], codec="zstd", asbytes=True) if row["n_bytes"] else b""
        self.data, self.ends = np.frombuffer(raw, np.uint8), np.cumsum(self.lengths)
        self.parse: Parse = parse(self.data, self.ends)
        self.doc_id = self.order[self.parse.doc]
        # The block's dictionary: distinct phrases, by trigger, each with its smallest document.
        order, _ = grouped(self.parse.trigger, self.parse.phrase, self.doc_id)
        new = np.zeros(len(order), bool)
        trigger, phrase = self.parse.trigger[order], self.parse.phrase[order]
        if len(order):
            new[0] = True
            new[1:] = (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])
        first = np.flatnonzero(new)
        self.example = order[first]  # an instance of each phrase, of the smallest document
        self.word_of = np.empty(len(order), np.int64)  # instance to phrase
        self.word_of[order] = np.cumsum(new) - 1
        self.word_trigger, self.word_doc = trigger[first], self.doc_id[self.example]
        self.triggers, self.trigger_first = np.unique(self.word_trigger, return_index=True)
        self.trigger_of = np.searchsorted(self.triggers, self.word_trigger)  # phrase to trigger

    def records(self) -> tuple[np.ndarray, np.ndarray]:
        """Phrase hash and smallest document of each trigger; MIXED or MANY if it has several phrases."""
        words = np.diff(np.append(self.trigger_first, len(self.word_trigger)))
        phrase = self.parse.phrase[self.example[self.trigger_first]] | np.uint64(1)
        return np.where(words > MANY_PHRASES, MANY, np.where(words > 1, MIXED, phrase)), self.word_doc[self.trigger_first]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _short(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _long(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def _ids(values: np.ndarray) -> tuple[int, int, bytes]:
    """Least id, bytes for each difference to it, and the differences. Absent ids come last."""
    known = values[values != NO_ID]
    low = int(known.min()) if len(known) else 0
    over = int(known.max()) - low + 1 if len(known) else 0
    steps = np.where(values == NO_ID, over, values - low).astype(np.uint64)
    width = max(1, (over.bit_length() + 7) // 8)
    return low, width, _short(steps, width) + over.to_bytes(8, "little")


def _ids_back(low: int, width: int, data: bytes) -> np.ndarray:
    steps, over = _long(data[:-8], width).astype(np.int64), int.from_bytes(data[-8:], "little")
    return np.where(steps == over, NO_ID, steps + low)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


# ------------------------------------------------------------------ first exchange: triggers
def _send_triggers(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        block = Block(row)
        phrase, doc = block.records()
        bucket = _bucket(block.triggers, buckets).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            at = slice(edges[b], edges[b + 1])
            low, width, ids = _ids(doc[at])
            out.append((b, row["block"], low, width, ids, _short(block.triggers[at], TRIGGER_BYTES), _short(phrase[at], PHRASE_BYTES)))
        if out:
            yield _batch(out, TRIGGERS)


TRIGGERS = (("bucket", pa.int64()), ("block", pa.int64()), ("low", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("trigger", pa.binary()), ("phrase", pa.binary()))
ENTRIES = (("bucket", pa.int64()), ("block", pa.int64()), ("low", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()))
ANSWERS = (("block", pa.int64()), ("bucket", pa.int64()), ("answer", pa.binary()))
SQL_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def _ddl(fields: tuple) -> str:
    return ", ".join(f"{name} {SQL_KINDS[kind]}" for name, kind in fields)


def _batch(rows: list[tuple], fields: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), fields, strict=True)], names=[n for n, _ in fields])


def _judge_triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket after the other: what each block has to know of each trigger it sent."""
    for bucket, group in groupby(_rows(batches), key=lambda r: r["bucket"]):
        rows = list(group)
        trigger, phrase = (np.concatenate([_long(r[n], w) for r in rows]) for n, w in (("trigger", TRIGGER_BYTES), ("phrase", PHRASE_BYTES)))
        doc = np.concatenate([_ids_back(r["low"], r["width"], r["ids"]) for r in rows])
        order, first = grouped(trigger)
        size = np.diff(np.append(first, len(order)))
        phrase, doc = phrase[order], doc[order]
        most, least = np.maximum.reduceat(phrase, first), np.minimum.reduceat(phrase, first)
        several = (most != least) | (least == MIXED) | (least == MANY)
        many = (size > SPREAD_BLOCKS) | np.logical_or.reduceat(phrase == MANY, first)
        code = np.where(several, np.where(many, SPREAD, SEVERAL), ALONE)
        code = np.repeat(code, size)
        smaller = np.repeat(np.minimum.reduceat(doc, first), size) < doc
        answer = np.empty(len(order), np.uint8)
        answer[order] = np.where((code == ALONE) & smaller, SMALLER, code)
        ends = np.cumsum([len(r["trigger"]) // TRIGGER_BYTES for r in rows])
        for r, part in zip(rows, np.split(answer, ends[:-1]), strict=True):
            yield _batch([(r["block"], bucket, part.tobytes())], ANSWERS)


# ------------------------------------------------------------------ second exchange: phrases
class Entries:
    """Phrases (or single strings) of a block that have to be compared byte by byte."""

    def __init__(self, block: Block, codes: np.ndarray):
        self.word_code = codes[block.trigger_of]
        p = block.parse
        words = np.flatnonzero(self.word_code == SEVERAL)
        starts, counts = p.start[block.example[words]], (p.end - p.start)[block.example[words]]
        # strings of spread triggers, once per block, with the smallest document that has them
        spread = np.flatnonzero(self.word_code[block.word_of] == SPREAD)
        n = (p.end - p.start)[spread]
        self.single_at = expanded(p.start[spread], n)
        hashes, docs = p.strings[self.single_at], np.repeat(block.doc_id[spread], n)
        order, _ = grouped(hashes, docs)
        ordered = hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = order[np.flatnonzero(new)]
        self.single_of = np.empty(len(order), np.int64)
        self.single_of[order] = np.cumsum(new) - 1
        self.single_docs = docs
        route = np.concatenate((block.word_trigger[words], hashes[first]))
        self.start = np.concatenate((starts, self.single_at[first]))
        self.count = np.concatenate((counts, np.ones(len(first), np.int64)))
        self.doc = np.concatenate((block.word_doc[words], docs[first]))
        self.route, self.words = route, words


def _codes(row: dict) -> np.ndarray:
    parts = [a["answer"] for a in sorted(row["answers"] or [], key=lambda a: a["bucket"])]
    return np.frombuffer(b"".join(parts), np.uint8)


def _send_phrases(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        block = Block(row)
        entries = Entries(block, _codes(row))
        bucket = _bucket(entries.route, buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[b] : edges[b + 1]]
            low, width, ids = _ids(entries.doc[at])
            data = block.data[expanded(entries.start[at], entries.count[at] + LENGTH - 1)]
            out.append((b, row["block"], low, width, ids, entries.count[at].astype("<u4").tobytes(), data.tobytes()))
        if out:
            yield _batch(out, ENTRIES)


def _judge_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket a suffix array of the dictionary's strings; equal ones are neighbours in it.
    The answer has a bit for each string of each phrase: a smaller document than the phrase's has it."""
    for bucket, group in groupby(_rows(batches), key=lambda r: r["bucket"]):
        rows = list(group)
        counts = [np.frombuffer(r["sizes"], "<u4").astype(np.int64) for r in rows]
        data = np.frombuffer(b"".join(r["data"] for r in rows), np.uint8)
        count = np.concatenate(counts)
        begin = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
        doc = np.repeat(np.concatenate([_ids_back(r["low"], r["width"], r["ids"]) for r in rows]), count)
        starts = expanded(begin, count)
        smaller = np.empty(len(starts), bool)
        for part in leading_parts(data, starts, SORTED_STRINGS):
            order, first = suffix_order(data, starts[part])
            order = part[order]
            least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
            smaller[order] = least < doc[order]
        ends = np.cumsum([c.sum() for c in counts])
        for r, part in zip(rows, np.split(smaller, ends[:-1]), strict=True):
            yield _batch([(r["block"], bucket, np.packbits(part, bitorder="little").tobytes())], ANSWERS)


# ------------------------------------------------------------------ removal
def _remove(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for row in _rows(batches):
        block = Block(row)
        p, codes = block.parse, _codes(row)
        entries = Entries(block, codes)
        gone = np.zeros(len(block.data), bool)  # of the string that starts here
        later = block.doc_id > block.word_doc[block.word_of]
        whole = np.isin(entries.word_code[block.word_of], (ALONE, SMALLER)) & (later | (entries.word_code[block.word_of] == SMALLER))
        gone[expanded(p.start[whole], (p.end - p.start)[whole])] = True
        bits = _bits(row, entries, buckets)
        offset = np.cumsum(entries.count) - entries.count
        entry_of = np.full(len(entries.word_code), -1)
        entry_of[entries.words] = np.arange(len(entries.words))
        own = np.flatnonzero(entries.word_code[block.word_of] == SEVERAL)
        n = (p.end - p.start)[own]
        answered = bits[expanded(offset[entry_of[block.word_of[own]]], n)]
        at = expanded(p.start[own], n)
        gone[at] |= answered | np.repeat(later[own], n)
        singles = len(entries.words) + entries.single_of
        gone[entries.single_at] |= bits[offset[singles]] | (entries.single_docs > entries.doc[singles])
        since = np.cumsum(gone, dtype=np.int32)
        covered = since.copy()
        covered[LENGTH:] -= since[:-LENGTH]  # strings that start in the last LENGTH bytes
        covered = covered > 0
        spans, kept = [], []
        for a, b in zip((block.ends - block.lengths).tolist(), block.ends.tolist(), strict=True):
            here = covered[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate(([False], here, [False])).astype(np.int8)))
            spans.append([{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
            kept.append(block.data[a:b][~here].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.ids, pa.int64()), pa.array(block.lengths), pa.array(spans, span), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "spans", "kept"],
        )


def _bits(row: dict, entries: Entries, buckets: int) -> np.ndarray:
    """The answers to a block's entries, put back into their order."""
    bucket = _bucket(entries.route, buckets).astype(np.int64)
    out = np.zeros(int(entries.count.sum()), bool)
    offset = np.cumsum(entries.count) - entries.count
    for answer in row["phrase_answers"] or []:
        at = np.flatnonzero(bucket == answer["bucket"])
        n = int(entries.count[at].sum())
        out[expanded(offset[at], entries.count[at])] = np.unpackbits(np.frombuffer(answer["answer"], np.uint8), count=n, bitorder="little")
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20, bucket_bytes: int = 4 << 20) -> DataFrame:
    """Documents with n_bytes, spans (removed byte runs, end exclusive) and kept (bytes).

    Each byte goes that lies in a string of 50 bytes which also starts in a document with a
    smaller id, all judged on the input. Texts are bytes of UTF-8; strings never cross documents.

    1. Whole documents are put into blocks, written once to the shared folder, bucketed by block.
    2. A rolling hash fires at the window of 32 bytes with the least hash in any 50; the triggers
       cut each block into phrases, so that equal strings lie at equal triggers.
    3. Each block sends its triggers once, with the phrase's hash and its smallest document, to
       the trigger's bucket. A trigger with one phrase in the whole corpus is settled there.
    4. Phrases of other triggers, a small part, are sent as bytes. Each bucket makes the suffix
       array of these dictionary phrases; equal strings are neighbours in it, and its answer
       joins the parse at every instance. A trigger that many blocks hold, or with many phrases in a block, sends its strings one
       by one instead, each to its own bucket, so that none gathers a frequent passage.
    5. Each block removes what its own and the other blocks' smaller documents have.

    Per trigger or string a bucket gets at most one row a block, and buckets are as many as the
    bytes ask for. Null and empty texts have no spans; a null id counts as larger than all others
    and equal to other null ids; repeated ids do not remove each other's strings. Ids are
    integers. Other columns are ignored; an empty table gives no rows; long texts stay whole.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"blocks_{uuid.uuid4().hex}"
    made = texts.mapInArrow(lambda b: _blocks(b, block_bytes), "block long, ids array<long>, lengths array<long>, n_bytes long, data binary")
    made.write.bucketBy(n, "block").option("path", scratch_path(spark, "blocks")).option("compression", "none").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the resolved table keeps its files and buckets
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(n, -(-total // bucket_bytes))

    def judged(sent: DataFrame, judge, label: str) -> DataFrame:
        dealt = sent.repartition(n, "bucket").sortWithinPartitions("bucket", "block")
        return materialize(dealt.mapInArrow(judge, _ddl(ANSWERS)), label)

    def joined(frame: DataFrame, answers: DataFrame, column: str) -> DataFrame:
        by_block = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias(column))
        return frame.join(by_block.hint("shuffle_hash"), "block", "left")

    triggers = judged(blocks.mapInArrow(lambda b: _send_triggers(b, buckets), _ddl(TRIGGERS)), _judge_triggers, "triggers")
    told = joined(blocks, triggers, "answers")
    phrases = judged(told.mapInArrow(lambda b: _send_phrases(b, buckets), _ddl(ENTRIES)), _judge_phrases, "phrases")
    told = joined(told, phrases, "phrase_answers")
    out = told.mapInArrow(lambda b: _remove(b, buckets), "id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)
