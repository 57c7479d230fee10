"""Cross-tokenizer alignment: groups of tokens of two tokenizers, and how often their ids meet."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import byte_texts, chosen
from vacantia.llm.exchange import answer_rows, asked, block_table, by_shard, by_shards, distinct, expanded, joined_answers, packed, partitions, rows_of, unpacked, with_answers

MARK = "▁"
#: Both tokenizers end a token where a space follows a character that is none.
CUT = re.compile(r"(?<=\S)(?= [\s\S])")
#: How A's pre-tokenizer splits a text (fixed by the kind of tokenizer), and texts of letters that every Unicode version has alike.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COMMON = re.compile("[\t\n\r -~\u00a1-\u024f]*")
#: Links of one group up to which they are listed one by one.
LISTED = 1 << 12


def byte_level() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token, from the tokens' byte ends: a group ends where both do."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)


class Aligner:
    """A byte-level tokenizer (A) and a piece tokenizer that adds a space (B).

    ``identity`` maps an A id to the B id of the same bytes, or to -1: an exact group of one token
    each is that pair, so its links need no pair table.
    """

    def __init__(self, a_path: str, b_path: str, held: int = 400_000):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b, self.held = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path), held
        self.a.encode_special_tokens = True
        letters, names = byte_level(), sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.a_bytes = [b""] * (names[-1][1] + 1)
        for name, i in names:
            self.a_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        vocabulary = {x: i for i, x in enumerate(self.a_bytes) if x and len(x) == len(names[i][0])}
        self.plain = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=vocabulary, special_tokens={})
        numbers = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        #: Each id with each of the signs that may follow it.
        self.signs, self.listed = len(numbers), [x + sign for sign in ",|;\n" for x in numbers]
        self.a_size, self.b_size = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        known: dict[bytes, int] = {}
        for i, x in enumerate(self.b_bytes):
            if x and not self.b.is_byte(i):
                known.setdefault(x, i)
        self.identity = np.array([known.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        pieces = (self.b.id_to_piece(i) for i in range(len(self.b_bytes)))
        #: Whether no piece goes on after a space that follows another character.
        self.separable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.forget()

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace(MARK, " ").encode()

    def forget(self) -> None:
        """Chunks seen so far: their groups as text, four counts (A, B, groups, links), and their pairs."""
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.bad: list[int] = []
        self._counts: list[np.ndarray] = []
        self._pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.tables = None

    def encode(self, spaced: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text that starts with the added space; None if their bytes are not those of the text."""
        if COMMON.fullmatch(spaced):
            a = self.plain.encode_ordinary(spaced)
        else:
            a = self.a.encode_batch_fast([spaced], add_special_tokens=False)[0].ids
        b = self.b.encode(spaced[1:], num_threads=1)
        data = spaced.encode()
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, pair, links) of ids that share a group; a pair is A id times B's vocabulary plus B id."""
        n, wide = int(ga[-1]) + 1, len(self.b_bytes)
        p, q = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        a_start, b_start = np.cumsum(p) - p, np.cumsum(q) - q
        few = p * q <= LISTED
        of_a = few[ga]
        row = np.repeat(np.flatnonzero(of_a), q[ga[of_a]])
        group = ga[row]
        column = expanded(b_start[ga[of_a]], q[ga[of_a]])
        found = [(group, a[row] * wide + b[column], np.ones(len(row), np.int64))]
        for g in np.flatnonzero(~few):
            xs, nx = np.unique(a[a_start[g] : a_start[g] + p[g]], return_counts=True)
            ys, ny = np.unique(b[b_start[g] : b_start[g] + q[g]], return_counts=True)
            made = (xs[:, None] * wide + ys[None, :]).reshape(-1)
            found.append((np.full(len(made), g), made, (nx[:, None] * ny[None, :]).reshape(-1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _learn(self, chunks: list[str], spaced: str) -> bool:
        """Chunks whose joined text is ``spaced``; False if that does not give its own bytes."""
        coded = self.encode(spaced)
        if coded is None:
            return False
        a, b = coded
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.cumsum([len(c.encode()) for c in chunks])
        ga, gb = groups_of(a_ends, b_ends)
        group_end = a_ends[np.concatenate((np.flatnonzero(np.diff(ga)), [len(ga) - 1]))]
        chunk_of = np.searchsorted(ends, group_end)
        n = len(group_end)
        p, q = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        counts = np.stack([np.bincount(chunk_of, x, len(chunks)) for x in (p, q, np.ones(n), p * q)]).astype(np.int64)
        group, pair, links = self.pairs(a, b, ga, gb)
        wide = self.n_pairs
        key, at = np.unique(chunk_of[group] * wide + pair, return_inverse=True)
        total = np.bincount(at, links).astype(np.int64)
        first = len(self.texts)
        self._counts.append(counts)
        self._pairs.append((key // wide + first, key % wide, total))
        # all tokens by group, A's first, each with the sign that follows it; a line for each chunk
        place = np.argsort(np.concatenate((2 * ga, 2 * gb + 1)), kind="stable")
        kind = np.concatenate((2 * ga, 2 * gb + 1))[place]
        sign = np.zeros(len(place), np.int64)
        last = np.flatnonzero(np.diff(kind, append=kind[-1] + 1))
        closed = kind[last] // 2
        sign[last] = np.where(kind[last] % 2 == 0, 1, np.where(np.diff(chunk_of, append=len(chunks))[closed] > 0, 3, 2))
        listed = (np.concatenate((a, b))[place] + self.signs * sign).tolist()
        self.texts += "".join(map(self.listed.__getitem__, listed)).split("\n")[:-1]
        self.number.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        return True

    @property
    def n_pairs(self) -> int:
        return len(self.a_bytes) * len(self.b_bytes)

    def _learn_each(self, chunks: list[str]) -> None:
        for c in chunks:
            if not self._learn([c], c):
                self.number[c] = len(self.texts)
                self._counts.append(np.zeros((4, 1), np.int64))
                self.bad.append(len(self.texts))
                self.texts.append("")

    def learn(self, chunks: set[str], size: int = 4_000) -> None:
        new = [c for c in chunks if c not in self.number]
        if not new:
            return
        self.tables = None
        joint = [c for c in new if not c[-1].isspace()] if self.separable else []
        for i in range(0, len(joint), size):
            some = joint[i : i + size]
            if not self._learn(some, "".join(some)):
                self._learn_each(some)
        self._learn_each([c for c in new if c not in self.number])

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts by chunk (4 rows), where each chunk's pairs begin (and the end), pairs, links."""
        if self.tables is None:
            self._counts = [np.concatenate(self._counts, axis=1)]
            owner, pair, links = (np.concatenate(x) for x in zip(*self._pairs, strict=True)) if self._pairs else [np.array([], np.int64)] * 3
            self._pairs = [(owner, pair, links)]  # owners ascend, as chunks are numbered when they are learned
            self.tables = (self._counts[0], np.searchsorted(owner, np.arange(len(self.texts) + 1)), pair, links)
        return self.tables

    def chunks(self, text: bytes) -> list[str]:
        """Parts of the text with its added space that both tokenizers keep apart; none if it has no tokens."""
        try:
            spaced = " " + text.decode()
        except UnicodeDecodeError:
            return []
        if len(spaced) == 1 or MARK in spaced:
            return []
        return CUT.split(spaced) if self.separable else [spaced]

    def numbers(self, split: list[list[str]]) -> list[np.ndarray]:
        """Chunk numbers of each text; texts with a chunk that changes its bytes are tried as a whole."""
        every = set().union(*split)
        if len(self.number) + len(every) > self.held:
            self.forget()
        self.learn(every)
        get = self.number.__getitem__
        out = [np.fromiter(map(get, parts), np.int64, len(parts)) for parts in split]
        for k in [k for k, x in enumerate(out) if np.isin(x, self.bad).any()] if self.bad else []:
            whole = "".join(split[k])
            self.learn({whole})
            out[k] = np.array([] if get(whole) in self.bad else [get(whole)], np.int64)
        return out


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


class Block:
    """Documents as numbers of distinct chunks, and the chunks' pairs as numbers of distinct pairs."""

    @staticmethod
    def row(number: int, ids: list, split: list[list[str]], both: Aligner) -> dict:
        chunks = both.numbers(split)
        counts, starts, pairs, links = both.table() if both.texts else (np.zeros((4, 0), np.int64), np.zeros(1, np.int64), *[np.array([], np.int64)] * 2)
        lengths = np.array([len(c) for c in chunks])
        every = np.concatenate(chunks)
        times = np.bincount(every, minlength=1)
        used = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]  # frequent ones get small numbers
        place = np.empty(len(times), np.int64)
        place[used] = np.arange(len(used))
        local = place[every]
        width = starts[used + 1] - starts[used]
        at = expanded(starts[used], width)
        pair, link = pairs[at], links[at]
        wide = len(both.b_bytes)
        exact = both.identity[pair // wide] == pair % wide
        key, slot = np.unique(pair, return_inverse=True)
        doc_of = np.repeat(np.arange(len(chunks)), lengths)
        seen = distinct(doc_of * max(len(used), 1) + local)  # a chunk counts once a document
        doc, chunk = seen // max(len(used), 1), seen % max(len(used), 1)
        ends = np.cumsum(width)
        where = expanded((ends - width)[chunk], width[chunk])
        held = distinct(np.repeat(doc, width[chunk]) * max(len(key), 1) + slot[where]) % max(len(key), 1)
        n_docs = np.bincount(held, minlength=len(key))
        fast = np.zeros(len(key), bool)
        fast[slot] = exact
        digests = [hashlib.sha256(";".join([both.texts[i] for i in c.tolist()]).encode()).hexdigest() if len(c) else "" for c in chunks]
        return {
            "block": number, "ids": ids, "digests": digests, "lengths": packed(lengths), "chunks": packed(local),
            "counts": packed(counts[:, used].reshape(-1)), "widths": packed(width), "slots": packed(slot), "links": packed(link),
            "pairs": packed(np.diff(key, prepend=0)), "fast": np.packbits(fast).tobytes(), "n_docs": packed(n_docs), "n_pairs": int((~fast).sum()),
        }

    def __init__(self, row: dict):
        self.pairs, self.n_docs = np.cumsum(unpacked(row["pairs"])), unpacked(row["n_docs"])
        self.fast = np.unpackbits(np.frombuffer(row["fast"], np.uint8), count=len(self.pairs)).astype(bool)

    def slow(self) -> np.ndarray:
        """Numbers of the pairs that go to the pair shuffle."""
        return np.flatnonzero(~self.fast)


def _block_schema(kind: pa.DataType) -> pa.Schema:
    names = ("lengths", "chunks", "counts", "widths", "slots", "links", "pairs", "fast", "n_docs")
    return pa.schema([("block", pa.int64()), ("ids", pa.list_(kind)), ("digests", pa.list_(pa.string())), *((n, pa.binary()) for n in names), ("n_pairs", pa.int64())])


def _blocks(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, block_bytes: int) -> Iterator[pa.RecordBatch]:
    both, number, ids, split, size = aligner(a_path, b_path), TaskContext.get().partitionId() << 32, [], [], 0
    kind = None
    for batch in batches:
        kind = batch.schema.field("__id").type
        for start, texts in byte_texts(batch.column("__text"), block_bytes):
            for i, text in zip(batch.column("__id").slice(start, len(texts)).to_pylist(), texts, strict=True):
                ids.append(i)
                split.append(both.chunks(text))
                size += len(text)
                if size >= block_bytes or len(ids) >= block_bytes >> 6:
                    yield pa.RecordBatch.from_pylist([Block.row(number, ids, split, both)], _block_schema(kind))
                    number, ids, split, size = number + 1, [], [], 0
    if ids:
        yield pa.RecordBatch.from_pylist([Block.row(number, ids, split, both)], _block_schema(kind))


def _vectors(batches: Iterator[pa.RecordBatch], size: int, wide: int) -> Iterator[pa.RecordBatch]:
    """A vector as long as A's vocabulary: in how many of the task's documents each identity pair is linked."""
    vector = np.zeros(size, np.int64)
    for row in rows_of(batches):
        block = Block(row)
        vector[block.pairs[block.fast] // wide] += block.n_docs[block.fast]
    at = np.flatnonzero(vector)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(vector[at])], names=["a", "n"])


MESSAGES = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("pairs", pa.binary()), ("n_docs", pa.binary())])


def _send(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        block = Block(row)
        at = block.slow()
        to, order, edges = by_shard(block.pairs[at], shards)
        rows = []
        for shard, i, j in zip(to.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            some = at[order[i:j]]
            rows.append({"shard": shard, "block": row["block"], "pairs": packed(np.diff(block.pairs[some], prepend=0)), "n_docs": packed(block.n_docs[some])})
        yield pa.RecordBatch.from_pylist(rows, MESSAGES)


def _totals(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """Documents per pair, back to each block; and, as an answer without a block, the highest of each A id here."""
    for shard, rows in by_shards(batches):
        pairs = [np.cumsum(unpacked(r["pairs"])) for r in rows]
        key, at = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, np.concatenate([unpacked(r["n_docs"]) for r in rows]))
        parts = np.split(total[at], np.cumsum([len(p) for p in pairs])[:-1])
        for i in range(0, len(rows), 500):
            yield answer_rows(shard, [r["block"] for r in rows[i : i + 500]], [packed(p) for p in parts[i : i + 500]])
        ids, first = np.unique(key // wide, return_index=True)
        best = np.maximum.reduceat(total, first)
        yield answer_rows(shard, [None], [packed(np.concatenate((ids, best)))])


def _best(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    vector = np.zeros(size, np.int64)
    for row in rows_of(batches):
        ids, best = unpacked(row["answer"]).reshape(2, -1)
        np.maximum.at(vector, ids, best)
    at = np.flatnonzero(vector)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(vector[at])], names=["a", "n"])


def _vector(frame: DataFrame, size: int) -> np.ndarray:
    """At most a row for each A id."""
    out = np.zeros(size, np.int64)
    rows = frame.toArrow()
    out[rows.column("a").to_numpy()] = rows.column("n").to_numpy()
    return out


def _scored(batches: Iterator[pa.RecordBatch], exact: np.ndarray, best: np.ndarray, wide: int, shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind = batch.schema.field("ids").type.value_type
        for row in rows_of([batch]):
            block = Block(row)
            slow = block.slow()
            _, order, _ = by_shard(block.pairs[slow], shards)
            total = exact[block.pairs // wide]
            total[slow] = joined_answers(row["answers"], order)[0]
            top = (total == best[block.pairs // wide]).astype(np.int64)
            slots, links, widths = unpacked(row["slots"]), unpacked(row["links"]), unpacked(row["widths"])
            owner = np.repeat(np.arange(len(widths)), widths)
            counts = unpacked(row["counts"]).reshape(4, -1)
            values = [*counts, *np.zeros((2, len(widths)), np.int64)]
            np.add.at(values[4], owner, links * top[slots])
            np.add.at(values[5], owner, links * total[slots])
            lengths, chunks = unpacked(row["lengths"]), unpacked(row["chunks"])
            ends = np.cumsum(lengths)
            sums = [np.concatenate(([0], np.cumsum(v[chunks]))) for v in values]
            made = [pa.array(s[ends] - s[ends - lengths], pa.int64()) for s in sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], kind), *made, pa.array(row["digests"], pa.string())],
                names=["__id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )


def align(
    docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, shard_pairs: int = 1 << 20,
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts with a space before them are encoded by a byte-level tokenizer (A) and a piece tokenizer
    (B). Groups end where tokens of both end; two tokens of a group are a link. The count of an id
    pair is the number of documents that link it; ``n_best`` counts links whose pair has the
    highest count of its A id, ``count_sum`` sums the counts over links, ``groups_sha256`` is that
    of the groups' ids (``a1,a2|b1;a3|b2``).

    Each task puts documents into blocks of about ``block_bytes`` and splits texts where both
    tokenizers do, so that a distinct part is aligned once and remembered. Pairs of an A id and
    the B id of the same bytes are counted in one vector per task, as long as A's vocabulary.
    Only other pairs enter the shuffle, once per block, to shards by hash; totals return to the
    blocks. The highest counts are a vector of the same length, so both are broadcast.

    Texts that are null, empty or not UTF-8, or whose tokens give other bytes, have zeros and an
    empty digest, and no links. Null ids and repeated rows count as documents of their own; other
    columns are ignored; long texts are encoded whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    frame = chosen(docs, id_col, text_col, (), ())
    kind = frame.schema["__id"].dataType.simpleString()
    both = aligner(a_path, b_path)
    size, wide = len(both.a_bytes), len(both.b_bytes)
    binary = ", ".join(f"{n} binary" for n in ("lengths", "chunks", "counts", "widths", "slots", "links", "pairs", "fast", "n_docs"))
    made = frame.mapInArrow(lambda b: _blocks(b, a_path, b_path, block_bytes), f"block long, ids array<{kind}>, digests array<string>, {binary}, n_pairs long")
    blocks = block_table(made, "aligned")
    held = blocks.select("block", "pairs", "fast", "n_docs")
    shards = max(partitions(docs), -(-(blocks.agg(F.sum("n_pairs")).first()[0] or 0) // shard_pairs))
    sent = held.mapInArrow(lambda b: _send(b, shards), "shard long, block long, pairs binary, n_docs binary")
    answers = asked(sent, lambda b: _totals(b, wide), "pair_totals")
    exact = _vector(held.mapInArrow(lambda b: _vectors(b, size, wide), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")), size)
    tops = answers.where("block IS NULL").mapInArrow(lambda b: _best(b, size), "a long, n long").groupBy("a").agg(F.max("n").alias("n"))
    shared = spark.sparkContext.broadcast((exact, np.maximum(exact, _vector(tops, size))))
    told = with_answers(blocks, answers.where("block IS NOT NULL"), "answers")
    out = told.mapInArrow(
        lambda b: _scored(b, *shared.value, wide, shards),
        f"__id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )
    return out.withColumnRenamed("__id", id_col)
