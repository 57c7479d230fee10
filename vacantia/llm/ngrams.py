"""Scores of an n-gram model whose levels are Elias-Fano tries, built and asked shard by shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import byte_texts
from vacantia.llm.eliasfano import TrieLevel
from vacantia.llm.exchange import answer_rows, asked, block_table, by_shard, by_shards, ordered_answers, packed, partitions, rows_of, shard_of, squeezed, unpacked, unsqueezed, with_answers, words_array

#: A code is so many parts of a negative decimal logarithm, and at most the largest one.
STEPS, LAST_CODE = 4096, 65_534
#: The probability of each code.
PROBABILITIES = 10.0 ** (np.arange(LAST_CODE + 1) / -STEPS)
#: The end of a text is a token that no word can be.
END = b""
#: Children of a context with more tokens than this are dealt over several shards.
SPREAD = 1 << 16


def code_of(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS), 0, LAST_CODE).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)


def _joint(heads: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One number for each pair, in the pairs' order; by ranks where the bits of both do not fit."""
    bits = int(words.max(initial=0)).bit_length()
    if int(heads.max(initial=0)).bit_length() + bits > 62:
        heads, words = (np.unique(x, return_inverse=True)[1] for x in (heads, words))
        bits = int(words.max(initial=0)).bit_length()
    return heads << bits | words


def _sorted_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in their order and the place of each, equal keys by place; as one number each where their bits fit."""
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 63:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = np.sort(keys << bits | np.arange(len(keys)))
    return both >> bits, both & ((1 << bits) - 1)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in their order, the first place of each, and the number of the key at each place."""
    keys, order = _sorted_places(keys)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    numbers = np.empty(len(keys), np.int64)
    numbers[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return keys[first], order[first], numbers


# ------------------------------------------------------------------ blocks
BINARIES = ("counts", "skips", "tokens", "words", "trained")
PIECES = ("docs", "held_out", *BINARIES)


def _block(number: int, ids: list, held: list[bool], docs: list[int], skips: list[int], pieces: list[list[bytes]]) -> dict:
    """Words are numbered by the bits of their counts, frequent ones first, and else in their order, which
    makes both the tokens and the words short; ``trained`` counts them in texts to learn from."""
    found = pa.array([w for p in pieces for w in p], pa.large_binary()).dictionary_encode()
    tokens, words = found.indices.to_numpy().astype(np.int64), found.dictionary
    size = np.frexp(np.bincount(tokens, minlength=len(words)))[1]
    order = pc.array_sort_indices(words).to_numpy().astype(np.int64)
    order = order[np.argsort(-size[order].astype(np.int8), kind="stable")]
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    tokens, words = rank[tokens], words.take(pa.array(order)).to_pylist()
    lengths = np.array([len(p) for p in pieces])
    counted = _counted(lengths, np.array(skips)) & np.repeat(~np.array(held), lengths)
    return {
        "block": number, "ids": ids, "held_out": held, "docs": docs, "counts": packed(lengths), "skips": packed(np.array(skips)), "tokens": packed(tokens),
        "words": b" ".join(words), "trained": packed(np.bincount(tokens[counted], minlength=len(words))), "n_tokens": len(tokens),
    }


def _counted(lengths: np.ndarray, skips: np.ndarray) -> np.ndarray:
    """Tokens of pieces that are not there as context only."""
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return place >= np.repeat(skips, lengths)


def _blocks(batches: Iterator[pa.RecordBatch], order: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Texts in pieces of at most ``block_tokens``; a later piece begins with the last tokens before it as context."""
    part = TaskContext.get().partitionId() << 32
    number, doc, size = part, part, 0
    held: list[list] = [[], [], [], [], []]  # ids, held out, docs, skips, pieces

    def flush() -> pa.RecordBatch:
        shape = [("block", pa.int64()), ("ids", pa.list_(kind)), ("held_out", pa.list_(pa.bool_())), ("docs", pa.list_(pa.int64()))]
        return pa.RecordBatch.from_pylist([_block(number, *held)], pa.schema([*shape, *((n, pa.binary()) for n in BINARIES), ("n_tokens", pa.int64())]))

    for batch in batches:
        kind = batch.schema.field("__id").type
        for start, texts in byte_texts(batch.column("__text")):
            some = [batch.column(n).slice(start, len(texts)).to_pylist() for n in ("__id", "__out")]
            for i, out, text in zip(*some, texts, strict=True):
                words = [*text.lower().split(), END]
                doc += 1
                for at in range(0, len(words), block_tokens):
                    lead = min(at, order - 1)
                    piece = words[at - lead : at + block_tokens]
                    for values, value in zip(held, (i, out, doc, lead, piece), strict=True):
                        values.append(value)
                    size += len(piece)
                    if size >= block_tokens:
                        yield flush()
                        number, size, held = number + 1, 0, [[], [], [], [], []]
    if size:
        yield flush()


# ------------------------------------------------------------------ words
MESSAGES = pa.schema([("shard", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in ("heads", "widths", "words", "trained"))])
MESSAGE_SHAPE = "shard long, block long, heads binary, widths binary, words binary, trained binary"


def _word_shards(words: bytes, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of joined words, by a polynomial of their bytes."""
    found = words_array(words)
    offsets, letters = np.frombuffer(found.buffers()[1], np.int32), np.frombuffer(found.buffers()[2], np.uint8)
    lengths = np.diff(offsets)
    powers = np.full(int(lengths.max(initial=0)) + 1, 0x100000001B3, np.uint64)
    np.multiply.accumulate(powers, out=powers)
    place = np.arange(len(letters)) - np.repeat(offsets[:-1], lengths)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(7)) * powers[place], dtype=np.uint64)))
    return by_shard(sums[offsets[1:]] - sums[offsets[:-1]], shards)


def _send_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        words, trained = row["words"].split(b" "), unpacked(row["trained"])
        to, order, edges = _word_shards(row["words"], shards)
        rows = []
        for shard, i, j in zip(to.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = order[i:j]
            rows.append({"shard": shard, "block": row["block"], "words": squeezed(b" ".join([words[k] for k in at])), "trained": packed(trained[at])})
        yield pa.RecordBatch.from_pylist(rows, MESSAGES)


def _judge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers, frequent words first, and counts in texts to learn from, both zero for other words; without a block: known words and their tokens."""
    for shard, rows in by_shards(batches):
        parts = [words_array(unsqueezed(r["words"])) for r in rows]
        numbers = pa.chunked_array(parts).combine_chunks().dictionary_encode().indices.to_numpy()  # in order of first appearance
        totals = np.zeros(int(numbers.max(initial=-1)) + 1, np.int64)
        np.add.at(totals, numbers, np.concatenate([unpacked(r["trained"]) for r in rows]))
        known = totals > 0
        ids = np.empty(len(totals), np.int64)
        ids[np.argsort(-totals, kind="stable")] = np.arange(1, len(totals) + 1)
        ids[~known] = 0
        start = 0
        for r, part in zip(rows, parts, strict=True):
            own = numbers[start : start + len(part)]
            yield answer_rows(shard, [r["block"]], [packed(np.concatenate((ids[own], totals[own])))])
            start += len(part)
        yield answer_rows(shard, [None], [packed(np.array([known.sum(), totals.sum()]))])


# ------------------------------------------------------------------ levels
class State:
    """A block's grams, level by level: number of the gram that ends at each token, and per distinct
    gram its id (0 if not learned), its tokens to learn from and the logarithm of its last word's probability."""

    def __init__(self, row: dict, shards: int, size: tuple[int, int]):
        self.row, self.shards = row, shards
        self.tokens, self.lengths, skips = (unpacked(row[n]) for n in ("tokens", "counts", "skips"))
        self.counted = _counted(self.lengths, skips)
        self.learned = self.counted & np.repeat(~np.array(row["held_out"], bool), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(self.tokens)) - np.repeat(starts, self.lengths)
        to, order, edges = _word_shards(row["words"], shards)
        number, count = ordered_answers(row["answers_1"], 2)
        self.word_ids, self.word_totals = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        self.word_ids[order] = np.where(number > 0, 1 + np.repeat(to, np.diff(edges)) + shards * (number - 1), 0)
        self.word_totals[order] = count
        known, tokens = size
        self.base = np.log10((self.word_totals + 0.5) / (tokens + 0.5 * (known + 1)))
        self.gram, self.ids, self.totals, self.log10 = self.tokens, self.word_ids, self.word_totals, self.base
        self.best = self.base[self.tokens]

    def grow(self, n: int) -> None:
        """Distinct grams of n words, and those whose first n - 1 words and last word were learned, in the order they are sent."""
        self.at = np.flatnonzero(self.place >= n - 1)
        bits = len(self.word_ids).bit_length()
        key, first, self.inverse = _numbered(self.gram[self.at - 1] << bits | self.tokens[self.at])
        prefix, word = key >> bits, key & ((1 << bits) - 1)
        self.suffix, self.total = self.gram[self.at[first]], self.totals[prefix]
        known = np.flatnonzero((self.ids[prefix] > 0) & (self.word_ids[word] > 0))
        heads, words = self.ids[prefix[known]], self.word_ids[word[known]]
        dealt = _mixed(heads) * np.uint64(31)
        wide = np.flatnonzero(self.total[known] >= SPREAD)
        dealt[wide] += _mixed(words[wide]) % (1 + self.total[known[wide]] // SPREAD).astype(np.uint64)
        target = shard_of(dealt, self.shards)
        by_word = _sorted_places(words)[1]
        order = by_word[_sorted_places(_joint(target, heads)[by_word])[1]]
        self.asked, self.target, self.heads, self.words = known[order], target[order], heads[order], words[order]
        self.edges = np.concatenate(([0], np.flatnonzero(np.diff(self.target)) + 1, [len(order)])) if len(order) else np.array([0])

    def messages(self) -> Iterator[dict]:
        if not len(self.asked):
            return
        edges, heads = self.edges.tolist(), self.heads
        first = np.ones(len(heads), bool)
        first[1:] = (heads[1:] != heads[:-1]) | (self.target[1:] != self.target[:-1])
        new = np.flatnonzero(first)
        trained = np.bincount(self.inverse[self.learned[self.at]], minlength=len(self.suffix))[self.asked]
        cuts = np.searchsorted(new, edges)
        widths = np.diff(np.append(new, len(heads)))
        for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            mine = new[cuts[k] : cuts[k + 1]]
            yield {
                "shard": int(self.target[i]), "block": self.row["block"], "heads": packed(np.diff(heads[mine], prepend=0)),
                "widths": packed(widths[cuts[k] : cuts[k + 1]]), "words": packed(self.words[i:j]), "trained": packed(trained[i:j]),
            }

    def told(self, n: int, strength: float, last: bool) -> None:
        """The answers of level n: counts, and for all levels but the last the steps from one number to the next."""
        values = ordered_answers(self.row[f"answers_{n}"], 1 if last else 2)
        seen = np.flatnonzero(values[0])
        at, count = self.asked[seen], values[0][seen]
        lower, total = self.log10[self.suffix], self.total
        log10 = lower + np.log10(strength / (total + strength))
        log10[at] = code_of(np.log10((count + strength * PROBABILITIES[code_of(lower[at])]) / (total[at] + strength))) / -STEPS
        self.best[self.at] = log10[self.inverse]
        if last:
            return
        ids, totals, gram = np.zeros(len(total), np.int64), np.zeros(len(total), np.int64), np.zeros(len(self.tokens), np.int64)
        number = np.cumsum(values[1])
        number -= np.repeat(np.concatenate(([0], number))[self.edges[:-1]], np.diff(self.edges))
        ids[at], totals[at] = 1 + self.target[seen] + self.shards * number[seen], count
        gram[self.at] = self.inverse
        self.gram, self.ids, self.totals, self.log10 = gram, ids, totals, log10


def _states(batches: Iterator[pa.RecordBatch], n: int, strengths: tuple[float, ...], shards: int, size: tuple[int, int]) -> Iterator[State]:
    """Blocks that know all levels below ``n``."""
    for row in rows_of(batches):
        state = State(row, shards, size)
        for level in range(2, n):
            state.grow(level)
            state.told(level, strengths[level - 2], level == len(strengths) + 1)
        yield state


def _send_grams(batches: Iterator[pa.RecordBatch], n: int, strengths: tuple[float, ...], shards: int, size: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for state in _states(batches, n, strengths, shards, size):
        state.grow(n)
        yield pa.RecordBatch.from_pylist(list(state.messages()), MESSAGES)


def _judge_grams(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Each shard's level of the trie, and what it answers to each block; a gram of several blocks is looked up once."""
    for shard, rows in by_shards(batches):
        widths = [unpacked(r["widths"]) for r in rows]
        heads = np.concatenate([np.repeat(np.cumsum(unpacked(r["heads"])), w) for r, w in zip(rows, widths, strict=True)])
        parts = [unpacked(r["words"]) for r in rows]
        sizes, words = [len(p) for p in parts], np.concatenate(parts)
        joint = _joint(heads, words)
        order = np.argsort(joint)
        first = np.flatnonzero(np.diff(joint[order], prepend=-1))
        number = np.empty(len(order), np.int64)
        number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        count = np.add.reduceat(np.concatenate([unpacked(r["trained"]) for r in rows])[order], first)
        one = order[first]
        heads, words, seen = heads[one], words[one], count > 0
        del joint, order, first, one, parts
        level = TrieLevel(TrieLevel.encoded(heads[seen], words[seen], count[seen]))
        found = level.find(heads, words)
        counts = np.where(found >= 0, np.append(level.codes, 0).astype(np.int64)[found], 0)
        start = 0
        for r, size in zip(rows, sizes, strict=True):
            own = number[start : start + size]
            answer = [counts[own]]
            if not last:  # grams are asked in the trie's order, so numbers grow
                places, steps = found[own], np.zeros(size, np.int64)
                here = np.flatnonzero(places >= 0)
                steps[here] = np.diff(places[here], prepend=0)
                answer.append(steps)
            yield answer_rows(shard, [r["block"]], [packed(np.concatenate(answer))])
            start += size


def _scored(batches: Iterator[pa.RecordBatch], strengths: tuple[float, ...], shards: int, size: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind = batch.schema.field("ids").type.value_type
        for state in _states([batch], len(strengths) + 2, strengths, shards, size):
            row, ends = state.row, np.cumsum(state.lengths)
            begins, counted = ends - state.lengths, state.counted
            sums = []
            for values in (counted.astype(np.int64), (state.word_totals > 0)[state.tokens] & counted, np.where(counted, state.base[state.tokens], 0.0), np.where(counted, state.best, 0.0)):
                sums.append(pa.array(np.add.reduceat(values.astype(np.float64), begins)))
            whole = [s.cast(pa.int64()) for s in sums[:2]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["docs"], pa.int64()), pa.array(row["ids"], kind), pa.array(row["held_out"], pa.bool_()), *whole, *sums[2:]],
                names=["doc", "__id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )


def score(
    docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", strengths: tuple[float, ...] = (256.0, 4.0),
    block_tokens: int = 1 << 20, shard_keys: int = 1 << 20,
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the lower-cased (A-Z) words between ASCII white space and one end per text. The
    model learns from all texts that are not held out, of grams up to len(strengths) + 1 words:
    P(w) = (c + 0.5) / (N + 0.5 (V + 1)), and with a context h whose last words without the first
    are h', P(w | h) = (c(h w) + s P(w | h')) / (c(h) + s), s the level's strength. Contexts do not
    reach beyond a text's beginning. ``score`` is the base-10 logarithm of the text's probability,
    ``base_score`` that under P(w) alone, ``n_known`` counts tokens that the model has learned.

    Texts are cut into blocks of at most ``block_tokens`` tokens, long ones into pieces that carry
    their context. For each level the blocks send their distinct grams, with counts, to shards
    (about ``shard_keys`` grams each) by context, contexts with many tokens over several. A shard
    adds up the counts, puts them into one level of a trie in Elias-Fano form and answers each
    block by successor searches in it; the numbers that it gives are the contexts of the next
    level. A block knows c(h) and P(w | h') from the levels below, so it works out a learned
    gram's probability itself, quantised to 1/4096 of a decimal. A block sends a gram once, and
    counts follow all of the corpus: nothing is pruned. All that is broadcast is N and V.

    Null and empty texts are one end token. A null ``held_out`` counts as false. Null ids and
    repeated rows are documents of their own; other columns are ignored; an empty table gives no
    rows; with nothing to learn from all scores are zero (V and N are).
    """
    if not strengths:
        raise ValueError("at least one level above the words")
    out = F.coalesce(held_out, F.lit(False))
    frame = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), out.alias("__out"))
    kind = frame.schema["__id"].dataType.simpleString()
    made = frame.mapInArrow(
        lambda b: _blocks(b, len(strengths) + 1, block_tokens),
        f"block long, ids array<{kind}>, held_out array<boolean>, docs array<long>, {', '.join(f'{n} binary' for n in BINARIES)}, n_tokens long",
    )
    blocks = block_table(made, "texts")
    shards = max(partitions(docs), -(-(blocks.agg(F.sum("n_tokens")).first()[0] or 0) // shard_keys))
    sent = blocks.select("block", "words", "trained").mapInArrow(lambda b: _send_words(b, shards), MESSAGE_SHAPE)
    answers = asked(sent, _judge_words, "words")
    stats = answers.where("block IS NULL").select("answer").mapInArrow(_sums, "known long, tokens long")
    found = stats.agg(F.sum("known"), F.sum("tokens")).first()
    size = (found[0] or 0, found[1] or 0)
    told = with_answers(blocks, answers.where("block IS NOT NULL"), "answers_1")
    for n in range(2, len(strengths) + 2):
        sent = told.mapInArrow(lambda b, n=n: _send_grams(b, n, strengths, shards, size), MESSAGE_SHAPE)
        last = n == len(strengths) + 1  # the last level's answers are read once
        told = with_answers(told, asked(sent, lambda b, last=last: _judge_grams(b, last), None if last else f"grams_{n}"), f"answers_{n}")
    pieces = told.mapInArrow(
        lambda b: _scored(b, strengths, shards, size),
        f"doc long, __id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    scored = pieces.groupBy("doc").agg(F.first("__id").alias(id_col), F.first("held_out").alias("held_out"), *sums)
    return scored.select(id_col, "held_out", "n_tokens", "n_known", F.lit(size[1]).cast("long").alias("train_tokens"), "base_score", "score")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        known, tokens = unpacked(row["answer"]).tolist()
        yield pa.RecordBatch.from_pydict({"known": [known], "tokens": [tokens]})


def bits_per_token(log10: float, tokens: int) -> float:
    return -log10 * math.log2(10) / tokens
