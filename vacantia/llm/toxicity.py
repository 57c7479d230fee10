"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import TEXT, byte_texts, chosen, named, passed_on, text_of

BITS, WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 17, 4, 6, 8, 8
WINDOW, STRIDE = 32, 16
GRAMS = (3, 4, 5)
MADE = ("score", "predicted")
#: Texts that a sample to learn from may hold have at most so many bytes.
LEARNED_BYTES = 1 << 20


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; buckets of its character n-grams, and where each word's begin."""
    data = np.frombuffer(b"".join(b"^" + w + b"$$$$" for w in words), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 5 for w in words])
    starts = np.cumsum(lengths) - lengths
    prime, mix = np.uint64(1099511628211), np.uint64(0x9E3779B97F4A7C15)
    grams = []
    for n in GRAMS:
        value = np.zeros(len(data), np.uint64)
        for k in range(n):
            value[: len(data) - n + 1] = value[: len(data) - n + 1] * prime + data[k : len(data) - n + 1 + k] + np.uint64(n)
        grams.append((value * mix) >> np.uint64(64 - BITS))
    inside = np.ones(len(data), bool)
    for back in range(1, 5):
        inside[starts + lengths - back] = False
    powers = np.ones(int(lengths.max(initial=1)), np.uint64)
    np.multiply.accumulate(np.where(np.arange(len(powers)) == 0, np.uint64(1), prime), out=powers)
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    word = np.add.reduceat((data + np.uint64(7)) * powers[place], starts) * mix >> np.uint64(64 - BITS)
    flat = np.stack([g[inside] for g in grams], axis=1).reshape(-1)
    counts = (lengths - 4) * len(GRAMS)
    return word.astype(np.int32), flat.astype(np.int32), np.cumsum(counts) - counts


def _all_hashes(words: list[bytes], size: int = 4000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_hashes in pieces, to bound the memory in between."""
    pieces = [_hashes(words[i : i + size]) for i in range(0, len(words), size)]
    before = np.cumsum([0, *(len(g) for _, g, _ in pieces)])
    return (
        np.concatenate([w for w, _, _ in pieces]), np.concatenate([g for _, g, _ in pieces]),
        np.concatenate([s + b for (_, _, s), b in zip(pieces, before)]),
    )


def windows_of(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover n words."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    words: np.ndarray
    chars: np.ndarray
    gates: list[dict[str, np.ndarray]]
    pool: dict[str, np.ndarray]

    def parameters(self) -> list[np.ndarray]:
        return [self.words, self.chars, *(p for d in (*self.gates, self.pool) for p in d.values())]

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """Word vector and, over the character n-grams, the largest of each component."""
        word, grams, starts = _hashes(words)
        most = np.maximum.reduceat(self.chars[grams], starts, axis=0)
        return np.concatenate((self.words[word], most), axis=1), (word, grams, starts)

    def steps(self, projected: np.ndarray, mask: np.ndarray, d: int, saved: list | None = None) -> np.ndarray:
        """States (time, row, hidden) of direction d from projected inputs (time, row, gates)."""
        u, h = self.gates[d]["u"], np.zeros((projected.shape[1], HIDDEN), np.float32)
        out = np.empty((*projected.shape[:2], HIDDEN), np.float32)
        times = range(len(projected)) if d == 0 else range(len(projected) - 1, -1, -1)
        for t in times:
            inner = h @ u
            zr = _sigmoid(projected[t, :, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(projected[t, :, 2 * HIDDEN :] + r * inner[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if saved is not None:
                saved.append((t, h, z, r, n, inner[:, 2 * HIDDEN :]))
            h = h + mask[t][:, None] * (new - h)
            out[t] = h
        return out

    def logits(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        hidden = np.tanh(states @ self.pool["a"])
        weight = np.exp(hidden @ self.pool["v"]) * mask
        weight /= weight.sum(axis=0) + 1e-9
        context = np.einsum("tb,tbh->bh", weight, states)
        return context @ self.pool["w"] + self.pool["c"][0], (hidden, weight, context)

    def project(self, inputs: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions."""
        return np.concatenate([inputs @ g["w"] + g["b"] for g in self.gates], axis=1).astype(np.float32)

    def run(self, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Scores of windows: ids (time, row) into a table of projected words; row 0 is padding."""
        mask = (ids > 0).astype(np.float32)
        mask[0] = 1
        both = table[ids]
        states = np.concatenate([self.steps(both[:, :, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN], mask, d) for d in (0, 1)], axis=2)
        return _sigmoid(self.logits(states, mask)[0])


def fresh_network(seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    size = WORD_DIM + CHAR_DIM
    gates = [{"w": draw(size, 3 * HIDDEN), "u": draw(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32)} for _ in range(2)]
    pool = {"a": draw(2 * HIDDEN, ATTENTION), "v": draw(ATTENTION), "w": draw(2 * HIDDEN), "c": np.zeros(1, np.float32)}
    return Network(draw(1 << BITS, WORD_DIM) * np.float32(0.1), draw(1 << BITS, CHAR_DIM) * np.float32(0.1), gates, pool)


def _gradients(net: Network, words: list[bytes], ids: np.ndarray, target: np.ndarray, weights: np.ndarray) -> list:
    """Of the weighted log loss, by back-propagation through time; of the two vector tables as (rows, gradients)."""
    inputs, (word, grams, starts) = net.inputs(words)
    x = np.concatenate((np.zeros((1, inputs.shape[1]), np.float32), inputs))[ids]
    mask = (ids > 0).astype(np.float32)
    mask[0] = 1
    saved: list[list] = [[], []]
    states = np.concatenate([net.steps(x @ g["w"] + g["b"], mask, d, saved[d]) for d, g in enumerate(net.gates)], axis=2)
    logit, (hidden, weight, context) = net.logits(states, mask)
    d_logit = (_sigmoid(logit) - target) * weights
    pool = {"w": context.T @ d_logit, "c": np.array([d_logit.sum()])}
    d_context = d_logit[:, None] * net.pool["w"]
    d_weight = np.einsum("bh,tbh->tb", d_context, states)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
    pool["v"] = np.einsum("tb,tba->a", d_energy, hidden)
    d_hidden = d_energy[:, :, None] * net.pool["v"] * (1 - hidden**2)
    pool["a"] = np.einsum("tbh,tba->ha", states, d_hidden)
    d_states = weight[:, :, None] * d_context + d_hidden @ net.pool["a"].T
    d_x, gates = np.zeros_like(x), []
    for d, g in enumerate(net.gates):
        grad = {k: np.zeros_like(v) for k, v in g.items()}
        d_h = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, h, z, r, n, inner in reversed(saved[d]):
            d_h = d_h + d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            m = mask[t][:, None]
            d_new = d_h * m
            d_n = d_new * (1 - z) * (1 - n**2)
            d_z = d_new * (h - n) * z * (1 - z)
            d_r = d_n * inner * r * (1 - r)
            outer, inside = np.concatenate((d_z, d_r, d_n), axis=1), np.concatenate((d_z, d_r, d_n * r), axis=1)
            grad["w"] += x[t].T @ outer
            grad["b"] += outer.sum(axis=0)
            grad["u"] += h.T @ inside
            d_x[t] += outer @ g["w"].T
            d_h = d_h * (1 - m) + d_new * z + inside @ g["u"].T
        gates.append(grad)
    d_inputs = np.zeros((len(words) + 1, x.shape[2]), np.float32)
    np.add.at(d_inputs, ids.reshape(-1), d_x.reshape(-1, x.shape[2]))
    words_at, local = np.unique(word, return_inverse=True)
    d_words = np.zeros((len(words_at), WORD_DIM), np.float32)
    np.add.at(d_words, local, d_inputs[1:, :WORD_DIM])
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(grams))))
    at, component = np.nonzero(net.chars[grams] == inputs[owner, WORD_DIM:])
    chars_at, local = np.unique(grams[at], return_inverse=True)
    d_chars = np.zeros((len(chars_at), CHAR_DIM), np.float32)
    np.add.at(d_chars, (local, component), d_inputs[1 + owner[at], WORD_DIM + component])
    of_rest = [p[k] for p, own in zip((*gates, pool), (*net.gates, net.pool), strict=True) for k in own]
    return [(words_at, d_words), (chars_at, d_chars), *of_rest]


def _evidence(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """How far documents with a feature are toxic more often than all are: the root of the
    likelihood ratio beyond 3, which chance rarely exceeds."""
    both = toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.nan_to_num(toxic * np.log(toxic / (both * share))) + np.nan_to_num(clean * np.log(clean / (both * (1 - share))))
    root = np.sqrt(np.maximum(2 * ratio, 0))
    return np.where(toxic > both * share, np.clip(root - 3, 0, 6), 0).astype(np.float32) / 2


def train(texts: Iterable[bytes], labels: list[int], *, epochs: int = 6, batch: int = 128, seed: int = 7) -> Network:
    """Fit on whole texts, each standing for its highest-scoring windows.

    Vectors start from the evidence that words and n-grams give; before each of the first epochs
    the windows to learn from are chosen anew: the best one of a toxic text, the two best of
    a clean one. Without both classes the network stays as drawn.
    """
    net, rng = fresh_network(seed), np.random.default_rng(seed)
    target = np.array(labels, np.float32)
    if not 0 < target.sum() < len(target):
        return net
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number) + 1) for w in t.lower().split()], np.int32) for t in texts]
    words = list(number) or [b""]
    del number
    word, grams, starts = _all_hashes(words)
    parts = np.diff(np.append(starts, len(grams)))
    n = np.array([target.sum(), len(target) - target.sum()])
    counts = np.zeros((2, 2, 1 << BITS))
    for doc, y in zip(docs, labels, strict=True):
        own = np.unique(doc) - 1
        counts[0, 1 - y, np.unique(word[own])] += 1
        at = np.repeat(starts[own] - np.concatenate(([0], np.cumsum(parts[own])[:-1])), parts[own]) if len(own) else own
        counts[1, 1 - y, np.unique(grams[at + np.arange(len(at))])] += 1
    odds = _evidence(counts[:, 0], counts[:, 1], target.mean())
    net.words[:, 0], net.chars[:, 0] = odds[0], odds[1]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()[2:]]
    squares = np.zeros_like(net.words), np.zeros_like(net.chars)
    counted = [windows_of(len(doc)) for doc in docs]
    owner = np.repeat(np.arange(len(docs)), [len(c) for c in counted])
    ids = np.zeros((len(owner), WINDOW), np.int32)
    row = 0
    for doc, begins in zip(docs, counted, strict=True):
        for begin in begins:
            piece = doc[begin : begin + WINDOW]
            ids[row, : len(piece)] = piece
            row += 1
    first_guess = np.concatenate(([0], odds[0][word] + np.maximum.reduceat(odds[1][grams], starts)))
    scores = np.concatenate([np.sort(first_guess[part], axis=1)[:, -4:].sum(axis=1) for part in np.array_split(ids, len(ids) // 1024 + 1)])
    del docs, doc, word, grams, starts, parts, counts, first_guess
    step = 0
    for epoch in range(epochs):
        if epoch in (1, 2, 4):
            table = np.zeros((len(words) + 1, 6 * HIDDEN), np.float32)
            for i in range(0, len(words), 4000):
                table[i + 1 : i + 4001] = net.project(net.inputs(words[i : i + 4000])[0])
            scores = np.concatenate([net.run(table, part.T) for part in np.array_split(ids, len(ids) // 1024 + 1)])
            del table
        order = np.lexsort((-scores, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        picked = order[(place == 0) | ((place < 2) & (target[owner[order]] == 0))]
        share = target[owner[picked]].mean()
        rng.shuffle(picked)
        for rows in np.array_split(picked, len(picked) // batch + 1):
            used, local = np.unique(ids[rows], return_inverse=True)
            pad = 0 if used[0] == 0 else 1
            names = [words[i - 1] for i in used if i] or [b""]
            y = target[owner[rows]]
            weights = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(rows)
            step += 1
            grads = _gradients(net, names, local.reshape(len(rows), WINDOW).T + pad, y, weights)
            for p, (rows_, g), sq in zip((net.words, net.chars), grads[:2], squares, strict=True):
                sq[rows_] += g * g
                p[rows_] -= 0.02 * g / (np.sqrt(sq[rows_]) + 1e-4)
            for p, g, (m, v) in zip(net.parameters()[2:], grads[2:], moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return net


def train_rows(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str, text_col: str, label_col: str, per_class: int) -> Network:
    """Train on at most ``per_class`` labelled documents of each class, those with the least hash of the id.

    Only their ids are broadcast, and only their texts reach the driver: one per id (of repeated
    ids that with the least hash), and none of over ``LEARNED_BYTES`` bytes."""
    known = labels.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col(id_col).isNotNull() & ~F.coalesce(held_out, F.lit(True)))
    ranked = [known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for y in (0, 1)]
    sample = F.broadcast(ranked[0].union(ranked[1]).groupBy(F.col(id_col).alias("__known")).agg(F.max("y").alias("y")))
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    short = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LEARNED_BYTES).join(sample, F.col("__id") == F.col("__known"))
    rows = short.groupBy("__id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y")).collect()
    rows.sort(key=lambda r: (str(r["__id"]), bytes(r.text or b"")))
    return train((bytes(r.text or b"") for r in rows), [r.y for r in rows])


def _scores(batches: Iterator[pa.RecordBatch], net: Network, known_words: int = 200_000, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    number: dict[bytes, int] = {}
    table = np.zeros((known_words + 1, 6 * HIDDEN), np.float32)
    for batch in batches:
        passed = passed_on(batch)
        for start, texts in byte_texts(text_of(batch), 1 << 20):
            split = [t.lower().split() for t in texts]
            best = np.zeros(len(texts))
            pending: list[int] = []
            size = 0
            for doc, words in enumerate(split):
                pending.append(doc)
                size += len(words)
                if size >= rows * STRIDE or doc + 1 == len(split):
                    _score(pending, split, best, net, number, table, known_words, rows)
                    pending, size = [], 0
            made = [pa.array(best), pa.array((best >= 0.5).astype(np.int32))]
            part = passed.slice(start, len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *MADE])


def _score(pending: list[int], split: list[list[bytes]], best: np.ndarray, net: Network, number: dict, table: np.ndarray, known_words: int, rows: int) -> None:
    """Scores of some documents, their words in pieces that the word table can hold."""
    for doc_group in ([pending] if sum(len(split[d]) for d in pending) <= known_words else [[d] for d in pending]):
        longest = max(len(split[d]) for d in doc_group)
        for piece in range(0, max(1, longest), known_words // 2 // STRIDE * STRIDE):
            # a text has windows in a piece if one of its own starts there
            here = [d for d in doc_group if not piece or len(split[d]) - piece > WINDOW - STRIDE]
            if not here:
                break
            words = [split[d][piece : piece + known_words // 2 + WINDOW - STRIDE] for d in here]
            new = list(set().union(*words).difference(number))
            if len(number) + len(new) > known_words:
                number.clear()
                new = list(set().union(*words))
            if new:
                first = len(number) + 1
                number.update(zip(new, range(first, first + len(new)), strict=True))
                table[first : first + len(new)] = net.project(net.inputs(new)[0])
            ids = np.array([number[w] for ws in words for w in ws], np.int64)
            lengths = np.array([len(ws) for ws in words])
            offsets = np.cumsum(lengths) - lengths
            begins = [windows_of(n) for n in lengths]
            owner = np.repeat(np.arange(len(words)), [len(b) for b in begins])
            at = np.concatenate(begins)
            for a in range(0, len(owner), rows):
                place = at[a : a + rows] + np.arange(WINDOW)[:, None]
                own = owner[a : a + rows]
                inside = place < lengths[own]
                taken = np.where(inside, ids[np.where(inside, place + offsets[own], 0)] if len(ids) else 0, 0)
                found = net.run(table, taken)
                np.maximum.at(best, np.array(here)[own], found)


def score_toxicity(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents with score (0 to 1) and predicted (score >= 0.5).

    The score is the highest of all windows of 32 words, which overlap by half and cover the
    whole text. A word enters as a vector of its own (hashed) and the component-wise largest of
    its characters' 3- to 5-gram vectors, both of A-Z lower-cased words; their gate inputs are
    computed once per distinct word. The network (fixed size, about 5 MB) is broadcast.

    Null and empty texts are one empty window and get its score. Ids may be null or repeated;
    ``keep`` names columns to pass on, and one with the name of a result column is replaced.
    """
    frame = chosen(docs, id_col, text_col, keep, MADE)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name != TEXT)
    scored = frame.mapInArrow(lambda batches: _scores(batches, shared.value), f"{fields}, score double, predicted int")
    return named(scored, id_col, text_col)
