"""Secret scans: fixed patterns, and a linear-chain conditional random field decoded by Viterbi."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import TEXT, chosen, named, passed_on, text_of

#: Fixed patterns of the contract, and the least length of group 2 or of the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the same patterns look like to Spark, to find texts to learn from.
LIKELY = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
MADE = ("spans",)

Span = tuple[str, int, int]


def base_spans(text: str, *, hexadecimal: bool = True) -> list[Span]:
    """Matches of the fixed patterns in code points, leftmost and not overlapping within a kind."""
    found: list[Span] = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "apikey", "api_key")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if hexadecimal:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return found


def by_place(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ------------------------------------------------------------------ features of a token
N_SHAPE = 20


def shape(token: str) -> tuple[int, ...]:
    """Numbers of the shape features that hold; none for a plain word."""
    core = token.strip("\"'.,;:!?()[]{}<>")
    if core.isalpha() and len(core) < 24 and not any(k in core.lower() for k in KEYWORDS):
        return (0,) if core == token or len(token) - len(core) <= 1 and token[:1].isalpha() and token[-1:] in ".," else (1,)
    low = core.lower()
    digits = sum(c.isdigit() for c in core)
    upper, lower = sum(c.isupper() for c in core), sum(c.islower() for c in core)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:]))
    on = [2 + (len(core) >= 8) + (len(core) >= 16) + (len(core) >= 24)]
    if digits:
        on.append(6 + (digits * 5 >= len(core)) + (digits == len(core)))
    if turns:
        on.append(9 + (turns >= 4))
    if core and all(c in "0123456789abcdefABCDEF" for c in core):
        on.append(11)
    if upper and digits and not lower:
        on.append(12)
    if upper > 2 and lower > 2 and digits:
        on.append(13)
    if any(k in low for k in KEYWORDS):
        on.append(14)
    if "=" in token or ":" in token:
        on.append(15 if core else 16)
    if token[:1] in "\"'":
        on.append(17)
    if "@" in token or "/" in token:
        on.append(18)
    if any(ord(c) > 127 for c in core):
        on.append(19)
    return tuple(on)


#: Words two before to two after a token have weights of their own, and so have file features.
OFFSETS = (-2, -1, 0, 1, 2)
N_FILE = 3


def file_features(text: str) -> np.ndarray:
    """Of the whole text: code-like marks, many digits, many assignments."""
    n = max(len(text), 1)
    marks = sum(text.count(c) for c in "{};")
    return np.array([marks * 100 > n, sum(map(text.count, "0123456789")) * 50 > n, (text.count("=") + text.count(":")) * 200 > n], float)


class Shapes:
    """Numbers of the distinct shapes, remembered for tokens until there are too many."""

    def __init__(self, limit: int = 300_000):
        self.limit, self.tokens = limit, {}
        self.numbers: dict[tuple[int, ...], int] = {(): 0, (0,): 1}
        self.rows = [np.zeros(N_SHAPE), np.eye(N_SHAPE)[0]]

    def of(self, tokens: list[str]) -> list[int]:
        known = self.tokens
        new = set(tokens).difference(known)
        if len(known) + len(new) > self.limit:
            known.clear()
            new = set(tokens)
        for token in new:
            on = shape(token)
            if on not in self.numbers:
                self.numbers[on] = len(self.rows)
                row = np.zeros(N_SHAPE)
                row[list(on)] = 1
                self.rows.append(row)
            known[token] = self.numbers[on]
        return [known[t] for t in tokens]

    def table(self) -> np.ndarray:
        return np.array(self.rows)


@dataclass
class Field:
    """Weights of the random field: shape by offset, file features of shaped tokens, and moves."""

    shapes: np.ndarray  # (offset, shape, tag)
    file: np.ndarray  # (file feature, tag)
    moves: np.ndarray  # (tag before, tag)

    def scores(self, numbers: np.ndarray, table: np.ndarray, file: np.ndarray) -> np.ndarray:
        """Tag scores of tokens given as shape numbers, between two paddings at both ends."""
        n = len(numbers) - 4
        out = np.zeros((n, 3))
        for k, offset in enumerate(OFFSETS):
            out += (table @ self.shapes[k])[numbers[2 + offset : 2 + offset + n]]
        plain = numbers[2 : 2 + n] <= 1
        return out + np.where(plain, 0, 1)[:, None] * (file @ self.file)

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best tags. A token whose "outside" leads by more than the moves around it can ever
        make up is outside on the best path, so Viterbi runs between such tokens only."""
        tags = np.zeros(len(scores), np.int8)
        swing = 2 * (self.moves[self.moves > -1e8].max() - self.moves[self.moves > -1e8].min())
        open_ = np.flatnonzero(scores[:, 0] - scores[:, 1:].max(axis=1) <= swing)
        for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            if len(part):
                tags[part] = self._viterbi(scores[part])
        return tags

    def _viterbi(self, scores: np.ndarray) -> list[int]:
        best, back = self.moves[OUTSIDE] + scores[0], []
        for row in scores[1:]:
            through = best[:, None] + self.moves
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + row
        tag = int((best + self.moves[:, OUTSIDE]).argmax())
        tags = [tag]
        for pointers in reversed(back):
            tag = int(pointers[tag])
            tags.append(tag)
        return tags[::-1]


def _padded(numbers: list[int]) -> np.ndarray:
    return np.array([0, 0, *numbers, 0, 0], np.int64)


def tag_tokens(places: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """B for the first token that a base span touches, I for its others."""
    tags, reached = [OUTSIDE] * len(places), 0
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        first = True
        while reached < len(places) and places[reached][1] <= a:
            reached += 1
        at = reached
        while at < len(places) and places[at][0] < b:
            tags[at] = BEGIN if first else INSIDE
            first, at = False, at + 1
    return tags


def bare_secrets(text: str) -> tuple[str, list[Span]]:
    """The text with assigned secrets standing alone, and the spans to tag in it."""
    parts, spans, done, size = [], [], 0, 0
    for kind, a, b in sorted(base_spans(text), key=lambda s: s[1]):
        if a >= done:
            value = ASSIGN.fullmatch(text[a:b])[2] if kind == "assign" else text[a:b]
            parts += [text[done:a], value]
            size += a - done
            spans.append(("", size, size + len(value)))
            size, done = size + len(value), b
    return "".join([*parts, text[done:]]), spans


def train(texts: list[str], *, length: int = 16, rounds: int = 150) -> Field:
    """Fit by conditional log-likelihood on stretches of ``length`` tokens around everything
    that is not a plain word, and on plain stretches. Base spans are the tags to learn; texts
    that have some are learned from once more with their values standing alone, so that the
    shape counts where no keyword helps. Equal stretches count as one with a weight."""
    shapes, stretches = Shapes(), Counter()
    for text in texts:
        spans = base_spans(text)
        for version, marked in [(text, spans), *([bare_secrets(text)] if spans else [])]:
            places = [m.span() for m in re.finditer(r"\S+", version)]
            numbers = shapes.of([version[a:b] for a, b in places])
            short = [0] * (length - len(numbers))
            tags, file = tag_tokens(places, marked) + short, tuple(file_features(version))
            padded = (0, 0, *numbers, *short, 0, 0)
            last = -1
            for i in [i for i, x in enumerate(numbers) if x > 1] or [len(numbers) // 2]:
                start = max(0, min(i - length // 2, len(numbers) - length))
                if start > last:
                    stretches[padded[start : start + length + 4], tuple(tags[start : start + length]), file] += 1
                    last = start + length // 2
    field = Field(np.zeros((len(OFFSETS), N_SHAPE, 3)), np.zeros((N_FILE, 3)), np.zeros((3, 3)))
    field.moves[OUTSIDE, INSIDE] = -1e9
    if not stretches:
        return field
    table = shapes.table()
    often = np.array(list(stretches.values()), float)[:, None, None]
    often /= often.sum()
    numbers = np.array([s[0] for s in stretches])
    gold = np.eye(3)[np.array([s[1] for s in stretches])]
    files = np.array([s[2] for s in stretches])
    by_offset = [numbers[:, 2 + o : 2 + o + length] for o in OFFSETS]
    on = (by_offset[2] > 1)[:, :, None]
    moves = field.moves
    steps = [np.zeros_like(x) for x in (field.shapes, field.file, moves)]
    pairs = np.einsum("bti,btj->ij", often * gold[:, :-1], gold[:, 1:])
    for _ in range(rounds):
        scores = on * (files @ field.file)[:, None, :]
        for k, seen in enumerate(by_offset):
            scores = scores + (table @ field.shapes[k])[seen]
        forward, backward = np.empty_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, length):
            forward[:, t] = scores[:, t] + _log_sum(forward[:, t - 1][:, :, None] + moves, 1)
        for t in range(length - 2, -1, -1):
            backward[:, t] = _log_sum(moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        total = _log_sum(forward[:, -1], 1)
        share = np.exp(forward + backward - total[:, None, None])
        both = sum(
            (often * np.exp(forward[:, t][:, :, None] + moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :] - total[:, None, None])).sum(axis=0)
            for t in range(length - 1)
        )
        rest = often * (gold - share)
        grad = np.zeros_like(field.shapes)
        for k, seen in enumerate(by_offset):
            sums = [np.bincount(seen.reshape(-1), rest[:, :, tag].reshape(-1), len(table)) for tag in range(3)]
            grad[k] = table.T @ np.stack(sums, axis=1)
        grads = (grad - 1e-4 * field.shapes, files.T @ (on * rest).sum(axis=1) - 1e-4 * field.file, pairs - both)
        for value, g, square in zip((field.shapes, field.file, moves), grads, steps, strict=True):
            square += g * g
            value += 0.5 * g / (np.sqrt(square) + 1e-8)
        moves[OUTSIDE, INSIDE] = -1e9
    return field


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def field_spans(text: str, tags: np.ndarray, taken: list[Span]) -> list[Span]:
    """Code points of tagged runs of tokens, without outer quotes and stops, clear of base spans."""
    places = [m.span() for m in re.finditer(r"\S+", text)]
    found: list[Span] = []
    runs: list[list[int]] = []
    for i in np.flatnonzero(tags):
        if tags[i] == INSIDE and runs and runs[-1][1] == i:
            runs[-1][1] = i + 1
        else:
            runs.append([int(i), int(i) + 1])
    for first, end in runs:
        a, b = places[first][0], places[end - 1][1]
        while a < b and text[a] in "\"'([{<":
            a += 1
        while a < b and text[b - 1] in "\"'.,;:!?)]}>":
            b -= 1
        if a < b and not any(x < b and a < y for _, x, y in taken):
            found.append(("crf", a, b))
    return found


def scan(text: str, field: Field, shapes: Shapes) -> list[Span]:
    """All spans of a text, by start and then kind."""
    tokens = text.split()
    numbers = shapes.of(tokens)
    found = base_spans(text, hexadecimal=any(len(t) >= LEAST["hex"] for t in tokens))
    if tokens and max(numbers) > 1:
        tags = field.decode(field.scores(_padded(numbers), shapes.table(), file_features(text)))
        if tags.any():
            found += field_spans(text, tags, found)
    return by_place(found)


def _scanned(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    shapes = Shapes()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        passed = passed_on(batch)
        for row in range(0, batch.num_rows, 500):
            texts = text_of(batch).slice(row, 500).to_pylist()
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t or "", field, shapes)] for t in texts]
            part = passed.slice(row, len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], names=[*part.schema.names, *MADE])


#: Texts that a sample to learn from may hold have at most so many bytes.
LEARNED_BYTES = 1 << 20


def train_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1000) -> Field:
    """Learn from at most ``per_class`` texts that look like having a secret and as many of all
    texts, each those with the least hash of the id; only these reach the driver, one per id (of
    repeated ids that with the least hash), and none of over ``LEARNED_BYTES`` bytes."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    texts = texts.where(F.col("id").isNotNull() & (F.octet_length("text") <= LEARNED_BYTES))
    picked = [frame.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(per_class) for frame in (texts.where(F.col("text").rlike(LIKELY)), texts)]
    sample = F.broadcast(picked[0].union(picked[1]).distinct())
    rows = texts.join(sample, "id", "left_semi").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    return train([r.text for r in sorted(rows, key=lambda r: (str(r.id), r.text))])


def find_secrets(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents with spans: structs (kind, start, end) in code points, end exclusive, by start
    and then kind (assign, access, hex, crf).

    Matches of the fixed patterns all stay. The random field tags every white-space token as
    begin, inside or outside of a secret from its shape, the shapes and keywords of two words on
    either side, and features of the file; what it finds besides the patterns has kind crf and
    touches none of their spans. Null and empty texts have no spans; ids may be null or repeated;
    ``keep`` names columns to pass on; a column named spans is replaced; texts are read whole.
    """
    frame = chosen(docs, id_col, text_col, keep, MADE)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name != TEXT)
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    found = frame.mapInArrow(lambda batches: _scanned(batches, shared.value), f"{fields}, spans {kind}")
    return named(found, id_col, text_col)
