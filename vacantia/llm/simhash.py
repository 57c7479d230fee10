"""SimHash near-deduplication by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import byte_texts
from vacantia.llm.components import components
from vacantia.llm.exchange import answer_rows, asked, block_table, by_shard, by_shards, joined_answers, packed, partitions, rows_of, unpacked, with_answers
from vacantia.session import materialize

BITS, SEED = 64, 42
MANY = 256


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bits set in over half of the XXH64 of the word shingles, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hash_of(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-width].tolist()]
    hashes = np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65_536 + 1):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def covering_masks(radius: int) -> list[int]:
    """Masks such that fingerprints within ``radius`` (up to 5) bits agree on one of them.

    Bit i has a nonzero vector f(i) of radius + 1 bits, and the mask of each nonzero vector v
    holds the bits with odd <f(i), v>. At most ``radius`` vectors have a common orthogonal v, so
    some mask leaves out all differing bits. The bits a mask leaves out fall into radius + 1
    parts, of which one has no difference either: it joins the mask. That keeps buckets apart and
    bounds them, at radius 2 to 2 ** 19 fingerprints.
    """
    vectors = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, vectors + 1):
        free = [i for i in range(BITS) if ((i % vectors + 1) & v).bit_count() % 2 == 0]
        mask = (1 << BITS) - 1 - sum(1 << i for i in free)
        masks += [mask | sum(1 << i for i in free[part :: radius + 1]) for part in range(radius + 1)]
    return masks


def bucket_links(values: np.ndarray, radius: int, free: list[int]) -> list[tuple[int, int]]:
    """Links that join the sorted distinct fingerprints of one bucket as all their links would.

    Small buckets are compared as a matrix; in large ones each value looks up the values at every
    offset within the radius, so the work grows with the values, not their pairs. The members
    of a component hang together as a tree with few children each.
    """
    n = len(values)
    labels = np.arange(n)
    if n <= MANY:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
        sources, targets = np.nonzero(near)
        moves = [(sources, targets)]
    else:
        offsets = [sum(1 << i for i in c) for size in range(1, radius + 1) for c in combinations(free, size)]

        def look() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for offset in offsets:
                wanted = values ^ np.uint64(offset)
                at = np.minimum(np.searchsorted(values, wanted), n - 1)
                found = np.flatnonzero(values[at] == wanted)
                yield found, at[found]

        moves = None
    while True:
        before = labels.copy()
        for sources, targets in moves or look():
            np.minimum.at(labels, targets, labels[sources])
        while not np.array_equal(labels, labels[labels]):
            labels = labels[labels]
        if np.array_equal(before, labels):
            break
    links = []
    order = np.argsort(labels, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
        links += [(int(values[members[(k - 1) // 8]]), int(values[members[k]])) for k in range(1, len(members))]
    return links


def _links(batches: Iterator[pa.RecordBatch], radius: int, masks: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (mask, key): one bucket after the other."""
    rest_mask, rest_key, rest_fp = np.array([], np.int32), np.array([], np.uint64), np.array([], np.uint64)

    def work(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(mask)]))
        links = []
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            free = [i for i in range(BITS) if not masks[mask[a]] >> i & 1]
            links += bucket_links(np.unique(fp[a:b]), radius, free)
        pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        mask = np.concatenate((rest_mask, batch.column("mask").to_numpy(zero_copy_only=False)))
        key = np.concatenate((rest_key, batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)))
        fp = np.concatenate((rest_fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
        last = int(np.flatnonzero((mask != mask[-1]) | (key != key[-1]))[-1]) + 1 if (mask[0], key[0]) != (mask[-1], key[-1]) else 0
        if last:
            yield work(mask[:last], key[:last], fp[:last])
        rest_mask, rest_key, rest_fp = mask[last:], key[last:], fp[last:]
    if len(rest_mask):
        yield work(rest_mask, rest_key, rest_fp)


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in byte_texts(batch.column("__text")):
            found = pa.array([_signed(fingerprint(t, width)) for t in texts], pa.int64())
            ids, rows = (batch.column(n).slice(start, len(texts)) for n in ("__id", "row"))
            yield pa.RecordBatch.from_arrays([ids, rows, found], names=["__id", "row", "fp"])


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, radius: int = 2, width: int = 3) -> DataFrame:
    """One row per document: id, fingerprint (hex), component_id, kept, row.

    Documents link when their fingerprints differ in at most ``radius`` bits; component_id is
    the smallest id reachable over links, and one row of each component is kept: that of this id
    (of repeated rows, the one read first). Copies become one fingerprint before any comparison.
    Distinct fingerprints are dealt into buckets by ``covering_masks``, so no link can be missed;
    a bucket gives a tree of links, and components are found over those.

    Null and empty texts, and others without words, have fingerprint zero and link like others.
    Null ids come after all others. Other columns are ignored; long texts are hashed whole; an
    empty table gives no rows. ``row`` numbers the rows; ``row_col`` names a column that does,
    for joins back.
    """
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    frame = docs.select(F.col(f"`{id_col}`").alias("__id"), row.alias("row"), F.col(f"`{text_col}`").alias("__text"))
    kind = frame.schema["__id"].dataType.simpleString()
    hashed = frame.mapInArrow(lambda batches: _fingerprints(batches, width), f"__id {kind}, row long, fp long")
    rows = materialize(hashed, "fingerprints")
    best = F.struct(F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), "row")
    copies = materialize(rows.groupBy("fp").agg(F.min(best).alias("best")), "distinct")
    masks = covering_masks(radius)
    keyed = F.explode(F.array(*[_key(number, mask) for number, mask in enumerate(masks)]))
    dealt = copies.select("fp", keyed.alias("k")).select("k.mask", "k.key", "fp")
    sorted_ = dealt.repartition("mask", "key").sortWithinPartitions("mask", "key")
    links = sorted_.mapInArrow(lambda batches: _links(batches, radius, masks), "a long, b long")
    roots = components(links)
    group = roots.join(copies, roots.node == copies.fp).groupBy("root").agg(F.min("best").alias("first"))
    linked = roots.join(group, "root").select(F.col("node").alias("fp"), "first")
    answers = copies.join(linked, "fp", "left").select("fp", F.coalesce("first", "best").alias("first"))
    return rows.join(answers, "fp").select(
        F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"), "row",
    )


def _key(number: int, mask: int) -> Column:
    return F.struct(F.lit(number).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))


# ------------------------------------------------------------------ similar texts, verified
#: Shingles of one text in `SAMPLED` that count as common from `COMMON_FROM` texts on, and how many are listed at most.
SAMPLED, COMMON_FROM, COMMON = 16, 4, 1 << 16
#: A block of a large bucket has at most so many shingles, a text counting as `LEAST` or more: 512 texts or one long one.
BLOCK, LEAST = 1 << 20, 1 << 11
#: Rows of a bucket up to which its pairs are sent as such, and not compared in blocks.
FEW = 64
#: Bits of a row's place in its block of texts, and the bytes and texts that such a block may have.
PLACE, TEXT_BYTES = 20, 4 << 20
#: Bits of a shingle's hash that buckets go by; a collision only adds a pair to compare.
TOKEN_BITS = 48


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles, none of a text without words."""
    import xxhash

    words, hash_of = text.lower().split(), xxhash.xxh64_intdigest
    if not words:
        return np.array([], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, last = [0, *ends[:-width].tolist()], [len(joined)] if len(words) <= width else (ends[width - 1 :] - 1).tolist()
    return np.unique(np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts[: len(last)], last, strict=True)], np.uint64))


def majority(found: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for part in np.array_split(found, len(found) // 65_536 + 1):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view(np.uint64)[0])


def prefix(found: np.ndarray, listed: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in one order for all texts: those not listed by hash, then the listed by rank.

    Sets of Jaccard ``similarity`` share at least that part of either, so more than it has
    outside the prefix: their prefixes have a shingle in common, whatever is listed.
    """
    size = len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1
    if not len(found) or not len(listed):
        return found[:size]
    at = np.minimum(np.searchsorted(listed, found), len(listed) - 1)
    return found[np.argsort(np.where(listed[at] == found, rank[at], -1), kind="stable")[:size]]


def similar(sizes: np.ndarray, other: int, both: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of ``sizes`` and one of ``other`` agree to ``similarity``, with ``both`` in common."""
    return both + 1e-9 >= similarity * (sizes + other - both)


def early(n: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """Rows that can be the smaller (or an equal) set of a similar pair whose first common shingle is this one.

    With the first common shingle at places i and j of sets of n and m shingles, at most
    min(n - i, m - j) are common, and similar sets have s / (1 + s) (n + m) in common or more; for
    n <= m that is at least 2 s / (1 + s) n.
    """
    return n - place + 1e-9 >= 2 * similarity / (1 + similarity) * n


def _all_shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in byte_texts(batch.column("__text")):
            found = np.concatenate([shingles(t, width) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["shingle"])


def _common(frame: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, sorted, and their ranks by number of texts.

    They only set the order of shingles: any list gives the same links, this one small buckets.
    """
    sample = frame.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0).select("__text")
    counts = sample.mapInArrow(lambda batches: _all_shingles(batches, width), "shingle long").groupBy("shingle").count()
    most = counts.where(F.col("count") >= COMMON_FROM).orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    listed = np.array([r.shingle for r in most], np.int64).view(np.uint64)
    order = np.argsort(listed)
    return listed[order], (len(most) - order).astype(np.int64)


def _text_schema(kind: pa.DataType) -> pa.Schema:
    row = pa.struct([("id", kind), ("row", pa.int64()), ("slot", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("fp", pa.int64())])
    return pa.schema([("block", pa.int64()), ("rows", pa.list_(row)), ("texts", pa.list_(pa.binary())), ("sizes", pa.binary()), ("tokens", pa.binary()), ("n_tokens", pa.int64())])


def _text_blocks(batches: Iterator[pa.RecordBatch], width: int, similarity: float, listed: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of whole texts, with a row's digest, number of shingles, fingerprint and prefix."""
    import xxhash

    block, size, rows, texts, heads = TaskContext.get().partitionId() << 22, 0, [], [], []

    def flush() -> pa.RecordBatch:
        tokens = np.concatenate(heads) >> np.uint64(64 - TOKEN_BITS)
        made = {"block": block, "rows": rows, "texts": texts, "sizes": packed(np.array([len(h) for h in heads])), "tokens": packed(tokens), "n_tokens": len(tokens)}
        return pa.RecordBatch.from_pylist([made], _text_schema(kind))

    for batch in batches:
        kind = batch.schema.field("__id").type
        for start, part in byte_texts(batch.column("__text"), TEXT_BYTES):
            given = [batch.column(n).slice(start, len(part)).to_pylist() for n in ("__id", "row")]
            for i, row, text in zip(*given, part, strict=True):
                found = shingles(text, width)
                hi, lo = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64).tolist()
                rows.append({"id": i, "row": row, "slot": block << PLACE | len(rows), "hi": hi, "lo": lo, "n": len(found), "fp": _signed(majority(found)) if len(found) else 0})
                texts.append(text)
                heads.append(prefix(found, listed, rank, similarity))
                size += len(text)
                if size >= TEXT_BYTES or len(rows) >> PLACE:
                    yield flush()
                    block, size, rows, texts, heads = block + 1, 0, [], [], []
    if rows:
        yield flush()


class Heads:
    """Prefixes of a block's texts that stand for their copies: tokens, their texts, places, and distinct tokens."""

    def __init__(self, row: dict):
        sizes, tokens = unpacked(row["sizes"]), unpacked(row["tokens"])
        stays = np.zeros(len(sizes), bool)
        stays[np.array(row["firsts"] or [], np.int64)] = True
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = stays[self.text]
        self.tokens, self.text, self.place = tokens[own], self.text[own], self.place[own]
        self.n = np.array([r["n"] for r in row["rows"]], np.int64)
        self.slot = np.array([r["slot"] for r in row["rows"]], np.int64)
        self.key, self.of, self.times = np.unique(self.tokens, return_inverse=True, return_counts=True)


TOKEN_MESSAGES = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("several", pa.binary())])


def _send_tokens(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        heads = Heads(row)
        to, order, edges = by_shard(heads.key, shards)
        rows = []
        for shard, i, j in zip(to.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = order[i:j]
            several = np.packbits(heads.times[at] > 1).tobytes()
            rows.append({"shard": shard, "block": row["block"], "keys": packed(np.diff(heads.key[at], prepend=0)), "several": several})
        yield pa.RecordBatch.from_pylist(rows, TOKEN_MESSAGES)


def _judge_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each token of each block: 1 if another text has it, in this block or elsewhere."""
    for shard, rows in by_shards(batches):
        parts = [np.cumsum(unpacked(r["keys"])) for r in rows]
        several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(p)) for r, p in zip(rows, parts, strict=True)])
        _, at, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = (count > 1) | (np.bincount(at, several) > 0)
        answers = np.split(shared[at].astype(np.int64), np.cumsum([len(p) for p in parts])[:-1])
        for i in range(0, len(rows), 500):
            yield answer_rows(shard, [r["block"] for r in rows[i : i + 500]], [packed(x) for x in answers[i : i + 500]])


def _told(row: dict, shards: int) -> tuple[Heads, np.ndarray]:
    """A block's prefixes, and which of their tokens another text has."""
    heads = Heads(row)
    _, order, _ = by_shard(heads.key, shards)
    return heads, joined_answers(row["answers"], order)[0][heads.of] > 0


def _shared(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Rows of the tokens that several texts have, with the text's number of such tokens."""
    for row in rows_of(batches):
        heads, common = _told(row, shards)
        text = heads.text[common]
        company = np.bincount(text, minlength=len(heads.n))[text]
        columns = (heads.tokens[common], heads.slot[text], heads.n[text], heads.place[common], company)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["token", "row", "n", "place", "company"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Shingles of the texts that are asked for."""
    for row in rows_of(batches):
        for i in range(0, len(row["wanted"]), 256):
            some = row["wanted"][i : i + 256]
            found = pa.array([shingles(row["texts"][k], width).tobytes() for k in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([row["block"] << PLACE | k for k in some]), found], names=["row", "found"])


def _sent(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Shingles of a text to each block that has a partner of it."""
    for row in rows_of(batches):
        held: dict[int, bytes] = {}
        for i in range(0, len(row["ships"]), 256):
            some = row["ships"][i : i + 256]
            for x in some:
                if x["a"] not in held:
                    held[x["a"]] = shingles(row["texts"][x["a"] & (1 << PLACE) - 1], width).tobytes()
            columns = [pa.array([x["to"] for x in some]), pa.array([x["a"] for x in some]), pa.array([held[x["a"]] for x in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "a", "found"])


def _buckets(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole buckets, and where each begins and the last ends; rows come sorted by the first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if not len(columns[0]):
            continue
        edges = np.flatnonzero(np.diff(columns[0])) + 1
        new = bool(held) and columns[0][0] != held[-1][0][-1]
        if len(edges) or new:  # parts of one bucket are joined once, when it ends
            cut = edges[-1] if len(edges) else 0
            whole = [np.concatenate(x) for x in zip(*held, [c[:cut] for c in columns], strict=True)]
            if len(whole[0]):
                yield whole, np.concatenate(([0], np.flatnonzero(np.diff(whole[0])) + 1, [len(whole[0])]))
            held, columns = [], [c[cut:] for c in columns]
        held.append(columns)
    if held:
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        yield whole, np.concatenate(([0], np.flatnonzero(np.diff(whole[0])) + 1, [len(whole[0])]))


def _stars(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (token, company, row): each row of a bucket with its first one, if sizes and places allow."""
    share = similarity / (1 + similarity)
    token, first, size, root, at = None, 0, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens, row, n, roots, place = (batch.column(c).to_numpy() for c in ("token", "row", "n", "root", "place"))
        begins = np.concatenate(([0], np.flatnonzero(np.diff(tokens)) + 1))
        of = np.searchsorted(begins, np.arange(len(row)), side="right") - 1
        lead, lead_n, lead_root, lead_place = row[begins], n[begins], roots[begins], place[begins]
        if tokens[0] == token:
            lead[0], lead_n[0], lead_root[0], lead_place[0] = first, size, root, at
        token, first, size, root, at = tokens[-1], lead[-1], lead_n[-1], lead_root[-1], lead_place[-1]
        a, a_n, a_root, a_place = lead[of], lead_n[of], lead_root[of], lead_place[of]
        fits = (a_root != roots) & (np.minimum(a_n, n) + 1e-9 >= similarity * np.maximum(a_n, n))
        fits &= np.minimum(a_n - a_place, n - place) + 1e-9 >= share * (a_n + n)
        pairs = np.unique(np.stack((a[fits], row[fits]), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that are similar: the shingles of a have come to the block that has b's text."""
    for row in rows_of(batches):
        given = {x["a"]: np.frombuffer(x["found"], np.uint64) for x in row["given"]}
        links, now, own = [], None, np.array([], np.uint64)
        for a, b in sorted(((x["a"], x["b"]) for x in row["pairs"]), key=lambda x: x[1]):
            if b != now:
                now, own = b, shingles(row["texts"][b & (1 << PLACE) - 1], width)
            other = given[a]
            at = np.minimum(np.searchsorted(own, other), max(len(own) - 1, 0))
            both = int((own[at] == other).sum()) if len(own) else 0
            if similar(len(own), len(other), both, similarity):
                links.append((a, b))
        pairs = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _pairs(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of different groups in buckets of up to ``FEW`` rows, in how many buckets they meet,
    and whether one of these can be that of their first common token."""
    share = similarity / (1 + similarity)
    for (_, row, n, place, root), edges in _buckets(batches, ("token", "row", "n", "place", "root")):
        found = [np.empty((0, 5), np.int64)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > FEW or (root[a:b] == root[a]).all():
                continue
            i, j = (a + x for x in np.triu_indices(b - a, 1))
            fits = (root[i] != root[j]) & (np.minimum(n[i], n[j]) + 1e-9 >= similarity * np.maximum(n[i], n[j]))
            i, j = i[fits], j[fits]
            i, j = np.where(row[i] < row[j], i, j), np.where(row[i] < row[j], j, i)
            first = np.minimum(n[i] - place[i], n[j] - place[j]) + 1e-9 >= share * (n[i] + n[j])
            found.append(np.stack((row[i], row[j], n[i], n[j], first), axis=1))
        every = np.concatenate(found)
        pairs, at, counts = np.unique(every[:, :4], axis=0, return_inverse=True, return_counts=True)
        first = np.bincount(at, every[:, 4], len(pairs)) > 0
        yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in pairs.T], pa.array(counts), pa.array(first)], names=["a", "b", "n_a", "n_b", "times", "first"])


def _blocks(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Block pairs of the larger buckets that hold rows of several groups; a bucket's rows come sorted by size.

    The smaller set of a pair has the token early (``early``), so of the left block only such rows
    are sent, and two blocks meet unless sizes or a common group rule out a new link. Their key is
    a hash of their rows: what several buckets have alike is compared once.
    """
    import xxhash

    for (_, row, n, place, root), edges in _buckets(batches, ("token", "row", "n", "place", "root")):
        first = early(n, place, similarity)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a <= FEW or (root[a:b] == root[a]).all() or not first[a:b].any():
                continue
            number = np.cumsum(np.maximum(n[a:b], LEAST).astype(np.int64)) // BLOCK
            cuts = a + np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1, [b - a]))
            for i in range(len(cuts) - 1):
                left = np.arange(cuts[i], cuts[i + 1])
                left = left[first[left]]
                if not len(left):
                    continue
                for j in range(i, len(cuts) - 1):
                    if n[left[-1]] < similarity * n[cuts[j]] - 1e-9:
                        break
                    at = np.arange(cuts[i], cuts[i + 1]) if i == j else np.concatenate((left, np.arange(cuts[j], cuts[j + 1])))
                    if (root[at] == root[at[0]]).all():
                        continue
                    fixed = [pa.array(np.full(len(at), x, np.int32)) for x in (i, j)]
                    key = np.full(len(at), _signed(xxhash.xxh3_64_intdigest(row[at].tobytes())))
                    columns = [pa.array(key), *fixed, pa.array(at >= cuts[i + 1]), pa.array(row[at]), pa.array(root[at])]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "i", "j", "right", "row", "root"])


def block_links(rows: list[int], roots: list[int], right: list[bool], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A tree of verified links between groups: each row with all later ones of other groups, or all of the right block."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    rows, roots, right = (np.array(x)[order] for x in (rows, roots, right))
    sets = [sets[k] for k in order]
    sizes, crossing, links = np.array([len(s) for s in sets]), right.any(), []
    for k in range(len(rows)):
        fits = (roots[k + 1 :] != roots[k]) & (similarity * sizes[k + 1 :] <= sizes[k] + 1e-9)
        if crossing:
            fits &= right[k + 1 :] != right[k]
        others = k + 1 + np.flatnonzero(fits)
        if not len(others):
            continue
        joined = np.concatenate([sets[o] for o in others])
        at = np.minimum(np.searchsorted(sets[k], joined), sizes[k] - 1)
        both = np.add.reduceat((sets[k][at] == joined).astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
        for o in others[similar(sizes[others], sizes[k], both, similarity)]:
            if roots[o] != roots[k]:
                links.append((int(rows[k]), int(rows[o])))
                roots[roots == roots[o]] = roots[k]
    return links


def _compared(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, i, j): one pair of blocks after the other."""
    key, held = None, []

    def work() -> pa.RecordBatch:
        rows, roots, right, sets = zip(*held, strict=True)
        links = block_links(rows, roots, right, [np.frombuffer(s, np.uint64) for s in sets], similarity)
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        keys = zip(*[batch.column(n).to_pylist() for n in ("key", "i", "j")], strict=True)
        values = zip(*[batch.column(n).to_pylist() for n in ("row", "root", "right", "found")], strict=True)
        for now, value in zip(keys, values, strict=True):
            if now != key and held:
                yield work()
                held = []
            key = now
            held.append(value)
    if held:
        yield work()


def _near_fingerprints(firsts: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of rows whose fingerprints are linked by ``covering_masks``, and rows of equal fingerprints with their first."""
    masks = covering_masks(radius)
    copies = materialize(firsts.where("n > 0").groupBy("fp").agg(F.min("slot").alias("one")), "fingerprints")
    keyed = F.explode(F.array(*[_key(number, mask) for number, mask in enumerate(masks)]))
    dealt = copies.select("fp", keyed.alias("k")).select("k.mask", "k.key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key")
    links = dealt.mapInArrow(lambda batches: _links(batches, radius, masks), "a long, b long").distinct()
    left, right = (copies.select(F.col("fp").alias(c), F.col("one").alias(f"{c}_row")) for c in ("a", "b"))
    between = links.join(left, "a").join(right, "b").select(F.col("a_row").alias("a"), F.col("b_row").alias("b"))
    alike = firsts.where("n > 0").join(copies, "fp").where("slot <> one").select(F.col("one").alias("a"), F.col("slot").alias("b"))
    return between.unionByName(alike)


def similar_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, similarity: float = 0.8, width: int = 5, radius: int = 2,
) -> DataFrame:
    """One row per document: id, component_id, kept, row. Groups are linked by verified similarity.

    Documents link when their sets of ``width``-word shingles agree to ``similarity`` (Jaccard),
    decided on all shingles of both; no such pair is missed. Equal sets become one row first.

    1. Texts are written in blocks, each with its fingerprint (the majority bits of its shingles)
       and its prefix: the part of its shingles, rare ones first, of which similar sets share one.
    2. Fingerprints meet by ``covering_masks``; pairs within ``radius`` bits are verified and linked.
    3. What is further apart is found by prefixes. Blocks ask shards which of their prefix tokens
       another text has, and only those tokens become rows. In its buckets a row first meets the
       one with the most common tokens. To verify a pair, the shingles of one text go to the block
       of the other. Buckets that still hold several groups send their pairs,
       those of over ``FEW`` rows pairs of blocks that a task of bounded size compares. A pair is
       only taken where the places of the token let it be the pair's first common one.

    One row of each component is kept, that of its smallest id (nulls last, then the row number).
    Null and empty texts are one group; repeated rows are each a row; other columns are ignored.
    ``row`` numbers the rows; ``row_col`` names a column that does, for joins back.
    """
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    frame = docs.select(F.col(f"`{id_col}`").alias("__id"), row.cast("long").alias("row"), F.col(f"`{text_col}`").alias("__text"))
    kind = frame.schema["__id"].dataType.simpleString()
    listed, rank = _common(frame, width)
    fields = f"id: {kind}, row: bigint, slot: bigint, hi: bigint, lo: bigint, n: bigint, fp: bigint"
    made = frame.mapInArrow(
        lambda batches: _text_blocks(batches, width, similarity, listed, rank),
        f"block long, rows array<struct<{fields}>>, texts array<binary>, sizes binary, tokens binary, n_tokens long",
    )
    blocks = block_table(made, "similar")
    rows = blocks.select(F.explode("rows").alias("r")).select("r.*")
    firsts = materialize(rows.groupBy("hi", "lo").agg(F.min(F.struct("slot", "n", "fp")).alias("one")).select("one.*"), "firsts")
    near = materialize(_near_fingerprints(firsts, radius), "near")

    def by_block(slots: DataFrame, name: str) -> DataFrame:
        place = F.col("slot").bitwiseAND(F.lit((1 << PLACE) - 1))
        return slots.groupBy(F.shiftright("slot", PLACE).alias("block")).agg(F.collect_list(place).alias(name)).hint("shuffle_hash")

    held = blocks.join(by_block(firsts, "firsts"), "block", "left")
    shards = max(partitions(docs), -(-(blocks.agg(F.sum("n_tokens")).first()[0] or 0) // (1 << 20)))
    slim = held.select("block", "rows", "sizes", "tokens", "firsts")
    sent = slim.mapInArrow(lambda b: _send_tokens(b, shards), "shard long, block long, keys binary, several binary")
    told = with_answers(slim, asked(sent, _judge_tokens, "tokens"), "answers")
    shared = materialize(told.mapInArrow(lambda b: _shared(b, shards), "token long, row long, n long, place long, company long"), "shared")
    texts = blocks.select("block", "texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Shingles of a go once to each block with a partner of it; texts stay where they are."""
        pairs = materialize(pairs.select("a", "b", F.shiftright("a", PLACE).alias("block"), F.shiftright("b", PLACE).alias("to")), f"{name}_pairs")
        ships = pairs.select("block", "a", "to").distinct().groupBy("block").agg(F.collect_list(F.struct("a", "to")).alias("ships"))
        made = texts.join(ships.hint("shuffle_hash"), "block").mapInArrow(lambda b: _sent(b, width), "block long, a long, found binary")
        given = made.groupBy("block").agg(F.collect_list(F.struct("a", "found")).alias("given"))
        own = pairs.groupBy(F.col("to").alias("block")).agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
        met = texts.join(given.hint("shuffle_hash"), "block").join(own.hint("shuffle_hash"), "block")
        return materialize(met.mapInArrow(lambda b: _verified(b, width, similarity), "a long, b long"), name)

    def grouped(links: DataFrame) -> DataFrame:
        roots = components(links)
        return shared.join(roots, shared.row == roots.node, "left").select("token", "row", "n", "place", "company", F.coalesce("root", "row").alias("root"))

    links = verified(near, "links")
    ranked = grouped(links).repartition("token").sortWithinPartitions("token", F.desc("company"), "row")
    links = links.union(verified(ranked.mapInArrow(lambda b: _stars(b, similarity), "a long, b long").distinct(), "links"))
    dealt = grouped(links).drop("company").repartition("token").sortWithinPartitions("token", "n", "row")
    counted = dealt.mapInArrow(lambda b: _pairs(b, similarity), "a long, b long, n_a long, n_b long, times long, first boolean")
    counted = counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("times").alias("times"), F.max("first").alias("first"))
    # Common shingles up to the end of the one prefix are all counted; of those after it the set has no more than it has left.
    most = F.col("times") + F.greatest(*[F.ceil(similarity * F.col(n) - 1e-9) - 1 for n in ("n_a", "n_b")])
    enough = most + 1e-9 >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b"))
    rest = verified(counted.where(F.col("first") & enough).select("a", "b"), "links")
    shape = "key long, i int, j int, right boolean, row long, root long"
    pieces = materialize(dealt.mapInArrow(lambda b: _blocks(b, similarity), shape).distinct(), "blocks")
    links = links.union(rest)
    if not pieces.isEmpty():
        wanted = by_block(pieces.select(F.col("row").alias("slot")).distinct(), "wanted")
        sets = materialize(texts.join(wanted, "block").mapInArrow(lambda b: _sets(b, width), "row long, found binary"), "sets")
        met = pieces.join(sets, "row").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        met = met.select("key", "i", "j", "right", "row", "root", "found")
        links = links.union(met.mapInArrow(lambda b: _compared(b, similarity), "a long, b long"))
    roots = components(links)

    best = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    copies = rows.groupBy("hi", "lo").agg(F.min("slot").alias("one"), F.min(best).alias("least"))
    joined = copies.join(roots, copies.one == roots.node, "left").withColumn("root", F.coalesce("root", "one"))
    first = joined.groupBy("root").agg(F.min("least").alias("first"))
    answers = joined.join(first, "root").select("hi", "lo", "first")
    return rows.join(answers, ["hi", "lo"]).select(
        F.col("id").alias(id_col), F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"), "row"
    )
