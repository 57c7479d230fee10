"""Merkle dataset manifest: a persistent hash tree whose versions copy only the paths of changed leaves."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.session import materialize

#: A block has up to 2 ** LEVELS nodes of one level, at positions that agree but for their last LEVELS bits.
LEVELS = 10
#: Columns that a leaf covers, in this order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Tree:
    """One aligned block: its nodes level by level. Versions share all nodes that they do not copy."""

    def __init__(self, leaves: list[str], levels: int):
        self.levels = [leaves]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[str]:
        """Level by level what stands beside the path of a leaf: "<" or ">" (left or right of it) and a digest, or "" (nothing)."""
        out = []
        for nodes in self.levels[:-1]:
            beside = at ^ 1
            out.append(("<" if beside < at else ">") + nodes[beside] if beside < len(nodes) else "")
            at >>= 1
        return out


def ancestors(leaf: str, siblings: list[str]) -> list[str]:
    """The copied path of a version: ``leaf`` and all nodes above it, with all other nodes as they were."""
    out = [leaf]
    for s in siblings:
        out.append(digest(s[1:] + out[-1] if s[:1] == "<" else out[-1] + s[1:]))
    return out


def height(nodes: int) -> int:
    """Levels above ``nodes`` nodes until one remains."""
    return max(nodes - 1, 0).bit_length()


def _leaf(frame_columns: dict[str, Column]) -> Column:
    """Each value as its number of UTF-8 bytes, a colon and the value; null as a dash."""
    parts = []
    for column in frame_columns.values():
        value = column.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def _placed(frame: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with ``pos``, their number in their group ``g`` by ``order``, and ``n``, the group's rows.

    Rows are sorted over all partitions and written; each partition's rows of a group are counted,
    and prefix sums of the counts give every partition its offset.
    """
    keys = ["g", *order]
    dealt = frame.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "__tie").sortWithinPartitions(*keys, "__tie")
    rows = materialize(dealt.drop("__tie").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), name)
    counts = rows.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("g", "part", "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"), F.sum("held").over(Window.partitionBy("g")).alias("n"))
    return rows.join(offsets, ["g", "part"]).withColumn("pos", F.col("offset") + F.col("at") - F.col("first")).drop("part", "at", "first", "offset")


def _in_blocks(rows: DataFrame, items: list[str], levels: int) -> DataFrame:
    """One row per block (g, block, n) with its nodes in order."""
    block = F.shiftright("pos", levels).alias("block")
    return rows.groupBy("g", block).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", *items))).alias("items"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _tree(row: dict, levels: int) -> Tree:
    return Tree([x["digest"] for x in row["items"]], min(levels, height(row["n"])))


def _roots(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        above = -(-row["n"] // (1 << levels))
        yield pa.RecordBatch.from_pylist([{"g": row["g"], "pos": row["block"], "n": above, "digest": _tree(row, levels).root}], NODES)


NODES = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
PATHS = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string())])


def _paths(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Of each node of a block: its siblings up to the root, those of the block's own root last."""
    for row in _rows(batches):
        tree = _tree(row, levels)
        made = [
            {"g": row["g"], "pos": x["pos"], "path": tree.siblings(k) + row["path"], "subroot": row["subroot"]}
            for k, x in enumerate(row["items"])
        ]
        yield pa.RecordBatch.from_pylist(made, PATHS)


def _grown(blocks: DataFrame, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from the leaves upwards, and the root of each group (g, pos, n, digest)."""
    tables = [blocks]
    while True:
        made = tables[-1].select("g", "block", "n", F.transform("items", lambda x: F.struct(x["digest"].alias("digest"))).alias("items"))
        nodes = materialize(made.mapInArrow(lambda b: _roots(b, levels), "g string, pos long, n long, digest string"), f"{name}_nodes")
        if nodes.where("n > 1").isEmpty():
            return tables, nodes
        tables.append(materialize(_in_blocks(nodes, ["digest"], levels), f"{name}_blocks"))


def _lowered(tables: list[DataFrame], paths: DataFrame, levels: int) -> DataFrame:
    """Paths (g, pos, path, subroot) of the lowest blocks' roots, from those of the groups' roots."""
    for table in reversed(tables[1:]):
        above = paths.select("g", F.col("pos").alias("block"), "path", "subroot")
        slim = table.select("g", "block", "n", "items").join(above, ["g", "block"])
        paths = slim.mapInArrow(lambda b: _paths(b, levels), "g string, pos long, path array<string>, subroot string")
    return paths


def build_manifest(
    docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", covered: tuple[str, ...] = COVERED,
    changed: dict[str, Column] | None = None, where: Column | None = None, levels: int = LEVELS,
) -> DataFrame:
    """One row per document: id, group, pos, leaf, subroot, root, proof, changed_leaf, copied, folded_root, verified.

    A leaf is the SHA-256 of the ``covered`` columns. The leaves of a group, by id (null first,
    then by digest), are hashed in twos level by level until its subroot remains, a node without a
    neighbour alone; the subroots, by group (null first, bytewise), give the root in the same way.

    Positions come from a distributed sort and prefix sums. A group is cut into aligned blocks of
    2 ** ``levels`` leaves; the roots of blocks are the leaves of the next round, so no task holds
    more than one block, however large a group is. ``proof`` lists the siblings from leaf to root.

    Where ``where`` holds, the document is a version of its own in which the columns of ``changed``
    have other values. A version shares all nodes of the tree but the leaf's ancestors, which
    ``copied`` lists from the new leaf to the new root: within its block, then in the blocks of
    upper levels; node ``level`` of them replaces number ``pos >> level`` of its group. Elsewhere
    ``changed_leaf`` and ``copied`` are null. ``folded_root`` is computed from the changed (else
    the given) leaf and the proof; ``verified`` tells whether it is the root.

    Repeated rows are leaves side by side; null ids and groups count like others; an empty table
    gives no rows. Columns with other names are ignored; names of results replace given ones.
    """
    values = {c: F.col(f"`{c}`") for c in covered}
    after = F.when(F.coalesce(where, F.lit(False)), _leaf(values | (changed or {}))) if where is not None else F.lit(None).cast("string")
    group = F.col(f"`{group_col}`").cast("string")
    read = docs.select(
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("g"), F.col(f"`{id_col}`").alias("id"),
        _leaf(values).alias("digest"), after.alias("after"),
    )
    # Hashing reads whole texts; only digests are sorted.
    leaves = _placed(materialize(read, "leaves"), ["id", "digest"], "sorted")
    blocks = materialize(_in_blocks(leaves, ["digest", "id", "after"], levels), "blocks")
    tables, subroots = _grown(blocks, levels, "groups")
    ordered = _placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"], "subroots")
    tops = materialize(_in_blocks(ordered, ["digest", "name"], levels), "tops")
    top_tables, top = _grown(tops, levels, "tops")
    found = top.select("digest").first()
    root = F.lit(found.digest if found else None).cast("string")
    start = top.select("g", F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("path"), root.alias("subroot"))
    above = _lowered(top_tables, start, levels).select("g", F.col("pos").alias("block"), "path")
    joined = tops.join(above, ["g", "block"]).select("n", "items", "path")
    roots = materialize(joined.mapInArrow(lambda b: _group_paths(b, levels), "g string, pos long, path array<string>, subroot string"), "roots")
    lowered = _lowered(tables, roots, levels).select("g", F.col("pos").alias("block"), "path", "subroot")
    kind = read.schema["id"].dataType.simpleString()
    shape = f"g string, pos long, id {kind}, leaf string, subroot string, root string, proof array<string>, changed_leaf string, copied array<string>, folded_root string, verified boolean"
    whole = blocks.join(lowered, ["g", "block"]).withColumn("root", root)
    out = whole.mapInArrow(lambda b: _leaves(b, levels), shape)
    named = F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias(group_col)
    return out.select(F.col("id").alias(id_col), named, *[c for c in out.columns if c not in ("g", "id")])


def _group_paths(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Of each group: the siblings of its subroot."""
    for row in _rows(batches):
        tree = _tree(row, levels)
        made = [{"g": x["name"], "pos": 0, "path": tree.siblings(k) + row["path"], "subroot": x["digest"]} for k, x in enumerate(row["items"])]
        yield pa.RecordBatch.from_pylist(made, PATHS)


def _leaves(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind = batch.schema.field("items").type.value_type.field("id").type
        shape = pa.schema([
            ("g", pa.string()), ("pos", pa.int64()), ("id", kind), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
            ("proof", pa.list_(pa.string())), ("changed_leaf", pa.string()), ("copied", pa.list_(pa.string())), ("folded_root", pa.string()), ("verified", pa.bool_()),
        ])
        for row in _rows([batch]):
            tree, root, made = _tree(row, levels), row["root"], []
            for k, x in enumerate(row["items"]):
                proof = tree.siblings(k) + row["path"]
                path = ancestors(x["after"] or x["digest"], proof)
                made.append({
                    "g": row["g"], "pos": x["pos"], "id": x["id"], "leaf": x["digest"], "subroot": row["subroot"], "root": root, "proof": proof,
                    "changed_leaf": x["after"], "copied": path if x["after"] else None, "folded_root": path[-1], "verified": path[-1] == root,
                })
            yield pa.RecordBatch.from_pylist(made, shape)


def proof_digest(proof: str = "proof") -> Column:
    """SHA-256 of a proof's digests, joined in order."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""), 256)
