"""Exact deduplication: sorted runs of digests, merged in rounds between partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import SPACES
from vacantia.session import materialize


def normalised(text: Column) -> Column:
    """Text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, radix: int = 8, rounds: int | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal when they agree without ASCII white space; the row with the most code points
    stays, then the smallest id (nulls last), then the row that was read first, so of repeated
    rows exactly one stays. ``row`` numbers the rows; ``row_col`` names a column that does, for joins back. Null and
    empty texts are one group. Other columns are ignored.

    Each partition first makes one run: its distinct digests, with the best row and the number of
    rows. Binomial rounds follow over radix ** rounds slots, by default as many that every
    partition has a slot of its own. In round k a slot trades
    runs with the radix - 1 slots that differ from it in digit k: each digest moves to the slot
    that has the digest's own digit there, and the slot merges the sorted runs it receives,
    keeping the best row per digest. After the last round a slot holds all of its digests. A slot
    never receives a digest more than radix times in a round, however large the group is. A
    digest counts as the same only with the same number of bytes (``octets``), checked on every
    level. Winners go back by digest to the partitions' runs, and by partition to the documents.
    """
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    read = docs.select(F.col(f"`{id_col}`").alias("__id"), row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    bare = read.select("__id", "row", F.char_length("text").alias("points"), normalised(F.col("text")).alias("bare"))
    rows = materialize(
        bare.select(
            F.spark_partition_id().alias("part"), "row", "__id", "points",
            F.sha2("bare", 256).alias("digest"), F.octet_length("bare").alias("octets"),
        ),
        "digests",
    )
    best = F.struct((-F.col("points")).alias("shorter"), F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), "row")
    runs = rows.groupBy("part", "digest", "octets").agg(F.min(best).alias("best"), F.count("*").alias("n"))
    runs = materialize(runs.sortWithinPartitions("part", "digest", "octets"), "runs")
    if rounds is None:
        parts = 1 + (runs.agg(F.max("part")).first()[0] or 0)
        rounds = max(1, math.ceil(math.log(parts, radix) - 1e-9))
    slots = radix**rounds
    address = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(slots))
    merged = runs.withColumn("slot", F.pmod(F.col("part").cast("long"), F.lit(slots)))
    for k in range(rounds):
        unit = radix**k
        digit = lambda x: F.pmod(F.floor(x / unit), F.lit(radix))  # noqa: B023, E731
        moved = F.col("slot") + (digit(address) - digit(F.col("slot"))) * unit
        traded = merged.withColumn("slot", moved).repartition(slots, "slot").sortWithinPartitions("slot", "digest", "octets")
        merged = traded.groupBy("slot", "digest", "octets").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    winners = merged.select("digest", "octets", F.col("best").alias("winner"), F.col("n").alias("group_size"))
    answers = runs.select("part", "digest", "octets").join(winners, ["digest", "octets"])
    return rows.join(answers, ["part", "digest", "octets"]).select(
        F.col("__id").alias(id_col), F.col("winner.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"), F.col("digest").alias("text_sha256"), "row",
    )
