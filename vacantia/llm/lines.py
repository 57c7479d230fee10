"""Line deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import SPACES, ascii_lower
from vacantia.session import materialize


#: Parts that the holders of a line are dealt into, so that a very common line is no single task's.
SALTS = 32


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), min_chars: int = 20, min_docs: int = 3,
) -> DataFrame:
    """Documents with kept_text, n_lines (before) and n_dropped.

    A line's key is the line without outer ASCII white space, A-Z lower-cased. Keys of at least
    ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines but
    those of the largest id that holds it. Lines are exploded as 128-bit hashes with their
    position, never as text; a document sends each hash once, and counts are summed before they
    are shuffled. Only the positions to drop return to the documents, which keep the other lines
    in order.

    A null or empty text is one empty line. A null id counts as a document smaller than all
    others; repeated rows of an id are one document for the counts and each lose the same lines.
    ``keep`` names columns to pass on, but for those the result makes. Long texts are split whole.
    """
    made = ("kept_text", "n_lines", "n_dropped")
    passed = [F.col(f"`{c}`") for c in keep if c not in made]
    base = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"), *passed)
    base = base.withColumn("__hash", F.xxhash64("__text"))
    keys = (
        base.select("__id", "__hash", F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line"))
        .select("__id", "__hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("__id", "__hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    held = materialize(keys.groupBy("h1", "h2", "__id", "__hash").agg(F.collect_list("pos").alias("pos")), "lines")
    known = F.struct(F.col("__id").isNotNull().alias("known"), F.col("__id").alias("id"))
    common = (
        held.groupBy("h1", "h2", "__id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max(known).alias("last"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", F.col("last.id").alias("last_id"))
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = held.withColumn("salt", F.pmod(F.xxhash64("__id", "__hash"), F.lit(SALTS)).cast("int"))
    dropped = (
        salted.join(common.select("*", salts), ["h1", "h2", "salt"])
        .where(~F.col("last_id").eqNullSafe(F.col("__id")))
        .groupBy(F.col("__id").alias("__of"), F.col("__hash").alias("__of_hash"))
        .agg(F.flatten(F.collect_list("pos")).alias("drop"))
    )
    same = F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__hash") == F.col("__of_hash"))
    lines = F.split("__text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col("drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    joined = base.join(dropped.hint("shuffle_hash"), same, "left").withColumn("lines", lines).withColumn("n_lines", F.size("lines").cast("long"))
    return joined.select(
        F.col("__id").alias(id_col), *passed,
        F.when(F.col("drop").isNull(), F.col("__text")).otherwise(kept).alias("kept_text"),
        "n_lines", F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
