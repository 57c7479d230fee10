"""A corpus from documents: toxicity, exact and near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import decontam, exact, packing, simhash, toxicity
from vacantia.llm.common import read
from vacantia.llm.queries import public_words, toxicity_network
from vacantia.session import materialize, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]


def _numbered(docs: DataFrame) -> DataFrame:
    """With a number for each row, the same in every reading of the stage's written input."""
    return docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row"))


def _kept(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows that a grouping keeps; texts are shuffled once and only row numbers are held for it."""
    kept = groups.where("kept").select("row").hint("shuffle_hash")
    return docs.join(kept, "row", "left_semi").select(*COLUMNS)


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5."""
    network = toxicity_network(spark, read(spark, sf_dir, "documents", "doc_id", "text"), sf_dir)
    return toxicity.score_toxicity(docs, network, keep=REST).where("predicted = 0").select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that agrees but for white space."""
    rows = _numbered(docs)
    return _kept(rows, exact.exact_groups(rows.select("doc_id", "text", "row"), row_col="row"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree to 0.8."""
    rows = _numbered(docs)
    return _kept(rows, simhash.similar_groups(rows.select("doc_id", "text", "row"), row_col="row"))


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    found = decontam.find_contamination(docs, read(spark, sf_dir, "benchmark"), keep=REST)
    return found.where(~decontam.contaminated()).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4,096-token sequences, with the checksum of their ids."""
    pieces = packing.pack(docs.select("doc_id", "text"), public_words)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", clean_language),
    ("exact_dedup", exact_copies),
    ("simhash_dedup", near_copies),
    ("decontamination", no_benchmarks),
    ("packing", packed),
]
#: The network, fingerprints and tokenizer are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
