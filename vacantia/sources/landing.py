"""Landed raw postings: JSON scan, JSON sinks, page-bounded and profile-driven ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions import dictionaries as D
from vacantia.operators.phrases import word_list
from vacantia.operators.ranking import cap_per_run, keep_first, top_per_group
from vacantia.operators.selection import filter_identified, filter_recent
from vacantia.schema import LANDED
from vacantia.session import materialize
from vacantia.sources.json_files import CORRUPT, reader_with_corrupt, reads, well_formed


def read_landed(
    spark: SparkSession, directory: str, schema: T.StructType = LANDED, pattern: str = "jobs_*.json"
) -> DataFrame:
    """All postings of files named like `pattern` below the directory.

    A file holds a JSON list or a single object; a file that does not parse is left out whole
    (`skipped_files` names it). A missing directory or one without such files has no rows.
    src_file and src_pos give every posting a fixed position.
    """
    rows = _scan(_whole_files(spark, schema), directory, schema, pattern)
    return well_formed(rows, schema)


def skipped_files(
    spark: SparkSession, directory: str, schema: T.StructType = LANDED, pattern: str = "jobs_*.json"
) -> DataFrame:
    """(src_file, bytes) of the files that read_landed leaves out, for the run's log."""
    rows = _scan(_whole_files(spark, schema), directory, schema, pattern)
    return rows.filter(F.col(CORRUPT).isNotNull() & reads(schema.fieldNames()[0])).select("src_file", F.octet_length(CORRUPT).cast("long").alias("bytes"))


def _whole_files(spark: SparkSession, schema: T.StructType) -> DataFrameReader:
    return reader_with_corrupt(spark.read, schema).option("multiLine", True)


def read_landed_lines(
    spark: SparkSession, directory: str, schema: T.StructType = LANDED, pattern: str = "*.json"
) -> DataFrame:
    """Postings of JSON-lines files, which Spark splits and reads in parallel; bad lines are dropped."""
    return well_formed(_scan(reader_with_corrupt(spark.read, schema), directory, schema, pattern), schema)


def _scan(
    reader: DataFrameReader, directory: str, schema: T.StructType, pattern: str
) -> DataFrame:
    try:
        rows = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(directory)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        spark = SparkSession.active()
        fields = [*schema.fields, T.StructField(CORRUPT, T.StringType()), T.StructField("src_file", T.StringType()), T.StructField("src_pos", T.LongType())]
        return spark.createDataFrame([], T.StructType(fields))
    # A scan task reads its files in order, so the id grows along each file.
    return rows.withColumn("src_file", F.col("_metadata.file_path")).withColumn("src_pos", F.monotonically_increasing_id())


def write_landed(
    df: DataFrame, directory: str, source: str = "source", date: str = "collect_date"
) -> None:
    """Append JSON lines partitioned by source and date; runs never overwrite each other.

    Rows of one source and date are spread over all tasks that hold them, so a
    source with a third of all rows is not written by a single task.
    """
    df.write.partitionBy(source, date).mode("append").json(directory)


def append_lines(df: DataFrame, directory: str, default_source: str = "unknown") -> None:
    """Append postings as JSON lines; a missing source is recorded as unknown."""
    df.withColumn("source", F.coalesce(F.col("source"), F.lit(default_source))).write.mode(
        "append"
    ).json(directory)


def collect_runs(
    landed: DataFrame,
    *,
    run_keys: Sequence[str],
    order: Sequence[str],
    identifier: str,
    max_jobs: int,
    created: str | None = None,
    as_of=None,
    max_days_old: int | None = None,
) -> DataFrame:
    """Postings each collection run keeps: with an id, recent, the first per id, max_jobs at most."""
    rows = filter_identified(landed, identifier)
    if created is not None:
        rows = filter_recent(rows, created, as_of, max_days_old)
    ordered = [F.col(c).asc() for c in order]
    return cap_per_run(keep_first(rows, [*run_keys, identifier], ordered), run_keys, ordered, max_jobs)


def profiles_table(spark: SparkSession, profiles: Sequence[tuple] = D.COLLECTION_PROFILES) -> DataFrame:
    return spark.createDataFrame(
        list(profiles), "name string, country string, what string, category string, max_jobs int"
    )


def match_profiles(
    landed: DataFrame, profiles: DataFrame, *, key: Sequence[str], country: str, category: str, texts: Sequence[str]
) -> DataFrame:
    """(key columns, profile, max_jobs): every profile that a posting answers.

    A posting answers a profile of its country and category if its texts hold all words of
    `what`, in any order and case; a profile without words takes every such posting. The words
    of the profiles are an inverted index that the postings' distinct words meet in a join; a
    pair counts when as many words met as the profile has, so containment takes one pass over
    the texts, whatever the number of profiles. Null texts have no words; a null country or
    category answers nothing.
    """
    asked = profiles.select(
        F.col("name").alias("profile"), "max_jobs", F.col("country").alias("_country"), F.col("category").alias("_category"),
        F.array_distinct(word_list(F.coalesce("what", F.lit("")))).alias("_words"),
    ).withColumn("_needed", F.size("_words"))
    place = [F.col(country).alias("_country"), F.col(category).alias("_category")]
    wanted = asked.filter("_needed > 0").withColumn("_word", F.explode("_words")).drop("_words")
    words = F.explode(F.array_distinct(word_list(F.concat_ws(" ", *texts)))).alias("_word")
    met = landed.select(*key, *place, words).join(wanted, ["_country", "_category", "_word"])
    full = met.groupBy(*key, "profile", "max_jobs", "_needed").agg(F.count(F.lit(1)).alias("_met")).filter("_met = _needed")
    free = landed.select(*key, *place).join(asked.filter("_needed = 0").drop("_words", "_needed"), ["_country", "_category"])
    columns = [*key, "profile", "max_jobs"]
    return full.select(*columns).unionByName(free.select(*columns))


def collect_for_profiles(
    landed: DataFrame, profiles: DataFrame, *, identifier: str = "id", country: str = "country", category: str = "category",
    texts: Sequence[str] = ("title", "description"), order: Sequence[str] = ("src_file", "src_pos"),
    created: str | None = None, as_of=None, max_days_old: int | None = None,
) -> DataFrame:
    """Postings each profile keeps: (profile, identifier, order columns, found).

    With an id, recent, the first per id, and at most the profile's max_jobs in the given order;
    `found` is the number of the profile's postings before that cap (which is the feature).
    """
    rows = filter_identified(landed, identifier)
    if created is not None:
        rows = filter_recent(rows, created, as_of, max_days_old)
    matched = match_profiles(rows, profiles, key=[identifier, *order], country=country, category=category, texts=texts)
    ordered = [*[F.col(c).asc() for c in order], F.col(identifier).asc()]
    matched = materialize(keep_first(matched, ["profile", identifier], ordered), "matched")
    largest = profiles.agg(F.max("max_jobs")).first()[0] or 0
    ranked = top_per_group(matched, ["profile"], ordered, largest, rank="_rank").filter(F.col("_rank") <= F.col("max_jobs"))
    found = matched.groupBy("profile").agg(F.count(F.lit(1)).alias("found"))
    return ranked.join(found, "profile").select("profile", identifier, *order, "found")


def profile_runs(kept: DataFrame, profiles: DataFrame, source: str, timestamp: str, identifier: str = "id") -> DataFrame:
    """A log entry (COLLECTION_LOG) for every profile, also for those that found nothing."""
    counts = kept.groupBy("profile").agg(
        F.count(F.lit(1)).alias("n"), F.max("found").alias("found"), F.sort_array(F.collect_list(F.col(identifier).cast("string"))).alias("ids")
    )  # at most max_jobs ids a profile
    runs = profiles.join(counts, profiles["name"] == counts["profile"], "left")
    n = F.coalesce("n", F.lit(0))
    parameters = F.create_map(*[x for c in ("country", "what", "category", "max_jobs") for x in (F.lit(c), F.col(c).cast("string"))])
    return runs.select(
        F.lit(timestamp).alias("timestamp"), F.lit(source).alias("source"), F.col("name").alias("profile"),
        F.when(n > 0, "success").otherwise("no_new_jobs").alias("status"), n.alias("jobs_collected"), n.alias("jobs_deduplicated"),
        F.lit(0.0).alias("duration_seconds"), F.lit(0).cast("long").alias("api_calls"), parameters.alias("parameters"),
        F.lit(None).cast("string").alias("filepath"), F.coalesce("ids", F.array().cast("array<string>")).alias("job_ids"),
    )


def collect_profiles(
    landed: DataFrame,
    profiles: Sequence[tuple[str, int]],
    *,
    profile: str,
    order: Sequence[str],
) -> DataFrame:
    """First max_jobs rows per profile; rows of other profiles are left out.

    The cap is cut to its own size per profile, after a cut to the largest cap
    that Spark applies on the map side.
    """
    caps = {name: cap for name, cap in profiles}
    wanted = landed.filter(F.col(profile).isin(*caps))
    ranked = cap_per_run(wanted, [profile], [F.col(c).asc() for c in order], max(caps.values()))
    return _within_cap(ranked, profile, order, caps)


def _within_cap(df: DataFrame, profile: str, order: Sequence[str], caps: dict[str, int]) -> DataFrame:
    limit = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    position = F.row_number().over(W.partitionBy(profile).orderBy(*order))
    return (
        df.withColumn("_position", position)
        .filter(F.col("_position") <= F.element_at(limit, F.col(profile)))
        .drop("_position")
    )
