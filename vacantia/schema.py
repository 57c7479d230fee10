"""Declared schemas and the producer-to-canonical column names."""

from __future__ import annotations

from pyspark.sql import types as T

CANONICAL = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("location_display", T.StringType()),
        T.StructField("location_country", T.StringType()),
        T.StructField("category_label", T.StringType()),
        T.StructField("salary_min", T.DoubleType()),
        T.StructField("salary_max", T.DoubleType()),
        T.StructField("contract_type", T.StringType()),
        T.StructField("contract_time", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("redirect_url", T.StringType()),
        T.StructField("created_date", T.TimestampNTZType()),
        T.StructField("source", T.StringType()),
        T.StructField("collected_at", T.TimestampNTZType()),
        T.StructField("src_file", T.StringType()),
        T.StructField("src_pos", T.LongType()),
    ]
)

# Every key a landed posting of either source may carry.
LANDED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("created", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("redirect_url", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("salary_min", T.DoubleType()),
        T.StructField("salary_max", T.DoubleType()),
        T.StructField("contract_type", T.StringType()),
        T.StructField("contract_time", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
        T.StructField("collected_at", T.StringType()),
    ]
)

# Nested API payload (company, location and category are objects).
NESTED_PAYLOAD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("adref", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("created", T.StringType()),
        T.StructField("redirect_url", T.StringType()),
        T.StructField("salary_min", T.DoubleType()),
        T.StructField("salary_max", T.DoubleType()),
        T.StructField("contract_type", T.StringType()),
        T.StructField("contract_time", T.StringType()),
        T.StructField("category", T.StructType([T.StructField("label", T.StringType())])),
        T.StructField("company", T.StructType([T.StructField("display_name", T.StringType())])),
        T.StructField(
            "location",
            T.StructType(
                [
                    T.StructField("display_name", T.StringType()),
                    T.StructField("area", T.ArrayType(T.StringType())),
                ]
            ),
        ),
    ]
)

# Flat API payload (element 0 of the array is metadata).
FLAT_PAYLOAD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("slug", T.StringType()),
        T.StructField("position", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("url", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ]
)

# Canonical name -> producer names, first one present wins.
CANONICAL_ALIASES = {
    "job_id": ("job_id", "id"),
    "title": ("title", "position", "job_title"),
    "location_display": ("location_display", "location"),
    "location_country": ("location_country", "country"),
    "category_label": ("category_label", "category"),
    "redirect_url": ("redirect_url", "url"),
    "created_date": ("created_date", "created", "created_at"),
}

COLLECTION_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("profile", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("jobs_collected", T.LongType()),
        T.StructField("jobs_deduplicated", T.LongType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("api_calls", T.LongType()),
        T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
        T.StructField("filepath", T.StringType()),
        T.StructField("job_ids", T.ArrayType(T.StringType())),
    ]
)

PROCESSING_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("records_in", T.LongType()),
        T.StructField("records_in_by_source", T.MapType(T.StringType(), T.LongType())),
        T.StructField("records_out", T.LongType()),
        T.StructField("output_path", T.StringType()),
    ]
)

EMBEDDING_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("embedding_dim", T.IntegerType()),
        T.StructField("num_jobs", T.LongType()),
        T.StructField("num_embeddings_per_job", T.LongType()),
        T.StructField("total_embeddings", T.LongType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("embeddings_per_second", T.DoubleType()),
        T.StructField("output_path", T.StringType()),
    ]
)

CV_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("cv_id", T.StringType()),
        T.StructField("skills_extracted", T.LongType()),
        T.StructField("jobs_matched", T.LongType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("model_used", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

SEARCH_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("search_type", T.StringType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField(
            "query",
            T.StructType(
                [
                    T.StructField("keywords", T.StringType()),
                    T.StructField("location", T.StringType()),
                    T.StructField("skills", T.StringType()),
                    T.StructField("filename", T.StringType()),
                    T.StructField("source", T.StringType()),
                ]
            ),
        ),
        T.StructField("results_count", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)
