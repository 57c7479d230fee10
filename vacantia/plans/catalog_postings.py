"""Queries on ingest, row mapping, filters, deduplication and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dictionaries as D
from vacantia.functions.labels import half_even_percent
from vacantia.operators import ranking, rows, selection
from vacantia.plans.end_to_end import consolidate
from vacantia.plans.registry import Tables, query
from vacantia.schema import COLLECTION_LOG, LANDED, SEARCH_LOG
from vacantia.session import scratch_path
from vacantia.sources import landed_files, landing, logs, tables

AS_OF = "2001-08-01 12:00:00"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_label(text: str, rules, default: str) -> str:
    """CASE over ordered keyword rules."""
    whens = [
        "WHEN " + " OR ".join(f"contains({text}, {sql_text(k)})" for k in keywords) + f" THEN {sql_text(label)}"
        for label, keywords in rules
    ]
    return "CASE " + " ".join(whens) + f" ELSE {sql_text(default)} END"


SQL_COUNTRY = "CASE lower({c}) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in D.COUNTRY_LABELS.items()
) + " ELSE upper({c}) END"


# --------------------------------------------------------------------------- derived inputs


def nested_payloads(t: Tables) -> DataFrame:
    """Documents as nested API payloads: some without id, category, company or area."""
    d = t.documents
    return d.select(
        F.struct(
            F.when(F.col("lang") == "fr", "").otherwise(F.concat(F.lit("d"), "doc_id")).alias("id"),
            F.when(F.col("source") != "src5", F.concat(F.lit("a"), "doc_id")).alias("adref"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("description"),
            F.when(F.col("lang") == "es", F.lit("garbage"))
            .otherwise(F.lit("2001-05-01T10:00:00Z"))
            .alias("created"),
            F.concat(F.lit("http://jobs/"), "doc_id").alias("redirect_url"),
            F.col("n_chars").cast("double").alias("salary_min"),
            (F.col("n_chars") * 2).cast("double").alias("salary_max"),
            F.lit("permanent").alias("contract_type"),
            F.lit(None).cast("string").alias("contract_time"),
            F.struct(F.when(F.col("source") == "src1", "Given Jobs").alias("label")).alias("category"),
            F.when(F.col("source") != "src2", F.struct(F.upper("source").alias("display_name"))).alias(
                "company"
            ),
            F.struct(
                F.concat(F.lit("Town "), "lang").alias("display_name"),
                F.when(F.col("lang") != "de", F.array(F.upper("lang"), F.lit("City"))).alias("area"),
            ).alias("location"),
        ).alias("payload"),
        F.when(F.col("source") == "src4", F.lit(None)).otherwise(F.col("lang")).alias("code"),
    )


NESTED_SQL = """
nested AS (
  SELECT CASE WHEN lang = 'fr' THEN CASE WHEN source <> 'src5' THEN 'a' || doc_id END
              ELSE 'd' || doc_id END AS id,
         split_part(text, chr(10), 1) AS title,
         CASE WHEN source <> 'src2' THEN upper(source) END AS company,
         'Town ' || lang AS location,
         CASE WHEN source <> 'src4' THEN {country}
              WHEN lang <> 'de' THEN upper(lang) ELSE 'Unknown' END AS country,
         text AS description,
         CASE WHEN source = 'src1' THEN 'Given Jobs' ELSE {category} END AS category,
         CASE WHEN lang = 'es' THEN 'garbage' ELSE '2001-05-01T10:00:00Z' END AS created,
         'http://jobs/' || doc_id AS redirect_url,
         n_chars::DOUBLE AS salary_min, (n_chars * 2)::DOUBLE AS salary_max,
         'permanent' AS contract_type, 'adzuna' AS source
  FROM documents)
""".format(
    country=SQL_COUNTRY.format(c="lang"),
    category=sql_label(
        "lower(split_part(text, chr(10), 1) || ' ' || text)", D.CATEGORY_RULES, "Unknown"
    ),
)


def flat_payloads(t: Tables) -> DataFrame:
    """Pages as flat API payloads."""
    p = t.pages
    words = F.split(F.regexp_replace("url", r"^https?://", ""), r"[./?=&#]")
    return p.select(
        F.when(F.col("url").startswith("https"), "").otherwise(F.concat(F.lit("p"), "page_id")).alias("id"),
        F.concat(F.lit("s"), "page_id").alias("slug"),
        F.when(F.col("url").contains("/en/"), "").otherwise(F.lit("Position")).alias("position"),
        F.concat(F.lit("Title "), F.get(words, 0)).alias("title"),
        F.get(words, 1).alias("company"),
        F.when(F.col("url").contains("page="), "").otherwise(F.lit("Town")).alias("location"),
        F.col("html").alias("description"),
        words.alias("tags"),
        F.col("url").alias("url"),
        F.lit("").alias("date"),
        F.lit("2001-06-01T00:00:00").alias("created_at"),
    )


FLAT_SQL = """
flat_raw AS (
  SELECT *, regexp_split_to_array(regexp_replace(url, '^https?://', ''), '[./?=&#]') AS tags FROM pages),
flat AS (
  SELECT CASE WHEN starts_with(url, 'https') THEN 's' ELSE 'p' END || page_id AS id,
         CASE WHEN contains(url, '/en/') THEN 'Title ' || tags[1] ELSE 'Position' END AS title,
         tags[2] AS company,
         CASE WHEN contains(url, 'page=') THEN 'Remote' ELSE 'Town' END AS location,
         html AS description, tags, url, '2001-06-01T00:00:00' AS created_at, 'remoteok' AS source
  FROM flat_raw)
"""


# --------------------------------------------------------------------------- row mapping


@query(f"WITH {NESTED_SQL} SELECT * FROM nested WHERE id IS NOT NULL AND id <> ''")
def structure_nested_postings(t: Tables) -> DataFrame:
    out = rows.structure_nested(
        nested_payloads(t), payload="payload", country_code=F.col("code"), collected_at=F.lit(None)
    )
    return selection.filter_identified(out).drop("collected_at", "contract_time")


@query(f"WITH {FLAT_SQL} SELECT * EXCLUDE (tags), array_to_string(tags, ' ') AS tags FROM flat")
def structure_flat_postings(t: Tables) -> DataFrame:
    out = rows.structure_flat(flat_payloads(t), collected_at=F.lit(None)).drop("collected_at")
    return out.withColumn("tags", F.array_join("tags", " "))


@query(
    "SELECT doc_id, CASE WHEN source <> 'src4' THEN {} WHEN lang <> 'de' THEN upper(lang) "
    "ELSE 'Unknown' END AS country FROM documents".format(SQL_COUNTRY.format(c="lang"))
)
def resolve_country(t: Tables) -> DataFrame:
    code = F.when(F.col("source") != "src4", F.col("lang"))
    area = F.when(F.col("lang") != "de", F.array(F.upper("lang")))
    return t.documents.select("doc_id", rows.resolve_country(code, area).alias("country"))


@query(
    "SELECT doc_id, {} AS category FROM documents".format(
        sql_label("lower(text)", D.CATEGORY_RULES, "Unknown")
    )
)
def infer_category(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    return t.documents.select("doc_id", rows.infer_category(none, F.col("text"), none).alias("category"))


PART_RULES = (
    ("Red things", ("red", "ring")),
    ("Large things", ("large", "promo")),
    ("Tools", ("anvil", "bolt", "widget")),
)


@query(
    "SELECT p_partkey, {} AS label FROM part".format(
        sql_label("lower(p_name || ' ' || p_type)", PART_RULES, "Other")
    )
)
def label_by_rules(t: Tables) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return t.part.select("p_partkey", rows.first_matching_label(text, PART_RULES, "Other").alias("label"))


@query(
    f"WITH {NESTED_SQL}, {FLAT_SQL}, both_sources AS ("
    " SELECT id, title, company, description, location, country, category, redirect_url AS url,"
    " try_cast(created AS TIMESTAMP) AS ts, salary_min, source FROM nested WHERE id IS NOT NULL"
    " UNION ALL SELECT id, title, company, description, location, NULL, NULL, url,"
    " created_at::TIMESTAMP, NULL, source FROM flat)"
    " SELECT id AS job_id, title, company, length(description) AS description_chars,"
    " location AS location_display, country AS location_country, category AS category_label,"
    " url AS redirect_url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_date, salary_min, source"
    " FROM both_sources"
)
def union_of_sources(t: Tables) -> DataFrame:
    a = rows.structure_nested(
        nested_payloads(t), payload="payload", country_code=F.col("code"), collected_at=F.lit(None)
    )
    b = rows.structure_flat(flat_payloads(t), collected_at=F.lit(None))
    both = selection.union_sources(
        rows.to_canonical(selection.filter_identified(a)), rows.to_canonical(b)
    )
    return both.select(
        "job_id", "title", "company", F.length("description").cast("bigint").alias("description_chars"),
        "location_display", "location_country", "category_label", "redirect_url",
        F.date_format("created_date", "yyyy-MM-dd HH:mm:ss").alias("created_date"), "salary_min", "source",
    )


@query(
    "SELECT o_orderkey, CAST(floor((epoch_us(TIMESTAMP '2000-01-01 06:00:00') - epoch_us(o_orderdate))"
    " / 86400000000.0) AS INTEGER) AS job_age_days FROM orders"
)
def job_age(t: Tables) -> DataFrame:
    return rows.add_age(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "2000-01-01 06:00:00").drop(
        "o_orderdate"
    )


@query(
    "SELECT c_custkey, coalesce(try_cast(CASE WHEN c_mktsegment = 'BUILDING' THEN 'abc'"
    " WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_acctbal::VARCHAR END AS FLOAT), 0::FLOAT) AS salary"
    " FROM customer"
)
def salary_coercion(t: Tables) -> DataFrame:
    raw = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("abc"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit(None))
        .otherwise(F.col("c_acctbal").cast("string"))
    )
    return rows.coerce_salaries(t.customer.select("c_custkey", raw.alias("salary")), ["salary"])


@query(
    "SELECT doc_id, coalesce(nullif(text, ''), 'No description available.') AS description,"
    " coalesce(nullif(source, 'src0'), 'Not specified') AS company,"
    " coalesce(nullif(lang, 'en'), 'Not specified') AS location_display, 'Not specified' AS title,"
    " 'Not specified' AS redirect_url, 'N/A' AS contract_time FROM documents"
)
def default_fills(t: Tables) -> DataFrame:
    d = t.documents.select(
        "doc_id",
        F.nullif("text", F.lit("")).alias("description"),
        F.nullif("source", F.lit("src0")).alias("company"),
        F.nullif("lang", F.lit("en")).alias("location_display"),
    )
    return rows.fill_defaults(d)


@query(
    r"SELECT doc_id, regexp_replace(text, '^[\s\v\x{85}\p{Z}\x1c-\x1f]+|[\s\v\x{85}\p{Z}\x1c-\x1f]+$', '', 'g')"
    " AS description, source AS company FROM documents"
)
def trim_texts(t: Tables) -> DataFrame:
    padded = t.documents.select(
        "doc_id",
        F.concat(F.lit(" \t"), "text", F.lit("\n ")).alias("description"),
        F.concat(F.lit("\n"), "source", F.lit(" ")).alias("company"),
    )
    return rows.trim_texts(padded)


@query(
    "SELECT doc_id, text AS text_full, split_part(text, chr(10), 1) AS text_title,"
    " concat_ws(' at ', split_part(text, chr(10), 1), nullif(source, 'src0')) AS text_title_company,"
    " concat_ws(' ', nullif(lang, 'en'), split_part(text, chr(10), 1)) AS text_category_title FROM documents"
)
def embedding_texts(t: Tables) -> DataFrame:
    d = t.documents.select(
        "doc_id",
        F.col("text").alias("description"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.nullif("source", F.lit("src0")).alias("company"),
        F.nullif("lang", F.lit("en")).alias("category_label"),
    )
    return rows.embedding_texts(d).select(
        "doc_id", "text_full", "text_title", "text_title_company", "text_category_title"
    )


@query(
    "SELECT event_id, CASE WHEN event_type NOT IN ('error', 'click') THEN value END AS value, event_type,"
    " strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events"
)
def json_safe_rows(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    odd = (
        F.when(kind == "error", F.lit(float("nan")))
        .when(kind == "click", F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    e = t.events.select("event_id", odd.alias("value"), "event_type", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    return rows.json_safe(e)


@query(
    r"SELECT doc_id, CASE WHEN length(text) > 600 THEN"
    r" regexp_replace(substr(text, 1, 600), '[\s\v\x{85}\p{Z}\x1c-\x1f]+$', '') || '...' ELSE text END AS description"
    " FROM documents"
)
def shorten_descriptions(t: Tables) -> DataFrame:
    return rows.shorten_descriptions(t.documents.select("doc_id", F.col("text").alias("description")))


def _chunk_sql(budget: int, max_chunks: int | None) -> str:
    first = f"WHERE rn <= {max_chunks}" if max_chunks else ""
    return f"""
    WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
    filled AS (SELECT * FROM (SELECT * FROM numbered {first}) WHERE length(text) > 0),
    used AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS u FROM filled)
    SELECT conv_id, string_agg(substr(text, 1, {budget} - u), chr(10) || chr(10) ORDER BY turn) AS text
    FROM used WHERE u < {budget} GROUP BY conv_id"""


@query(_chunk_sql(800, None))
def join_chunks_budget(t: Tables) -> DataFrame:
    return rows.join_chunks(t.conversations, key="conv_id", position="turn", chunk="text", budget=800)


@query(_chunk_sql(20_000, 20))
def join_chunks_pages(t: Tables) -> DataFrame:
    return rows.join_chunks(t.conversations, key="conv_id", position="turn", chunk="text", max_chunks=20)


@query(
    "SELECT 'd' || doc_id AS id, coalesce(nullif(CASE WHEN lang = 'de' THEN '' ELSE lang END, ''), 'Position')"
    " AS title, source AS company, 'Town' AS location, lang AS country, source AS category,"
    " text AS description, n_chars::DOUBLE AS score, length(lang)::INTEGER AS cluster, 'http://x' AS url"
    " FROM documents"
)
def recommendation_rows(t: Tables) -> DataFrame:
    d = t.documents.select(
        F.lit("").alias("job_id"),
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.when(F.col("lang") == "de", "").otherwise(F.col("lang")).alias("title"),
        F.lit("Position").alias("position"),
        F.col("source").alias("company"),
        F.lit("Town").alias("location"),
        F.col("lang").alias("country"),
        F.col("source").alias("category"),
        F.lit("http://x").alias("url"),
        F.col("text").alias("description"),
        F.col("n_chars").alias("score"),
        F.length("lang").alias("cluster_id"),
    )
    return rows.recommendation_rows(d).drop("source", "salary_min", "salary_max", "created_date")


@query(
    "SELECT p_partkey, concat_ws(' | ', 'Job: ' || nullif(p_name, ''),"
    " 'Location: ' || nullif(CASE WHEN p_type = 'PROMO' THEN '' ELSE p_type END, ''),"
    " 'Skills: ' || CASE WHEN p_size > 10 THEN p_brand END) AS query_text FROM part"
)
def query_text(t: Tables) -> DataFrame:
    place = F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type"))
    skills = F.when(F.col("p_size") > 10, F.col("p_brand"))
    return t.part.select("p_partkey", rows.query_text(F.col("p_name"), place, skills).alias("query_text"))


@query(
    "SELECT match_score, count(*) AS n FROM (SELECT CAST(round_even((l_discount + 0.005) * 100, 0) AS INTEGER)"
    " AS match_score FROM lineitem) GROUP BY match_score"
)
def match_percent(t: Tables) -> DataFrame:
    score = half_even_percent(F.col("l_discount") + 0.005).alias("match_score")
    return t.lineitem.groupBy(score).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- filters


@query(
    "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ' '),"
    " lambda x: lower(x) IN ('der', 'que', 'dans'))) > 0"
)
def filter_by_tags(t: Tables) -> DataFrame:
    tagged = t.documents.select("doc_id", F.split("text", " ").alias("tags"))
    return selection.filter_tags(tagged, wanted=("Der", "QUE", "dans")).select("doc_id")


@query(
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'"
    " OR o_orderdate >= TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 365 DAY"
)
def filter_recent_texts(t: Tables) -> DataFrame:
    created = (
        F.when(F.col("o_orderstatus") == "P", F.lit("garbage"))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit(None))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    dated = t.orders.select("o_orderkey", created.alias("created"))
    return selection.filter_recent(dated, "created", AS_OF, 365).select("o_orderkey")


@query(
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate IS NULL"
    " OR o_orderdate >= TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 365 DAY"
)
def filter_recent_dates(t: Tables) -> DataFrame:
    recent = selection.filter_recent(t.orders, "o_orderdate", AS_OF, 365)
    return recent.select("o_orderkey", "o_totalprice")


@query(
    "SELECT doc_id FROM documents WHERE nullif(lang, 'en') IS NOT NULL AND nullif(source, 'src3') IS NOT NULL"
)
def filter_complete_rows(t: Tables) -> DataFrame:
    d = t.documents.select(
        "doc_id", F.nullif("lang", F.lit("en")).alias("title"), F.nullif("source", F.lit("src3")).alias("description")
    )
    return selection.filter_complete(d).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang <> 'en'")
def filter_identified_rows(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.when(F.col("lang") != "en", F.col("source")).otherwise("").alias("id"))
    return selection.filter_identified(d).select("doc_id")


@query("SELECT p_partkey, p_name AS q FROM part WHERE p_type <> 'PROMO'")
def filter_asked_queries(t: Tables) -> DataFrame:
    blank = F.when(F.col("p_type") == "PROMO", F.lit(" \n\t")).otherwise(F.col("p_name"))
    return selection.filter_asked(t.part.select("p_partkey", blank.alias("q")), "q")


SEARCH_WHERE = (
    "(regexp_matches(source, '(?i)th[ae]n|ente') OR regexp_matches(text, '(?i)th[ae]n|ente'))"
    " AND regexp_matches(lang, '(?i)E') AND regexp_matches(text, '(?i)and') AND regexp_matches(text, '(?i)on.s')"
)


@query(
    f"WITH hit AS (SELECT * FROM documents WHERE {SEARCH_WHERE}) SELECT doc_id, lang,"
    " (SELECT count(*) FROM hit) AS total_results FROM hit ORDER BY doc_id LIMIT 10 OFFSET 10"
)
def keyword_search_page(t: Tables) -> DataFrame:
    hits = selection.keyword_search(
        t.documents, query="th[ae]n|ente", location="E", skills="and, on.s,", title="source",
        description="text", place="lang",
    )
    return ranking.page_with_total(hits, [F.col("doc_id").asc()], ["doc_id", "lang"], page=2, page_size=10)


@query("SELECT count(*) AS n FROM documents WHERE contains(lower(text), 'the on.')")
def keyword_search_literal(t: Tables) -> DataFrame:
    hits = selection.keyword_search(t.documents, query="The on.", title="source", description="text", literal=True)
    return hits.agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- deduplication, top-n


@query(
    "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn"
    " FROM documents) WHERE rn = 1"
)
def dedup_keep_first(t: Tables) -> DataFrame:
    return ranking.keep_first_text(t.documents, "text", [], "doc_id").select("doc_id", "lang", "source")


@query(
    "SELECT c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment,"
    " nullif(c_nationkey, 3) ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn = 1"
)
def dedup_composite(t: Tables) -> DataFrame:
    c = t.customer.withColumn("k", F.nullif("c_nationkey", F.lit(3)))
    first = ranking.keep_first(
        c, ["c_nationkey", "c_mktsegment", "k"], [F.desc("c_acctbal"), F.asc("c_custkey")]
    )
    return first.select("c_custkey")


@query(
    "WITH kept AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)"
    " SELECT (SELECT count(*) FROM documents) AS rows_in,"
    " (SELECT count(*) FROM documents) - count(*) AS duplicates_removed,"
    " count(*) FILTER (lang = 'de' OR source = 'src3') AS missing_removed,"
    " count(*) - count(*) FILTER (lang = 'de' OR source = 'src3') AS rows_out FROM kept WHERE rn = 1"
)
def removal_counters(t: Tables) -> DataFrame:
    d = t.documents.select(
        "doc_id", "text", F.nullif("lang", F.lit("de")).alias("title"), F.nullif("source", F.lit("src3")).alias("company")
    )
    kept = ranking.keep_first_text(d, "text", [], "doc_id")
    return selection.removal_counts(d, kept, ["title", "company"])


@query(
    """
    WITH firsts AS (SELECT *, row_number() OVER (PARTITION BY event_type, id ORDER BY event_id) AS rn FROM (
        SELECT event_type, event_id, CASE WHEN user_id = 7 THEN '' ELSE 'u' || user_id END AS id, ts FROM events)
        WHERE id <> '' AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY),
    capped AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM firsts WHERE rn = 1)
    SELECT event_type, id, event_id FROM capped WHERE n <= 25
    """
)
def collect_pages(t: Tables) -> DataFrame:
    """Recent rows of every run, one per id, at most 25 a run (the feature), over all events."""
    landed = t.events.select(
        "event_type", "event_id", F.when(F.col("user_id") == 7, "").otherwise(F.concat(F.lit("u"), "user_id")).alias("id"), "ts"
    )
    kept = landing.collect_runs(
        landed, run_keys=["event_type"], order=["event_id"], identifier="id", created="ts",
        as_of="2024-01-31 00:00:00", max_days_old=30, max_jobs=25,
    )
    return kept.select("event_type", "id", "event_id")


ORDER_PROFILES = (("1-URGENT", 60), ("2-HIGH", 30), ("3-MEDIUM", 1500))


@query(
    "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority"
    " ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= CASE o_orderpriority"
    " WHEN '1-URGENT' THEN 60 WHEN '2-HIGH' THEN 30 WHEN '3-MEDIUM' THEN 1500 ELSE 0 END"
)
def collect_profiles(t: Tables) -> DataFrame:
    kept = landing.collect_profiles(
        t.orders, ORDER_PROFILES, profile="o_orderpriority", order=["o_orderdate", "o_orderkey"]
    )
    return kept.select("o_orderpriority", "o_orderkey")


ALL_PROFILES = (*D.COLLECTION_PROFILES, D.KEYWORD_FREE_PROFILE)
#: Postings that answer some of the profiles: titles by number, countries by number and language.
PROFILE_TITLES = (
    "Senior FRONTEND developer (React)", "Backend Developer, Python", "DevOps-Engineer", "Mobile developer", "Product manager", "Machine Learning Engineer",
    "Data Scientist", "Software engineering", "Engineer of software", "Nurse", "Scientist",
)
PROFILE_LANDED_SQL = """landed AS (SELECT doc_id AS id, ([{titles}])[doc_id % {n} + 1] AS title, text AS description,
    CASE WHEN lang <> 'en' THEN 'gb' ELSE (['gb', 'us', 'au'])[doc_id % 3 + 1] END AS country,
    CASE WHEN source = 'src3' THEN 'other-jobs' ELSE 'it-jobs' END AS category FROM documents)""".format(
    titles=", ".join(map(sql_text, PROFILE_TITLES)), n=len(PROFILE_TITLES)
)
PROFILES_SQL = "profiles(name, country, what, category, max_jobs) AS (VALUES {})".format(
    ", ".join(f"({sql_text(n)}, {sql_text(c)}, {sql_text(w)}, {sql_text(k)}, {m})" for n, c, w, k, m in ALL_PROFILES)
)
PROFILE_MATCHES_SQL = f"""WITH {PROFILE_LANDED_SQL}, {PROFILES_SQL},
    worded AS (SELECT *, string_split_regex(lower(title || ' ' || description), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+') AS words FROM landed),
    matched AS (SELECT p.name AS profile, id, max_jobs, count(*) OVER (PARTITION BY p.name) AS found, row_number() OVER (PARTITION BY p.name ORDER BY id) AS place
      FROM worded w JOIN profiles p ON w.country = p.country AND w.category = p.category
        AND (what = '' OR list_has_all(words, string_split(what, ' '))))"""


def _landed_for_profiles(t: Tables) -> DataFrame:
    number = F.col("doc_id")
    country = F.when(F.col("lang") != "en", "gb").otherwise(F.get(F.array(*map(F.lit, ("gb", "us", "au"))), (number % 3).cast("int")))
    return t.documents.select(
        number.alias("id"), F.get(F.array(*map(F.lit, PROFILE_TITLES)), (number % len(PROFILE_TITLES)).cast("int")).alias("title"),
        F.col("text").alias("description"), country.alias("country"), F.when(F.col("source") == "src3", "other-jobs").otherwise("it-jobs").alias("category"),
    )


@query(f"{PROFILE_MATCHES_SQL} SELECT profile, id, found FROM matched WHERE place <= max_jobs")
def collect_for_profiles(t: Tables) -> DataFrame:
    """Postings that each profile keeps by country, category and words, up to its own cap."""
    return landing.collect_for_profiles(_landed_for_profiles(t), landing.profiles_table(t.spark, ALL_PROFILES), order=[]).select("profile", "id", "found")


@query(
    f"""{PROFILE_MATCHES_SQL}, kept AS (SELECT profile, id FROM matched WHERE place <= max_jobs)
    SELECT name AS profile, CASE WHEN count(id) > 0 THEN 'success' ELSE 'no_new_jobs' END AS status, count(id) AS jobs_collected,
      what AS parameter, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR), '') AS ids
    FROM profiles LEFT JOIN kept ON profile = name GROUP BY name, what"""
)
def profile_run_log(t: Tables) -> DataFrame:
    """The runs' log entries, appended to a log and read back."""
    profiles = landing.profiles_table(t.spark, ALL_PROFILES)
    kept = landing.collect_for_profiles(_landed_for_profiles(t), profiles, order=[])
    path = scratch_path(t.spark, "collection-log")
    logs.append_log(landing.profile_runs(kept, profiles, "adzuna", "2025-01-01T00:00:00"), path)
    log = logs.read_log(t.spark, path, COLLECTION_LOG)
    return log.select("profile", "status", "jobs_collected", F.col("parameters")["what"].alias("parameter"), F.array_join("job_ids", ",").alias("ids"))


@query(
    "SELECT count(*) AS n, round(sum(v), 2) AS total FROM (SELECT l_extendedprice AS v FROM lineitem"
    " UNION ALL SELECT l_quantity FROM lineitem)"
)
def stack_columns(t: Tables) -> DataFrame:
    stacked = selection.stack_columns(t.lineitem, ["l_extendedprice", "l_quantity"])
    return stacked.agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, (SELECT count(*) FROM orders) AS total_results"
    " FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100"
)
def newest_page(t: Tables) -> DataFrame:
    order = [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").asc()]
    page = ranking.page_of(t.orders, order, page=3, page_size=50)
    return ranking.with_total(page, t.orders).select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "total_results"
    )


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS position FROM orders")
def newest_first(t: Tables) -> DataFrame:
    """All rows in their order, which the positions tell."""
    ordered = ranking.newest_first(t.orders, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")
    return ranking.with_positions(ordered).select("o_orderkey", "position")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def last_history(t: Tables) -> DataFrame:
    return ranking.last_entries(t.events, "ts", 50, "event_id").select("event_id", "event_type")


@query(
    "SELECT o_orderkey, o_totalprice FROM orders WHERE strftime(o_orderdate, '%Y%m') ="
    " (SELECT max(strftime(o_orderdate, '%Y%m')) FROM orders)"
)
def latest_version(t: Tables) -> DataFrame:
    versions = t.orders.withColumn("run_id", F.date_format("o_orderdate", "yyyyMM"))
    return tables.latest_version(versions).select("o_orderkey", "o_totalprice")


@query(
    "SELECT doc_id, (i - 1)::INTEGER AS pos, parts[i] AS item FROM (SELECT doc_id, string_split(text, chr(10))"
    " AS parts FROM documents), unnest(range(2, len(parts) + 1)) AS u(i)"
)
def drop_metadata_element(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.split("text", "\n").alias("parts"))
    return rows.drop_metadata_element(d, "parts", ["doc_id"])


@query(
    "SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey"
    " JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name"
)
def code_lookup(t: Tables) -> DataFrame:
    """Count per code first, then attach the labels; Spark sizes the lookup joins."""
    counts = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    named = counts.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "r_name", "n_name", "customers"
    )


# --------------------------------------------------------------------------- sources and sinks


def _landed_documents(t: Tables) -> DataFrame:
    return t.documents.select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"),
        F.col("source").alias("company"),
        F.lit("adzuna").alias("source"),
        F.col("lang").alias("collect_date"),
    )


@query(
    "SELECT 'd' || doc_id AS id, text AS description, source AS company, 'adzuna' AS source FROM documents"
)
def landing_roundtrip(t: Tables) -> DataFrame:
    """Documents landed as partitioned JSON lines and read back with the declared schema."""
    path = scratch_path(t.spark, "landing")
    landing.write_landed(_landed_documents(t).withColumnRenamed("source", "src").withColumn("source", F.col("src")), path, "src")
    back = landing.read_landed_lines(t.spark, path)
    return back.select("id", "description", "company", "source")


@query("SELECT 'd' || doc_id AS id, CASE WHEN lang = 'en' THEN 'unknown' ELSE source END AS source FROM documents")
def append_lines_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "lines")
    jobs = t.documents.select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.when(F.col("lang") != "en", F.col("source")).alias("source")
    )
    landing.append_lines(jobs, path)
    return landing.read_landed_lines(t.spark, path).select("id", "source")


@query("SELECT doc_id, text, lang, len(string_split(text, ' '))::INTEGER AS n_tags FROM documents")
def parquet_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "processed")
    tables.write_table(t.documents.select("doc_id", "text", "lang", F.split("text", " ").alias("tags")), path)
    back = tables.read_table(t.spark, path)
    return back.select("doc_id", "text", "lang", F.size("tags").alias("n_tags"))


@query("SELECT p_partkey, p_name || chr(10) || ' \"' || p_brand || '\", ' AS p_name, p_retailprice, '[\"' || p_type || '\",\"' || p_brand || '\"]' AS tags FROM part")
def csv_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "processed-csv")
    tables.write_table(
        t.part.select(
            "p_partkey", F.concat("p_name", F.lit('\n "'), "p_brand", F.lit('", ')).alias("p_name"), "p_retailprice", F.array("p_type", "p_brand").alias("tags")
        ), path, "csv"
    )
    schema = "p_partkey long, p_name string, p_retailprice double, tags string"
    return tables.read_csv_table(t.spark, path, schema)


@query(
    "SELECT event_id::VARCHAR AS keywords, event_type AS search_type, value AS duration_ms FROM events"
)
def log_roundtrip(t: Tables) -> DataFrame:
    """Search events appended to a JSON-lines log and read back."""
    path = scratch_path(t.spark, "log")
    e = t.events
    logs.append_log(
        e.select(
            F.col("ts").cast("string").alias("timestamp"),
            F.col("event_type").alias("search_type"),
            F.col("value").alias("duration_ms"),
            F.struct(F.col("event_id").cast("string").alias("keywords")).alias("query"),
        ),
        path,
    )
    back = logs.read_log(t.spark, path, SEARCH_LOG)
    return back.select(F.col("query.keywords").alias("keywords"), "search_type", "duration_ms")


@query(
    "SELECT search_type, duration_ms FROM (SELECT event_type AS search_type, value AS duration_ms, ts, event_id"
    " FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)"
)
def log_tail(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "tail")
    logs.append_log(
        t.events.select(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            F.col("event_type").alias("search_type"),
            F.col("value").alias("duration_ms"),
        ),
        path,
    )
    return logs.tail_log(t.spark, path, SEARCH_LOG, 50).select("search_type", "duration_ms")


@query("SELECT vec_id, label FROM embeddings")
def version_roundtrip(t: Tables) -> DataFrame:
    """Two versions of a table written; the later one is read."""
    path = scratch_path(t.spark, "versions")
    v = t.embeddings.select("vec_id", "label")
    tables.write_version(v.withColumn("label", F.lit(-1)), path, "20250101_000000")
    tables.write_version(v, path, "20250102_000000")
    return tables.read_latest(t.spark, path).select("vec_id", "label")


TRIM_SQL = r"regexp_replace({c}, '^[\s\v\x{{85}}\p{{Z}}\x1c-\x1f]+|[\s\v\x{{85}}\p{{Z}}\x1c-\x1f]+$', '', 'g')"


@query(
    f"""WITH {FLAT_SQL},
    a AS (SELECT 'd' || doc_id AS job_id, split_part(text, chr(10), 1) AS title, nullif(source, 'src2') AS company,
            text AS description, lang AS country, 'adzuna' AS source,
            row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents),
    b AS (SELECT id AS job_id, title, company, description, NULL AS country, source,
            row_number() OVER (PARTITION BY id ORDER BY id) AS rn FROM flat)
    SELECT job_id, {TRIM_SQL.format(c='title')} AS title, {TRIM_SQL.format(c='company')} AS company,
      length({TRIM_SQL.format(c='description')}) AS chars, country AS location_country, source
    FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE rn = 1 AND title IS NOT NULL AND description IS NOT NULL"""
)
def consolidate_postings(t: Tables) -> DataFrame:
    """Two landed sources deduplicated (by text and by id), united, completed and trimmed."""
    a = t.documents.select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.nullif("source", F.lit("src2")).alias("company"),
        F.col("text").alias("description"),
        F.col("lang").alias("country"),
        F.lit("adzuna").alias("source"),
        "doc_id",
    )
    b = rows.structure_flat(flat_payloads(t), collected_at=F.lit(None))
    both = selection.union_sources(
        rows.to_canonical(ranking.keep_first_text(a, "description", [], "doc_id")),
        ranking.keep_first(rows.to_canonical(b), ["job_id"], [F.col("redirect_url").asc(), F.xxhash64("description").asc()]),
    )
    clean = rows.trim_texts(selection.filter_complete(both))
    return clean.select(
        "job_id", "title", "company", F.length("description").cast("bigint").alias("chars"), "location_country", "source"
    )


@query(
    f"""WITH {NESTED_SQL}, one AS (SELECT id, source, category, country,
        row_number() OVER (PARTITION BY id ORDER BY id) AS rn FROM nested WHERE id IS NOT NULL)
    SELECT category AS category_label, country AS location_country, count(*) AS n FROM one WHERE rn = 1
    GROUP BY category, country"""
)
def consolidate_landed(t: Tables) -> DataFrame:
    """Landing, scan, deduplication by id, union and cleaning, counted by category and country."""
    path = scratch_path(t.spark, "raw")
    jobs = rows.structure_nested(
        nested_payloads(t), payload="payload", country_code=F.col("code"), collected_at=F.lit(None).cast("string")
    )
    selection.filter_identified(jobs).write.mode("append").json(path)
    clean = consolidate(landing.read_landed_lines(t.spark, path, LANDED))
    return clean.groupBy("category_label", "location_country").agg(F.count(F.lit(1)).alias("n"))


def _raw_folder(t: Tables) -> str:
    """Files as collectors leave them: lists of about 200 postings, one posting alone, a broken file, one that ends early, and jobs.jsonl."""
    path = scratch_path(t.spark, "raw-files")
    jobs = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"), "doc_id")
    files = -(-t.documents.count() // 200)
    body = F.to_json(F.collect_list(F.struct("id", "title", "description")))
    lists = jobs.filter("doc_id > 0").groupBy(F.pmod("doc_id", F.lit(files)).alias("n")).agg(body.alias("value"))
    single = jobs.filter("doc_id = 0").select(F.lit(-1).alias("n"), F.to_json(F.struct("id", "title", "description")).alias("value"))
    bad = t.spark.createDataFrame([(-2, '[{"id": "x1"}, {no json'), (-3, '[{"id": "x2"},'), (-4, '[{"id": "x3"}] more'), (-5, "7"), (-6, "[]")], "n long, value string")
    every = lists.unionByName(single).unionByName(bad)
    every.write.partitionBy("n").text(f"{path}/day=1")
    t.spark.createDataFrame([('{"id": "y1"}\n{"id": "y2"}',)], "value string").coalesce(1).write.text(f"{path}/lines")
    return path


RAW_PATTERN = "part-*"


@query(
    "SELECT 'd' || doc_id AS id, split_part(text, chr(10), 1) AS title, length(text) AS chars, NULL::VARCHAR AS problem FROM documents"
    " UNION ALL SELECT NULL, NULL, NULL, p FROM (VALUES ('n=-2'), ('n=-3'), ('n=-4')) AS v(p)"
)
def scan_raw_files(t: Tables) -> DataFrame:
    """Postings of the files that parse, and the files left out; a folder that is not there adds nothing."""
    scanned = landed_files.scan(t.spark, f"{_raw_folder(t)}/day=1", RAW_PATTERN, bytes_per_task=1 << 20)
    none = landed_files.scan(t.spark, scratch_path(t.spark, "absent"))
    jobs = landed_files.postings(scanned.unionByName(none))
    out = jobs.select("id", "title", F.length("description").cast("long").alias("chars"), F.lit(None).cast("string").alias("problem"))
    left = landed_files.problems(scanned).select(F.regexp_extract("src_file", "n=-?[0-9]+", 0).alias("problem"))
    return out.unionByName(left, allowMissingColumns=True)


@query(
    f"""WITH {NESTED_SQL}, one AS (SELECT id, source, category, country,
        row_number() OVER (PARTITION BY id ORDER BY id) AS rn FROM nested WHERE id IS NOT NULL)
    SELECT category AS category_label, country AS location_country, count(*) AS n FROM one WHERE rn = 1
    GROUP BY category, country"""
)
def consolidate_raw_files(t: Tables) -> DataFrame:
    """The same from files that hold a JSON list of 200 postings each, one object, or no JSON at all."""
    path = scratch_path(t.spark, "raw-lists")
    jobs = rows.structure_nested(
        nested_payloads(t), payload="payload", country_code=F.col("code"), collected_at=F.lit(None).cast("string")
    )
    numbered = selection.filter_identified(jobs).withColumn("file", F.xxhash64("id"))
    files = -(-t.documents.count() // 200)
    lists = numbered.withColumn("file", F.pmod("file", F.lit(files))).groupBy("file").agg(
        F.to_json(F.collect_list(F.struct(*jobs.columns))).alias("value")
    )
    single = t.spark.createDataFrame([(-1, '{"title": "an object without id"}'), (-2, "[{no json")], "file long, value string")
    lists.union(single).write.partitionBy("file").text(path)
    landed = selection.filter_identified(landing.read_landed(t.spark, path, LANDED, "part-*"))
    clean = consolidate(landed)
    return clean.groupBy("category_label", "location_country").agg(F.count(F.lit(1)).alias("n"))
