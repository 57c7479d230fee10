"""One query per operator, each over the whole of its tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import alignment, decontam, exact, lines, merkle, ngrams, packing, secrets, simhash, suffixes, toxicity, urls, warc
from vacantia.llm.common import read
from vacantia.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

#: White space of the contracts as a DuckDB expression.
SQL_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Of a public tokenizer's file; TOKENIZERS_DIR names another folder than the installed one."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def public_words() -> packing.Encoder:
    return packing.word_encoder(tokenizer_path(), end_id=2)


KEY = SQL_LOWER.format(f"trim(line, {SQL_SPACES})")


@query(f"""
WITH base AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM base)),
keyed AS (SELECT doc_id, i, line, {KEY} AS k FROM lines),
common AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, i, line, common.k IS NOT NULL AND doc_id <> last AS dropped FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""")
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.dedup_lines(read(spark, folder, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN host <> '' AND substr(md5(host || path), 1, 1) IN ('0', '1') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
""")
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The list stands in for one from outside: the corpus's keys whose MD5 starts with 0 or 1."""
    pages = read(spark, folder, "pages", "page_id", "url")
    key = urls.url_key(urls.host_of(F.col("url")), urls.path_of(F.col("url")))
    listed = pages.select(key.alias("key")).where(F.substring(F.md5("key"), 1, 1).isin("0", "1"))
    return urls.judge_urls(pages, listed)


@query()
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(read(spark, folder, "documents", "doc_id", "text"), public_words)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


SQL_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(SQL_LOWER.format("coalesce(text, '')"))


@query(f"""
WITH b AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(12, len(w) - 1)], ' ') AS s
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM starts JOIN wins USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.find_contamination(read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontam.hit_words().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"),
    )


@query(f"""
WITH base AS (SELECT doc_id, length(coalesce(text, '')) AS points, translate(coalesce(text, ''), {SQL_SPACES}, '') AS bare FROM documents),
ranked AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER w AS place
           FROM base WINDOW w AS (PARTITION BY bare ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(bare) AS text_sha256 FROM ranked
""")
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(read(spark, folder, "documents", "doc_id", "text")).drop("row")


@query()
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(read(spark, folder, "documents", "doc_id", "text"))
    return groups.select("doc_id", "fingerprint", "component_id", "kept")


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records made of pages: a full response of each, and a day later a conditional
    request of the same page under a fragment, whose validators are current, stale or missing."""
    tag, at = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"')), F.col("page_id") * 60
    modified = F.floor(F.col("page_id") / 10).cast("string")
    full = pages.select(
        (2 * F.col("page_id")).alias("record_id"), F.lit("response").alias("kind"), "url", at.alias("ts"),
        F.when(F.col("page_id") % 11 != 0, tag).alias("etag"), modified.alias("last_modified"),
        F.create_map(
            F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
            F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), at.cast("string"),
        ).alias("headers"),
    )
    later = at + 86_400
    again = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#again")).alias("url"),
        later.alias("ts"), F.when(F.col("page_id") % 5 == 0, '"stale"').when(F.col("page_id") % 5 != 1, F.concat(F.lit("W/"), tag)).alias("etag"),
        F.when(F.col("page_id") % 7 != 0, modified).alias("last_modified"),
        F.create_map(
            F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("date"), later.cast("string"),
            F.lit("expires"), (later + 600).cast("string"),
        ).alias("headers"),
    )
    return full.unionByName(again)


@query(rf"""
WITH parts AS (
  SELECT page_id, coalesce(html, '') AS html, page_id * 60 AS taken, CAST(page_id // 10 AS VARCHAR) AS modified,
    regexp_replace(regexp_replace({SQL_LOWER.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")}, '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), ''), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&'),
                    lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)='))), '&') AS asked
  FROM pages),
named AS (SELECT *, '"' || md5(html) || '"' AS tag, CASE WHEN host <> '' THEN host || path || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END END AS canon FROM parts),
full_ AS (SELECT 2 * page_id AS record_id, canon, taken AS ts, CASE WHEN page_id % 11 <> 0 THEN tag END AS etag, modified, octet_length(encode(html)) AS size FROM named),
again AS (SELECT 2 * page_id + 1 AS record_id, canon, taken + 86400 AS ts, modified AS m,
                 CASE WHEN page_id % 5 = 0 THEN '"stale"' WHEN page_id % 5 <> 1 THEN tag END AS etag,
                 CASE WHEN page_id % 7 <> 0 THEN modified END AS modified FROM named),
found AS (
  SELECT a.record_id, a.canon, a.ts, f.record_id AS response_id, f.size,
         coalesce(a.etag = f.etag, a.modified = f.modified) AS valid,
         row_number() OVER (PARTITION BY a.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) AS place
  FROM again a LEFT JOIN full_ f ON a.canon = f.canon AND f.ts < a.ts)
SELECT record_id, canon AS canonical_url, CASE WHEN valid THEN response_id END AS response_id,
       CASE WHEN response_id IS NULL THEN 'no_response' WHEN valid THEN 'resolved' WHEN NOT valid THEN 'mismatch' ELSE 'unverified' END AS status,
       CASE WHEN valid THEN 'cache-control=max-age=600;content-length=' || size || ';content-type=text/html;date=' || ts || ';expires=' || (ts + 600) END AS headers
FROM found WHERE place = 1
""")
def op3_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.resolve_revisits(captures(read(spark, folder, "pages", "page_id", "url", "html")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.withColumn("headers", F.array_join(pairs, ";"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def toxicity_network(spark: SparkSession, docs: DataFrame, folder: str, per_class: int = 2000) -> toxicity.Network:
    return toxicity.train_rows(docs, read(spark, folder, "labels"), held_out(), "doc_id", "text", "toxic", per_class)


@query()
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from at most 2,000 labelled texts of each class that are not held out."""
    docs = read(spark, folder, "documents", "doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity_network(spark, docs, folder))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


@query()
def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    found = secrets.find_secrets(docs, secrets.train_rows(docs))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )


@query()
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffixes.remove_repeats(read(spark, folder, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


#: Unsigned CRC-32 of a number's decimal digits.
SQL_CRC = """4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))"""
SQL_LEAF = "sha256(" + " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(({c})::VARCHAR)) || ':' || ({c}) END" for c in ("doc_id", "source", "lang", "{}", "text")
) + ")"


@query(f"""
WITH RECURSIVE crcs AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
leaves AS (
  SELECT doc_id, lang, {SQL_LEAF.format(*["n_chars"] * 3)} AS leaf, {SQL_LEAF.format(*["n_chars + 1"] * 3)} AS after,
         ({SQL_CRC.format("doc_id")}) % 7 = 0 AS tampered FROM documents, crcs),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes(lang, level, i, digest, n) AS (
  SELECT lang, 0, pos, leaf, n FROM placed
  UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n),
subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, i, digest, n) AS (
  SELECT 0, place, subroot, n FROM subroots
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
root AS (SELECT digest AS root FROM tops WHERE n = 1),
paths AS (
  SELECT p.lang, p.pos, level AS k, sum(CASE WHEN i = xor(pos >> level, 1) THEN 1 ELSE 0 END) AS beside,
         max(CASE WHEN i = xor(pos >> level, 1) THEN digest END) AS digest, (pos >> level) % 2 = 1 AS is_right
  FROM placed p JOIN nodes t ON p.lang IS NOT DISTINCT FROM t.lang AND t.n > 1 AND t.i // 2 = p.pos >> (t.level + 1) GROUP BY p.lang, p.pos, level
  UNION ALL
  SELECT p.lang, p.pos, 1000 + level, sum(CASE WHEN i = xor(place >> level, 1) THEN 1 ELSE 0 END),
         max(CASE WHEN i = xor(place >> level, 1) THEN digest END), (place >> level) % 2 = 1
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN tops t ON t.n > 1 AND t.i // 2 = s.place >> (t.level + 1) GROUP BY p.lang, p.pos, level, place),
steps AS (SELECT *, row_number() OVER (PARTITION BY lang, pos ORDER BY k) AS step FROM paths),
folds(lang, pos, step, digest) AS (
  SELECT lang, pos, 0, CASE WHEN tampered THEN after ELSE leaf END FROM placed
  UNION ALL
  SELECT f.lang, f.pos, f.step + 1, sha256(CASE WHEN s.digest IS NULL THEN f.digest WHEN is_right THEN s.digest || f.digest ELSE f.digest || s.digest END)
  FROM folds f JOIN steps s ON f.lang IS NOT DISTINCT FROM s.lang AND f.pos = s.pos AND s.step = f.step + 1),
proofs AS (SELECT lang, pos, max(step) AS last, sha256(coalesce(string_agg(digest, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY lang, pos)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root
LEFT JOIN proofs x ON p.lang IS NOT DISTINCT FROM x.lang AND p.pos = x.pos
JOIN folds f ON p.lang IS NOT DISTINCT FROM f.lang AND p.pos = f.pos AND f.step = coalesce(x.last, 0)
""")
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of the contract: one more character where 7 divides the CRC-32 of the id."""
    docs = read(spark, folder, "documents", *merkle.COVERED)
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = merkle.build_manifest(docs, changed={"n_chars": F.col("n_chars") + 1}, where=where)
    return made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root", "verified")


@query()
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query()
def op12_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from the four fifths of the documents whose CRC-32 of the id does not leave 1."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return ngrams.score(read(spark, folder, "documents", "doc_id", "text"), held)
