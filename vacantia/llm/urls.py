"""URL filters with DataFrame functions only: path rules, and a cascade of Bloom filters."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import ascii_lower
from vacantia.session import materialize, scratch_path

#: Rules (verdict, host, path) of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest fitting (verdict, rule), else null. A rule fits its host, all subdomains of it,
    and paths that start with the rule's."""
    fitting = [
        F.when(
            ((host == of) | host.endswith("." + of)) & path.startswith(start),
            F.struct(F.lit(verdict).alias("verdict"), F.lit(of + start).alias("rule")),
        )
        for verdict, of, start in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    return F.coalesce(*fitting)


@dataclass(frozen=True)
class Level:
    """One filter: 64-bit words, the number of its bits, and of the bits set for each key."""

    words: list[int]
    n_bits: int
    n_hashes: int


def _positions(key: Column, level: int, n_bits: int, n_hashes: int) -> list[Column]:
    first = F.pmod(F.xxhash64(F.lit(2 * level), key), F.lit(n_bits))
    second = F.pmod(F.xxhash64(F.lit(2 * level + 1), key), F.lit(n_bits))
    return [F.pmod(first + i * second, F.lit(n_bits)) for i in range(n_hashes)]


def _fits(key: Column, level: int, made: Level) -> Column:
    words = F.split(F.lit(",".join(map(str, made.words))), ",").cast("array<long>")  # folded into one constant
    tests = [
        F.bit_get(F.get(words, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1
        for p in _positions(key, level, made.n_bits, made.n_hashes)
    ]
    return reduce(Column.__and__, tests)


def key_table(keys: DataFrame, listed: DataFrame, key_col: str = "key") -> DataFrame:
    """(key, listed), one row a key of either; written, as all levels and parts read it. Null keys are left out."""
    all_keys = keys.select(F.col(f"`{key_col}`").alias("key"), F.lit(False).alias("listed"))
    marked = all_keys.union(listed.select(F.col(f"`{key_col}`"), F.lit(True))).where(F.col("key").isNotNull())
    return materialize(marked.groupBy("key").agg(F.max("listed").alias("listed")), "keys")


def bits_for(n: int, false_rate: float) -> int:
    return 64 * max(1, math.ceil(-n * math.log(false_rate) / math.log(2) ** 2 / 64))


def parts_for(table: DataFrame, false_rate: float, max_bits: int) -> int:
    """Parts by key hash so that no level of a part's cascade needs more than about ``max_bits`` bits.

    Level 0 has the listed keys, level 1 a share of the others (``false_rate``); later ones are smaller.
    """
    n = table.agg(F.count_if("listed").alias("inside"), F.count_if(~F.col("listed")).alias("outside")).first()
    return -(-bits_for(max(n.inside, math.ceil(n.outside * false_rate)), false_rate) // max_bits)


def part_of(key: Column, parts: int) -> Column:
    """The part that judges a key; null keys go to the first."""
    return F.when(key.isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))).cast("int")


def build_cascade(table: DataFrame, *, false_rate: float = 0.1) -> list[Level]:
    """Filters that tell the listed keys of a ``key_table`` from its other keys, exactly.

    Level 0 encodes the listed keys, level 1 those of the others that level 0 takes for listed,
    level 2 the listed keys that level 1 takes for unlisted, and so on until nothing is left. Bits
    are combined per 64-bit word in Spark; only words reach the driver. No listed key makes no level.
    """
    encode, against = table.where("listed"), table.where("not listed")
    n_hashes = max(1, round(-math.log2(false_rate)))
    levels: list[Level] = []
    while True:
        n = encode.count()
        if not n:
            return levels
        n_bits, number = bits_for(n, false_rate), len(levels)
        places = encode.select(F.explode(F.array(*_positions(F.col("key"), number, n_bits, n_hashes))).alias("at"))
        words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")
        )
        bits = [0] * (n_bits // 64)
        for row in words.toLocalIterator():
            bits[row.word] = row.bits
        levels.append(Level(bits, n_bits, n_hashes))
        encode, against = against.where(_fits(F.col("key"), number, levels[-1])), encode


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Exact for keys of the universe; null is not listed. A key is listed if it passes an odd
    number of levels before one rejects it, counted over the whole cascade."""
    out = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels) - 1, -1, -1):
        out = F.when(_fits(key, number, levels[number]), out).otherwise(F.lit(number % 2 == 1))
    return F.coalesce(key.isNotNull() & out, F.lit(False))


def judge_urls(
    pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", key_col: str = "key", keep: tuple[str, ...] = (),
    rules: tuple = RULES, false_rate: float = 0.1, max_bits: int = 1 << 23,
) -> DataFrame:
    """Pages with host, path, rule and verdict.

    The longest fitting rule decides; elsewhere a page is blocked if its key (host and path) is
    one of ``listed``, which a filter cascade over all keys of ``pages`` tells exactly and without
    a join. Filters are constants of the expression; where a level needs more than ``max_bits``
    bits, keys and pages are cut by key hash into as many parts as that asks for, each with a
    cascade of its own, and one part after the other is judged and written. A null url, or one without "://", has empty host and path, no key, and is allowed.
    Null ids and repeated rows are judged like others, each on its own; an empty table gives no
    rows. ``keep`` names columns to pass on, but for those the result makes.
    """
    made = ("host", "path", "rule", "verdict")
    url, columns = F.col(f"`{url_col}`"), [c for c in keep if c not in made]
    parts = pages.select(
        F.col(f"`{id_col}`").alias("__id"), host_of(url).alias("host"), path_of(url).alias("path"),
        *([F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__kept")] if columns else []),
    )
    parts = parts.withColumn("__key", url_key(F.col("host"), F.col("path")))
    table = key_table(parts.select(F.col("__key").alias(key_col)), listed, key_col)
    n = parts_for(table, false_rate, max_bits)

    def judged(rows: DataFrame, keys: DataFrame) -> DataFrame:
        levels = build_cascade(keys, false_rate=false_rate)
        by_list = F.when(is_listed(F.col("__key"), levels), F.lit("block")).otherwise(F.lit("allow"))
        return rows.withColumn("__rule", longest_rule(F.col("host"), F.col("path"), rules)).select(
            F.col("__id").alias(id_col), *[F.col(f"__kept.`{c}`").alias(c) for c in columns], "host", "path",
            F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), by_list).alias("verdict"),
        )

    if n == 1:
        return judged(parts, table)
    spark, paths = pages.sparkSession, [scratch_path(pages.sparkSession, x) for x in ("url_keys", "url_pages", "url_verdicts")]
    for frame, path, key in ((table, paths[0], "key"), (parts, paths[1], "__key")):
        frame.withColumn("__part", part_of(F.col(key), n)).write.partitionBy("__part").parquet(path)
    number = T.StructField("__part", T.IntegerType())
    keys, rows = (spark.read.schema(T.StructType([*f.schema.fields, number])).parquet(p) for f, p in ((table, paths[0]), (parts, paths[1])))
    for part in range(n):
        judged(rows.where(F.col("__part") == part), keys.where(F.col("__part") == part)).write.mode("append").parquet(paths[2])
    return spark.read.parquet(paths[2])


def url_key(host: Column, path: Column) -> Column:
    return F.when(host != "", F.concat(host, path))
