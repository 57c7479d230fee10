"""Row mapping, filters and deduplication on small fixtures."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from vacantia.functions import dates, labels, text
from vacantia.operators import ranking, rows, selection
from vacantia.schema import FLAT_PAYLOAD, NESTED_PAYLOAD



def values(df, column):
    return [r[column] for r in df.collect()]


def test_nested_payloads(spark):
    data = [
        ("1", "a1", "Nurse", "we teach python", None, None, None, None, None, None, None, {"display_name": "X"}, {"display_name": "L", "area": ["UK", "London"]}),
        ("", "a2", "t", "d", None, None, None, None, None, None, {"label": "Given"}, None, {"display_name": None, "area": []}),
        (None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    out = rows.structure_nested(spark.createDataFrame(data, NESTED_PAYLOAD), collected_at=F.lit(None))
    got = {r["id"]: r for r in out.collect()}
    # The first rule that hits wins, whichever keyword comes first in the text.
    assert got["1"]["category"] == "IT & Engineering" and got["1"]["country"] == "UK"
    assert got["a2"]["category"] == "Given" and got["a2"]["country"] == "Unknown"
    assert got[None]["category"] == "Unknown" and got[None]["company"] is None
    assert selection.filter_identified(out).count() == 2
    coded = rows.structure_nested(spark.createDataFrame(data[:1], NESTED_PAYLOAD), collected_at=F.lit(None), country_code=F.lit("GB"))
    assert values(coded, "country") == ["UK"]
    other = rows.structure_nested(spark.createDataFrame(data[:1], NESTED_PAYLOAD), collected_at=F.lit(None), country_code=F.lit("xx"))
    assert values(other, "country") == ["XX"]


def test_category_substring_traps(spark):
    df = spark.createDataFrame([("build things",), ("JavaScript",), ("zzz",), (None,)], "d string")
    none = F.lit(None).cast("string")
    out = df.select(rows.infer_category(none, F.col("d"), none).alias("c"))
    assert values(out, "c") == ["Design & Creative", "IT & Engineering", "Unknown", "Unknown"]


def test_flat_payloads_and_tags(spark):
    data = [
        ("1", "s", "", "Title", "C", "", "d", ["Python", "Go"], "u", "", "2025-01-01"),
        ("", "slug", "Pos", None, "C", "Paris", "d", None, "u", "2025-02-02", None),
        ("3", None, None, "T", "C", None, "d", ["rust", None], "u", None, None),
    ]
    out = rows.structure_flat(spark.createDataFrame(data, FLAT_PAYLOAD), collected_at=F.lit(None))
    got = {r["id"]: r for r in out.collect()}
    assert got["1"]["title"] == "Title" and got["1"]["location"] == "Remote" and got["1"]["created_at"] == "2025-01-01"
    assert got["slug"]["title"] == "Pos" and got["slug"]["location"] == "Paris"
    assert got["3"]["location"] == "Remote"
    assert values(selection.filter_tags(out, wanted=("PYTHON",)), "id") == ["1"]
    assert selection.filter_tags(out, wanted=()).count() == 3


def test_ages_floor_and_zone(spark):
    df = spark.createDataFrame(
        [("2025-01-02T06:00:00",), ("2025-01-03T12:00:00Z",), ("2024-12-31T23:00:00+05:00",), ("garbage",), (None,)], "c string"
    )
    out = rows.add_age(df, "c", "2025-01-02 06:00:00")
    assert values(out, "job_age_days") == [0, -2, 1, 0, 0]


def test_recency_keeps_unparseable(spark):
    df = spark.createDataFrame([("2025-01-01",), ("2024-01-01",), ("x",), (None,)], "c string")
    assert values(selection.filter_recent(df, "c", "2025-01-10 00:00:00", 30), "c") == ["2025-01-01", "x", None]
    assert selection.filter_recent(df, "c", "2025-01-10 00:00:00", None).count() == 4


def test_trim_and_truncate(spark):
    df = spark.createDataFrame([(" \n x\t ", "a" * 600), ("", "a" * 601), (None, "b" * 598 + "  \n" + "c" * 9)], "title string, description string")
    out = rows.shorten_descriptions(df.withColumn("title", text.strip_space(F.col("title")))).collect()
    assert [r["title"] for r in out] == ["x", "", None]
    assert out[0]["description"] == "a" * 600 and out[1]["description"] == "a" * 600 + "..."
    assert out[2]["description"] == "b" * 598 + "..."


def test_defaults_and_missing_columns(spark):
    df = spark.createDataFrame([(None, "t", None)], "description string, title string, company string")
    row = rows.fill_defaults(df).first()
    assert row["description"] == "No description available." and row["contract_time"] == "N/A"
    assert row["title"] == "t" and row["company"] == "Not specified" and row["redirect_url"] == "Not specified"


def test_salaries(spark):
    df = spark.createDataFrame([("abc",), (None,), ("12.5",)], "s string")
    assert values(rows.coerce_salaries(df, ["s"]), "s") == [0.0, 0.0, 12.5]


def test_json_safe(spark):
    df = spark.createDataFrame([(float("nan"), None), (float("inf"), "x"), (1.5, "y")], "v double, s string")
    out = rows.json_safe(df).collect()
    assert [r["v"] for r in out] == [None, None, 1.5] and out[0]["s"] is None


def test_embedding_texts_skip_missing_parts(spark):
    df = spark.createDataFrame([("T", None, None, "D"), (None, "C", "K", None)], "title string, company string, category_label string, description string")
    a, b = rows.embedding_texts(df).collect()
    assert (a["text_title_company"], a["text_category_title"]) == ("T", "T")
    assert (b["text_full"], b["text_title"], b["text_title_company"], b["text_category_title"]) == ("", "", "C", "K")


def test_chunks(spark):
    many = [("many", i, "x") for i in range(30)]
    data = [("a", 0, "hello"), ("a", 1, ""), ("a", 2, "world!"), ("a", 3, "zzz"), *many]
    df = spark.createDataFrame(data, "k string, p int, c string")
    got = {r["k"]: r["text"] for r in rows.join_chunks(df, key="k", position="p", chunk="c", budget=9).collect()}
    assert got == {"a": "hello\n\nworl", "many": "\n\n".join("x" * 9)}
    pages = rows.join_chunks(df, key="k", position="p", chunk="c", max_chunks=20)
    assert {r["k"]: len(r["text"]) for r in pages.collect()} == {"a": 18, "many": 20 + 2 * 19}


def test_query_text_and_guard(spark):
    df = spark.createDataFrame([("dev", "", None), ("", " ", "sql")], "k string, l string, s string")
    out = df.select(rows.query_text(F.col("k"), F.col("l"), F.col("s")).alias("q"))
    assert values(out, "q") == ["Job: dev", "Location:   | Skills: sql"]
    asked = spark.createDataFrame([("x",), (" \n",), ("",), (None,)], "q string")
    assert selection.filter_asked(asked, "q").count() == 1


def test_keyword_search_regex_and_literal(spark):
    df = spark.createDataFrame([("C++ dev", "uses c++", "UK"), ("Ccc", "ccc", "UK"), (None, None, None)], "title string, description string, location_display string")
    assert selection.keyword_search(df, query="c+").count() == 2
    assert selection.keyword_search(df, query="c++", literal=True).count() == 1
    assert selection.keyword_search(df, location="uk", skills="uses, ").count() == 1
    assert selection.keyword_search(df).count() == 3


def test_page_past_the_end(spark):
    df = spark.range(25)
    order = [F.col("id").asc()]
    assert values(ranking.page_of(df, order, 3, 10), "id") == list(range(20, 25))
    assert ranking.page_of(df, order, 4, 10).count() == 0


def test_keep_first_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 4), ("a", 3)], "k string, p int")
    out = ranking.keep_first(df, ["k"], [F.col("p").asc()])
    assert sorted(values(out, "p")) == [1, 3]


def test_match_percent_is_half_even(spark):
    df = spark.createDataFrame([(0.625,), (0.635,), (0.125,)], "s double")
    assert values(df.select(labels.half_even_percent(F.col("s")).alias("p")), "p") == [62, 64, 12]


def test_union_of_different_columns(spark):
    a = spark.createDataFrame([("1", "t")], "id string, title string")
    b = spark.createDataFrame([("2", ["x"])], "id string, tags array<string>")
    out = rows.to_canonical(selection.union_sources(a, b))
    assert sorted(values(out, "job_id")) == ["1", "2"] and "location_display" in out.columns


def test_labels(spark):
    df = spark.createDataFrame(
        [Row(d=0.0, m=0.0, n=None), Row(d=None, m=None, n=1234), Row(d=59.5, m=999.9, n=-1), Row(d=185.5, m=1234.5, n=0), Row(d=0.4, m=2675.0, n=5)],
        "d double, m double, n long",
    )
    out = df.select(
        labels.duration_label(F.col("d")).alias("d"), labels.millis_label(F.col("m")).alias("m"), labels.thousands(F.col("n")).alias("n")
    ).collect()
    assert [r["d"] for r in out] == ["0s", "0s", "1m 00s", "3m 06s", "0s"]
    # As Python formats 1.2345 and 2.675: half-even on the exact binary value.
    assert [r["m"] for r in out] == ["0ms", "0ms", "999ms", f"{1.2345:.2f}s", f"{2.675:.2f}s"]
    assert [r["n"] for r in out] == ["-", "1,234", "-1", "0", "5"]
    for value, expected in ((0.125, "12.5%"), (None, "-"), (1.0, "100.0%")):
        one = spark.createDataFrame([(value,)], "v double").select(labels.percent_label(F.col("v")).alias("p"))
        assert values(one, "p") == [expected]


def test_minute_label(spark):
    df = spark.createDataFrame([("2025-12-03T00:41:35.688436",), ("2025-12-03T00:41:35Z",), ("bad",), ("",), (None,)], "t string")
    assert values(df.select(dates.minute_label(F.col("t")).alias("l")), "l") == ["2025-12-03 00:41", "2025-12-03 00:41", None, "N/A", "N/A"]


def test_title_case(spark):
    df = spark.createDataFrame([("node.js tools",), ("NO_DATA",), ("o'neil 3d",)], "s string")
    assert values(df.select(text.title_case(F.col("s")).alias("t")), "t") == ["Node.Js Tools", "No_Data", "O'Neil 3D"]
