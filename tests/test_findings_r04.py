"""Cases of the fourth round's findings: entries found without sending texts or their words anywhere."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacantia.functions import dictionaries as D
from vacantia.operators import blocks, cvtext, phrases


def shuffled(df) -> int:
    """Bytes that a collected frame's exchanges wrote."""

    def of(node) -> int:
        metric, out = node.metrics().get("shuffleBytesWritten"), 0
        if metric.isDefined() and "Exchange" in node.nodeName() and "Reused" not in node.nodeName():
            out += metric.get().value()
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else None
        children = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        return out + sum(map(of, children))

    return of(df._jdf.queryExecution().executedPlan())


def texts_and_entries(spark, n_texts=120, n_words=1500):
    """Long texts of words that do not repeat, and entries of two words of which each text holds some."""
    draw = random.Random(4)
    word = lambda: f"{draw.getrandbits(40):010x}"
    names = [f"{word()} {word()}" for _ in range(3000)]
    lists = [[*(word() for _ in range(n_words)), *draw.sample(names, 5)] for _ in range(n_texts)]
    for x in lists:
        draw.shuffle(x)
    rows = [(i, n, "Phrases", rf"\b{n}\b", [n]) for i, n in enumerate(names)]
    place = {n: i for i, n in enumerate(names)}
    expected = {i: sorted(place[w] for w in x if w in place) for i, x in enumerate(lists)}
    texts = [(i, "developer, " + ", ".join(x)) for i, x in enumerate(lists)]
    return spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(rows, phrases.ENTRY), expected, sum(len(t) for _, t in texts)


@pytest.mark.parametrize("kind", ["entries", "tech"])
def test_texts_are_not_shuffled(spark, kind):
    """what is sent grows with the entries that are found, not with texts and their words."""
    texts, dictionary, expected, size = texts_and_entries(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a dictionary that is too large for it
    try:
        if kind == "entries":
            found = phrases.with_entries(texts, "t", dictionary).select("id", "entries.ord")
            got = {r.id: r.ord for r in found.collect()}
        else:
            found = phrases.with_tech_skills(texts, "t", dictionary).select("id", "skills.name")
            names = {r.name: r.ord for r in dictionary.collect()}
            got = {r.id: sorted(names[n] for n in r.name) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == expected
    assert shuffled(found) < size / 5


def test_blocks_and_pieces_change_nothing(spark):
    """Texts cut into many blocks, null and empty ones, repeated rows, one of more than a block, several keys of one entry."""
    texts = [f"Go w{i % 7}  w{i % 5} of é{i % 3} rest api, w{i % 11}-w{i % 4}." for i in range(60)] + [None, "", " , ", "go " * 500 + "w1 w2", "Go", "Go"]
    rows = [(i, f"w{i} of", "c", rf"\bw{i} of\b", [f"w{i} of"]) for i in range(12)] + [
        (20, "of é2", "c", r"\bof é2\b", ["of é2"]), (21, "REST API", "c", r"\b(REST|REST API)\b", ["REST", "REST API"]), (22, "Go", "c", r"\bGo\b", ["Go"]),
        (23, "w-w", "c", r"\bw\d-w3\b", [f"w{i}-w3" for i in range(11)]), (22, "Go", "c", r"\bGo\b", ["Go"]), (None, "go w1", None, r"\bgo w1\b", ["go w1"]),
    ]
    df, dictionary = spark.createDataFrame(list(enumerate(texts)), "id int, t string"), spark.createDataFrame(rows, phrases.ENTRY)
    got = {r.id: [e["name"] for e in r.entries] for r in phrases.with_entries(df, "t", dictionary).collect()}
    different = sorted({r[:4] for r in rows}, key=lambda r: -1 if r[0] is None else r[0])
    assert got == {i: [r[1] for r in different if re.search(r[3], t or "", re.I)] for i, t in enumerate(texts)}
    assert got[60] == got[61] == got[62] == [] and got[64] == got[65] == ["Go"] and {n for x in got.values() for n in x} > {"go w1", "w-w", "of é2"}
    index = phrases._key_index(dictionary)
    whole = {r.id: sorted(map(str, set(r._candidates))) for r in blocks.with_candidates(df, "t", index).collect()}
    small = {r.id: sorted(map(str, set(r._candidates))) for r in blocks.with_candidates(df.repartition(3), "t", index, 100).collect()}
    assert small == whole and len(whole) == len(texts)


def test_no_rows_and_no_entries(spark):
    df, rows = spark.createDataFrame([(1, "go on")], "id int, t string"), [(1, "Go", "c", r"\bGo\b", ["Go"])]
    full, none = spark.createDataFrame(rows, phrases.ENTRY), spark.createDataFrame([], phrases.ENTRY)
    assert phrases.with_entries(df.limit(0), "t", full).collect() == []
    assert [r.entries for r in phrases.with_entries(df, "t", none).collect()] == [[]]
    assert [[e["name"] for e in r.entries] for r in phrases.with_entries(df, "t", full).collect()] == [["Go"]]


def test_keys_are_words_and_pairs(monkeypatch):
    every = pa.array(["a b\tc\t", "\td\t", "\t", "e é\t"])
    rows, keys = blocks.passing_keys(every, np.full(8, 255, np.uint8))
    assert [*zip(rows.tolist(), [k.decode() for k in keys], strict=True)] == [
        (0, "a"), (0, "b"), (0, "c"), (0, "a b"), (0, "b\tc"), (1, "d"), (3, "e"), (3, "é"), (3, "e é"),
    ]
    letters, edges = blocks.letters_of(pa.array(["ab", "b", "xab", "", "ab"]))
    x = blocks.hashes(letters, edges[:-1], edges[1:]).tolist()
    assert x[0] == x[4] and len(set(x)) == 4
    assert blocks.hashes(letters, np.array([4]), np.array([6])).tolist() == [x[0]]
    many = np.tile(letters, 5)
    whole = blocks.hashes(many, np.arange(20), np.arange(20) + 5)
    for size in (1, 4, 7):
        monkeypatch.setattr(blocks, "PIECE_BYTES", size)
        assert (blocks.hashes(many, np.arange(20), np.arange(20) + 5) == whole).all()


def test_levels_are_looked_for_beside_phrases(spark):
    """the same levels as with every phrase looked for in the whole text, also for long names and places that share text."""
    long = "x" * 70
    texts = [
        "expert in expert in sql", "a sql expert expert", "using using sql, using go", f"using {long}", f"{long} expert", f"using {long[1:]}", "Ünï𝔘 expert\nin sql expert",
        "advanced\nsql", "advanced \nsql", "expert in  sql", "sqlexpert in sql", "lead lead expert in", "worked with 𝔘 developer", " expert", "expert in ", "", None,
    ]
    names = ["sql", "expert in sql", "sql expert", "go", long, "x", "ünï𝔘", "𝔘", "\nsql", " sql", "lead", "expert", "expert in", "", None]
    df = spark.createDataFrame([(t and t.lower(), s) for t in texts for s in names], "t string, s string")
    ranks = df.select("t", "s", cvtext.phrase_rank(F.col("t"), F.col("s")).alias("a"), cvtext.phrase_rank(F.col("t"), F.col("s"), cvtext.phrases_held(F.col("t"))).alias("b")).collect()
    assert [r for r in ranks if r.a != r.b] == [] and {r.a for r in ranks} == {1, 2, 3}
    whole = {(t, s): 1 if s and any(p.format(s) in t for p in D.EXPERT_PHRASES) else 2 if s and any(p.format(s) in t for p in D.INTERMEDIATE_PHRASES) else 3 for t, s in {(r.t, r.s) for r in ranks if r.t}}
    assert all(whole[r.t, r.s] == r.b for r in ranks if r.t and r.s)
    fixed = [p.replace("{}", "") for p in (*D.EXPERT_PHRASES, *D.INTERMEDIATE_PHRASES)]
    assert not [f for f in fixed for n in range(1, len(f)) if f[:n] == f[-n:]]  # else places could be missed
