"""Cases of the third round's findings, each against plain results or the query's own SQL."""

import datetime
import os
import tempfile

import pytest
from compare import connect, difference

import __spark_entry__ as entry


def folder_with(spark, base, **tables):
    """A copy of the base folder by links, with some tables given as frames."""
    out = tempfile.mkdtemp(prefix="findings-")
    for name in os.listdir(base):
        if name.removesuffix(".parquet") not in tables:
            os.symlink(os.path.join(base, name), os.path.join(out, name))
    for name, frame in tables.items():
        held = tempfile.mkdtemp(prefix="findings-part-")
        frame.coalesce(1).write.mode("overwrite").parquet(held)
        part = next(f for f in os.listdir(held) if f.endswith(".parquet"))
        os.link(os.path.join(held, part), os.path.join(out, f"{name}.parquet"))
    return out


def matches_sql(spark, base, name):
    return difference(entry.queries()[name](spark, base), connect(base), entry.oracle_sql()[name])


def test_zero_response_time_is_shown(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    at = datetime.datetime(2025, 1, 1)
    rows = [(10**6 + i, at, i, kind, 0.0, "{}") for i, kind in enumerate(("view", "click", "error", "signup"))]
    base = folder_with(spark, folder, events=events.unionByName(spark.createDataFrame(rows, events.schema)))
    assert matches_sql(spark, base, "source_health_report") is None


def test_state_of_arrivals_is_held_by_buckets(spark, tmp_path):
    """Many keys, null ones among them, cost one state value a bucket; kinds are those of the plain loop."""
    from vacantia.streaming import stateful

    start, shape = datetime.datetime(2025, 1, 1), "k string, ts timestamp, n long"
    rows = [(None if i % 7 == 0 else f"k{i % 301}", start + datetime.timedelta(minutes=(i * 7919) % 3000), i) for i in range(1200)]
    for part in (rows[:400], rows[400:800], rows[800:]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kinds = stateful.kinds_of_rows(stream, ["k"], "ts", "n", delay="2 hours", buckets=4)
    query = stateful.split_late(kinds, *(str(tmp_path / x) for x in ("first", "late", "counts", "cp")))
    query.awaitTermination()
    assert query.exception() is None
    newest, expected = {}, {"first": [], "late": []}
    for part in (rows[:400], rows[400:800], rows[800:]):
        for k, ts, n in sorted(part, key=lambda r: (r[1], r[2])):
            gap = (ts - newest.get(k, datetime.datetime.min)).total_seconds()
            if abs(gap) > 7200:
                expected["first" if gap > 0 else "late"].append(n)
            newest[k] = max(ts, newest.get(k, ts))
    for kind, numbers in expected.items():
        assert sorted(r.n for r in spark.read.parquet(str(tmp_path / kind)).collect()) == sorted(numbers) and numbers
    # a value and two entries of its timer a bucket, where keys of their own would be 300
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 4 * 3


def test_keys_of_a_bucket_expire_one_by_one():
    """A timer forgets the keys whose time is over and is set anew for the others."""
    import types

    import pandas as pd

    from vacantia.streaming.stateful import FirstRepeatLate, _held_keys

    class Held:
        value, timers = None, []
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, value: setattr(self, "value", value)
        clear = lambda self: setattr(self, "value", None)
        registerTimer = lambda self, at: self.timers.append(at)

    held, bucket = Held(), FirstRepeatLate(10, 1_000)
    bucket.handle = bucket.state = held

    def given(second, *keys):
        n = range(len(keys))
        frame = pd.DataFrame({"row_bucket": 0, "row_key": keys, "row_time": [second] * len(keys), "row_tie": n, "row_arrived": pd.Timestamp(second, unit="s")})
        return [kind for out in bucket.handleInputRows((0,), iter([frame]), None) for kind in out["row_kind"]]

    at = lambda ms: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert given(1, "a", "b", "a") == ["first", "repeat", "first"]  # by key
    assert given(2, "b") == ["repeat"] and held.timers == [2_000]
    list(bucket.handleExpiredTimer((0,), at(2_500), None))
    assert list(_held_keys(held.value[0])[0]) == ["b"] and held.timers == [2_000, 3_000]
    assert given(2, "a") == ["first"]
    list(bucket.handleExpiredTimer((0,), at(3_500), None))
    assert held.value is None


def test_entries_share_first_words(spark):
    """Entries with one first word meet only texts that hold both of their words, and plain ones need no pattern."""
    from vacantia.operators import phrases

    rows = [(i, f"of w{i}", "c", rf"\bof w{i}\b", [f"of w{i}"]) for i in range(400)] + [(400, "W3", "c", r"\bW3\b", ["W3"]), (401, "any", "c", r"\bof[ -]w7 x\b", ["of w7 x", "of-w7 x"])]
    texts = ["of w1, OF W2 of  w3 of-w4 xof w5 of w6y", "of-w7 x of w8", "w3\x01of\x01w9 of \x01w10", "of w7 x", "", None]
    found = phrases.with_entries(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", spark.createDataFrame(rows, phrases.ENTRY))
    got = {r.id: [e["name"] for e in r.entries] for r in found.collect()}
    assert got == {0: ["of w1", "of w2", "W3"], 1: ["of w8", "any"], 2: ["W3"], 3: ["of w7", "any"], 4: [], 5: []}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "entry_next" not in plan  # no condition beside the keys that join


def test_level_phrases_are_looked_for_where_they_can_be(spark):
    from pyspark.sql import functions as F

    from vacantia.operators import cvtext

    texts = ["expert in sql", "sql expert in x", "expertsql", "lead expert in sql", "using sql", "sql developer", "advanced sq", "", None]
    df = spark.createDataFrame([(t, s) for t in texts for s in ("sql", "lead ", "in")], "t string, s string")
    ranks = df.select(cvtext.phrase_rank(F.col("t"), F.col("s")).alias("a"), cvtext.phrase_rank(F.col("t"), F.col("s"), cvtext.phrases_held(F.col("t"))).alias("b")).collect()
    assert all(r.a == r.b for r in ranks) and {r.a for r in ranks} == {1, 2, 3}


def test_kmeans_scores_its_clusters(spark, folder):
    assert entry.queries()["train_kmeans"](spark, folder).first().silhouette_in_range is True


def test_model_has_words_pairs_and_triples():
    import inspect

    from vacantia.llm import ngrams

    assert len(inspect.signature(ngrams.score).parameters["strengths"].default) == 2


def test_tiles_are_few_and_results_exact(spark):
    """Copies, near copies and vectors far from zero: nearest of many and silhouettes as by plain differences."""
    import numpy as np
    from pyspark.sql import functions as F

    from vacantia.operators import vectors

    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)) + 1000
    x[100:200], x[200:300] = x[7], x[8] + 1e-5 * rng.normal(size=(100, 8))
    labels = np.arange(900) % 3
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x))], "id int, c int, v array<double>").repartition(4)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    centroids = df.filter("id % 2 = 1").select(F.col("id").alias("cluster"), F.col("v").alias("centroid"))
    got = {r.id: (r.d, r.n) for r in vectors.assign_nearest(df, "v", centroids, out="n", distance="d", max_broadcast=16).collect()}
    near = np.round(d[:, 1::2], 6)
    assert got == {i: (near[i].min(), 1 + 2 * int(near[i].argmin())) for i in range(900)}
    sums = np.stack([d[:, labels == k].sum(axis=1) for k in range(3)], axis=1)
    for r in vectors.euclidean_silhouettes(df, "v", "c", "id").collect():
        a, b = sums[r.id, r.cluster] / 299, np.delete(sums[r.id], r.cluster).min() / 300
        assert abs(r.silhouette - (b - a) / max(a, b)) < 1e-9
    assert spark.range(1).select(vectors.tiles_for(F.lit(150_000), 64), vectors.tiles_for(F.lit(3_000_000), 64)).first()[:] == (8, 92)


def test_word_ends_are_found_by_their_sign():
    import random
    import re

    from vacantia.llm import packing

    assert packing.WORD_END.pattern.startswith(b"[.,]")  # only the signs' places are looked at
    plain = re.compile(rb"(?<=[a-z0-9])(?=[.,])")
    draw = random.Random(5)
    for text in (b".", b",a.", b"a..,b,\n.", "é.a, é,1.5".encode(), *(bytes(draw.choice(b"az09.,\n \xc3\xa9\\") for _ in range(40)) for _ in range(500))):
        assert packing.WORD_END.sub(rb" \g<0>", text) == plain.sub(b" ", text)


def test_encoder_takes_bounded_pieces():
    import numpy as np
    import pyarrow as pa

    from vacantia.operators import vectors

    assert vectors.HashingEncoder().known <= 1 << 17
    places, sizes = vectors._Places(16, r"[^a-z]+", False, 4), []
    counts = places._counts
    places._counts = lambda column: sizes.append(len(column)) or counts(column)
    texts = ["a b c", "", None, "x" * 300, "a a", "d", "e f g h"]
    made = np.array(places.vectors(pa.array(texts), at_once=2, at_once_bytes=100).to_pylist())
    assert made.tolist() == [counts(pa.array([t], pa.string()))[0].tolist() if t is not None else [0.0] * 16 for t in texts]
    assert sizes == [2, 1, 1, 2, 1]
    assert places.vectors(pa.array([], pa.string())).to_pylist() == []
