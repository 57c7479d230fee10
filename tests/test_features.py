"""Dictionary tables, profiles, raw files, tiles, model runs, stateful streams and their awkward cases."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.functions import dictionaries as D
from vacantia.operators import cvtext, phrases, profile, ranking, vectors
from vacantia.sources import landed_files, landing, tables
from vacantia.streaming import jobs, stateful


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


# ------------------------------------------------------------------ deduplication and densities


def test_first_text_keeps_null_ids_and_one_of_each_text(spark):
    shape = "id long, t string, o int"
    first = lambda rows, order=(): sorted(map(tuple, ranking.keep_first_text(spark.createDataFrame(rows, shape), "t", list(order), "id").collect()), key=str)
    assert first([(None, "a", 1), (1, "a", 1), (2, "b", 1), (None, "c", 1)]) == [(1, "a", 1), (2, "b", 1), (None, "c", 1)]
    assert first([(1, "a", 1), (1, "b", 1), (2, "a", 1)]) == [(1, "a", 1), (1, "b", 1)]
    assert first([(1, "a", 2), (2, "a", 1), (None, None, 1), (None, None, 1)], ["o"]) == [(2, "a", 1), (None, None, 1)]
    assert first([]) == []


@pytest.mark.parametrize("centre", [0.0, 1e8, 1e9, -1e9])
def test_density_far_from_zero(spark, centre):
    rng = np.random.default_rng(2)
    values = centre + rng.normal(0, 0.5, 1000)
    got = profile.density(spark.createDataFrame([("m", float(v)) for v in values], "measure string, value double")).orderBy("point").collect()
    h = values.std(ddof=1) * len(values) ** -0.2
    x = np.array([r.x for r in got])
    plain = np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert np.allclose([r.density for r in got], plain, rtol=1e-4)


def test_density_without_spread(spark):
    rows = [("same", 7.0)] * 10 + [("one", 3.0), ("odd", float("nan")), ("odd", None), ("odd", float("inf")), ("odd", 1.0), ("odd", 2.0)]
    got = profile.density(spark.createDataFrame(rows, "measure string, value double"), points=5).collect()
    assert {(r.measure, r.x, r.density) for r in got if r.measure in ("same", "one")} == {("same", 7.0, None), ("one", 3.0, None)}
    assert sum(r.measure == "odd" and r.density > 0 for r in got) == 5
    assert profile.density(spark.createDataFrame([], "measure string, value double")).collect() == []


# ------------------------------------------------------------------ texts and dictionaries

CVS = [
    "skills: ſql and python, Kubernetes", "Software Engineer. Expert in Python, using React.js; C++x and C#y, CI/CD, scikit-learn", None, "", "developer: go golang Go REST API",
    "full-stack Node.js, machine  learning and Machine Learning", "technologies: NLP\nnatural language processing; AWS", "fullstack java and javascript", "programming\n: sql",
]


def test_hints_and_tables_change_nothing(spark):
    df = spark.createDataFrame(list(enumerate(CVS)), "id int, t string")
    hinted, hints = cvtext.with_hints(df, "t", "tech")
    text = F.col("t")
    plain = {r.id: r.s for r in df.select("id", cvtext.tech_skills(text).alias("s")).collect()}
    assert [s["name"] for s in plain[0]] == ["Python", "SQL", "Kubernetes"] and len(plain[1]) > 3
    assert {r.id: r.s for r in hinted.select("id", cvtext.tech_skills(text, hints=hints).alias("s")).collect()} == plain
    table = {r.id: r.skills for r in phrases.with_tech_skills(df, "t").collect()}
    assert {k: v or [] for k, v in table.items()} == {k: v or [] for k, v in plain.items()}
    general = {r.id: r.s for r in df.select("id", cvtext.general_skills(text).alias("s")).collect()}
    assert {r.id: r.skills for r in phrases.with_general_skills(df, "t").collect()} == general
    gate = df.select("id", cvtext.is_tech_cv(text).alias("a"), phrases.is_tech_cv(text).alias("b")).collect()
    assert all(bool(r.a) == r.b for r in gate) and {r.b for r in gate} == {True, False}


def test_dictionary_of_ten_thousand_entries(spark):
    rows = [(f"s{i}", "c", rf"\bterm{i}(?: plus)?\b") for i in range(10_000)]
    texts = spark.createDataFrame([(i, f"a term{i * 7}, TERM{i} Plus xterm{i + 1} term{i + 2}x") for i in range(50)] + [(None, "term5"), (None, None)], "id long, t string")

    def plan(n):
        found = phrases.with_entries(texts, "t", spark.createDataFrame([(i, *r, phrases.literal_forms(r[2])) for i, r in enumerate(rows[:n])], phrases.ENTRY))
        return found, len(found._jdf.queryExecution().optimizedPlan().toString())

    (small, few), (large, many) = plan(10), plan(10_000)
    assert many < 1.2 * few + 2000
    got = {r.id: [e["name"] for e in r.entries] for r in large.filter("id IS NOT NULL").collect()}
    assert all(got[i] == [f"s{k}" for k in sorted({i, 7 * i})] for i in range(50))
    assert sorted(len(r.entries) for r in large.filter("id IS NULL").collect()) == [0, 1]
    assert large.filter("t IS NULL").first().entries == []


def test_forms_of_patterns():
    assert phrases.literal_forms(r"\b(a|bc?)d\b") == ["ad", "bcd", "bd"]
    for _, pattern, *_ in (*D.TECH_SKILLS, *D.GENERAL_SKILLS):
        assert all(phrases.literal_forms(pattern))
    for bad in (r"\bfull.?stack\b", r"\ba+\b", r"\b[ab]\b", r"\b\d\b", r"a)"):
        with pytest.raises(ValueError):
            phrases.literal_forms(bad)


def test_profiles_take_all_words(spark):
    rows = [
        (1, "gb", "it-jobs", "Data Scientist", "x"), (2, "gb", "it-jobs", "Scientist", "of DATA"), (3, "gb", "it-jobs", "Database scientist", "x"), (4, "us", "it-jobs", "data scientist", None),
        (5, "gb", "other", "data scientist", "x"), (6, None, "it-jobs", "data scientist", "x"), (7, "gb", "it-jobs", None, None), (8, "gb", "it-jobs", "data data", "data"), (None, "gb", "it-jobs", "data scientist", "x"),
    ]
    landed = spark.createDataFrame(rows, "id long, country string, category string, title string, description string")
    profiles = spark.createDataFrame([("a", "gb", "data scientist", "it-jobs", 9), ("b", "gb", "", "it-jobs", 2), ("c", "fr", "x", "it-jobs", 5), ("d", "us", None, "it-jobs", 5)], "name string, country string, what string, category string, max_jobs int")
    kept = landing.collect_for_profiles(landed, profiles, order=[])
    assert sorted((r.profile, r.id, r.found) for r in kept.collect()) == [("a", 1, 2), ("a", 2, 2), ("b", 1, 5), ("b", 2, 5), ("d", 4, 1)]
    log = {r.profile: r for r in landing.profile_runs(kept, profiles, "adzuna", "now").collect()}
    assert {k: (r.status, r.jobs_collected, r.job_ids) for k, r in log.items()} == {
        "a": ("success", 2, ["1", "2"]), "b": ("success", 2, ["1", "2"]), "c": ("no_new_jobs", 0, []), "d": ("success", 1, ["4"]),
    }
    assert landing.collect_for_profiles(landed, profiles.limit(0), order=[]).collect() == []


# ------------------------------------------------------------------ raw files


def raw(tmp_path):
    put(tmp_path / "a/2025-01-01/jobs_1.json", [{"id": "1", "title": "x", "description": "[,{\"}]"}, {"id": "2"}, 7, None, "t"])
    put(tmp_path / "a/2025-01-02/jobs_2.json", {"id": "3", "title": "alone"})
    put(tmp_path / "a/jobs_bad.json", '[{"id": "4"}, {broken')
    put(tmp_path / "a/jobs_cut.json", '[{"id": "5"},')
    put(tmp_path / "a/jobs_more.json", '[{"id": "6"}] 1')
    put(tmp_path / "a/jobs_empty.json", "")
    put(tmp_path / "a/jobs_none.json", " [ ] ")
    put(tmp_path / "a/jobs_seven.json", "7")
    (tmp_path / "a/jobs_latin.json").write_bytes(b'[{"id": "\xe9"}]')
    put(tmp_path / "a/jobs.jsonl", '{"id": "7"}\n{"id": "8"}')
    return str(tmp_path / "a")


def test_raw_files_by_the_data_source(spark, tmp_path):
    scanned = landed_files.scan(spark, raw(tmp_path), bytes_per_task=40)
    assert sorted(r.id for r in landed_files.postings(scanned).collect()) == ["1", "2", "3"]
    assert landed_files.postings(scanned).filter("id = '1'").first().description == '[,{"}]'
    left = {os.path.basename(r.src_file): r.problem for r in landed_files.problems(scanned).collect()}
    assert set(left) == {"jobs_bad.json", "jobs_cut.json", "jobs_more.json", "jobs_empty.json", "jobs_latin.json"} and all(left.values())
    for none in ("absent", "a/2025-01-03"):
        assert landed_files.scan(spark, str(tmp_path / none)).collect() == []
    assert landed_files.scan(spark, f"file://{raw(tmp_path)}").count() == scanned.count()


def test_missing_folder_and_skipped_files(spark, tmp_path):
    assert landing.read_landed(spark, str(tmp_path / "none")).collect() == []
    assert landing.skipped_files(spark, str(tmp_path / "none")).collect() == []
    put(tmp_path / "b/x/jobs_1.json", [{"id": "1"}, {"id": "2"}])
    put(tmp_path / "b/jobs_2.json", {"id": "3"})
    put(tmp_path / "b/jobs_bad.json", '[{"id": "4"}, {broken')
    folder = str(tmp_path / "b")
    assert {r.id for r in landing.read_landed(spark, folder).collect()} == {"1", "2", "3"}
    assert [(os.path.basename(r.src_file), r.bytes) for r in landing.skipped_files(spark, folder).collect()] == [("jobs_bad.json", 21)]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_elements_in_pieces(size):
    def elements(text):
        return [json.loads(t) for t in landed_files.Elements(iter([text[i : i + size] for i in range(0, len(text), size)]))]

    value = [{"a": [1, -2.5e3, {"b": "]},{é\\"}], "c": None}, 12345, "x" * 50, [], {}, True]
    for indent in (None, 2):
        assert elements(json.dumps(value, indent=indent)) == value
    assert elements(' {"a": 1} ') == [{"a": 1}] and elements("[]") == elements("12") == elements('"x"') == []
    for bad in ("", "[", "[1", "[1,", "[1 2]", "[1],", "{", '{"a"}', "[1]]", "nul", "[,1]"):
        with pytest.raises(ValueError):
            elements(bad)


# ------------------------------------------------------------------ vectors


def test_many_centroids_and_queries(spark):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(300, 5)), rng.normal(size=(3000, 5))
    c[17] = c[2900]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    centroids = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster long, centroid array<double>").repartition(4)
    got = {r.id: (r.cluster_id, r.d) for r in vectors.assign_nearest(rows, "v", centroids, distance="d").collect()}
    d = np.round(np.sqrt(((x[:, None] - c) ** 2).sum(axis=2)), 6)
    assert {i: k for i, (k, _) in got.items()} == dict(enumerate(d.argmin(axis=1).tolist()))
    assert np.allclose([got[i][1] for i in range(300)], d.min(axis=1))
    for limit in (3000, 2999):  # both ways at the border
        again = vectors.assign_nearest(rows, "v", centroids, max_broadcast=limit)
        assert {r.id: r.cluster_id for r in again.collect()} == {i: k for i, (k, _) in got.items()}
    some = rows.limit(7)
    scores = {(r.query_id, r.id): r.score for r in vectors.similarity_scores(centroids, some, query_id="cluster", query_vector="centroid", posting_vector="v", keep=["id"]).collect()}
    few = vectors.similarity_scores(centroids, some, query_id="cluster", query_vector="centroid", posting_vector="v", keep=["id"], max_broadcast=5000)
    assert len(scores) == 7 * 3000 and scores == pytest.approx({(r.query_id, r.id): r.score for r in few.collect()}, abs=1e-12)


def test_silhouettes_of_many_clusters(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist(), int(rng.integers(0, 30))) for i in range(200)] + [(900, [5.0, 5.0, None], 77)], "id long, v array<double>, c int")
    few = {r.id: r.silhouette for r in vectors.squared_silhouettes(rows, "v", "c", "id").collect()}
    many = {r.id: r.silhouette for r in vectors.squared_silhouettes(rows, "v", "c", "id", max_clusters=4).collect()}
    assert many == pytest.approx(few, abs=1e-9) and few[900] == 0


@pytest.mark.parametrize("limit", [2048, 3])
def test_euclidean_silhouettes_by_bounds(spark, limit):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(m, 1.0, size=(n, 4)) for m, n in ((0, 120), (2, 60), (4, 90), (9, 30))] + [np.full((1, 4), 50.0)])
    c = np.repeat([0, 1, 2, 3, 7], [120, 60, 90, 30, 1])
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c))] + [(900, None, 1), (901, [0.0] * 4, None)], "id long, v array<double>, c int")
    got = {r.id: r.silhouette for r in vectors.euclidean_silhouettes(df.repartition(4), "v", "c", "id", max_clusters=limit, tile_rows=50).collect()}
    plain = {r.id: r.silhouette for r in vectors.euclidean_silhouette(df, "v", "c", "id").collect()}
    assert got == pytest.approx(plain, abs=1e-6) and len(got) == 301 and got[300] == 0


def test_null_elements_count_as_zero(spark):
    rows = [(1, [1.0, None], 0), (2, [1.0, 0.0], 0), (3, [None, 4.0], 1), (4, [0.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "id int, v array<double>, c int")
    assert {r.cluster: r.centroid for r in vectors.cluster_centroids(df, "v", "c").collect()} == {0: [1.0, 0.0], 1: [0.0, 4.0]}
    centroids = vectors.cluster_centroids(df, "v", "c")
    assert {r.cluster: r.n for r in vectors.lloyd_step(df, "v", centroids).collect()} == {0: 2, 1: 2}
    assert vectors.inertia(df, "v", "c", centroids).first()[0] == 0
    assert {r.silhouette for r in vectors.squared_silhouettes(df, "v", "c", "id").collect()} == {1.0}
    assert vectors.train_kmeans(df, "v").getK() == 2 and vectors.squared_silhouette(df, "v", "c") is not None


def test_lloyd_from_fixed_seeds(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.3, size=(40, 4)) for m in (0, 3, 6)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    far = spark.createDataFrame([(0, [0.0] * 4), (1, [6.0] * 4), (2, [99.0] * 4)], "cluster int, centroid array<double>")
    made = {r.cluster: r.centroid for r in vectors.train_lloyd(df, "v", "id", 3, seeds=far).collect()}
    assert made[2] == [99.0] * 4 and np.allclose(made[0], x[:80].mean(axis=0), atol=2) and len(made) == 3
    one, two = (sorted(map(tuple, vectors.train_lloyd(df.repartition(n), "v", "id", 3, rounds=50).selectExpr("cluster", "transform(centroid, c -> round(c, 9))").collect())) for n in (1, 4))
    assert one == two


def test_only_wanted_clusters_are_read(spark, tmp_path):
    rng = np.random.default_rng(6)
    jobs_ = spark.createDataFrame([(i, (np.eye(8)[i % 8] + rng.normal(0, 0.05, 8)).tolist(), i % 8) for i in range(400)], "job_id long, vector array<double>, cluster_id int")
    tables.write_clustered(jobs_, str(tmp_path / "served"))
    served = spark.read.parquet(str(tmp_path / "served"))
    centroids = vectors.cluster_centroids(jobs_, "vector", "cluster_id")
    q = spark.createDataFrame([("q", np.eye(8)[2].tolist()), ("r", (np.eye(8)[2] + np.eye(8)[3] / 10).tolist())], "query_id string, vector array<double>")
    args = dict(query_id="query_id", query_vector="vector", posting_id="job_id", posting_vector="vector")
    out = vectors.recommend_served(q, served, centroids, **args)
    plain = vectors.recommend(q, jobs_, centroids, posting_cluster="cluster_id", **args)
    rows = lambda df: sorted((r.query_id, r.rank, r.job_id, r.score) for r in df.collect())
    assert rows(out) == rows(plain) and len(rows(out)) == 20
    assert "dynamicpruningexpression" in out._jdf.queryExecution().toString()
    # files of the other clusters may be gone: nothing reads them
    for k in (0, 1, 3, 4, 5, 6, 7):
        for name in os.listdir(tmp_path / f"served/cluster_id={k}"):
            os.truncate(tmp_path / f"served/cluster_id={k}/{name}", 0)
    assert rows(vectors.recommend_served(q, served, centroids, **args)) == rows(plain)


def test_runs_without_manifest_are_not_seen(spark, tmp_path):
    root = str(tmp_path / "model")
    assert tables.committed_runs(spark, root).collect() == []
    with pytest.raises(FileNotFoundError):
        tables.load_run(spark, root)
    df = spark.range(5)
    tables.save_run(spark, root, "r1", {"a": df, "b": df.limit(2)})
    df.write.parquet(f"{root}/a/run_id=r2")
    held = tables.load_run(spark, root)
    assert held["a"].count() == 5 and held["b"].count() == 2
    tables.save_run(spark, root, "r2", {"a": df.limit(1)})
    assert tables.load_run(spark, root)["a"].count() == 1 and tables.load_run(spark, root, "r1")["a"].count() == 5
    assert sorted((r.run_id, r.artifact, r.rows) for r in tables.committed_runs(spark, root).collect()) == [("r1", "a", 5), ("r1", "b", 2), ("r2", "a", 1)]


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_axes_of_largest_variance(spark, shift):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6)) * [5, 1, 3, 0.5, 0.2, 0.1] @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + shift
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "id long, v array<double>").repartition(5)
    got = np.array([r.projection for r in vectors.project_pca(df, "v").orderBy("id").collect()])
    values, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    assert np.allclose(got, (x - x.mean(axis=0)) @ axes, atol=1e-4)
    with pytest.raises(ValueError):
        vectors.project_pca(df.filter("v IS NULL"), "v")


def test_positions_follow_the_order(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 7 = 0, null, id % 50) AS c").repartition(6)
    got = ranking.with_positions(ranking.newest_first(df, "c", "id")).orderBy("position").collect()
    plain = sorted(((None if i % 7 == 0 else i % 50), i) for i in range(1000) if i % 7) if False else sorted(range(1000), key=lambda i: (i % 7 == 0, -(i % 50) if i % 7 else 0, i))
    assert [r.id for r in got] == plain and [r.position for r in got] == list(range(1, 1001))


# ------------------------------------------------------------------ streams


def arrivals(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_entries_expire_and_state_is_bounded(spark, tmp_path):
    shape = "k string, ts timestamp, n long, entry string"
    import datetime as dt

    at = lambda h: dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)
    batches = [
        [("a", at(0), 1, '{"v": 1}'), ("b", at(1), 2, "{broken"), ("b", at(0), 3, '{"v": 0}')],
        [("a", at(5), 4, '{"v": 2}'), ("c", at(6), 5, "[1]"), ("a", at(4), 6, '{"v": 9}')],
        [("d", at(30), 7, '{"v": 3}')],
        [("d", at(31), 8, None)],
    ]
    stream = arrivals(spark, tmp_path / "in", batches, shape)
    changed = stateful.latest_entries(stream, "k", "ts", "entry", "n", lifetime="10 hours", delay="1 hour")
    query = jobs.update_parquet(changed, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert query.exception() is None
    newest = {r.k: (r.entry, r.expired) for r in jobs.newest_values(spark.read.parquet(str(tmp_path / "out")), ["k"]).collect()}
    assert newest == {"a": ("{}", True), "b": ("{}", True), "c": ("{}", True), "d": ("{}", False)}
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(kept) <= 12 and kept[-1] < max(kept)
    log = [(r.k, r.entry) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch_id").collect() if not r.expired and r.k in ("a", "b")]
    assert sorted(log) == [("a", '{"v": 1}'), ("a", '{"v": 2}'), ("b", "{}")]


def test_rows_in_are_first_repeat_and_late(spark, tmp_path):
    import datetime as dt

    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 5)), dt.datetime(2025, 1, 1) + dt.timedelta(minutes=int(rng.integers(0, 3000))), i) for i in range(300)]
    stream = arrivals(spark, tmp_path / "in", [rows[:100], rows[100:200], rows[200:]], "k int, ts timestamp, n long")
    kinds = stateful.kinds_of_rows(stream, ["k"], "ts", "n", delay="2 hours")
    query = stateful.split_late(kinds, *(str(tmp_path / x) for x in ("first", "late", "counts", "cp")))
    query.awaitTermination()
    assert query.exception() is None
    newest, expected = {}, {"first": [], "late": [], "repeat": []}
    for part in (rows[:100], rows[100:200], rows[200:]):
        for k, ts, n in sorted(part, key=lambda r: (r[1], r[2])):
            gap = None if k not in newest else (ts - newest[k]).total_seconds()
            expected["first" if gap is None or gap > 7200 else "late" if gap < -7200 else "repeat"].append(n)
            newest[k] = max(ts, newest.get(k, ts))
    got = {kind: sorted(r.n for r in spark.read.parquet(str(tmp_path / kind)).collect()) for kind in ("first", "late")}
    assert got == {kind: sorted(expected[kind]) for kind in ("first", "late")} and all(expected.values())
    counts = {r.kind: r.n for r in spark.read.json(str(tmp_path / "counts")).groupBy("kind").agg(F.sum("count").alias("n")).collect()}
    assert counts == {k: len(v) for k, v in expected.items()} and sum(counts.values()) == 300


# ------------------------------------------------------------------ the package on the workers' path


def test_queries_start_from_any_folder(tmp_path):
    code = (
        "import sys; sys.path.insert(0, {!r})\nimport __spark_entry__ as e\nfrom vacantia.session import get_session\n"
        "s = get_session('local[2]', **{{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'}})\n"
        "print('rows', e.queries()['tech_cv_gate'](s, '/root/testdata/sf0.001').count())"
    ).format(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in run.stdout, run.stderr[-2000:]
