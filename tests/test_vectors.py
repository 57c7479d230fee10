"""Vectors: ranking against brute force, clustering properties, encoders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.operators import vectors

RNG = np.random.default_rng(7)


def frame(spark, n, dim=12, clusters=3, prefix=None):
    x = RNG.normal(size=(n, dim))
    if n > 20:
        x[3] = x[5]  # a tie
        x[4] = 0  # a zero vector
    ids = [f"{prefix}{i}" if prefix else i for i in range(n)]
    # A third of all rows and more in one cluster.
    c = [0 if i % 2 else int(i % clusters) for i in range(n)]
    kind = "string" if prefix else "long"
    df = spark.createDataFrame([(i, v.tolist(), k) for i, v, k in zip(ids, x, c)], f"id {kind}, v array<float>, c int")
    return df.repartition(4), ids, x.astype("float32").astype("float64"), np.array(c)


def brute(q, p, qc=None, pc=None, n=5):
    def unit(m):
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norms == 0, 1, norms)

    qi, qx = q
    pi, px = p
    s = np.round(unit(qx) @ unit(px).T, 6)
    out = set()
    for i in range(len(qi)):
        rows = [(-(s[i, j] + 0.0), pi[j]) for j in range(len(pi)) if qc is None or qc[i] == pc[j]]
        for rank, (score, pid) in enumerate(sorted(rows)[:n], 1):
            out.add((qi[i], pid, round(-score, 6) + 0.0, rank))
    return out


@pytest.mark.parametrize("prefix", [None, "p"])
@pytest.mark.parametrize("tile", [2048, 16])
@pytest.mark.parametrize("pruned", [False, True])
def test_rank_by_cosine(spark, prefix, tile, pruned):
    q, qi, qx, qc = frame(spark, 15)
    p, pi, px, pc = frame(spark, 120, prefix=prefix)
    columns = {"query_cluster": "c", "posting_cluster": "c"} if pruned else {}
    out = vectors.rank_by_cosine(
        q, p, query_id="id", query_vector="v", posting_id="id", posting_vector="v", top_n=5, tile_rows=tile, **columns
    )
    got = {(r["query_id"], r["id"], round(r["score"], 6) + 0.0, r["rank"]) for r in out.collect()}
    assert got == brute((qi, qx), (pi, px), *((qc, pc) if pruned else (None, None)))


def test_empty_cluster_and_default_n(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], 9)], "id long, v array<float>, c int")
    p, *_ = frame(spark, 30, dim=2)
    args = dict(query_id="id", query_vector="v", posting_id="id", posting_vector="v")
    assert vectors.rank_by_cosine(q, p, **args, query_cluster="c", posting_cluster="c").count() == 0
    assert vectors.rank_by_cosine(q, p, **args, top_n=0).count() == 10


@pytest.mark.parametrize("limit", [2048, 6])
def test_assign_nearest(spark, limit):
    p, ids, x, _ = frame(spark, 60)
    # Centroids 3 and 5 are equal.
    c = spark.createDataFrame([(i, x[i].tolist()) for i in range(6)], "cluster int, centroid array<double>")
    got = {r["id"]: r["cluster_id"] for r in vectors.assign_nearest(p, "v", c, max_broadcast=limit).collect()}
    d = np.round(np.linalg.norm(x[:, None] - x[None, :6], axis=2), 6)
    assert got == dict(zip(ids, d.argmin(axis=1).tolist()))


@pytest.mark.parametrize("limit", [2048, 9])
def test_similarity_scores(spark, limit):
    q, qi, qx, _ = frame(spark, 8)
    p, pi, px, _ = frame(spark, 40)
    out = vectors.similarity_scores(
        q, p.withColumnRenamed("id", "job"), query_id="id", query_vector="v", posting_vector="v", keep=["job"], max_broadcast=limit
    )
    got = {(r["query_id"], r["job"]): r["score"] for r in out.collect()}
    assert len(got) == len(qi) * len(pi)
    norms = np.outer(np.linalg.norm(qx, axis=1), np.linalg.norm(px, axis=1))
    expected = np.divide(qx @ px.T, norms, out=np.zeros_like(norms), where=norms > 0)
    assert all(got[a, b] == pytest.approx(expected[i, j], abs=1e-9) for i, a in enumerate(qi) for j, b in enumerate(pi))


@pytest.mark.parametrize("tile", [16, 512])
def test_silhouette(spark, tile):
    p, ids, x, c = frame(spark, 61, clusters=4)
    c = c.copy()
    out = vectors.euclidean_silhouette(p, "v", "c", "id", tile_rows=tile)
    got = {r["id"]: r["silhouette"] for r in out.collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            assert got[i] == 0
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, c == k].mean() for k in set(c.tolist()) - {c[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-6)


def test_choose_k():
    assert [vectors.choose_k(n) for n in (10, 500, 900, 6000, 16964)] == [2, 2, 3, 20, 20]


def test_kmeans_properties(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    model = vectors.train_kmeans(e, "embedding", wanted=5)
    placed = vectors.predict_clusters(e, model, "embedding")
    assert placed.count() == e.count() and "features" not in placed.columns
    assert {r[0] for r in placed.select("cluster_id").distinct().collect()} <= set(range(model.getK()))
    again = vectors.train_kmeans(e, "embedding", wanted=5)
    assert np.allclose(np.array(model.clusterCenters()), np.array(again.clusterCenters()))
    s = vectors.squared_silhouette(placed, "embedding", "cluster_id")
    assert -1 <= s <= 1


def test_silhouette_of_all_rows(spark):
    p, ids, x, c = frame(spark, 4_100, clusters=4)
    c = c.copy()
    got = {r["id"]: r["silhouette"] for r in vectors.squared_silhouettes(p, "v", "c", "id").collect()}
    assert len(got) == len(ids) > 3_000
    for i in range(0, len(x), 97):
        d = ((x[i] - x) ** 2).sum(axis=1)
        own = c == c[i]
        a = d[own].sum() / (own.sum() - 1)
        b = min(d[c == k].mean() for k in set(c.tolist()) - {c[i]})
        assert got[ids[i]] == pytest.approx((b - a) / max(a, b), abs=1e-6)
    lone = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 1), (3, None, 1)], "id int, v array<double>, c int")
    assert [r["silhouette"] for r in vectors.squared_silhouettes(lone, "v", "c", "id").collect()] == [0, 0]


def test_ranking_of_bad_rows(spark):
    q = spark.createDataFrame([("a", [1.0, 0.0]), (None, [1.0, 0.0]), ("z", None), ("n", [None, 1.0])], "query_id string, vector array<double>")
    p = spark.createDataFrame([("x", [2.0, 0.0]), (None, [1.0, 0.0]), ("y", [None, 5.0]), ("w", [0.0, 0.0])], "job_id string, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["job_id"], r["score"]) for r in vectors.rank_by_cosine(q, p).collect())
    assert got == [("a", 1, "x", 1.0), ("a", 2, "w", 0.0), ("a", 3, "y", 0.0), ("n", 1, "w", 0.0), ("n", 2, "x", 0.0), ("n", 3, "y", 0.0)]
    uneven = spark.createDataFrame([("x", [2.0]), ("y", [1.0, 2.0, 3.0])], "job_id string, vector array<double>")
    for frame_ in (uneven, uneven.limit(1)):
        with pytest.raises(Exception):
            vectors.rank_by_cosine(q, frame_).collect()
    c = p.select(F.coalesce(F.length("job_id"), F.lit(0)).alias("cluster"), F.col("vector").alias("centroid"))
    few, many = (sorted(map(str, vectors.assign_nearest(p, "vector", c, max_broadcast=n).collect())) for n in (9, 2))
    assert few == many and len(few) == 4


def test_encoders(spark):
    df = spark.createDataFrame([(1, "Data data engineer"), (2, ""), (3, None)], "id int, t string")
    out = {r["id"]: r["v"] for r in vectors.HashingEncoder(64).encode(df, "t", "v").collect()}
    assert len(out[1]) == 64 and np.linalg.norm(out[1]) == pytest.approx(1, abs=1e-6)
    # Two words with counts 2 and 1 (or one bucket for both).
    assert sorted(x for x in out[1] if x)[-1] == pytest.approx(2 / 5**0.5, abs=1e-6) or max(out[1]) == 1
    assert sum(out[2]) == 0 and sum(out[3]) == 0

    def load():
        return lambda texts: np.array([[len(t), 1.0, 0.0] for t in texts])

    plug = vectors.FunctionEncoder(load, 3, "length")
    got = {r["id"]: r["v"] for r in plug.encode(df, "t", "v").collect()}
    assert got[2] == [0, 1, 0] and np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6)


def test_column_detection(spark):
    df = spark.createDataFrame([(1, "x", [1.0], [2.0])], "cluster int, t string, embedding_title array<float>, embedding_full array<float>")
    assert vectors.find_vector_column(df) == "embedding_title"
    assert vectors.find_serving_vector_column(df) == "embedding_full"
    assert vectors.find_cluster_column(df) == "cluster"
    with pytest.raises(ValueError):
        vectors.find_cluster_column(df.drop("cluster"))
    numbers = vectors.feature_vectors(spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string"))
    assert numbers.first()["features"].toArray().tolist() == [1.0, 2.0]
    with pytest.raises(ValueError):
        vectors.feature_vectors(df.select("t"))


def test_vector_check(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<float>")
    assert not vectors.vector_check(df, "v").first()["valid"]
    assert not vectors.vector_check(df.union(spark.createDataFrame([(None,)], "v array<float>")), "v").first()["valid"]
    assert vectors.usable_vectors(df, "v").count() == 1


def test_semantic_pages(spark):
    q, *_ = frame(spark, 3)
    p, *_ = frame(spark, 40)
    p = p.withColumnRenamed("id", "job_id")
    args = dict(posting_id="job_id", posting_vector="v", query_id="id", query_vector="v", page_size=10)
    last = vectors.semantic_search(q, p, top_n=25, page=3, **args)
    assert last.count() == 15 and {r["total_results"] for r in last.collect()} == {25}
    assert vectors.semantic_search(q, p, top_n=25, page=4, **args).count() == 0
    joined = vectors.semantic_search(q, p, metadata=p.select("job_id", F.col("c").alias("label")), **args)
    assert joined.count() == 30 and "label" in joined.columns


def test_pca(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    out = vectors.project_pca(e, "embedding")
    assert out.count() == e.count() and len(out.first()["projection"]) == 2
