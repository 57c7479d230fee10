"""Queries on embeddings, clusters, similarity and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.labels import half_even_percent
from vacantia.functions.vectors import squared_distance, squared_norm
from vacantia.operators import rows, selection, vectors
from vacantia.plans.registry import ORACLES, Tables, query
from vacantia.session import materialize, scratch_path
from vacantia.sources import tables

CENTROIDS_SQL = """
  parts AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  means AS (SELECT label, i, avg(x) AS m FROM parts GROUP BY label, i),
  centroids AS (SELECT label AS cluster, list(m ORDER BY i) AS centroid FROM means GROUP BY label)"""

NEAREST_SQL = """
  nearest AS (SELECT vec_id, embedding, label, cluster_id, d FROM (
    SELECT e.*, c.cluster AS cluster_id, round(list_distance(e.embedding::DOUBLE[], c.centroid), 6) AS d,
      row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], c.centroid), 6), c.cluster) AS rn
    FROM embeddings e, centroids c) WHERE rn = 1)"""

# One query per label: the member farthest from its own centroid.
OUTLIERS_SQL = """
  outliers AS (SELECT vec_id AS query_id, embedding AS vector FROM (
    SELECT e.*, row_number() OVER (PARTITION BY label
      ORDER BY round(list_distance(e.embedding::DOUBLE[], c.centroid), 6) DESC, e.vec_id) AS rn
    FROM embeddings e JOIN centroids c ON e.label = c.cluster) WHERE rn = 1)"""

COSINE_SQL = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


def centroids_of(t: Tables) -> DataFrame:
    """One row per label, computed once."""
    return materialize(vectors.cluster_centroids(t.embeddings, "embedding", "label"), "centroids")


def outliers_of(t: Tables, centroids: DataFrame) -> DataFrame:
    """One row per label, computed once; only ids are aggregated, vectors are then read by key."""
    own = t.embeddings.join(centroids, F.col("label") == F.col("cluster"))
    distance = F.round(squared_distance(F.col("embedding"), F.col("centroid")) ** 0.5, 6)
    farthest = own.groupBy("label").agg(F.max_by("vec_id", F.struct(distance, -F.col("vec_id"))).alias("query_id"))
    picked = t.embeddings.join(farthest.select("query_id"), F.col("vec_id") == F.col("query_id"))
    return materialize(picked.select("query_id", F.col("embedding").alias("vector")), "queries")


@query(
    f"WITH {CENTROIDS_SQL} SELECT label, (i - 1)::INTEGER AS pos, round(m, 6) AS value FROM means"
)
def cluster_centroids(t: Tables) -> DataFrame:
    c = vectors.cluster_centroids(t.embeddings, "embedding", "label")
    flat = c.select(F.col("cluster").alias("label"), F.posexplode("centroid").alias("pos", "value"))
    return flat.withColumn("value", F.round("value", 6))


@query(f"WITH {CENTROIDS_SQL}, {NEAREST_SQL} SELECT vec_id, cluster_id, d AS distance FROM nearest")
def assign_nearest(t: Tables) -> DataFrame:
    placed = vectors.assign_nearest(t.embeddings, "embedding", centroids_of(t), distance="distance")
    return placed.select("vec_id", "cluster_id", "distance")


@query(
    f"""WITH {CENTROIDS_SQL}, {OUTLIERS_SQL},
    placed AS (SELECT query_id, vector, cluster FROM (SELECT o.*, c.cluster, row_number() OVER (PARTITION BY query_id
        ORDER BY round(list_distance(o.vector::DOUBLE[], c.centroid), 6), c.cluster) AS rn FROM outliers o, centroids c)
        WHERE rn = 1),
    scored AS (SELECT p.query_id, e.vec_id, p.cluster, {COSINE_SQL.format(a='p.vector', b='e.embedding')} AS score
        FROM placed p JOIN embeddings e ON e.label = p.cluster)
    SELECT query_id, vec_id, cluster AS cluster_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 10"""
)
def recommend_in_cluster(t: Tables) -> DataFrame:
    centroids = centroids_of(t)
    return vectors.recommend(
        outliers_of(t, centroids),
        t.embeddings,
        centroids,
        query_id="query_id",
        query_vector="vector",
        posting_id="vec_id",
        posting_vector="embedding",
        posting_cluster="label",
    )


SEEDS_SQL = """seeds AS (SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS cluster, embedding::DOUBLE[] AS centroid
      FROM embeddings QUALIFY cluster < {k})"""


def _round_sql(n: int) -> str:
    """Centroids after the nth Lloyd round, from those of the one before."""
    before = "seeds" if n == 1 else f"c{n - 1}"
    return f"""
  near{n} AS (SELECT vec_id, embedding, cluster FROM (SELECT e.vec_id, e.embedding, c.cluster, row_number() OVER (PARTITION BY e.vec_id
      ORDER BY round(list_distance(e.embedding::DOUBLE[], c.centroid), 6), c.cluster) AS rn FROM embeddings e, {before} c) WHERE rn = 1),
  flat{n} AS (SELECT cluster, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM near{n}),
  mean{n} AS (SELECT cluster, list(m ORDER BY i) AS centroid FROM (SELECT cluster, i, avg(x) AS m FROM flat{n} GROUP BY ALL) GROUP BY cluster),
  c{n} AS (SELECT b.cluster, coalesce(m.centroid, b.centroid) AS centroid FROM {before} b LEFT JOIN mean{n} m USING (cluster))"""


def lloyd_sql(k: int, rounds: int) -> str:
    return ",".join([SEEDS_SQL.format(k=k), *[_round_sql(n) for n in range(1, rounds + 1)]])


@query(
    f"WITH {lloyd_sql(6, 4)} SELECT cluster::INTEGER AS cluster, (i - 1)::INTEGER AS pos, round(x, 6) AS value"
    " FROM (SELECT cluster, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS i FROM c4)"
)
def train_lloyd(t: Tables) -> DataFrame:
    """Centroids of six clusters after four rounds from fixed seeds."""
    c = vectors.train_lloyd(t.embeddings, "embedding", "vec_id", 6, rounds=4, tolerance=0.0)
    return c.select("cluster", F.posexplode("centroid").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(
    f"""WITH {lloyd_sql(6, 3)} SELECT vec_id, cluster::INTEGER AS cluster_id, '20250102_000000' AS run_id, 6 AS n_clusters
    FROM (SELECT e.vec_id, c.cluster, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], c.centroid), 6), c.cluster) AS rn
      FROM embeddings e, c3 c) WHERE rn = 1"""
)
def model_run(t: Tables) -> DataFrame:
    """Two complete runs and a half-written one are saved; rows are placed with the latest complete model."""
    root = scratch_path(t.spark, "model-runs")
    for day, rounds in ((1, 1), (2, 3)):
        model = vectors.train_lloyd(t.embeddings, "embedding", "vec_id", 6, rounds=rounds, tolerance=0.0)
        placed = vectors.assign_nearest(t.embeddings, "embedding", model)
        sizes = placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
        run = f"2025010{day}_000000"
        tables.save_run(t.spark, root, run, {"job_clusters": placed.select("vec_id", "cluster_id"), "models": model, "metrics": sizes})
    model.limit(1).write.parquet(f"{root}/models/run_id=20250103_000000")  # no manifest: not a run
    held = tables.load_run(t.spark, root)
    latest = tables.committed_runs(t.spark, root).agg(F.max("run_id")).first()[0]
    placed = vectors.assign_nearest(t.embeddings, "embedding", held["models"])
    return placed.select("vec_id", "cluster_id", F.lit(latest).alias("run_id"), F.lit(held["models"].count()).cast("int").alias("n_clusters"))


@query(
    """WITH c AS (SELECT vec_id AS cluster, embedding::DOUBLE[] AS centroid FROM embeddings WHERE vec_id % 2 = 1)
    SELECT vec_id, cluster_id, d AS distance FROM (SELECT e.vec_id, c.cluster AS cluster_id, round(list_distance(e.embedding::DOUBLE[], c.centroid), 6) AS d,
      row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], c.centroid), 6), c.cluster) AS rn FROM embeddings e, c) WHERE rn = 1"""
)
def assign_nearest_of_many(t: Tables) -> DataFrame:
    """Every second vector is a centroid: more than are sent to a task, so tiles of them meet tiles of rows."""
    c = t.embeddings.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("cluster"), F.col("embedding").alias("centroid"))
    placed = vectors.assign_nearest(t.embeddings, "embedding", c, distance="distance", max_broadcast=64)
    return placed.select("vec_id", "cluster_id", "distance")


@query(ORACLES["recommend_in_cluster"])
def recommend_served(t: Tables) -> DataFrame:
    """The same from a table laid out by cluster, of which only the wanted partitions are read."""
    centroids = centroids_of(t)
    path = scratch_path(t.spark, "served")
    tables.write_clustered(t.embeddings.withColumnRenamed("label", "cluster_id"), path)
    return vectors.recommend_served(
        outliers_of(t, centroids), t.spark.read.parquet(path), centroids, query_id="query_id", query_vector="vector",
        posting_id="vec_id", posting_vector="embedding",
    )


SEMANTIC_SQL = f"""
  scored AS (SELECT o.query_id, e.vec_id, {COSINE_SQL.format(a='o.vector', b='e.embedding')} AS score FROM outliers o, embeddings e),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)"""


@query(
    f"""WITH {CENTROIDS_SQL}, {OUTLIERS_SQL}, {SEMANTIC_SQL}
    SELECT r.query_id, r.vec_id, r.score, r.rank, 100::BIGINT AS total_results,
      CAST(round_even(r.score * 100, 0) AS INTEGER) AS match_score, e.label
    FROM ranked r JOIN embeddings e USING (vec_id) WHERE r.rank BETWEEN 11 AND 20"""
)
def semantic_search_page(t: Tables) -> DataFrame:
    """Second page of the 100 best per query, with the label joined by key."""
    queries = outliers_of(t, centroids_of(t))
    return vectors.semantic_search(
        queries, t.embeddings, posting_id="vec_id", posting_vector="embedding",
        metadata=t.embeddings.select("vec_id", "label"), page=2,
    )


@query(
    f"WITH {CENTROIDS_SQL}, {OUTLIERS_SQL}, {SEMANTIC_SQL} SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 100"
)
def top_by_similarity(t: Tables) -> DataFrame:
    queries = outliers_of(t, centroids_of(t))
    return vectors.rank_by_cosine(
        queries, t.embeddings, posting_id="vec_id", posting_vector="embedding", top_n=100
    )


@query(
    f"WITH {CENTROIDS_SQL} SELECT c.cluster AS query_id, e.vec_id,"
    f" {COSINE_SQL.format(a='c.centroid', b='e.embedding')} AS score FROM embeddings e, centroids c"
)
def similarity_to_centroids(t: Tables) -> DataFrame:
    scores = vectors.similarity_scores(
        centroids_of(t), t.embeddings, query_id="cluster", query_vector="centroid",
        posting_vector="embedding", keep=["vec_id"],
    )
    return scores.withColumn("score", F.round("score", 6))


@query(
    "SELECT doc_id, lang, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4)"
    " AS squared_norm FROM documents JOIN embeddings ON doc_id = vec_id"
)
def embeddings_by_key(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.embeddings, F.col("doc_id") == F.col("vec_id"))
    norm = F.round(squared_norm(F.col("embedding")), 4).alias("squared_norm")
    return joined.select("doc_id", "lang", "label", norm)


@query(
    "SELECT count(*) AS n_rows, count(*) FILTER (label <> 3) AS n_vectors, 64 AS min_dim, 64 AS max_dim,"
    " count(*) = count(*) FILTER (label <> 3) AS valid FROM embeddings"
)
def vector_check(t: Tables) -> DataFrame:
    e = t.embeddings.withColumn("embedding", F.when(F.col("label") != 3, F.col("embedding")))
    return vectors.vector_check(e, "embedding")


@query("SELECT vec_id FROM embeddings WHERE label NOT IN (3, 4)")
def usable_vectors(t: Tables) -> DataFrame:
    label = F.col("label")
    vector = F.when(label == 3, F.lit(None)).when(label == 4, F.slice("embedding", 1, 1)).otherwise(F.col("embedding"))
    return vectors.usable_vectors(t.embeddings.withColumn("embedding", vector), "embedding").select("vec_id")


@query("SELECT vec_id, label FROM embeddings WHERE label <> 5")
def clustered_rows(t: Tables) -> DataFrame:
    e = t.embeddings.withColumn("label", F.nullif("label", F.lit(5)))
    return selection.drop_missing(e, ["embedding", "label"]).select("vec_id", "label")


@query(
    f"WITH {CENTROIDS_SQL} SELECT round(sum(pow(list_distance(e.embedding::DOUBLE[], c.centroid), 2)), 4) AS inertia"
    " FROM embeddings e JOIN centroids c ON e.label = c.cluster"
)
def cluster_inertia(t: Tables) -> DataFrame:
    out = vectors.inertia(t.embeddings, "embedding", "label", centroids_of(t))
    return out.withColumn("inertia", F.round("inertia", 4))


@query(
    """WITH s AS (SELECT a.vec_id, a.label, b.label AS other, sum(pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)) AS total,
        count(*) AS n FROM embeddings a, embeddings b GROUP BY ALL),
    r AS (SELECT vec_id, label, max(total) FILTER (other = label) / nullif(max(n) FILTER (other = label) - 1, 0) AS a,
        min(total / n) FILTER (other <> label) AS b FROM s GROUP BY vec_id, label)
    SELECT label AS cluster, count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 5) AS silhouette FROM r GROUP BY label"""
)
def silhouette_by_cluster(t: Tables) -> DataFrame:
    """Mean silhouette per cluster over all rows; the SQL compares all pairs."""
    rows_ = vectors.squared_silhouettes(t.embeddings, "embedding", "label", "vec_id")
    return rows_.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("silhouette"), 5).alias("silhouette")
    )


@query(
    """WITH s AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS total,
        count(*) AS n FROM embeddings a, embeddings b GROUP BY ALL),
    r AS (SELECT vec_id, label, max(total) FILTER (other = label) / nullif(max(n) FILTER (other = label) - 1, 0) AS a,
        min(total / n) FILTER (other <> label) AS b FROM s GROUP BY vec_id, label)
    SELECT vec_id, label AS cluster, round(coalesce((b - a) / greatest(a, b), 0), 5) + 0 AS silhouette FROM r"""
)
def silhouette_by_row(t: Tables) -> DataFrame:
    """Euclidean silhouette of every row, with sums only for clusters that can be the nearest."""
    out = vectors.euclidean_silhouettes(t.embeddings, "embedding", "label", "vec_id")
    return out.select("vec_id", F.col("cluster").cast("int").alias("cluster"), (F.round("silhouette", 5) + F.lit(0.0)).alias("silhouette"))


@query(
    f"""WITH {CENTROIDS_SQL} SELECT vec_id, round(0.2 * list_cosine_similarity(e.embedding::DOUBLE[], c.centroid)
      + 0.8 * list_cosine_similarity(list_reverse(e.embedding::DOUBLE[]), c.centroid), 5) AS score
    FROM embeddings e JOIN centroids c ON e.label = c.cluster"""
)
def weighted_views(t: Tables) -> DataFrame:
    own = t.embeddings.join(centroids_of(t), F.col("label") == F.col("cluster"))
    own = own.withColumn("reversed", F.reverse("embedding"))
    score = vectors.weighted_view_score(
        (("centroid", "embedding", 0.2), ("centroid", "reversed", 0.8))
    )
    return own.select("vec_id", F.round(score, 5).alias("score"))


@query(
    f"""WITH {CENTROIDS_SQL}, {NEAREST_SQL},
    moved AS (SELECT cluster_id, count(*) AS n, sum(d * d) AS inertia FROM nearest GROUP BY cluster_id),
    coords AS (SELECT cluster_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM nearest),
    first_two AS (SELECT cluster_id, round(avg(x) FILTER (i = 1), 6) AS x1, round(avg(x) FILTER (i = 64), 6) AS x64
        FROM coords GROUP BY cluster_id)
    SELECT m.cluster_id AS cluster, m.n, round(m.inertia, 4) AS inertia, x1, x64 FROM moved m JOIN first_two USING (cluster_id)"""
)
def lloyd_step(t: Tables) -> DataFrame:
    """One KMeans iteration started from the label means."""
    step = vectors.lloyd_step(t.embeddings, "embedding", centroids_of(t))
    c = F.col("centroid")
    return step.select(
        "cluster", "n", F.round("inertia", 4).alias("inertia"), F.round(c[0], 6).alias("x1"), F.round(c[63], 6).alias("x64")
    )


@query(
    "SELECT count(*) AS n_samples, greatest(2, least(20, count(*) // 300))::INTEGER AS n_clusters,"
    " count(*) AS placed, true AS silhouette_in_range FROM embeddings"
)
def train_kmeans(t: Tables) -> DataFrame:
    """KMeans on the embeddings: size, chosen k, rows placed and the silhouette's range; train_lloyd has centroids that SQL repeats."""
    model = vectors.train_kmeans(t.embeddings, "embedding")
    placed = vectors.predict_clusters(t.embeddings, model, "embedding")
    score = vectors.squared_silhouette(placed, "embedding", "cluster_id")
    return placed.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.lit(model.getK()).alias("n_clusters"),
        F.count_if(F.col("cluster_id").between(0, model.getK() - 1)).alias("placed"),
        F.lit(score is not None and -1 <= score <= 1).alias("silhouette_in_range"),
    )


PCA_SQL = """
  flat AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  centred AS (SELECT vec_id, label, i, x - avg(x) OVER (PARTITION BY i) AS x FROM flat),
  cov AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM centred a JOIN centred b ON a.vec_id = b.vec_id GROUP BY ALL),
  m1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i)),
  p1(step, v) AS (SELECT 0, list_transform(range(len(m)), lambda k: 1.0::DOUBLE + k % 3) FROM m1
    UNION ALL SELECT step + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT step, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM p1, m1 WHERE step < 2000)),
  a1 AS (SELECT v FROM p1 WHERE step = 2000),
  m2 AS (SELECT list_transform(m, lambda r, k: list_transform(r, lambda x, l: x - e * v[k] * v[l])) AS m
    FROM (SELECT m, v, list_dot_product(list_transform(m, lambda r: list_dot_product(r, v)), v) AS e FROM m1, a1)),
  p2(step, v) AS (SELECT 0, list_transform(range(len(m)), lambda k: 1.0::DOUBLE + k % 5) FROM m2
    UNION ALL SELECT step + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT step, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM p2, m2 WHERE step < 2000)),
  axes AS (SELECT n, list_transform(v, lambda x: x * CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END) AS v
    FROM (SELECT 1 AS n, v FROM a1 UNION ALL SELECT 2, v FROM p2 WHERE step = 2000)),
  points AS (SELECT vec_id, label, list(x ORDER BY i) AS p FROM centred GROUP BY vec_id, label)"""


@query(
    f"""WITH RECURSIVE {PCA_SQL} SELECT vec_id, label, round(list_dot_product(p, (SELECT v FROM axes WHERE n = 1)), 3) + 0 AS x,
    round(list_dot_product(p, (SELECT v FROM axes WHERE n = 2)), 3) + 0 AS y FROM points"""
)
def pca_projection(t: Tables) -> DataFrame:
    """Coordinates on the two axes of largest variance; the SQL finds them by power iteration."""
    out = vectors.project_pca(t.embeddings, "embedding")
    x = lambda k: (F.round(F.col("projection")[k], 3) + F.lit(0.0))
    return out.select("vec_id", "label", x(0).alias("x"), x(1).alias("y"))


@query(
    "SELECT role, found, (SELECT count(*) FROM embeddings) AS n_rows FROM (VALUES ('vector', 'embedding_title'), ('serving', 'embedding_full'), ('cluster', 'cluster'),"
    " ('numbers', 'a,b'), ('no vector', NULL)) AS v(role, found)"
)
def detected_columns(t: Tables) -> DataFrame:
    """Columns that are found by their names and types, and rows that can be read by them."""
    e = t.embeddings.select(F.col("label").alias("cluster"), F.lit("x").alias("t"), F.col("embedding").alias("embedding_title"), F.col("embedding").alias("embedding_full"))
    numbers = t.embeddings.select(F.col("label").alias("a"), F.col("vec_id").cast("double").alias("b"))
    found = {
        "vector": (e, vectors.find_vector_column(e)), "serving": (e, vectors.find_serving_vector_column(e)), "cluster": (e, vectors.find_cluster_column(e)),
        "numbers": (vectors.feature_vectors(numbers).filter(F.size(vector_to_array("features")) == 2), ",".join(numbers.columns)),
        "no vector": (numbers, vectors.find_vector_column(numbers)),
    }
    rows = [
        frame.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(role).alias("role"), F.lit(name).cast("string").alias("found"), "n_rows") for role, (frame, name) in found.items()
    ]
    return reduce(DataFrame.unionAll, rows)


def _texts(t: Tables) -> DataFrame:
    return rows.embedding_texts(
        t.documents.select(
            F.col("doc_id").alias("job_id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("source").alias("company"),
            F.col("text").alias("description"),
            F.col("source"),
            F.col("lang").alias("category_label"),
        )
    )


PLACES_SQL = (
    "(SELECT {key}, tag, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS place, count(*) AS n FROM (SELECT {key}, tag,"
    " unnest(string_split_regex(lower(coalesce(content, '')), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {source}) WHERE w <> '' GROUP BY ALL)"
)

@query(
    f"""WITH texts AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, source AS company, text AS description, lang AS category FROM documents),
    long AS (SELECT doc_id, 'embedding_full' AS tag, description AS content FROM texts
        UNION ALL SELECT doc_id, 'embedding_title', title FROM texts
        UNION ALL SELECT doc_id, 'embedding_title_company', title || ' at ' || company FROM texts
        UNION ALL SELECT doc_id, 'embedding_category_title', category || ' ' || title FROM texts),
    places AS {PLACES_SQL.format(key='doc_id', dim=256, source='long')},
    sums AS (SELECT doc_id, tag, sum(n * (place + 1)) / sqrt(sum(n * n)) AS weighted FROM places GROUP BY doc_id, tag)
    SELECT doc_id AS job_id, 256 AS dim, {', '.join(f"coalesce(round(max(weighted) FILTER (tag = '{v}'), 6), 0) AS {v}_sum" for v in vectors.EMBEDDING_VIEWS)}
    FROM documents LEFT JOIN sums USING (doc_id) GROUP BY doc_id"""
)
def multi_view_embeddings(t: Tables) -> DataFrame:
    """Four hashed views per document; length, and the sum of unit components times their places of each."""
    out = vectors.embed_views(_texts(t), vectors.HashingEncoder(256, normalize=False))
    total = lambda v, f: F.aggregate(F.transform(v, f), F.lit(0.0), lambda a, x: a + x)
    place = lambda v: total(v, lambda x, i: x.cast("double") * (i + 1))
    sums = [
        F.coalesce(F.round(F.try_divide(place(v), F.sqrt(squared_norm(F.col(v)))), 6), F.lit(0.0)).alias(f"{v}_sum")
        for v in vectors.EMBEDDING_VIEWS
    ]
    return out.select("job_id", F.size("embedding_full").alias("dim"), *sums)


@query(
    f"""WITH asked AS (SELECT item_id AS id, 'q' AS tag, text AS content FROM benchmark WHERE regexp_matches(text, '\\S')),
    given AS (SELECT doc_id AS id, 'p' AS tag, text AS content FROM documents),
    q AS {PLACES_SQL.format(key='id', dim=512, source='asked')}, p AS {PLACES_SQL.format(key='id', dim=512, source='given')},
    qn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM q GROUP BY id), pn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM p GROUP BY id),
    dots AS (SELECT q.id AS query_id, p.id AS doc_id, sum(q.n * p.n) AS dot FROM q JOIN p USING (place) GROUP BY ALL),
    pairs AS (SELECT asked.id AS query_id, doc_id FROM asked, documents),
    scored AS (SELECT query_id, doc_id, coalesce(round(dot / (qn.norm * pn.norm), 6), 0) AS score FROM pairs
        LEFT JOIN dots USING (query_id, doc_id) LEFT JOIN qn ON qn.id = query_id LEFT JOIN pn ON pn.id = doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored)
    SELECT query_id, doc_id, score, rank, CAST(round_even(score * 100, 0) AS INTEGER) AS match_score FROM ranked WHERE rank <= 10"""
)
def search_documents_by_text(t: Tables) -> DataFrame:
    """Ten nearest documents for every benchmark text, encoded with the same encoder."""
    encoder = vectors.HashingEncoder(512, normalize=False)
    asked = selection.filter_asked(t.benchmark, "text")
    q = encoder.encode(asked, "text", "vector").select(F.col("item_id").alias("query_id"), "vector")
    p = encoder.encode(t.documents.select("doc_id", "text"), "text", "vector")
    ranked = vectors.rank_by_cosine(q, p, posting_id="doc_id", top_n=10)
    return ranked.withColumn("match_score", half_even_percent(F.col("score")))
