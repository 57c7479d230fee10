"""Embedding, clustering, similarity and ranking.

Matrix work (nearest centroid, bulk cosine) runs in Arrow batches with numpy
inside Spark tasks; only a bounded number of centroids or queries is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vacantia.functions.labels import half_even_percent
from vacantia.functions.vectors import cosine, squared_distance, squared_norm
from vacantia.operators.ranking import top_per_group
from vacantia.session import materialize

# Rows per tile of a ranking; two tiles and their scores fit a task.
TILE_ROWS = 4_096
# Centroids, clusters or queries that are sent to every task; more meet the rows tile by tile.
# 2 048 vectors of 768 doubles are 12.6 MB.
MAX_BROADCAST_ROWS = 2_048


# Doubles in a tile of vectors that meets another one; a task holds two tiles and a block of distances.
TILE_BYTES = 16 << 20
# Rows that are compared with a tile at once.
BLOCK_ROWS = 128
# A smaller side is cut into this many tiles if they are not tiny, so that all cores have work.
MIN_TILES, MIN_TILE_ROWS = 8, 512


def tiles_for(rows: Column, dim: int) -> Column:
    """Number of tiles of a side: few, as each one is sent to every tile of the other side, but of bounded size."""
    size = F.greatest(F.lit(1), F.least(F.lit(max(1, TILE_BYTES // (8 * max(dim, 1)))), F.greatest(F.lit(MIN_TILE_ROWS), F.ceil(rows / MIN_TILES))))
    return F.greatest(F.lit(1), F.ceil(rows / size)).cast("long")


def tile_pairs(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType,
    dim: int | None = None, left_rows: int = TILE_ROWS, right_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Every tile of the left table meets every tile of the right one, in a task of bounded size.

    Tiles follow from the keys' hashes, so a retried task gets the same rows. With `dim`, the
    length of the vectors, tiles are as large as memory allows and each side is sent few times.
    """
    if dim is None:
        n, m = (max(1, -(-frame.count() // size)) for frame, size in ((left, left_rows), (right, right_rows)))
    else:
        n, m = (frame.agg(tiles_for(F.count(F.lit(1)), dim)).first()[0] for frame in (left, right))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    a = left.withColumn("_lt", F.pmod(F.xxhash64(left_key), F.lit(n))).withColumn("_rt", every(m))
    b = right.withColumn("_rt", F.pmod(F.xxhash64(right_key), F.lit(m))).withColumn("_lt", every(n))
    return a.groupBy("_lt", "_rt").cogroup(b.groupBy("_lt", "_rt")).applyInArrow(compare, schema)


# --------------------------------------------------------------------------- encoders


class HashingEncoder:
    """Bag-of-words encoder: lower-cased tokens, hashed counts, unit length.

    A token's place is the first 32 bits of its MD5 modulo `dim`, which any SQL engine repeats.
    `normalize=False` leaves the counts, which are exact. All texts of a row are encoded in one
    Arrow pass; a worker hashes each distinct token once and remembers up to `known` of them.
    """

    def __init__(self, dim: int = 768, pattern: str = r"[^\p{L}\p{N}]+", normalize: bool = True, known: int = 1 << 17):
        self.dim, self.pattern, self.normalize, self.known = dim, pattern, normalize, known
        self.name = f"hashing-{dim}"

    def encode(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return self.encode_many(df, {out: text})

    def encode_many(self, df: DataFrame, texts: dict[str, str]) -> DataFrame:
        """A vector column for each text column, named by the keys."""
        kind = T.ArrayType(T.FloatType())
        shape = T.StructType([T.StructField(out, kind) for out in texts])
        places = _Places(self.dim, self.pattern, self.normalize, self.known)

        @F.arrow_udf(shape)
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for columns in batches:
                made = [places.vectors(c) for c in (columns if isinstance(columns, tuple) else (columns,))]
                yield pa.StructArray.from_arrays(made, names=list(texts))

        lowered = [F.lower(F.coalesce(F.col(text), F.lit(""))) for text in texts.values()]
        found = df.withColumn("_vectors", run(*lowered))
        return found.withColumns({out: F.col("_vectors").getField(out) for out in texts}).drop("_vectors")


class _Places:
    """Counts of hashed tokens; tokens that were seen keep their place."""

    def __init__(self, dim: int, pattern: str, normalize: bool, known: int):
        self.dim, self.pattern, self.normalize, self.known = dim, pattern, normalize, known
        self.seen: dict[str, int] = {}

    def _place(self, word: str) -> int:
        return int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:4], "big") % self.dim

    def vectors(self, column: pa.Array, at_once: int = 1_024, at_once_bytes: int = 1 << 20) -> pa.Array:
        """Of some texts at a time, by number and size; a longer text is taken alone."""
        flat = np.empty((len(column), self.dim), "float32")
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(column):
            before = ends[start - 1] if start else 0
            stop = min(max(int(np.searchsorted(ends, before + at_once_bytes, "right")), start + 1), start + at_once, len(column))
            flat[start:stop] = self._counts(column.slice(start, stop - start))
            start = stop
        pa.default_memory_pool().release_unused()
        offsets = np.arange(len(column) + 1, dtype="int32") * self.dim
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))

    def _counts(self, column: pa.Array) -> np.ndarray:
        words = pc.split_pattern_regex(column, self.pattern)
        row = pc.list_parent_indices(words).to_numpy()
        coded = pc.list_flatten(words).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.seen) + len(names) > self.known:
            self.seen.clear()
        for name in names:
            if name not in self.seen:
                self.seen[name] = self._place(name) if name else -1
        place = np.array([self.seen[n] for n in names], np.int64)[coded.indices.to_numpy()] if names else np.empty(0, np.int64)
        real = place >= 0
        counts = np.bincount(row[real] * self.dim + place[real], minlength=len(column) * self.dim).reshape(len(column), self.dim)
        return _unit_rows(counts.astype("float64")) if self.normalize else counts


class FunctionEncoder:
    """Encoder plug-in: `load()` returns encode(list of texts) -> array of shape (n, dim).

    The model is loaded once per Python worker and fed one Arrow batch at a
    time (spark.sql.execution.arrow.maxRecordsPerBatch).
    """

    def __init__(
        self,
        load: Callable[[], Callable[[list[str]], np.ndarray]],
        dim: int,
        name: str,
        normalize: bool = True,
    ):
        self.load, self.dim, self.name, self.normalize = load, dim, name, normalize

    def encode(self, df: DataFrame, text: str, out: str) -> DataFrame:
        load, normalize = self.load, self.normalize

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                vectors = np.asarray(model(texts.fillna("").tolist()), dtype="float32")
                if normalize:
                    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                    vectors = vectors / np.where(norms == 0, 1, norms)
                yield pd.Series(list(vectors))

        return df.withColumn(out, run(F.col(text)))


EMBEDDING_VIEWS = {
    "embedding_full": "text_full",
    "embedding_title": "text_title",
    "embedding_title_company": "text_title_company",
    "embedding_category_title": "text_category_title",
}
EMBEDDING_METADATA = (
    "job_id", "title", "company", "source", "location_display", "location_country",
    "category_label", "salary_min", "salary_max", "created_date", "redirect_url",
)


def embed_views(texts: DataFrame, encoder) -> DataFrame:
    """Metadata columns plus one vector per text view, in one pass over the postings."""
    if hasattr(encoder, "encode_many"):
        texts = encoder.encode_many(texts, EMBEDDING_VIEWS)
    else:
        for out, text in EMBEDDING_VIEWS.items():
            texts = encoder.encode(texts, text, out)
    metadata = [
        F.col(c) if c in texts.columns else F.lit(None).cast("string").alias(c)
        for c in EMBEDDING_METADATA
    ]
    return texts.select(*metadata, *EMBEDDING_VIEWS)


# --------------------------------------------------------------------------- schema inspection


def find_vector_column(
    df: DataFrame, preferred: Sequence[str] = ("embedding", "embeddings", "vector")
) -> str | None:
    """Preferred array column if present, else the first numeric array column."""
    numeric = (T.NumericType,)
    arrays = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, numeric)
    ]
    for name in preferred:
        if name in arrays:
            return name
    return arrays[0] if arrays else None


def find_serving_vector_column(df: DataFrame) -> str:
    found = find_vector_column(df, ("embedding_full", "embedding"))
    if found is None:
        raise ValueError("no vector column: expected embedding_full, embedding or an array of numbers")
    return found


def find_column(df: DataFrame, candidates: Sequence[str]) -> str:
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(candidates)} is among the columns {df.columns}")


def find_cluster_column(df: DataFrame) -> str:
    return find_column(df, ("cluster_id", "cluster"))


def feature_vectors(df: DataFrame, out: str = "features") -> DataFrame:
    """Vector column from the detected embedding column, or from all numeric columns."""
    name = find_vector_column(df)
    if name is not None:
        return df.withColumn(out, array_to_vector(F.col(name)))
    numeric = [c for c, k in df.dtypes if k in ("float", "double", "int", "bigint")]
    if not numeric:
        raise ValueError("no embedding column and no numeric columns")
    return VectorAssembler(inputCols=numeric, outputCol=out, handleInvalid="skip").transform(df)


def vector_check(df: DataFrame, vector: str) -> DataFrame:
    """Row and vector counts and the range of lengths; `valid` when every row has one length."""
    size = F.size(vector)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(vector).alias("n_vectors"),
        F.min(F.when(F.col(vector).isNotNull(), size)).alias("min_dim"),
        F.max(F.when(F.col(vector).isNotNull(), size)).alias("max_dim"),
    ).withColumn(
        "valid",
        (F.col("n_rows") == F.col("n_vectors"))
        & F.coalesce(F.col("min_dim") == F.col("max_dim"), F.lit(True)),
    )


def usable_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a real vector: not null and longer than the one-element placeholder."""
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 1))


# --------------------------------------------------------------------------- clustering


def filled(vector: str) -> Column:
    """The vector with zero for each null element, as all clustering operators read it."""
    return F.transform(F.col(vector), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))


def dense(vector: str) -> Column:
    return array_to_vector(filled(vector))


def choose_k(n_rows: int, wanted: int = 20, rows_per_cluster: int = 300) -> int:
    return max(2, min(wanted, max(2, n_rows // rows_per_cluster)))


def train_kmeans(df: DataFrame, vector: str, wanted: int = 20, seed: int = 42) -> KMeansModel:
    """KMeans on unit or raw vectors; centroids are the only data that leaves the executors."""
    features = df.filter(F.col(vector).isNotNull()).select(dense(vector).alias("features"))
    k = choose_k(features.count(), wanted)
    return KMeans(k=k, seed=seed, initMode="k-means||", featuresCol="features").fit(features)


def seed_centroids(df: DataFrame, vector: str, identifier: str, k: int) -> DataFrame:
    """(cluster, centroid): the k rows whose id has the least MD5, numbered in that order."""
    rows = df.filter(F.col(vector).isNotNull()).select(F.md5(F.col(identifier).cast("string")).alias("_md5"), F.col(identifier).alias("_id"), filled(vector).alias("centroid"))
    first = rows.orderBy("_md5", "_id").limit(k)  # k is the number of clusters
    order = W.orderBy("_md5", "_id")
    return first.select((F.row_number().over(order) - 1).alias("cluster"), "centroid")


def train_lloyd(
    df: DataFrame, vector: str, identifier: str, k: int, rounds: int = 20, tolerance: float = 1e-4, seeds: DataFrame | None = None
) -> DataFrame:
    """(cluster, centroid) of KMeans that any engine can repeat: fixed seeds, Lloyd rounds, a stop test.

    A round takes every row to its nearest centroid (equal distances to 6 decimals: the lower
    cluster) and makes new means; a cluster without rows keeps its centroid. It ends after
    `rounds`, or when no centroid has moved by more than `tolerance`. Each round's k centroids are
    written, so lineage does not grow; rows are never moved.
    """
    now = materialize(seeds if seeds is not None else seed_centroids(df, vector, identifier, k), "centroids")
    for _ in range(rounds):
        moved = lloyd_step(df, vector, now).select("cluster", F.col("centroid").alias("_new"))
        both = now.join(moved, "cluster", "left").select("cluster", F.col("centroid").alias("_old"), F.coalesce("_new", "centroid").alias("centroid"))
        both = materialize(both, "centroids")
        now = both.select("cluster", "centroid")
        if both.filter(squared_distance(F.col("_old"), F.col("centroid")) > tolerance**2).isEmpty():
            break
    return now


def predict_clusters(
    df: DataFrame, model: KMeansModel, vector: str, out: str = "cluster_id"
) -> DataFrame:
    featured = df.withColumn("features", dense(vector))
    model = model.copy()
    model.setPredictionCol(out)
    return model.transform(featured).drop("features")


def cluster_centroids(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """(cluster, centroid): element-wise means with map-side partial sums."""
    return (
        df.filter(F.col(vector).isNotNull() & F.col(cluster).isNotNull())
        .groupBy(F.col(cluster).alias("cluster"))
        .agg(Summarizer.mean(dense(vector)).alias("m"))
        .select("cluster", vector_to_array("m").alias("centroid"))
    )


def assign_nearest(
    df: DataFrame,
    vector: str,
    centroids: DataFrame,
    out: str = "cluster_id",
    distance: str | None = None,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Nearest centroid by Euclidean distance; equal distances (6 decimals) take the lower id.

    Up to `max_broadcast` centroids are sent to every task, and no row moves. More are cut into
    tiles that meet tiles of rows; each row keeps the least (distance, id) of its tiles.
    Vectors of another length than the centroids' raise; a null element counts as zero.
    """
    given = centroids.select("cluster", "centroid")
    rows = given.limit(max_broadcast + 1).collect()
    if not rows:
        raise ValueError("no centroids")
    present = df.filter(F.col(vector).isNotNull())
    if len(rows) <= max_broadcast:
        found = present.withColumn("_nearest", _nearest_in(df, rows, centroids.schema["cluster"].dataType)(F.col(vector)))
    else:
        found = _nearest_of_tiles(present, vector, given)
    found = found.withColumn(out, F.col("_nearest.id"))
    if distance:
        found = found.withColumn(distance, F.col("_nearest.d"))
    return found.drop("_nearest")


def _distances(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Euclidean distances, one centroid after the other, rounded to 6 decimals."""
    d = np.empty((len(x), len(matrix)))
    for j, c in enumerate(matrix):
        d[:, j] = np.sqrt(((x - c) ** 2).sum(axis=1))
    return np.round(d, 6)


def _distance_blocks(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances to all of y) for a few rows of x at a time, by one matrix product each.

    The product loses digits where two vectors nearly agree; those distances are taken from the differences.
    """
    norms = (y**2).sum(axis=1)
    for i in range(0, len(x), BLOCK_ROWS):
        part = x[i : i + BLOCK_ROWS]
        own = (part**2).sum(axis=1)
        d = part @ y.T
        d *= -2
        d += own[:, None]
        d += norms
        close = np.flatnonzero(d < 1e-4 * (own[:, None] + own.max(initial=0)))
        step = max(1, (1 << 20) // max(y.shape[1], 1))
        for at in range(0, len(close), step):
            r, c = np.divmod(close[at : at + step], len(y))
            d[r, c] = ((part[r] - y[c]) ** 2).sum(axis=1)
        np.sqrt(np.maximum(d, 0, out=d), out=d)
        yield i, d


def _nearest_of_tiles(present: DataFrame, vector: str, centroids: DataFrame) -> DataFrame:
    """Rows with _nearest (d, id): a blocked argmin over tiles of centroids, its candidates by exact differences."""
    rows = materialize(present.withColumn("_row", F.monotonically_increasing_id()), "rows")
    kind = centroids.schema["cluster"].dataType
    result = T.StructType([T.StructField("_row", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("id", kind)])
    dim = centroids.agg(F.max(F.size("centroid"))).first()[0] or 0

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return to_arrow_schema(result).empty_table()
        ids = y.column("cluster").combine_chunks()
        order = pc.sort_indices(ids)  # the first of equal distances is the lowest id
        ids, matrix = ids.take(order), np.nan_to_num(_matrix(y.column("centroid").combine_chunks().take(order)))
        v = _matrix(x.column("v").combine_chunks(), matrix.shape[1])
        least, best = np.empty(len(v)), np.empty(len(v), np.int64)
        some = max(1, (1 << 20) // max(matrix.shape[1], 1))
        slack = 2e-6 + 1e-9 * np.sqrt(max((v**2).sum(axis=1).max(), (matrix**2).sum(axis=1).max()))  # of rounding and of the product
        for i, d in _distance_blocks(v, matrix):
            low = d.min(axis=1)
            r, c = np.nonzero(d <= low[:, None] + slack)  # all that can be the least after rounding
            exact = np.concatenate([np.round(np.sqrt(((v[i + r[k : k + some]] - matrix[c[k : k + some]]) ** 2).sum(axis=1)), 6) for k in range(0, len(r), some)])
            first = np.lexsort((c, exact, r))
            first = first[np.searchsorted(r[first], np.arange(len(d)))]
            least[i : i + len(d)], best[i : i + len(d)] = exact[first], c[first]
        return pa.table([x.column("_row"), pa.array(least), ids.take(pa.array(best))], schema=to_arrow_schema(result))

    left = rows.select("_row", filled(vector).alias("v"))
    right = centroids.select("cluster", F.col("centroid").cast("array<double>").alias("centroid"))
    parts = tile_pairs(left, right, "_row", "cluster", compare, result, dim=dim)
    least = parts.groupBy("_row").agg(F.min(F.struct("d", "id")).alias("_nearest"))
    return rows.join(least, "_row").drop("_row")


def _nearest_in(df: DataFrame, rows: list, kind: T.DataType) -> Callable[[Column], Column]:
    """Struct (d, id) of the nearest of some centroids."""
    rows = sorted(rows, key=lambda r: r["cluster"])
    ids = np.array([r["cluster"] for r in rows])
    matrix = np.nan_to_num(np.array([r["centroid"] for r in rows], dtype="float64"))
    shared = df.sparkSession.sparkContext.broadcast((ids, matrix))
    result = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("id", kind)])

    @F.arrow_udf(result)
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids, matrix = shared.value
        for column in batches:
            d = _distances(np.nan_to_num(_matrix(column, matrix.shape[1])), matrix)
            best = d.argmin(axis=1)
            yield pa.StructArray.from_arrays(
                [pa.array(d[np.arange(len(d)), best]), pa.array(ids[best])], names=["d", "id"]
            )

    return nearest


def lloyd_step(df: DataFrame, vector: str, centroids: DataFrame) -> DataFrame:
    """One KMeans iteration: rows to their nearest centroid, then new means and sizes."""
    placed = assign_nearest(df, vector, centroids, out="_placed", distance="_distance")
    return placed.groupBy(F.col("_placed").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_distance") ** 2).alias("inertia"),
        vector_to_array(Summarizer.mean(dense(vector))).alias("centroid"),
    )


def inertia(df: DataFrame, vector: str, cluster: str, centroids: DataFrame) -> DataFrame:
    """Sum of squared distances to the own centroid."""
    own = df.join(centroids, F.col(cluster) == F.col("cluster"))
    return own.agg(F.sum(squared_distance(filled(vector), F.col("centroid"))).alias("inertia"))


def squared_silhouette(df: DataFrame, vector: str, cluster: str) -> float | None:
    """Silhouette with squared Euclidean distances over all rows, linear in the rows."""
    featured = df.select(
        dense(vector).alias("features"), F.col(cluster).cast("int").alias("prediction")
    )
    n, k = featured.agg(F.count(F.lit(1)), F.count_distinct("prediction")).first()
    if n < 2 * k or k < 2:
        return None
    return ClusteringEvaluator(metricName="silhouette").evaluate(featured)


def squared_silhouettes(
    df: DataFrame, vector: str, cluster: str, identifier: str, max_clusters: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """(id, cluster, silhouette) of every row with squared Euclidean distances, in two scans.

    The mean squared distance of x to a cluster follows from the cluster's size, mean and mean
    squared norm (one row a cluster). Up to `max_clusters` of those are broadcast; more are cut
    into tiles that meet tiles of rows. A cluster of one row has 0; a null element counts as zero.
    """
    rows = df.filter(F.col(vector).isNotNull() & F.col(cluster).isNotNull())
    norm = squared_norm(filled(vector))
    stats = rows.groupBy(F.col(cluster).alias("c")).agg(
        F.count(F.lit(1)).alias("n"),
        vector_to_array(Summarizer.mean(dense(vector))).alias("mean"),
        F.avg(norm).alias("norm"),
    )
    known = sorted(stats.limit(max_clusters + 1).collect(), key=lambda r: r["c"])
    if len(known) > max_clusters:
        return _silhouettes_of_tiles(rows, stats, vector, cluster, identifier, max_clusters)
    labels = np.array([r["c"] for r in known])
    shared = df.sparkSession.sparkContext.broadcast(
        (np.array([r["mean"] for r in known]), np.array([r["norm"] for r in known]), np.array([r["n"] for r in known]))
    )

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        means, norms, sizes = shared.value
        for vectors, clusters in batches:
            x = np.nan_to_num(_matrix(vectors, means.shape[1] if len(means) else None))
            own = np.searchsorted(labels, clusters.to_numpy(zero_copy_only=False))
            each = (x**2).sum(axis=1)[:, None] + norms[None, :] - 2 * x @ means.T
            at = np.arange(len(x))
            size = sizes[own]
            a = each[at, own] * size / np.maximum(size - 1, 1)
            each[at, own] = np.inf
            b = each.min(axis=1, initial=np.inf)
            top = np.maximum(a, b)
            fine = (size > 1) & np.isfinite(top) & (top > 0)
            yield pa.array(np.where(fine, np.clip((b - a) / np.where(fine, top, 1), -1, 1), 0.0))

    return rows.select(
        F.col(identifier).alias(identifier), F.col(cluster).alias("cluster"), score(F.col(vector), F.col(cluster)).alias("silhouette")
    )


def _silhouettes_of_tiles(rows: DataFrame, stats: DataFrame, vector: str, cluster: str, identifier: str, tile: int) -> DataFrame:
    """The same by tiles: each gives a row's least mean distance to its other clusters, and that to its own."""
    stats = materialize(stats, "clusters")
    held = materialize(
        rows.select(F.monotonically_increasing_id().alias("_row"), F.col(identifier).alias("_id"), F.col(cluster).alias("_own"), filled(vector).alias("v")), "rows"
    )
    result = T.StructType([T.StructField("_row", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("a", "b"))])

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return to_arrow_schema(result).empty_table()
        v, means = _matrix(x.column("v").combine_chunks()), _matrix(y.column("mean").combine_chunks())
        norms, sizes = (y.column(n).to_numpy() for n in ("norm", "n"))
        each = (v**2).sum(axis=1)[:, None] + norms[None, :] - 2 * v @ means.T
        own = x.column("_own").to_numpy()[:, None] == y.column("c").to_numpy()[None, :]
        within = np.where(own, each * sizes / np.maximum(sizes - 1, 1), -np.inf).max(axis=1)
        single = (own & (sizes == 1)).any(axis=1)
        other = np.where(own, np.inf, each).min(axis=1)
        a = np.where(single, np.nan, within)
        return pa.table([x.column("_row"), pa.array(a), pa.array(other)], schema=to_arrow_schema(result))

    parts = tile_pairs(held.select("_row", "_own", "v"), stats, "_row", "c", compare, result, right_rows=tile)
    # a cluster of one row has a = NaN, which counts as the largest
    both = parts.groupBy("_row").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    top = F.greatest("a", "b")
    fine = ~F.isnan("a") & (top > 0) & (top < F.lit(float("inf")))
    value = F.when(fine, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col("b") - F.col("a")) / top))).otherwise(0.0)
    return held.join(both, "_row").select(F.col("_id").alias(identifier), F.col("_own").alias("cluster"), value.alias("silhouette"))


def euclidean_silhouettes(
    df: DataFrame, vector: str, cluster: str, identifier: str, max_clusters: int = MAX_BROADCAST_ROWS, tile_rows: int | None = None
) -> DataFrame:
    """(id, cluster, silhouette) of every row with Euclidean distances, summed only where they can matter.

    The mean distance of a row to a cluster is at least its distance to the cluster's mean and at
    most its root mean square distance, which follows from the cluster's size, mean and mean
    squared norm. So a row meets its own cluster and those others whose lower bound does not
    exceed the least upper bound, tile by tile in tasks of bounded size that return sums. Up to
    `max_clusters` clusters are bounded in this way; with more every row meets every cluster. A
    cluster of one row has 0; a null element counts as zero.
    """
    rows = df.filter(F.col(vector).isNotNull() & F.col(cluster).isNotNull())
    held = materialize(
        rows.select(F.monotonically_increasing_id().alias("_row"), F.col(identifier).alias("_id"), F.col(cluster).cast("long").alias("_own"), filled(vector).alias("v")), "rows"
    )
    stats = held.groupBy("_own").agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("mean"), F.avg(squared_norm(F.col("v"))).alias("norm")
    )
    known = sorted(stats.limit(max_clusters + 1).collect(), key=lambda r: r["_own"])
    shared = df.sparkSession.sparkContext.broadcast(
        (np.array([r["_own"] for r in known]), np.array([r["mean"] for r in known]), np.array([r["norm"] for r in known])) if len(known) <= max_clusters else None
    )

    @F.arrow_udf("array<long>")
    def near(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        labels, means, norms = shared.value
        for vectors, clusters in batches:
            x = _matrix(vectors, means.shape[1])
            squares = (x**2).sum(axis=1)[:, None] - 2 * x @ means.T
            low = np.sqrt(np.clip(squares + (means**2).sum(axis=1), 0, None))
            high = np.sqrt(np.clip(squares + norms, 0, None))
            own = np.searchsorted(labels, clusters.to_numpy(zero_copy_only=False))
            at = np.arange(len(x))
            high[at, own] = np.inf
            wanted = low <= high.min(axis=1, initial=np.inf)[:, None] * (1 + 1e-9) + 1e-9
            wanted[at, own] = True
            lengths = wanted.sum(axis=1)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype("int32")
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(labels[np.nonzero(wanted)[1]]))

    if len(known) <= max_clusters:
        asked = held.select("_row", "_own", "v", F.explode(near(F.col("v"), F.col("_own"))).alias("c"))
    else:
        labels = stats.agg(F.collect_list("_own").alias("every")).scalar()
        asked = held.select("_row", "_own", "v", F.explode(labels).alias("c"))
    asked = materialize(asked, "asked")
    members = held.select(F.col("_own").alias("c"), "_row", "v")

    def tiles(frame: DataFrame, out: str) -> DataFrame:
        n = F.count(F.lit(1))
        return frame.groupBy("c").agg((F.ceil(n / tile_rows).cast("long") if tile_rows else tiles_for(n, dim)).alias(out))

    dim = max((len(r["mean"]) for r in known), default=0)
    sizes = tiles(members, "p_tiles").join(tiles(asked, "q_tiles"), "c")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    q = asked.join(sizes, "c").select("_row", "v", "c", F.pmod(F.xxhash64("_row"), F.col("q_tiles")).alias("qt"), every("p_tiles").alias("pt"))
    p = members.join(sizes, "c").select("v", "c", F.pmod(F.xxhash64("_row"), F.col("p_tiles")).alias("pt"), every("q_tiles").alias("qt"))
    shape = T.StructType([T.StructField("_row", T.LongType()), T.StructField("c", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])

    def sums(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return to_arrow_schema(shape).empty_table()
        a, b = _matrix(x.column("v").combine_chunks()), _matrix(y.column("v").combine_chunks())
        total = np.empty(len(a))
        for i, d in _distance_blocks(a, b):
            total[i : i + len(d)] = d.sum(axis=1)
        return pa.table([x.column("_row"), x.column("c"), pa.array(total), pa.array(np.full(len(a), len(b)))], schema=to_arrow_schema(shape))

    keys = ["c", "qt", "pt"]
    parts = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(sums, shape)
    means = parts.groupBy("_row", "c").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).join(held.select("_row", "_id", "_own"), "_row")
    own = F.col("c") == F.col("_own")
    each = means.groupBy("_row", "_id", "_own").agg(
        F.max(F.when(own, F.col("total"))).alias("own_total"), F.max(F.when(own, F.col("n"))).alias("own_n"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b")
    )
    a = F.try_divide(F.col("own_total"), F.col("own_n") - 1)
    value = F.when(F.col("own_n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - a, F.greatest(F.col("b"), a)), F.lit(0.0)))
    return each.select(F.col("_id").alias(identifier), F.col("_own").alias("cluster"), value.alias("silhouette"))


def euclidean_silhouette(
    df: DataFrame, vector: str, cluster: str, identifier: str, tile_rows: int = 512
) -> DataFrame:
    """Exact Euclidean silhouette per row: (id, cluster, silhouette).

    Quadratic by definition and for small tables only; squared_silhouettes is the one for all
    rows. The table is read for its size and for both sides. Rows are hashed
    into tiles of about `tile_rows`; a task compares one tile with another and
    returns distance sums per row and cluster, never pairs.
    """
    rows = df.filter(F.col(vector).isNotNull() & F.col(cluster).isNotNull()).select(
        F.col(identifier).alias("id"),
        F.col(cluster).cast("long").alias("c"),
        filled(vector).alias("v"),
    )
    tiles = max(1, -(-rows.count() // tile_rows))
    numbered = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))
    left = numbered.select("id", "c", "v", F.col("tile").alias("a"), every.alias("b"))
    right = numbered.select("c", "v", every.alias("a"), F.col("tile").alias("b"))
    id_type = rows.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("c", T.LongType()),
            T.StructField("other", T.LongType()),
            T.StructField("total", T.DoubleType()),
            T.StructField("n", T.LongType()),
        ]
    )

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame(columns=schema.names)
        a, b = np.stack(x["v"].to_numpy()), np.stack(y["v"].to_numpy())
        sq = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T
        d = np.sqrt(np.clip(sq, 0, None))
        labels, index = np.unique(y["c"].to_numpy(), return_inverse=True)
        member = np.zeros((len(b), len(labels)))
        member[np.arange(len(b)), index] = 1
        sums, counts = d @ member, member.sum(0).astype("int64")
        reps = len(labels)
        return pd.DataFrame(
            {
                "id": np.repeat(x["id"].to_numpy(), reps),
                "c": np.repeat(x["c"].to_numpy(), reps),
                "other": np.tile(labels, len(a)),
                "total": sums.ravel(),
                "n": np.tile(counts, len(a)),
            }
        )

    parts = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(compare, schema)
    sums = parts.groupBy("id", "c", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("c") == F.col("other")
    per_row = sums.groupBy("id", "c").agg(
        F.max(F.when(own, F.col("total"))).alias("own_total"),
        F.max(F.when(own, F.col("n"))).alias("own_n"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    a = F.try_divide(F.col("own_total"), F.col("own_n") - 1)
    return per_row.select(
        F.col("id").alias(identifier),
        F.col("c").alias("cluster"),
        F.when(F.col("own_n") == 1, F.lit(0.0))
        .otherwise(F.coalesce(F.try_divide(F.col("b") - a, F.greatest(F.col("b"), a)), F.lit(0.0)))
        .alias("silhouette"),
    )


def covariance(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance matrix of all vectors; what leaves the executors is a few d x d matrices.

    Each task sums its rows' outer products around the first vector it saw, so values far from
    zero lose no digits; the sums are merged in two steps. A null element counts as zero.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(filled(vector).alias("v"))
    shape = "n long, mean array<double>, scatter array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                mean = x.mean(axis=0)
                total = _merged(total, (len(x), mean, (x - mean).T @ (x - mean)))
        if total is not None:
            yield _moments(total)

    def merged(table: pa.Table) -> pa.Table:
        total = None
        for row in table.to_pylist():
            d = len(row["mean"])
            total = _merged(total, (row["n"], np.array(row["mean"]), np.array(row["scatter"]).reshape(d, d)))
        return pa.Table.from_batches([_moments(total)])

    parts = rows.mapInArrow(partial, shape).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(16)))
    few = parts.groupBy("g").applyInArrow(lambda t: merged(t.drop_columns(["g"])), shape).toArrow()  # at most 16 rows
    if not few.num_rows:
        raise ValueError("no vectors")
    row = merged(few).to_pylist()[0]
    d = len(row["mean"])
    return np.array(row["mean"]), np.array(row["scatter"]).reshape(d, d) / max(row["n"] - 1, 1)


def _merged(a: tuple | None, b: tuple) -> tuple:
    """Number, mean and scatter matrix of two sets of rows together."""
    if a is None:
        return b
    n, shift = a[0] + b[0], b[1] - a[1]
    return n, a[1] + shift * b[0] / n, a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def _moments(total: tuple) -> pa.RecordBatch:
    n, mean, scatter = total
    return pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "scatter": [scatter.ravel().tolist()]})


def principal_axes(df: DataFrame, vector: str, k: int = 2, rounds: int = 20_000, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the k axes of largest variance by orthogonal iteration; each axis's largest component is positive."""
    mean, matrix = covariance(df, vector)
    axes = np.linalg.qr(matrix @ np.eye(len(mean), k) + np.eye(len(mean), k) * 1e-9)[0]
    for _ in range(rounds):
        after = np.linalg.qr(matrix @ axes)[0]
        after = after * np.where((after * axes).sum(axis=0) < 0, -1.0, 1.0)
        moved = np.abs(after - axes).max()
        axes = after
        if moved < tolerance:
            break
    values, turned = np.linalg.eigh(axes.T @ matrix @ axes)  # the axes within their span
    axes = axes @ turned[:, np.argsort(-values, kind="stable")]
    largest = np.abs(axes).argmax(axis=0)
    return mean, axes * np.where(axes[largest, np.arange(axes.shape[1])] < 0, -1.0, 1.0)


def project_pca(df: DataFrame, vector: str, k: int = 2, out: str = "projection") -> DataFrame:
    """Rows with their centred coordinates on the k axes of largest variance; row-local after one pass for the axes."""
    mean, axes = principal_axes(df, vector, k)
    shared = df.sparkSession.sparkContext.broadcast((mean, axes))

    @F.arrow_udf("array<double>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mean, axes = shared.value
        for column in batches:
            made = (np.nan_to_num(_matrix(column, len(mean))) - mean) @ axes
            offsets = np.arange(len(made) + 1, dtype="int32") * axes.shape[1]
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.ravel()))

    return df.filter(F.col(vector).isNotNull()).withColumn(out, project(F.col(vector)))


# --------------------------------------------------------------------------- ranking


def _matrix(column: pa.Array, length: int | None = None) -> np.ndarray:
    """(n, d) doubles from an Arrow list column without nulls; rows of unequal length raise."""
    if len(column) == 0:
        return np.empty((0, length or 0))
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1 or length not in (None, int(lengths[0])):
        raise ValueError(f"vectors of lengths {lengths.tolist()}, expected {length or 'one length'}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype("float64", copy=False).reshape(len(column), -1)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1, norms)


def _best(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n best by (score desc, id asc)."""
    if len(scores) > n:
        bound = np.partition(scores, len(scores) - n)[len(scores) - n]
        keep = np.flatnonzero(scores >= bound)
    else:
        keep = np.arange(len(scores))
    order = np.lexsort((ids[keep], -scores[keep]))
    return keep[order][:n]


def rank_by_cosine(
    queries: DataFrame,
    postings: DataFrame,
    *,
    query_id: str = "query_id",
    query_vector: str = "vector",
    query_cluster: str | None = None,
    posting_id: str = "job_id",
    posting_vector: str = "vector",
    posting_cluster: str | None = None,
    top_n: int = 10,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Best top_n postings per query: (query_id, posting_id, score, rank), and cluster_id if pruned.

    With the cluster columns given, a query only meets postings of its own
    cluster. Scores are rounded to 6 decimals before ranking; ties go to the
    lower posting id. A zero vector and one with a null element score 0; rows without
    id or vector are left out; vectors of unequal length raise.

    Both sides are split into tiles within their cluster, and tile meets tile in a task of
    bounded size that returns its best top_n per query. Each side is read once.
    """
    if top_n <= 0:
        top_n = 10
    pruned = query_cluster is not None and posting_cluster is not None
    none = F.lit(0).cast("long")
    q = queries.filter(F.col(query_vector).isNotNull() & F.col(query_id).isNotNull()).select(
        F.col(query_id).alias("query_id"),
        F.col(query_vector).alias("v"),
        (F.col(query_cluster).cast("long") if pruned else none).alias("c"),
    )
    p = postings.filter(F.col(posting_vector).isNotNull() & F.col(posting_id).isNotNull()).select(
        F.col(posting_id).alias("posting_id"),
        F.col(posting_vector).alias("v"),
        (F.col(posting_cluster).cast("long") if pruned else none).alias("c"),
    )
    if pruned:
        p, q = p.filter("c IS NOT NULL"), q.filter("c IS NOT NULL")
    result = T.StructType(
        [
            T.StructField("query_id", q.schema["query_id"].dataType),
            T.StructField("posting_id", p.schema["posting_id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("cluster_id", T.LongType()),
        ]
    )
    partial = _tile_scores(q, p, result, top_n, tile_rows)
    order = [F.desc("score"), F.asc("posting_id")]
    ranked = top_per_group(partial, ["query_id"], order, top_n, rank="rank")
    ranked = ranked.withColumnRenamed("posting_id", posting_id)
    return ranked if pruned else ranked.drop("cluster_id")


def _tile_scores(
    queries: DataFrame, postings: DataFrame, result: T.StructType, n: int, tile_rows: int
) -> DataFrame:
    """Block-wise comparison: every query tile meets every posting tile of its cluster."""

    def tile_counts(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("long").alias(out))

    sizes = tile_counts(postings, "p_tiles").join(tile_counts(queries, "q_tiles"), "c")
    def all_tiles(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    # The tile follows from the id, so a retried task places rows as before.
    q = queries.join(sizes, "c").select(
        "query_id", "v", "c", F.pmod(F.xxhash64("query_id"), F.col("q_tiles")).alias("qt"),
        all_tiles("p_tiles").alias("pt"),
    )
    p = postings.join(sizes, "c").select(
        "posting_id", "v", "c", F.pmod(F.xxhash64("posting_id"), F.col("p_tiles")).alias("pt"),
        all_tiles("q_tiles").alias("qt"),
    )

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        shape = to_arrow_schema(result)
        if not x.num_rows or not y.num_rows:
            return shape.empty_table()
        a, b = (_unit_rows(_matrix(t.column("v").combine_chunks())) for t in (x, y))
        if a.shape[1] != b.shape[1]:
            raise ValueError(f"vectors of lengths {a.shape[1]} and {b.shape[1]}")
        ids = y.column("posting_id").combine_chunks()
        place = pc.rank(ids, tiebreaker="first").to_numpy()  # ids in their own order, of any type
        scores = np.round(np.nan_to_num(a @ b.T), 6) + 0.0
        picks = [_best(place, s, n) for s in scores]
        lengths = [len(k) for k in picks]
        columns = [
            x.column("query_id").take(pa.array(np.repeat(np.arange(len(a)), lengths))), ids.take(pa.array(np.concatenate(picks))),
            pa.array(np.concatenate([s[k] for k, s in zip(picks, scores)])), pa.array(np.full(sum(lengths), x.column("c")[0].as_py())),
        ]
        return pa.table([c.cast(f.type) for c, f in zip(columns, shape)], schema=shape)

    keys = ["c", "qt", "pt"]
    return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(compare, result)


def similarity_scores(
    queries: DataFrame,
    postings: DataFrame,
    *,
    query_id: str,
    query_vector: str,
    posting_vector: str,
    keep: Sequence[str],
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Cosine of every posting with every query: one row per posting and query.

    The output is all pairs. Up to `max_broadcast` queries are sent to every task and nothing is
    shuffled; more are cut into tiles that meet tiles of postings. rank_by_cosine returns the best
    per query. A zero vector and one with a null element score 0; vectors of unequal length raise.
    """
    given = queries.select(query_id, query_vector).filter(F.col(query_vector).isNotNull())
    kind = T.ArrayType(queries.schema[query_id].dataType)
    present = postings.filter(F.col(posting_vector).isNotNull())
    rows = given.limit(max_broadcast + 1).collect()
    if len(rows) > max_broadcast:
        return _scores_of_tiles(present, given, query_id, query_vector, posting_vector, keep)
    ids = F.array(*[F.lit(r[0]) for r in rows]).cast(kind)
    scores = _scores_with(postings, rows)(F.col(posting_vector))
    scored = present.select(*keep, F.posexplode(scores).alias("_q", "score"))
    return scored.select(*keep, F.get(ids, F.col("_q")).alias("query_id"), "score")


def _scores_of_tiles(present: DataFrame, queries: DataFrame, query_id: str, query_vector: str, posting_vector: str, keep: Sequence[str]) -> DataFrame:
    left = present.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(posting_vector).cast("array<double>").alias("_v"))
    left = materialize(left, "postings")
    right = queries.select(F.col(query_id).alias("_q"), F.col(query_vector).cast("array<double>").alias("_w"))
    kept = [left.schema[c] for c in keep]
    result = T.StructType([*kept, T.StructField("query_id", right.schema["_q"].dataType), T.StructField("score", T.DoubleType())])

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        shape = to_arrow_schema(result)
        if not x.num_rows or not y.num_rows:
            return shape.empty_table()
        a, b = (_unit_rows(_matrix(t.column(n).combine_chunks())) for t, n in ((x, "_v"), (y, "_w")))
        scores = np.nan_to_num(a @ b.T)
        row = pa.array(np.repeat(np.arange(len(a)), len(b)))
        query = pa.array(np.tile(np.arange(len(b)), len(a)))
        columns = [*(x.column(f.name).take(row) for f in kept), y.column("_q").take(query), pa.array(scores.ravel())]
        return pa.table([c.cast(f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    return tile_pairs(left, right, "_row", "_q", compare, result, right_rows=256)


def _scores_with(df: DataFrame, rows: list) -> Callable[[Column], Column]:
    unit = _unit_rows(np.array([r[1] for r in rows], dtype="float64").reshape(len(rows), -1))
    shared = df.sparkSession.sparkContext.broadcast(unit)

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        unit = shared.value
        for column in batches:
            given = _unit_rows(_matrix(column, unit.shape[1] or None))
            scores = np.nan_to_num(given @ unit.T) if len(unit) else np.empty((len(column), 0))
            offsets = np.arange(len(column) + 1, dtype="int32") * len(unit)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores.ravel()))

    return score


def weighted_view_score(pairs: Sequence[tuple[str, str, float]]) -> Column:
    """Sum of weight x cosine over (query view, posting view, weight)."""
    total = F.lit(0.0)
    for query_view, posting_view, weight in pairs:
        total = total + F.lit(float(weight)) * cosine(F.col(query_view), F.col(posting_view))
    return total


def semantic_search(
    queries: DataFrame,
    postings: DataFrame,
    *,
    posting_id: str,
    posting_vector: str,
    metadata: DataFrame | None = None,
    top_n: int = 100,
    page: int = 1,
    page_size: int = 10,
    **columns: str,
) -> DataFrame:
    """Page of the top_n postings per query with match_score in percent and total_results."""
    ranked = rank_by_cosine(
        queries,
        usable_vectors(postings, posting_vector),
        posting_id=posting_id,
        posting_vector=posting_vector,
        top_n=top_n,
        **columns,
    )
    total = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    first = (page - 1) * page_size
    shown = ranked.withColumn("total_results", total).filter(
        (F.col("rank") > first) & (F.col("rank") <= first + page_size)
    )
    shown = shown.withColumn("match_score", half_even_percent(F.col("score")))
    if metadata is None:
        return shown
    return metadata.join(shown, posting_id)


def recommend_served(
    queries: DataFrame, served: DataFrame, centroids: DataFrame, *, query_id: str, query_vector: str, posting_id: str,
    posting_vector: str, cluster: str = "cluster_id", top_n: int = 10,
) -> DataFrame:
    """recommend() over a table that write_clustered() laid out by cluster: only wanted clusters are read.

    The queries' clusters (no more than there are centroids) are joined to the partition column, so
    Spark prunes partitions by them at run time.
    """
    given = queries.filter(F.size(query_vector) > 0)
    placed = materialize(assign_nearest(given, query_vector, centroids, out="_cluster"), "placed")
    wanted = placed.filter(F.size(query_vector) > 0).select(F.col("_cluster").alias(cluster)).distinct()
    pruned = served.join(F.broadcast(wanted), cluster, "left_semi")
    ranked = rank_by_cosine(
        placed, pruned, query_id=query_id, query_vector=query_vector, query_cluster="_cluster", posting_id=posting_id,
        posting_vector=posting_vector, posting_cluster=cluster, top_n=top_n,
    )
    return ranked.select("query_id", posting_id, "score", "rank", "cluster_id")


def recommend(
    queries: DataFrame,
    postings: DataFrame,
    centroids: DataFrame,
    *,
    query_id: str,
    query_vector: str,
    posting_id: str,
    posting_vector: str,
    posting_cluster: str,
    top_n: int = 10,
) -> DataFrame:
    """Nearest cluster per query, then the best top_n postings inside that cluster."""
    placed = assign_nearest(queries, query_vector, centroids, out="cluster_id")
    ranked = rank_by_cosine(
        placed,
        postings,
        query_id=query_id,
        query_vector=query_vector,
        query_cluster="cluster_id",
        posting_id=posting_id,
        posting_vector=posting_vector,
        posting_cluster=posting_cluster,
        top_n=top_n,
    )
    return ranked.select("query_id", posting_id, "score", "rank", "cluster_id")
