"""Topic clusters over post vectors: KMeans, a flat density clustering, and what follows from labels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from murmurlens.operators.components import connected_components
from murmurlens.operators.kmeans import assigned, best_centres
from murmurlens.operators.neighbours import ball_index, close_links, distances, kth_neighbour
from murmurlens.operators.ordering import value_at_quantile, with_global_index
from murmurlens.operators.vectors import as_matrix
from murmurlens.runtime import stage

# Limits and defaults of the clustering methods.
MIN_CLUSTERS, MAX_CLUSTERS = 2, 50
RESTARTS, MAX_ITERATIONS, SEED = 10, 300, 42
MIN_CLUSTER_SIZE, MIN_SAMPLES = 15, 5
LARGE_CLUSTERS, FALLBACK_CLUSTERS = 15, 10
MAX_NOISE = 0.8
MEMBERS_SHOWN = 20
# Warnings.
NO_VECTORS = "No embeddings available for clustering."
TOO_MANY = "Requested {k} clusters, but dataset only has {n} points. Using {most} clusters instead."
MAY_DEGENERATE = (
    "Warning: {k} clusters for {n} posts may produce very small or degenerate clusters. "
    "Results may not be meaningful."
)
LARGE_DATASET = "Used KMeans (15 clusters) for performance on large dataset."
DEGENERATE = "HDBSCAN produced insufficient clusters. Used KMeans fallback with 10 clusters."

DENSITY_QUANTILE = 0.75
ROWS_PER_CELL = 2_000


# -- KMeans ------------------------------------------------------------------------------------


def relabel_by_size(points: DataFrame) -> DataFrame:
    """Number clusters 0, 1, … by size, then by smallest member; noise (-1) stays."""
    sizes = points.filter("cluster >= 0").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.min("post_id").alias("first")
    )
    ranked = with_global_index(sizes, F.desc("size"), F.asc("first")).select(
        "cluster", F.col("index").cast("int").alias("number")
    )
    return points.join(ranked, "cluster", "left").select(
        "post_id", F.coalesce("number", F.lit(-1)).alias("cluster")
    )


def kmeans(
    vectors: DataFrame, k: int, restarts: int = RESTARTS, max_iterations: int = MAX_ITERATIONS, seed: int = SEED
) -> DataFrame:
    """``(post_id, cluster)``: the cheapest of ``restarts`` KMeans runs, which advance together."""
    rows = vectors.select("post_id", "embedding").persist()
    try:
        points = rows.count()
        if not MIN_CLUSTERS <= k <= max(MIN_CLUSTERS, points):
            raise ValueError(f"{k} clusters for {points} points")
        centres = best_centres(rows, points, k, restarts, max_iterations, seed)
        return relabel_by_size(stage(assigned(rows, centres), "kmeans"))
    finally:
        rows.unpersist()


def nearest_centre(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """``(post_id, cluster, distance)`` for ``centres(cluster, embedding)``, at most 50 of them."""
    rows = centres.select("cluster", "embedding").limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} centres")
    rows.sort(key=lambda row: row["cluster"])
    shared = vectors.sparkSession.sparkContext.broadcast(
        ([row["cluster"] for row in rows], np.array([row["embedding"] for row in rows], dtype=np.float64))
    )
    schema = T.StructType(
        [vectors.schema["post_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())]
    )
    arrow_schema = to_arrow_schema(schema)

    def assign(batches):
        names, matrix = shared.value
        for batch in batches:
            if batch.num_rows:
                away = distances(as_matrix(batch.column(1)), matrix)
                nearest = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(arrow_schema.field(0).type),
                        pa.array([names[i] for i in nearest], pa.int32()),
                        pa.array(away[np.arange(len(nearest)), nearest]),
                    ],
                    schema=arrow_schema,
                )

    return vectors.select("post_id", "embedding").mapInArrow(assign, schema)


# -- density -----------------------------------------------------------------------------------


def core_distances(vectors: DataFrame, min_samples: int = MIN_SAMPLES, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``(post_id, core)``: distance to the ``min_samples``-th nearest other point, null where there are
    fewer. Exact; what the ball partition rules out is not looked at."""
    index = ball_index(vectors, rows_per_cell)
    return index.of_every_id(stage(kth_neighbour(index, min_samples), "cores"))


def density_links(core_points: DataFrame, eps: float, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``(src, dst)``: enough links within ``eps`` to connect what is within ``eps``.

    Each block and pair of blocks that are near enough returns a spanning forest of its own links.
    The forests together connect exactly the points that all links connect.
    """
    return close_links(ball_index(core_points, rows_per_cell), eps)


def density_clusters(
    vectors: DataFrame,
    min_cluster_size: int = MIN_CLUSTER_SIZE,
    min_samples: int = MIN_SAMPLES,
    eps: float | None = None,
    quantile: float = DENSITY_QUANTILE,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """``(post_id, cluster)`` with -1 for noise.

    Points whose core distance is within ``eps`` are linked when they lie within ``eps`` of each
    other; connected groups of at least ``min_cluster_size`` points are clusters. This is the cut
    of the density hierarchy at ``eps``, which defaults to a quantile of the core distances. How many
    pairs of points are looked at depends on how far a ball partition tells them apart.
    """
    vectors = stage(vectors.select("post_id", "embedding"), "density-vectors")
    cores = stage(core_distances(vectors, min_samples, rows_per_cell), "core-distances")
    if eps is None:
        eps = value_at_quantile(cores.filter("core IS NOT NULL"), "core", "post_id", quantile)
    if eps is None:
        return vectors.select("post_id", F.lit(-1).alias("cluster"))
    dense = stage(vectors.join(cores.filter(F.col("core") <= eps).select("post_id"), "post_id", "left_semi"), "dense")
    links = density_links(dense, eps, rows_per_cell)
    groups = connected_components(dense.select(F.col("post_id").alias("id")), links)
    groups = stage(groups, "density-groups")
    large = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_cluster_size)
    numbered = with_global_index(large, F.desc("size"), F.asc("component")).select(
        "component", F.col("index").cast("int").alias("number")
    )
    labels = groups.join(numbered, "component").select(F.col("id").alias("post_id"), "number")
    return vectors.select("post_id").join(labels, "post_id", "left").select(
        "post_id", F.coalesce("number", F.lit(-1)).alias("cluster")
    )


# -- projection --------------------------------------------------------------------------------


def project_2d(vectors: DataFrame) -> DataFrame:
    """``(post_id, x, y)``: the first two principal components of the centred vectors. The sign of
    a component is fixed by making its largest loading positive."""
    rows = vectors.select("post_id", array_to_vector("embedding").alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(rows)
    centred = scaler.transform(rows)
    model = PCA(k=2, inputCol="centred", outputCol="plane").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if column[np.abs(column).argmax()] >= 0 else -1.0 for column in loadings.T]
    plane = vector_to_array("plane")
    return model.transform(centred).select(
        "post_id", (plane[0] * signs[0]).alias("x"), (plane[1] * signs[1]).alias("y")
    )


# -- what follows from labels ------------------------------------------------------------------


def first_members(points: DataFrame, members: int = MEMBERS_SHOWN) -> DataFrame:
    """``(cluster, place, post_id)`` of the first members in id order. The rank limit prunes every
    task to ``members`` rows per cluster before the shuffle."""
    place = F.row_number().over(W.partitionBy("cluster").orderBy("post_id"))
    return points.select("cluster", "post_id", place.alias("place")).filter(F.col("place") <= members)


def cluster_summaries(points: DataFrame, members: int = MEMBERS_SHOWN) -> DataFrame:
    """``(cluster_id, label, size, post_ids)``."""
    sizes = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    ids = first_members(points, members).groupBy("cluster").agg(F.array_sort(F.collect_list("post_id")).alias("post_ids"))
    name = F.when(F.col("cluster") >= 0, F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
    return sizes.join(ids, "cluster").select(
        F.col("cluster").alias("cluster_id"), name.otherwise("Noise/Outliers").alias("label"), "size", "post_ids"
    )


def cluster_counts(points: DataFrame) -> DataFrame:
    """One row: points, clusters, noise points and their share."""
    per_cluster = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return per_cluster.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_points"),
        F.sum((F.col("cluster") >= 0).cast("bigint")).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster") < 0, F.col("n"))), F.lit(0)).alias("noise_points"),
    ).select(
        "total_points",
        F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"),
        "noise_points",
        F.when(F.col("total_points") > 0, F.col("noise_points") / F.col("total_points")).otherwise(0.0).alias("noise_ratio"),
    )


# -- choice of method --------------------------------------------------------------------------


@dataclass(frozen=True)
class Choice:
    method: str
    k: int | None
    warning: str | None


def choose_method(points: int, n_clusters: int | None = None, density_limit: int | None = None) -> Choice:
    """KMeans when a number is asked for, else density clustering. With ``density_limit``, data of
    more points than that is given to KMeans too."""
    if points == 0:
        return Choice("none", None, NO_VECTORS)
    if n_clusters is not None:
        most = min(MAX_CLUSTERS, points)
        if n_clusters > most:
            return Choice("kmeans", most, TOO_MANY.format(k=n_clusters, n=points, most=most))
        warning = MAY_DEGENERATE.format(k=n_clusters, n=points) if n_clusters >= points // 2 else None
        return Choice("kmeans", n_clusters, warning)
    if density_limit is not None and points > density_limit:
        return Choice("kmeans", LARGE_CLUSTERS, LARGE_DATASET)
    return Choice("hdbscan", None, None)


@dataclass(frozen=True)
class Clustering:
    """``points(post_id, cluster, x, y)``, ``clusters(cluster_id, label, size, post_ids)`` and the
    decision that led to them."""

    points: DataFrame
    clusters: DataFrame
    n_clusters: int
    method: str
    warning: str | None
    total_points: int


def run_clustering(
    vectors: DataFrame,
    n_clusters: int | None = None,
    project: bool = True,
    restarts: int = RESTARTS,
    density_limit: int | None = None,
    density: Callable[[DataFrame], DataFrame] = density_clusters,
) -> Clustering:
    """Cluster ``vectors(post_id, embedding)`` by the method that :func:`choose_method` picks. Too
    few density clusters or too much noise lead to KMeans with a warning; failures surface."""
    total = vectors.count()
    choice = choose_method(total, n_clusters, density_limit)
    if choice.method == "none":
        empty = vectors.select("post_id", F.lit(-1).alias("cluster"))
        if project:
            empty = empty.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
        return Clustering(empty, cluster_summaries(empty), 0, "none", choice.warning, 0)
    labelled = None
    if choice.method == "hdbscan":
        labelled = stage(density(vectors), "density")
        found = cluster_counts(labelled).first()
        if found["n_clusters"] <= 1 or found["noise_ratio"] > MAX_NOISE:
            labelled, choice = None, Choice("kmeans", max(MIN_CLUSTERS, min(FALLBACK_CLUSTERS, total)), DEGENERATE)
    if labelled is None:
        labelled = stage(kmeans(vectors, choice.k, restarts=restarts), "clusters")
    found = cluster_counts(labelled).first()
    points = labelled.join(project_2d(vectors), "post_id") if project else labelled
    return Clustering(points, cluster_summaries(labelled), found["n_clusters"], choice.method, choice.warning, total)
