"""The stored vectors: ids kept with their vectors, reused where valid, completed where not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlens.runtime import stage

VECTORS_SCHEMA = "post_id string, embedding array<float>"


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS_SCHEMA).parquet(path)


def save_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """Overwrite the store. ``vectors`` must not read from ``path`` itself."""
    if vectors.isEmpty():
        raise ValueError("no vectors to store")
    vectors.select("post_id", "embedding").write.mode("overwrite").parquet(path)
    return read_vectors(vectors.sparkSession, path)


def vector_gaps(vectors: DataFrame, posts: DataFrame, dimensions: int) -> DataFrame:
    """One row: posts without a valid vector, vectors without a post, vectors of wrong length.
    All zero means that the store can be reused as it is."""
    sized = vectors.select("post_id", (F.size("embedding") == dimensions).alias("fits"))
    matched = posts.select("post_id", F.lit(1).alias("is_post")).join(sized, "post_id", "full")

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))

    return matched.agg(
        count(F.col("is_post").isNotNull() & ~F.coalesce("fits", F.lit(False))).alias("missing"),
        count(F.col("is_post").isNull()).alias("orphaned"),
        count(F.coalesce(~F.col("fits"), F.lit(False))).alias("wrong_length"),
    )


def complete_vectors(
    posts: DataFrame,
    path: str,
    encode: Callable[[DataFrame], DataFrame],
    dimensions: int,
    rebuild: bool = False,
) -> DataFrame:
    """Vectors for all posts. Valid ones are kept and only posts without one are encoded.

    ``encode`` maps ``(post_id, content)`` to ``(post_id, embedding)``. Vectors without a post or
    of another length make the store be written anew from the valid rest.
    """
    spark = posts.sparkSession
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    texts = posts.select("post_id", "content")
    if rebuild or not files.exists(location):
        return save_vectors(encode(texts), path)
    stored = read_vectors(spark, path)
    gaps = vector_gaps(stored, posts, dimensions).first()
    if not any(gaps):
        return stored
    valid = stored.filter(F.size("embedding") == dimensions)
    missing = texts.join(valid.select("post_id"), "post_id", "left_anti")
    fresh = encode(missing).select("post_id", "embedding")
    if gaps["orphaned"] or gaps["wrong_length"]:
        kept = valid.join(posts.select("post_id"), "post_id", "left_semi")
        return save_vectors(stage(kept.unionByName(fresh), "vectors"), path)
    fresh.write.mode("append").parquet(path)
    return read_vectors(spark, path)
