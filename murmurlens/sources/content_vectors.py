"""Vectors by content: one per distinct text, kept under a fingerprint of the text that was encoded.

A post finds its vector by the fingerprint of its own text, so a post whose text changed gets the
vector of the new text, posts with equal texts share one, and what is missing is found by the
filters of a :class:`~murmurlens.sources.keyed.KeyedStore` without reading the stored vectors. Vectors
of texts that no post has any more stay until :func:`forget_unused`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurlens.functions.text import text_to_encode
from murmurlens.operators.skew import spread_join
from murmurlens.runtime import stage
from murmurlens.sources.keyed import BUCKETS, KeyedStore

SCHEMA = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


@dataclass(frozen=True)
class Encoded:
    """``vectors(post_id, embedding)`` of all posts, and how many texts had to be encoded for them."""

    vectors: DataFrame
    encoded: int
    parts_read: int


def vector_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedStore:
    return KeyedStore(spark, path, SCHEMA, "fingerprint", buckets)


def fingerprint(content: Column) -> Column:
    """128 bits of the text as it is given to the encoder."""
    return F.md5(text_to_encode(content))


def _fits(store: KeyedStore, dimensions: int) -> bool:
    return store.read().filter(F.size("embedding") != dimensions).isEmpty()


def vectors_by_content(posts: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], dimensions: int, rebuild: bool = False) -> Encoded:
    """Vectors for all ``posts(post_id, content)``; only texts without one are encoded.

    ``encode`` maps ``(post_id, content)`` to ``(post_id, embedding)``; it is given fingerprints for ids, each
    once. A store with vectors of another length is of another encoder and is written anew.
    """
    store = vector_store(posts.sparkSession, path)
    if store.snapshot().commits and (rebuild or not _fits(store, dimensions)):
        store.replace(store.read().limit(0))
    named = stage(posts.select("post_id", fingerprint(F.col("content")).alias("fingerprint")), "fingerprints")
    asked = named.select("fingerprint").distinct()
    missing, read = store.absent(asked)
    missing = stage(missing.select("fingerprint"), "missing-vectors")
    texts = posts.select(fingerprint(F.col("content")).alias("fingerprint"), "content")
    # One text for each fingerprint, combined in every task before it is shuffled.
    wanted = spread_join(texts, missing, "fingerprint", "content", "left_semi").groupBy("fingerprint").agg(F.first("content").alias("content"))
    encoded = 0
    if not missing.isEmpty():
        fresh = encode(wanted.select(F.col("fingerprint").alias("post_id"), "content")).select(F.col("post_id").alias("fingerprint"), "embedding")
        encoded = store.insert(fresh.withColumn("position", F.lit(0)), "position").stored
    return Encoded(spread_join(named, store.read(), "fingerprint", "post_id").select("post_id", "embedding"), encoded, read)


def forget_unused(posts: DataFrame, path: str) -> None:
    """Keep the vectors of the texts of ``posts`` alone."""
    store = vector_store(posts.sparkSession, path)
    used = posts.select(fingerprint(F.col("content")).alias("fingerprint")).distinct()
    store.replace(store.read().join(used, "fingerprint", "left_semi"))
