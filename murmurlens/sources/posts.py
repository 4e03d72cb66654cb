"""The stored posts table: replace, insert-or-ignore, load once, read back.

The table is a :class:`~murmurlens.sources.keyed.KeyedStore` on the post id: every change is a new
version that readers see whole or not at all, and an insert reads only the buckets whose Bloom
filter hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmurlens.operators.skew import first_wins
from murmurlens.schema import POSTS_SCHEMA
from murmurlens.sources.keyed import BUCKETS, KeyedStore


def posts_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedStore:
    return KeyedStore(spark, path, POSTS_SCHEMA, "post_id", buckets)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return posts_store(spark, path).read()


def has_posts(spark: SparkSession, path: str) -> bool:
    """Whether the table exists and holds a row."""
    return posts_store(spark, path).snapshot().rows > 0


def replace_posts(posts: DataFrame, path: str) -> DataFrame:
    """Make ``posts``, whose ids are unique, the whole table."""
    store = posts_store(posts.sparkSession, path)
    store.replace(posts)
    return store.read()


def new_posts(existing: DataFrame, incoming: DataFrame, position: str) -> DataFrame:
    """The incoming rows whose id is not in ``existing`` yet, the first row of a repeated id only."""
    unique = first_wins(incoming, "post_id", position)
    return unique.join(existing.select("post_id"), "post_id", "left_anti")


def insert_posts(incoming: DataFrame, path: str, position: str) -> DataFrame:
    """Insert-or-ignore on the post id: add what is new, leave stored rows as they are."""
    store = posts_store(incoming.sparkSession, path)
    store.insert(incoming, position)
    return store.read()


def load_once(spark: SparkSession, path: str, build) -> DataFrame:
    """Run ``build()`` and store its posts unless the table holds rows already."""
    if not has_posts(spark, path):
        replace_posts(build(), path)
    return read_posts(spark, path)
