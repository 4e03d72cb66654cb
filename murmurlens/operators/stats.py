"""Dataset and community statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlens.functions.text import clip
from murmurlens.operators.filters import people_only


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Put one-row frames with different columns side by side without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(name, ignorenulls=True).alias(name) for name in stacked.columns])


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    """A distinct count over one column: two narrow aggregations instead of the row-multiplying
    plan that several distinct counts in one aggregate would get."""
    return df.select(column).distinct().agg(F.count(column).alias(name))


def top_post(posts: DataFrame) -> DataFrame:
    """The post with the highest score; the smallest id among equals."""
    return posts.orderBy(F.desc_nulls_last("score"), "post_id").limit(1)


def dataset_stats(posts: DataFrame) -> DataFrame:
    totals = posts.agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.min("created_utc").alias("start"),
        F.max("created_utc").alias("end"),
        F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("avg_score"),
    )
    best = top_post(posts.select("post_id", "title", "score", "author", "subreddit")).select(
        F.struct("title", "score", "author", "subreddit").alias("top_post")
    )
    return one_row(
        [
            totals,
            distinct_count(posts, "author", "unique_authors"),
            distinct_count(posts, "subreddit", "unique_subreddits"),
            best,
        ]
    ).select("total_posts", "unique_authors", "unique_subreddits", "start", "end", "avg_score", "top_post")


def ingest_summary(posts: DataFrame, counters: DataFrame) -> DataFrame:
    """Dataset statistics next to the number of skipped lines."""
    stats = dataset_stats(posts).withColumnRenamed("total_posts", "total_records")
    return one_row([stats, counters.select(F.col("skipped").alias("skipped_records"))])


def top_communities(posts: DataFrame, limit: int = 10) -> DataFrame:
    return (
        posts.groupBy("subreddit")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "subreddit")
        .limit(limit)
    )


def top_authors(posts: DataFrame, limit: int = 10) -> DataFrame:
    return (
        people_only(posts)
        .groupBy("author")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "author")
        .limit(limit)
    )


def community_activity(posts: DataFrame, limit: int = 50) -> DataFrame:
    return (
        posts.groupBy("subreddit")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("avg_score"),
        )
        .orderBy(F.desc("count"), "subreddit")
        .limit(limit)
    )


def narrative_breakdown(posts: DataFrame, limit: int = 5) -> DataFrame:
    """The communities with the highest total score, with their engagement totals."""
    return (
        people_only(posts)
        .groupBy("subreddit")
        .agg(
            F.count(F.lit(1)).alias("post_count"),
            F.sum("score").alias("total_score"),
            F.sum("num_comments").alias("total_comments"),
            F.sum("num_crossposts").alias("total_crossposts"),
            F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("avg_score"),
        )
        .orderBy(F.desc_nulls_last("total_score"), "subreddit")
        .limit(limit)
    )


def key_posts(posts: DataFrame, limit: int = 30) -> DataFrame:
    """The highest-scored posts by people, ranked, with clipped text.

    Ids are ranked on narrow columns first; only the chosen rows fetch their text.
    """
    ranked = (
        people_only(posts.select("post_id", "author", "score"))
        .orderBy(F.desc_nulls_last("score"), "post_id")
        .limit(limit)
        .select("post_id")
    )
    return posts.join(ranked, "post_id").select(
        "post_id",
        "title",
        clip(F.col("selftext"), 300).alias("selftext"),
        clip(F.col("content"), 400).alias("content"),
        "author",
        "created_utc",
        "subreddit",
        "score",
        "num_comments",
        "permalink",
        "crosspost_parent",
    ).orderBy(F.desc_nulls_last("score"), "post_id")
