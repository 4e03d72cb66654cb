"""Semantic search over post vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlens.functions import text
from murmurlens.functions.text import clip
from murmurlens.operators.filters import checked_top_k, validate_queries
from murmurlens.operators.series import bucket_date
from murmurlens.operators.vectors import top_k
from murmurlens.runtime import stage

# Post columns a search hit carries, with the widths of the clipped ones.
HIT_COLUMNS = [
    "title", "selftext", "content", "author", "created_utc", "subreddit", "score",
    "num_comments", "permalink", "url", "crosspost_parent", "domain", "upvote_ratio",
]
CLIPPED_HIT_COLUMNS = {"selftext": 500, "content": 500}


def with_posts(hits: DataFrame, posts: DataFrame) -> DataFrame:
    """Hits with the columns of their posts. Hits without a post are dropped, ranks stay."""
    details = posts.select(
        "post_id",
        *[
            (clip(F.col(name), CLIPPED_HIT_COLUMNS[name]).alias(name) if name in CLIPPED_HIT_COLUMNS else name)
            for name in HIT_COLUMNS
            if name in posts.columns
        ],
    )
    return hits.join(details, "post_id")


def search(queries: DataFrame, vectors: DataFrame, posts: DataFrame, k: int = 10) -> DataFrame:
    """Search for a batch of ``queries(query_id, text, embedding)``.

    Blank queries find nothing. Ranking runs on ids and vectors alone. The ranked ids are written
    before their posts are fetched, so the planner sees how few they are and need not shuffle the
    posts; a large batch of queries gets a shuffle join by the same size check.
    """
    asked = validate_queries(queries).filter(F.col("error").isNull())
    hits = stage(top_k(asked, vectors, checked_top_k(k)), "hits")
    return with_posts(hits, posts)


def search_report(queries: DataFrame, hits: DataFrame, context_posts: int = 10) -> DataFrame:
    """One row per query: cleaned text, error, warning, hit count, digest, follow-ups, context.

    ``hits`` comes from :func:`search`, so a query has at most a hundred rows.
    """
    shown = F.struct("rank", "subreddit", "author", "score", "title", clip(F.col("content"), 300).alias("content"))
    first = F.slice(F.array_sort(F.collect_list(shown)), 1, context_posts)
    per_query = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("total_results"),
        F.count_distinct("subreddit").alias("communities"),
        F.array_join(F.transform(first, post_block), "\n---\n").alias("context"),
    )
    checked = validate_queries(queries)
    query, found = F.col("query"), F.coalesce("total_results", F.lit(0))
    failed = F.col("error").isNotNull()
    return checked.join(per_query, "query_id", "left").select(
        "query_id",
        "query",
        "error",
        "warning",
        found.alias("total_results"),
        F.when(failed, F.col("error"))
        .otherwise(text.search_digest(query, found, F.coalesce("communities", F.lit(0))))
        .alias("summary"),
        F.when(failed, F.array().cast("array<string>")).otherwise(text.follow_ups(query, found > 0)).alias("follow_up_queries"),
        F.coalesce("context", F.lit("")).alias("context"),
    )


def post_block(post: Column, place: Column) -> Column:
    """Numbered text block of one post, for prompts and exports. ``place`` counts from 0."""
    return F.format_string(
        "[Post %d] r/%s by u/%s (score: %d)\nTitle: %s\nContent: %s\n",
        place + 1, post["subreddit"], post["author"], post["score"], post["title"], post["content"],
    )


def search_volume(hits: DataFrame, grain: str = "day") -> DataFrame:
    """Volume over time of the hits of each query: ``(query_id, date, count)``."""
    return hits.groupBy("query_id", bucket_date(F.col("created_utc"), grain).alias("date")).agg(
        F.count(F.lit(1)).alias("count")
    )


def search_payload(report: DataFrame, hits: DataFrame) -> DataFrame:
    """One nested row per query with its hits in rank order."""
    ordered = ["rank"] + [c for c in hits.columns if c not in ("query_id", "rank")]
    nested = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(name) for name in ordered]))).alias("results")
    )
    return report.join(nested, "query_id", "left")
