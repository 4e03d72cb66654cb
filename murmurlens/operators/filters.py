"""Row filters shared by the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlens.functions import text
from murmurlens.functions.clean import strip
from murmurlens.schema import ENGAGEMENT_METRICS, EXCLUDED_AUTHORS


def is_person(author: Column) -> Column:
    return author.isNotNull() & ~author.isin(*EXCLUDED_AUTHORS)


def people_only(posts: DataFrame) -> DataFrame:
    """Without deleted accounts, the moderation bot and missing authors."""
    return posts.filter(is_person(F.col("author")))


def in_community(posts: DataFrame, community: str | None) -> DataFrame:
    return posts.filter(F.col("subreddit") == community) if community else posts


def with_ids(posts: DataFrame, ids: DataFrame, key: str = "post_id") -> DataFrame:
    """Posts whose id is in ``ids``. Both sides are even on the id, so the planner may choose
    broadcast or shuffle by size; nothing is forced."""
    return posts.join(ids.select(key), key, "left_semi")


def dated(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("created_utc").isNotNull())


def checked_metric(metric: str) -> str:
    return metric if metric in ENGAGEMENT_METRICS else ENGAGEMENT_METRICS[0]


def checked_grain(grain: str) -> str:
    return "week" if grain == "week" else "day"


def checked_top_k(top_k: int) -> int:
    if top_k < 1:
        raise ValueError("at least one hit must be asked for")
    return top_k


def validate_queries(queries: DataFrame, column: str = "text") -> DataFrame:
    """Add ``query`` (trimmed), ``error`` and ``warning``."""
    raw = F.col(column)
    return queries.select(
        "*",
        F.coalesce(strip(raw), F.lit("")).alias("query"),
        text.query_error(raw).alias("error"),
        text.query_warning(raw).alias("warning"),
    )
