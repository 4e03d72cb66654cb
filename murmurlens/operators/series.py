"""Volume and engagement over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlens.functions.text import series_digest
from murmurlens.operators.filters import checked_grain, checked_metric, in_community, with_ids


def bucket_date(moment: Column, grain: str) -> Column:
    """First date of the day or of the week (weeks start on Monday)."""
    return F.date_trunc(checked_grain(grain), moment).cast("date")


def volume(posts: DataFrame, grain: str = "day", community: str | None = None) -> DataFrame:
    """``(date, count)``; dates without posts are absent."""
    return (
        in_community(posts, community)
        .groupBy(bucket_date(F.col("created_utc"), grain).alias("date"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def volume_of(posts: DataFrame, ids: DataFrame, grain: str = "day") -> DataFrame:
    """Volume of the posts listed in ``ids(post_id)``."""
    return volume(with_ids(posts.select("post_id", "created_utc"), ids), grain)


def engagement(posts: DataFrame, grain: str = "day", metric: str = "score") -> DataFrame:
    value = F.col(checked_metric(metric))
    return posts.groupBy(bucket_date(F.col("created_utc"), grain).alias("date")).agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.round(F.avg(value), 2), F.lit(0.0)).alias("avg_metric"),
        F.coalesce(F.sum(value), F.lit(0)).alias("total_metric"),
    )


def trend(series: DataFrame, label: Column | str, points: int = 60) -> DataFrame:
    """One row describing a series: total, first peak, the first ``points`` pairs and a sentence.

    A series has one row per date, so gathering its points stays small.
    """
    name = F.lit(label) if isinstance(label, str) else label
    pair = F.struct("date", "count")
    shown = F.slice(F.array_sort(F.collect_list(pair)), 1, points)
    summary = series.agg(
        F.count(F.lit(1)).alias("total_data_points"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_posts"),
        F.min_by(pair, F.struct(-F.col("count"), F.col("date"))).alias("peak"),
        F.array_join(
            F.transform(shown, lambda p: F.format_string("%s: %d", p["date"].cast("string"), p["count"])), ", "
        ).alias("data_text"),
    )
    return summary.select(
        name.alias("query"),
        "total_data_points",
        "total_posts",
        F.col("peak.date").alias("peak_date"),
        F.col("peak.count").alias("peak_count"),
        "data_text",
        series_digest(name, F.col("total_posts"), F.col("peak.date"), F.col("peak.count")).alias("summary"),
    )
