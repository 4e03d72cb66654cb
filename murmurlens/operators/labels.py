"""Names and details for clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurlens.functions.text import GENERIC_LABELS, clip, is_topic_word, keyword_label, tidy_label, word_pieces
from murmurlens.operators.clustering import MEMBERS_SHOWN, first_members
from murmurlens.runtime import stage

# Posts shown per cluster.
POSTS_SHOWN = 5
UNCATEGORIZED = "Uncategorized"


def member_posts(points: DataFrame, posts: DataFrame, members: int = POSTS_SHOWN) -> DataFrame:
    """Details of the first ``members`` of every cluster, noise left out. The chosen ids are written
    first, so that the planner joins by their true size."""
    chosen = stage(first_members(points.filter("cluster >= 0"), members), "members")
    return chosen.join(
        posts.select(
            "post_id", "title", clip(F.col("selftext"), 300).alias("selftext"), "author", "created_utc",
            "subreddit", "score", "num_comments", "permalink",
        ),
        "post_id",
    )


def keyword_labels(points: DataFrame, posts: DataFrame) -> DataFrame:
    """``(cluster, label)`` from the two most frequent title words over all members of each cluster;
    the word of the smallest post id, then of the first place, among equals. Words are counted with
    partial sums, so a large cluster is no large group."""
    members = points.filter("cluster >= 0").join(posts.select("post_id", "title", "subreddit"), "post_id")
    words = members.select(
        "cluster", "post_id", F.posexplode(word_pieces(F.col("title"))).alias("pos", "word")
    ).filter(is_topic_word(F.col("word")))
    counted = words.groupBy("cluster", "word").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("post_id", "pos")).alias("seen")
    )
    best = W.partitionBy("cluster").orderBy(F.desc("n"), "seen")
    top = (
        counted.withColumn("r", F.row_number().over(best))
        .filter("r <= 2")
        .groupBy("cluster")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda w: w["word"]).alias("words"))
    )
    first = members.groupBy("cluster").agg(F.min_by("subreddit", "post_id").alias("community"))
    words_or_none = F.coalesce("words", F.array().cast("array<string>"))
    return first.join(top, "cluster", "left").select(
        "cluster", tidy_label(keyword_label(words_or_none, F.col("community"))).alias("label")
    )


def name_clusters(points: DataFrame, posts: DataFrame, keyword_clusters: int | None = None) -> DataFrame:
    """``(cluster_id, label, size, post_ids, top_posts)``, largest first.

    Clusters are named by keywords. With ``keyword_clusters`` only that many of the largest are, and
    the others by the community of their first post.
    Equal names get a running number in order of size.
    """
    members = member_posts(points, posts)
    sizes = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    ordered = sizes if keyword_clusters is None else sizes.orderBy(F.desc("size"), "cluster").limit(keyword_clusters)
    largest = ordered.select("cluster", F.lit(True).alias("is_large"))
    shown = F.array_sort(
        F.collect_list(
            F.when(
                F.col("place") <= POSTS_SHOWN,
                F.struct("place", "post_id", "title", "selftext", "author", "created_utc", "subreddit", "score", "num_comments", "permalink"),
            )
        )
    )
    details = members.groupBy("cluster").agg(
        F.min_by("subreddit", "place").alias("community"), shown.alias("top_posts")
    )
    ids = first_members(points, MEMBERS_SHOWN).groupBy("cluster").agg(F.array_sort(F.collect_list("post_id")).alias("post_ids"))
    keywords = keyword_labels(points, posts).withColumnRenamed("label", "keywords")
    named = (
        sizes.join(largest, "cluster", "left")
        .join(ids, "cluster", "left")
        .join(details, "cluster", "left")
        .join(keywords, "cluster", "left")
    )
    plain = F.when(F.col("is_large"), F.coalesce("keywords", F.lit(UNCATEGORIZED))).otherwise("Topic Group")
    base = F.when(
        plain.isin(*GENERIC_LABELS) & (F.coalesce("community", F.lit("")) != ""),
        F.concat(F.lit("r/"), F.col("community"), F.lit(" discussions")),
    ).otherwise(plain)
    named = named.withColumn("base", F.when(F.col("cluster") < 0, "Noise/Outliers").otherwise(base))
    repeat = F.row_number().over(W.partitionBy("base").orderBy(F.desc("size"), "cluster")) - 1
    label = F.when(repeat > 0, F.concat("base", F.lit(" ("), repeat.cast("string"), F.lit(")"))).otherwise(F.col("base"))
    return named.select(
        F.col("cluster").alias("cluster_id"), label.alias("label"), "size", "post_ids", "top_posts"
    ).orderBy(F.desc("size"), "cluster_id")


def posts_of_cluster(points: DataFrame, posts: DataFrame, cluster_id: int, limit: int = MEMBERS_SHOWN) -> DataFrame:
    """The first ``limit`` posts of one cluster in id order, highest score first; empty when the
    cluster does not exist."""
    chosen = points.filter(F.col("cluster") == cluster_id).orderBy("post_id").limit(limit).select("post_id")
    return (
        posts.join(chosen, "post_id")
        .select(
            "post_id", "title", clip(F.col("selftext"), 300).alias("selftext"), "author", "created_utc",
            "subreddit", "score", "num_comments", "permalink",
        )
        .orderBy(F.desc_nulls_last("score"), "post_id")
    )
