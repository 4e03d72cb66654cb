"""The author interaction graph: nodes, weighted undirected edges, selections from both.

Edges are stored once with ``src < dst``. A crosspost of somebody else's post weighs 3, a
community shared with a neighbour in its author list weighs 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurlens.operators.filters import people_only, with_ids
from murmurlens.operators.ordering import with_global_index
from murmurlens.operators.skew import spread_join
from murmurlens.operators.stats import one_row
from murmurlens.runtime import stage

# Edge weights, size above which a community links nobody, neighbours per author.
CROSSPOST_WEIGHT = 3
SHARED_COMMUNITY_WEIGHT = 1
NEIGHBOURS = 24
BUCKET_ROWS = 20_000
MAX_NODES = 250


def author_nodes(posts: DataFrame) -> DataFrame:
    """``(id, post_count, total_score, subreddits)``, one row per author."""
    per_pair = (
        people_only(posts)
        .groupBy("author", "subreddit")
        .agg(F.count(F.lit(1)).alias("posts"), F.sum(F.coalesce("score", F.lit(0))).alias("scores"))
    )
    return per_pair.groupBy(F.col("author").alias("id")).agg(
        F.sum("posts").alias("post_count"),
        F.sum("scores").alias("total_score"),
        F.array_sort(F.collect_list("subreddit")).alias("subreddits"),
    )


def crosspost_pairs(posts: DataFrame) -> DataFrame:
    """``(src, dst, crossposts)``: authors who shared each other's posts.

    Shares are counted per (parent, author) before the join; a parent shared by a large part of
    all posts is dealt over several tasks.
    """
    people = people_only(posts).filter(F.col("author") != "")
    shares = (
        people.filter(F.col("crosspost_parent") != "")
        .groupBy(F.replace("crosspost_parent", F.lit("t3_"), F.lit("")).alias("parent_id"), "author")
        .agg(F.count(F.lit(1)).alias("shares"))
    )
    parents = people.select(F.col("post_id").alias("parent_id"), F.col("author").alias("parent_author"))
    pairs = spread_join(shares, parents, "parent_id", spread="author")
    return (
        pairs.filter(F.col("author") != F.col("parent_author"))
        .groupBy(
            F.least("author", "parent_author").alias("src"), F.greatest("author", "parent_author").alias("dst")
        )
        .agg(F.sum("shares").alias("crossposts"))
    )


def coactivity_pairs(posts: DataFrame, max_authors: int | None = None, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``(src, dst)`` per shared community: each author with the next authors of the sorted list.

    All (community, author) pairs are sorted together and cut into buckets of a fixed number of
    rows, so a community of any size is spread over as many tasks as it needs. The first rows of a
    bucket are also given to the one before it, whose last authors they follow. ``max_authors``
    leaves out larger communities where that is wanted.
    """
    members = people_only(posts).select("subreddit", "author").distinct()
    if max_authors is not None:
        members = stage(members, "members")
        sizes = members.groupBy("subreddit").agg(F.count(F.lit(1)).alias("authors"))
        members = members.join(sizes.filter(F.col("authors") <= max_authors).select("subreddit"), "subreddit", "left_semi")
    rows = max(BUCKET_ROWS, neighbours)
    placed = with_global_index(members, "subreddit", "author").withColumn("bucket", F.floor(F.col("index") / rows))
    ahead = placed.filter((F.col("index") % rows < neighbours) & (F.col("bucket") > 0)).withColumn("bucket", F.col("bucket") - 1)
    both = placed.withColumn("own", F.lit(True)).unionByName(ahead.withColumn("own", F.lit(False)))
    following = W.partitionBy("bucket", "subreddit").orderBy("index").rowsBetween(1, neighbours)
    listed = both.select("own", F.col("author").alias("src"), F.collect_list("author").over(following).alias("next"))
    return listed.filter("own").select("src", F.explode("next").alias("dst"))


def interaction_edges(crossposts: DataFrame, coactivity: DataFrame) -> DataFrame:
    shared = coactivity.select("src", "dst", F.lit(0).cast("bigint").alias("crossposts"), F.lit(1).cast("bigint").alias("shared"))
    both = crossposts.withColumn("shared", F.lit(0).cast("bigint")).unionByName(shared)
    summed = both.groupBy("src", "dst").agg(
        F.sum("crossposts").alias("crosspost_count"), F.sum("shared").alias("cosubreddit_count")
    )
    weight = CROSSPOST_WEIGHT * F.col("crosspost_count") + SHARED_COMMUNITY_WEIGHT * F.col("cosubreddit_count")
    return summed.select("src", "dst", weight.alias("weight"), "crosspost_count", "cosubreddit_count")


def build_edges(posts: DataFrame) -> DataFrame:
    return interaction_edges(crosspost_pairs(posts), coactivity_pairs(posts))


def symmetric(edges: DataFrame, *columns: str) -> DataFrame:
    """Both directions of every undirected edge."""
    return edges.select("src", "dst", *columns).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns)
    )


def assemble_nodes(nodes: DataFrame, ranks: DataFrame, communities: DataFrame) -> DataFrame:
    """Node attributes with rank (six decimals) and community; 0 where missing."""
    return (
        nodes.join(ranks.select("id", "pagerank"), "id", "left")
        .join(communities.select("id", "community"), "id", "left")
        .select(
            "id",
            F.col("id").alias("label"),
            "post_count",
            "total_score",
            "subreddits",
            F.coalesce(F.round("pagerank", 6), F.lit(0.0)).alias("pagerank"),
            F.coalesce("community", F.lit("0")).alias("community"),
        )
    )


def top_nodes(nodes: DataFrame, limit: int = MAX_NODES) -> DataFrame:
    return nodes.orderBy(F.desc("pagerank"), "id").limit(limit)


def filter_nodes(nodes: DataFrame, min_pagerank: float = 0.0, community: str | None = None) -> DataFrame:
    kept = nodes.filter(F.col("pagerank") >= min_pagerank)
    return kept if community is None else kept.filter(F.col("community") == community)


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``. Each end is a semi-join on unique ids that is skewed
    only on the edge side, which the planner splits at run time."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    ).select(*edges.columns)


def authors_of(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct authors of the listed posts, deleted accounts left out."""
    listed = with_ids(posts.select("post_id", "author"), ids)
    return listed.filter(F.col("author").isNotNull() & (F.col("author") != "[deleted]")).select(
        F.col("author").alias("id")
    ).distinct()


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node, edge and community counts and the top influencer (null and 0 when empty)."""
    top = nodes.orderBy(F.desc("pagerank"), "id").limit(1)
    row = one_row(
        [
            nodes.agg(F.count(F.lit(1)).alias("total_nodes")),
            nodes.select("community").distinct().agg(F.count(F.lit(1)).alias("num_communities")),
            edges.agg(F.count(F.lit(1)).alias("total_edges")),
            top.select(F.col("id").alias("top_influencer"), F.col("pagerank").alias("top_pagerank")),
        ]
    )
    return row.select(
        "total_nodes", "total_edges", "num_communities", "top_influencer",
        F.coalesce("top_pagerank", F.lit(0.0)).alias("top_pagerank"),
    )


def component_table(components: DataFrame, members: int = 20) -> DataFrame:
    """``(component, size, nodes)`` with the first ``members`` ids.

    Sizes are combined map-side; the rank limit prunes every task to ``members`` rows per
    component before ids are gathered.
    """
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    place = F.row_number().over(W.partitionBy("component").orderBy("id"))
    first = (
        components.withColumn("place", place)
        .filter(F.col("place") <= members)
        .groupBy("component")
        .agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    )
    return sizes.join(first, "component").select("component", "size", "nodes")


