"""The questions a user of the dashboard asks, each as one function.

Every function takes stored tables and returns DataFrames. Nothing is collected except counts and
single rows that decide the next step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlens.functions import text
from murmurlens.operators import clustering, graph, labels, search, series, stats
from murmurlens.operators.components import connected_components
from murmurlens.operators.filters import checked_top_k
from murmurlens.operators.louvain import louvain
from murmurlens.operators.pagerank import pagerank
from murmurlens.runtime import stage

# Messages and limits of the reports.
NO_INTERACTIONS = "No interactions found in the dataset."
NO_POSTS = "No posts provided."
NO_CLUSTER = "Cluster not found or empty."
SERIES_HITS = 50
STORY_POSTS, STORY_SHOWN, STORY_CONTEXT = 30, 15, 15


# -- search ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SearchResult:
    """``report``: one row per query. ``hits``: ranked posts per query."""

    report: DataFrame
    hits: DataFrame

    def payload(self) -> DataFrame:
        """One nested row per query."""
        return search.search_payload(self.report, self.hits)


def search_posts(queries: DataFrame, vectors: DataFrame, posts: DataFrame, k: int = 10) -> SearchResult:
    hits = search.search(queries, vectors, posts, k)
    return SearchResult(search.search_report(queries, hits), hits)


# -- time --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SeriesResult:
    points: DataFrame
    trend: DataFrame


def volume_over_time(posts: DataFrame, grain: str = "day", community: str | None = None) -> SeriesResult:
    """Volume of all posts or of one community, in date order, with a sentence about it."""
    points = series.volume(posts, grain, community)
    label = f"r/{community} activity" if community else "All posts activity"
    return SeriesResult(points.orderBy("date"), series.trend(points, label))


def engagement_over_time(posts: DataFrame, grain: str = "day", metric: str = "score") -> DataFrame:
    return series.engagement(posts, grain, metric).orderBy("date")


def volume_of_search(
    query: DataFrame, vectors: DataFrame, posts: DataFrame, k: int = SERIES_HITS,
    grain: str = "day", community: str | None = None,
) -> SeriesResult:
    """Volume over time of the posts that one query finds. ``query`` has a single row; its hits
    stay in the cluster."""
    asked = query.filter(F.col("text").isNotNull())
    hits = search.search(asked, vectors, posts, checked_top_k(k))
    points = series.volume(hits, grain, community)
    label = F.coalesce(F.lit(query.select(F.trim("text")).first()[0]), F.lit(""))
    return SeriesResult(points.orderBy("date"), series.trend(points, label))


# -- network -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class GraphResult:
    nodes: DataFrame
    edges: DataFrame
    totals: DataFrame
    components: DataFrame
    message: str | None = None


def build_graph(posts: DataFrame) -> GraphResult:
    """The full graph with ranks, communities and components, written as tables."""
    authors = stage(graph.author_nodes(posts), "authors")
    edges = stage(graph.build_edges(posts), "edges")
    nodes = stage(graph.assemble_nodes(authors, pagerank(authors, edges), louvain(authors, edges)), "nodes")
    components = stage(graph.component_table(connected_components(authors, edges)), "components")
    return GraphResult(nodes, edges, graph.graph_totals(nodes, edges), components)


def filter_graph(
    full: GraphResult, min_pagerank: float = 0.0, community: str | None = None, max_nodes: int = graph.MAX_NODES
) -> GraphResult:
    """The best-ranked nodes that pass the filters and the edges among them. Components stay those
    of the full graph."""
    nodes = graph.top_nodes(graph.filter_nodes(full.nodes, min_pagerank, community), max_nodes)
    nodes = stage(nodes, "chosen-nodes")
    edges = graph.induced_edges(full.edges, nodes)
    message = NO_INTERACTIONS if min_pagerank == 0.0 and nodes.isEmpty() else None
    return GraphResult(nodes, edges, graph.graph_totals(nodes, edges), full.components, message)


def graph_of_posts(full: GraphResult, posts: DataFrame, ids: DataFrame) -> GraphResult:
    """The authors of the listed posts, the edges among them and the components they form."""
    authors = graph.authors_of(posts, ids)
    nodes = stage(full.nodes.join(authors, "id", "left_semi"), "post-nodes")
    edges = stage(graph.induced_edges(full.edges, nodes), "post-edges")
    components = graph.component_table(connected_components(nodes, edges))
    message = NO_POSTS if ids.isEmpty() else None
    return GraphResult(nodes, edges, graph.graph_totals(nodes, edges), components, message)


# -- clusters ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class ClusterResult:
    """``clusters``: named clusters, largest first. ``clustering``: points and the method used."""

    clusters: DataFrame
    clustering: clustering.Clustering


def topic_clusters(vectors: DataFrame, posts: DataFrame, n_clusters: int | None = None, **options) -> ClusterResult:
    found = clustering.run_clustering(vectors, n_clusters, **options)
    return ClusterResult(labels.name_clusters(found.points, posts), found)


def cluster_posts(found: clustering.Clustering, posts: DataFrame, cluster_id: int, limit: int = 20) -> tuple[DataFrame, str | None]:
    """Posts of one cluster and a message when there are none."""
    chosen = labels.posts_of_cluster(found.points, posts, cluster_id, limit)
    return chosen, NO_CLUSTER if chosen.isEmpty() else None


# -- case study --------------------------------------------------------------------------------


@dataclass(frozen=True)
class CaseStudy:
    """``narrative``: one row with the digest sentence and the texts a writer needs."""

    topic: str
    narrative: DataFrame
    key_posts: DataFrame
    timeline: SeriesResult
    network: GraphResult
    breakdown: DataFrame


def story_narrative(topic: str, key_posts: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: digest, numbered text of the key posts and the network facts."""
    best_first = F.struct((-F.col("score")).alias("order"), "post_id", "created_utc", "subreddit", "author", "score", "title", "content")
    blocks = F.transform(F.slice(F.array_sort(F.collect_list(best_first)), 1, STORY_CONTEXT), text.story_block)
    counted = key_posts.agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_distinct("subreddit").alias("communities"),
        F.count_distinct("author").alias("authors"),
    )
    told = key_posts.agg(F.array_join(blocks, "\n\n").alias("context"))
    facts = totals.select(
        text.network_facts(
            F.col("total_nodes"), F.col("total_edges"), F.col("top_influencer"), F.col("top_pagerank"), F.col("num_communities")
        ).alias("network_facts")
    )
    return stats.one_row([counted, told, facts]).select(
        F.lit(topic).alias("topic"),
        text.case_digest(F.lit(topic), F.col("posts"), F.col("communities"), F.col("authors")).alias("narrative"),
        "context",
        "network_facts",
    )


def case_study(posts: DataFrame, full: GraphResult, topic: str) -> CaseStudy:
    """The highest-scored posts, who wrote them, when, and where engagement gathers."""
    key = stage(stats.key_posts(posts, STORY_POSTS), "key-posts")
    network = graph_of_posts(full, posts, key.select("post_id"))
    points = series.volume(key, "day")
    return CaseStudy(
        topic=topic,
        narrative=story_narrative(topic, key, network.totals),
        key_posts=key.orderBy(F.desc_nulls_last("score"), "post_id").limit(STORY_SHOWN),
        timeline=SeriesResult(points.orderBy("date"), series.trend(points, topic)),
        network=network,
        breakdown=stats.narrative_breakdown(posts),
    )
