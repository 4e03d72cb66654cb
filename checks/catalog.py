"""All registered queries, each next to the SQL it is compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.fixtures import Inputs, inputs
from checks.sql import BLANKS, with_parts
from murmurlens.functions import text
from murmurlens.functions.text import STOP_WORDS
from murmurlens.operators import clustering, filters, graph, ingest, labels, ordering, search, series, stats, vectors
from murmurlens.plans import reports
from murmurlens.runtime import stage
from murmurlens.schema import FIELD_CANDIDATES, POST_COLUMNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *parts: str):
    """Register a function of :class:`Inputs`; ``parts`` are the SQL parts that ``sql`` reads."""

    def add(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(inputs(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_parts(sql, *parts) if parts else sql
        return build

    return add


# -- posts: projections, filters, statistics ---------------------------------------------------

POSTS_COMPARED = [
    "post_id", "title", "selftext", "content", "author", "created_utc", "subreddit", "platform", "score",
    "num_comments", "num_crossposts", "crosspost_parent", "domain", "over_18",
]


@query("posts_table", f"SELECT {', '.join(POSTS_COMPARED)} FROM posts", "posts")
def _(tables):
    return tables.posts().select(*POSTS_COMPARED)


@query("people_posts", "SELECT post_id, author, score FROM people", "people")
def _(tables):
    return filters.people_only(tables.posts()).select("post_id", "author", "score")


@query(
    "dated_range",
    "SELECT MIN(created_utc) AS earliest, MAX(created_utc) AS latest FROM posts WHERE created_utc IS NOT NULL",
    "posts",
)
def _(tables):
    return filters.dated(tables.posts()).agg(
        F.min("created_utc").alias("earliest"), F.max("created_utc").alias("latest")
    )


@query(
    "clipped_text",
    """SELECT post_id, SUBSTRING(COALESCE(selftext, ''), 1, 500) AS text_500, SUBSTRING(COALESCE(content, ''), 1, 400) AS text_400,
       SUBSTRING(COALESCE(selftext, ''), 1, 300) AS text_300, SUBSTRING(COALESCE(content, ''), 1, 200) AS text_200,
       SUBSTRING(COALESCE(title, ''), 1, 120) AS text_120 FROM posts""",
    "posts",
)
def _(tables):
    return tables.posts().select(
        "post_id",
        text.clip(F.col("selftext"), 500).alias("text_500"),
        text.clip(F.col("content"), 400).alias("text_400"),
        text.clip(F.col("selftext"), 300).alias("text_300"),
        text.clip(F.col("content"), 200).alias("text_200"),
        text.clip(F.col("title"), 120).alias("text_120"),
    )


STATS_SQL = """SELECT COUNT(*) AS total_posts, COUNT(DISTINCT author) AS unique_authors,
       COUNT(DISTINCT subreddit) AS unique_subreddits, MIN(created_utc) AS start, MAX(created_utc) AS "end",
       ROUND(AVG(score), 2) AS avg_score,
       (SELECT title FROM posts ORDER BY score DESC, post_id LIMIT 1) AS top_title,
       (SELECT score FROM posts ORDER BY score DESC, post_id LIMIT 1) AS top_score,
       (SELECT author FROM posts ORDER BY score DESC, post_id LIMIT 1) AS top_author,
       (SELECT subreddit FROM posts ORDER BY score DESC, post_id LIMIT 1) AS top_subreddit
FROM posts"""


@query("dataset_stats", STATS_SQL, "posts")
def _(tables):
    return stats.dataset_stats(tables.posts()).select(
        "total_posts", "unique_authors", "unique_subreddits", "start", "end", "avg_score",
        *[F.col(f"top_post.{name}").alias(f"top_{name}") for name in ("title", "score", "author", "subreddit")],
    )


@query(
    "top_post",
    "SELECT post_id, title, score FROM posts ORDER BY score DESC, post_id LIMIT 1",
    "posts",
)
def _(tables):
    return stats.top_post(tables.posts().select("post_id", "title", "score"))


@query(
    "top_communities",
    "SELECT subreddit, COUNT(*) AS count FROM posts GROUP BY subreddit ORDER BY count DESC, subreddit LIMIT 10",
    "posts",
)
def _(tables):
    return stats.top_communities(tables.posts())


@query(
    "top_authors",
    "SELECT author, COUNT(*) AS count FROM people GROUP BY author ORDER BY count DESC, author LIMIT 10",
    "people",
)
def _(tables):
    return stats.top_authors(tables.posts())


@query(
    "community_activity",
    """SELECT subreddit, COUNT(*) AS count, ROUND(AVG(score), 2) AS avg_score
       FROM posts GROUP BY subreddit ORDER BY count DESC, subreddit LIMIT 50""",
    "posts",
)
def _(tables):
    return stats.community_activity(tables.posts())


@query(
    "narrative_breakdown",
    """SELECT subreddit, COUNT(*) AS post_count, CAST(SUM(score) AS BIGINT) AS total_score,
       CAST(SUM(num_comments) AS BIGINT) AS total_comments, CAST(SUM(num_crossposts) AS BIGINT) AS total_crossposts,
       ROUND(AVG(score), 2) AS avg_score
       FROM people GROUP BY subreddit ORDER BY total_score DESC, subreddit LIMIT 5""",
    "people",
)
def _(tables):
    return stats.narrative_breakdown(tables.posts())


@query(
    "key_posts",
    """SELECT post_id, title, SUBSTRING(selftext, 1, 300) AS selftext, SUBSTRING(content, 1, 400) AS content, author,
       created_utc, subreddit, score, num_comments, permalink, crosspost_parent
       FROM people ORDER BY score DESC, post_id LIMIT 30""",
    "people",
)
def _(tables):
    return stats.key_posts(tables.posts())


@query(
    "query_validation",
    f"""WITH asked AS (SELECT doc_id, 'body' AS part, text FROM documents
         UNION ALL SELECT doc_id, 'short', lang FROM documents
         UNION ALL SELECT doc_id, 'blank', REPEAT(' ', LEN(lang)) FROM documents
         UNION ALL SELECT d.doc_id, 'label', CAST(l.toxic AS VARCHAR) FROM documents d LEFT JOIN labels l USING (doc_id)),
       trimmed AS (SELECT *, COALESCE(TRIM(text, {BLANKS}), '') AS query FROM asked)
       SELECT doc_id, part, query, CASE WHEN query = '' THEN 'Query cannot be empty' END AS error,
         CASE WHEN LEN(query) BETWEEN 1 AND 2 THEN 'Very short query (''' || query || '''). Results may be broad. '
           || 'Try a more descriptive query for better results.' END AS warning FROM trimmed""",
)
def _(tables):
    documents, labels = tables.raw("documents"), tables.raw("labels").select("doc_id", "toxic")
    parts = {"body": F.col("text"), "short": F.col("lang"), "blank": F.expr("repeat(' ', length(lang))"), "label": F.col("toxic").cast("string")}
    asked = documents.join(labels, "doc_id", "left").select(
        "doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("text")) for k, v in parts.items()])).alias("asked")
    ).select("doc_id", "asked.part", "asked.text")
    return filters.validate_queries(asked).select("doc_id", "part", "query", "error", "warning")


# -- series ------------------------------------------------------------------------------------


def _series_sql(grain: str, source: str = "posts", where: str = "") -> str:
    return f"SELECT CAST(DATE_TRUNC('{grain}', created_utc) AS DATE) AS date, COUNT(*) AS count FROM {source} {where} GROUP BY 1"


for grain in ("day", "week"):
    query(f"volume_by_{grain}", _series_sql(grain), "posts")(
        lambda tables, grain=grain: series.volume(tables.posts(), grain)
    )
    for metric in ("score", "num_comments", "num_crossposts"):
        query(
            f"engagement_{metric}_by_{grain}",
            f"""SELECT CAST(DATE_TRUNC('{grain}', created_utc) AS DATE) AS date, COUNT(*) AS count,
                ROUND(AVG({metric}), 2) AS avg_metric, CAST(SUM({metric}) AS BIGINT) AS total_metric FROM posts GROUP BY 1""",
            "posts",
        )(lambda tables, grain=grain, metric=metric: series.engagement(tables.posts(), grain, metric))


@query("volume_of_community", _series_sql("day", where="WHERE subreddit = 'src7-en'"), "posts")
def _(tables):
    return series.volume(tables.posts(), "day", community="src7-en")


@query(
    "volume_of_id_set",
    _series_sql("week", where="WHERE post_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"),
    "posts",
)
def _(tables):
    ids = tables.raw("labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("post_id"))
    return series.volume_of(tables.posts(), ids, "week")


@query(
    "volume_of_no_ids",
    _series_sql("day", where="WHERE post_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic > 1)"),
    "posts",
)
def _(tables):
    ids = tables.raw("labels").filter("toxic > 1").select(F.col("doc_id").cast("string").alias("post_id"))
    return series.volume_of(tables.posts(), ids)


for grain in ("day", "week"):
    query(
        f"orders_volume_by_{grain}",
        f"SELECT CAST(DATE_TRUNC('{grain}', o_orderdate) AS DATE) AS date, COUNT(*) AS count FROM orders GROUP BY 1",
    )(
        lambda tables, grain=grain: series.volume(
            tables.raw("orders").select(F.col("o_orderdate").cast("timestamp").alias("created_utc")), grain
        )
    )


def _trend_sql(label: str, source: str) -> str:
    return f"""SELECT '{label}' AS query, COUNT(*) AS total_data_points, CAST(COALESCE(SUM(count), 0) AS BIGINT) AS total_posts,
       ARG_MIN(date, (-count, date)) AS peak_date, ARG_MIN(count, (-count, date)) AS peak_count,
       (SELECT COALESCE(STRING_AGG(date || ': ' || count, ', ' ORDER BY date), '')
        FROM (SELECT * FROM ({source}) ORDER BY date LIMIT 60)) AS data_text,
       CASE WHEN COUNT(*) = 0 THEN 'No time series data available for "{label}".'
            ELSE 'The query "{label}" returned ' || CAST(SUM(count) AS BIGINT) || ' posts. Peak activity was on '
                 || ARG_MIN(date, (-count, date)) || ' with ' || ARG_MIN(count, (-count, date)) || ' posts.' END AS summary
       FROM ({source}) s"""


@query("trend_of_all_posts", _trend_sql("All posts activity", _series_sql("day")), "posts")
def _(tables):
    return series.trend(series.volume(tables.posts()), "All posts activity")


@query(
    "trend_of_community",
    _trend_sql("r/src7-en activity", _series_sql("day", where="WHERE subreddit = 'src7-en'")),
    "posts",
)
def _(tables):
    return series.trend(series.volume(tables.posts(), community="src7-en"), "r/src7-en activity")


# -- ingest ------------------------------------------------------------------------------------

_SAMPLE_KEYS = """keys AS (SELECT UNNEST(['id', 'title', 'selftext', 'author', 'created_utc', 'subreddit', 'score',
  'num_comments', 'crosspost_parent', 'over_18']) AS source_key)"""
_INGESTED = {
    "title": f"TRIM(title, {BLANKS})",
    "selftext": f"TRIM(selftext, {BLANKS})",
    "content": f"TRIM(TRIM(title, {BLANKS}) || ' ' || TRIM(selftext, {BLANKS}), {BLANKS})",
    "created_utc": "DATE_TRUNC('second', created_utc)",
    "num_crossposts": "0",
    "domain": "''",
    "author_fullname": "''",
    "ups": "0",
    "downs": "0",
    "is_self": "FALSE",
    "link_flair_text": "''",
    "author_flair_text": "''",
}


@query(
    "ingest_posts",
    f"SELECT {', '.join(f'{_INGESTED.get(name, name)} AS {name}' for name in POST_COLUMNS)} FROM kept",
    "kept",
)
def _(tables):
    return tables.ingested().posts


@query(
    "ingest_counters",
    """SELECT COUNT(*) AS lines, COUNT(*) FILTER (NOT is_bad) AS valid, COUNT(*) FILTER (is_bad) AS skipped,
       COUNT(*) FILTER (NOT is_bad) - (SELECT COUNT(*) FROM kept) AS duplicates FROM lines""",
    "kept",
)
def _(tables):
    return tables.ingested().counters


@query(
    "ingest_summary",
    STATS_SQL.replace("total_posts", "total_records").replace("posts", "kept").replace("title FROM", f"TRIM(title, {BLANKS}) FROM")
    .replace("MIN(created_utc)", "DATE_TRUNC('second', MIN(created_utc))")
    .replace("MAX(created_utc)", "DATE_TRUNC('second', MAX(created_utc))")
    .replace("FROM kept", "FROM kept", 1).replace("\nFROM kept", ", (SELECT COUNT(*) FROM lines WHERE is_bad) AS skipped_records\nFROM kept"),
    "kept",
)
def _(tables):
    done = tables.ingested()
    return stats.ingest_summary(done.posts, done.counters).select(
        "total_records", "unique_authors", "unique_subreddits", "start", "end", "avg_score", "skipped_records",
        *[F.col(f"top_post.{name}").alias(f"top_{name}") for name in ("title", "score", "author", "subreddit")],
    )


@query(
    "ingest_line_status",
    """SELECT line_no % 1000000000 AS post_number, line_no >= 1000000000 AS is_repeat,
       CASE WHEN is_bad THEN 'malformed' ELSE 'valid' END AS status FROM lines""",
    "lines",
)
def _(tables):
    position = F.col("line_pos")
    rows = F.lit(10**11).cast("decimal(12,0)")
    number = F.floor(position / rows).cast("bigint") * 65_536 + (position % rows).cast("bigint")
    return ingest.parse_lines(tables.lines()).select(
        (number % 10**9).alias("post_number"), (number >= 10**9).alias("is_repeat"), "status"
    )


_CANDIDATE_ROWS = ", ".join(
    f"('{field}', '{key}', {rank})" for field, keys in FIELD_CANDIDATES.items() for rank, key in enumerate(keys)
)


@query(
    "ingest_field_map",
    f"""WITH {_SAMPLE_KEYS}, candidates(field, source_key, choice) AS (VALUES {_CANDIDATE_ROWS})
        SELECT field, ARG_MIN(source_key, choice) AS source_key FROM candidates JOIN keys USING (source_key) GROUP BY field""",
)
def _(tables):
    return ingest.detect_fields(tables.lines())


@query(
    "ingest_key_profile",
    f", {_SAMPLE_KEYS} SELECT source_key, (SELECT COUNT(*) FROM lines WHERE NOT is_bad) AS records FROM keys",
    "lines",
)
def _(tables):
    return ingest.profile_keys(tables.lines())


@query(
    "ingest_preview",
    """, head AS (SELECT *, ROW_NUMBER() OVER (ORDER BY line_no) AS record_no FROM lines WHERE NOT is_bad ORDER BY line_no LIMIT 3),
    cells AS (
      SELECT record_no, 'id' AS source_key, post_id AS v FROM head
      UNION ALL SELECT record_no, 'title', title FROM head
      UNION ALL SELECT record_no, 'selftext', selftext FROM head
      UNION ALL SELECT record_no, 'author', author FROM head
      UNION ALL SELECT record_no, 'created_utc', CAST(CAST(FLOOR(EPOCH(created_utc)) AS BIGINT) AS VARCHAR) FROM head
      UNION ALL SELECT record_no, 'subreddit', subreddit FROM head
      UNION ALL SELECT record_no, 'score', CAST(score AS VARCHAR) FROM head
      UNION ALL SELECT record_no, 'num_comments', CAST(num_comments AS VARCHAR) FROM head
      UNION ALL SELECT record_no, 'crosspost_parent', crosspost_parent FROM head
      UNION ALL SELECT record_no, 'over_18', CASE WHEN over_18 THEN 'True' ELSE 'False' END FROM head)
    SELECT record_no, source_key, CASE WHEN LEN(v) > 80 THEN SUBSTRING(v, 1, 80) || '...' ELSE v END AS preview FROM cells""",
    "lines",
)
def _(tables):
    return ingest.preview_records(tables.lines()).withColumn("record_no", F.col("record_no").cast("bigint"))


@query(
    "insert_or_ignore",
    """SELECT post_id, COUNT(*) AS rows FROM (
         SELECT post_id FROM posts WHERE author NOT IN ('[deleted]', 'AutoModerator') UNION SELECT post_id FROM kept) u
       GROUP BY post_id""",
    "kept",
)
def _(tables):
    from murmurlens.sources.posts import new_posts

    stored = filters.people_only(tables.posts())
    incoming = tables.ingested().posts.withColumn("position", F.col("post_id").cast("bigint"))
    fresh = new_posts(stored, incoming, "position")
    return (
        stored.select("post_id").unionByName(fresh.select("post_id")).groupBy("post_id").agg(F.count(F.lit(1)).alias("rows"))
    )


_LATER = "CAST(post_id AS BIGINT) % 100"


@query(
    "store_of_three_batches",
    f"""SELECT post_id, title FROM people
       UNION ALL SELECT post_id, TRIM(title, {BLANKS}) FROM kept WHERE post_id NOT IN (SELECT post_id FROM people)
       UNION ALL SELECT 'new' || post_id, title FROM posts WHERE {_LATER} = 1""",
    "people", "kept",
)
def _(tables):
    """A keyed store after people's posts, the ingested ones and a last batch of one per cent new and as
    many stored ids: what was stored first stays."""
    return tables.posts_store()[0].read().select("post_id", "title")


@query(
    "store_inserts",
    f"""SELECT 1 AS batch, COUNT(*) AS offered, COUNT(*) AS stored, 0 AS version FROM people
       UNION ALL SELECT 2, COUNT(*), COUNT(*) FILTER (post_id NOT IN (SELECT post_id FROM people)), 1 FROM kept
       UNION ALL SELECT 3, COUNT(*), COUNT(*) FILTER ({_LATER} = 1), 2 FROM posts WHERE {_LATER} < 2
         AND ({_LATER} = 1 OR post_id IN (SELECT post_id FROM people UNION SELECT post_id FROM kept))""",
    "people", "kept",
)
def _(tables):
    done = [(n, x.offered, x.stored, x.snapshot.version) for n, x in enumerate(tables.posts_store()[1], 1)]
    return tables.spark.createDataFrame(done, "batch int, offered long, stored long, version int")


# -- search ------------------------------------------------------------------------------------


@query(
    "unit_vectors",
    """SELECT post_id, ROUND(embedding[1] / SQRT(LIST_DOT_PRODUCT(embedding, embedding)), 6) AS first_component,
       ROUND(LIST_DOT_PRODUCT(embedding, embedding) / LIST_DOT_PRODUCT(embedding, embedding), 6) AS squared_length
       FROM vectors""",
    "vectors",
)
def _(tables):
    unit = vectors.l2_normalize(F.col("embedding"))
    return tables.vectors().select("post_id", unit.alias("unit")).select(
        "post_id",
        F.round(F.element_at("unit", 1), 6).alias("first_component"),
        F.round(vectors.dot(F.col("unit"), F.col("unit")), 6).alias("squared_length"),
    )


@query(
    "topic_vectors",
    "SELECT query_id, text, ARRAY_TO_STRING(LIST_TRANSFORM(embedding, lambda x: CAST(CAST(ROUND(x * 1e6) AS BIGINT) AS VARCHAR)), ',') AS micro FROM topics",
    "topics",
)
def _(tables):
    micro = F.transform("embedding", lambda x: F.round(x * 1e6).cast("bigint").cast("string"))
    return tables.topic_queries().select("query_id", "text", F.array_join(micro, ",").alias("micro"))


@query("nearest_to_topics", "SELECT * FROM topic_hits", "topic_hits")
def _(tables):
    return vectors.top_k(tables.topic_queries(), tables.vectors(), 50)


@query(
    "similar_posts",
    """SELECT * FROM (SELECT a.post_id AS query_id, b.post_id, ROUND(LIST_DOT_PRODUCT(a.embedding, b.embedding), 6) AS similarity_score,
         CAST(ROW_NUMBER() OVER (PARTITION BY a.post_id
           ORDER BY ROUND(LIST_DOT_PRODUCT(a.embedding, b.embedding), 6) DESC, b.post_id) AS INT) AS rank
       FROM vectors a, vectors b) s WHERE rank <= 10""",
    "vectors",
)
def _(tables):
    every = tables.vectors()
    return vectors.top_k(every.select(F.col("post_id").alias("query_id"), "embedding"), every, 10)


_HITS = """SELECT query_id, rank, post_id, similarity_score, title, SUBSTRING(selftext, 1, 500) AS selftext,
   SUBSTRING(content, 1, 500) AS content, author, created_utc, subreddit, score, num_comments, permalink, url,
   crosspost_parent, domain, upvote_ratio FROM hits"""


@query("search_hits", _HITS, "hits")
def _(tables):
    return search.search(tables.topic_queries(), tables.vectors(), tables.posts(), 50)


@query("similarity_percent", "SELECT query_id, rank, ROUND(similarity_score * 100, 1) AS percent FROM topic_hits", "topic_hits")
def _(tables):
    hits = vectors.top_k(tables.topic_queries(), tables.vectors(), 50)
    return hits.select("query_id", "rank", text.similarity_percent(F.col("similarity_score")).alias("percent"))


@query(
    "search_report",
    """SELECT q.query_id, q.text AS query, COUNT(h.post_id) AS total_results,
       CASE WHEN COUNT(h.post_id) = 0 THEN 'No results found for the query: "' || q.text || '"'
            ELSE 'Found ' || COUNT(h.post_id) || ' posts related to "' || q.text || '" across '
                 || COUNT(DISTINCT h.subreddit) || ' subreddits.' END AS summary,
       'How are communities responding to ' || q.text || '?|Key influencers discussing ' || q.text || '|Timeline of '
         || q.text || ' discussions' AS follow_up_queries,
       STRING_AGG('[Post ' || h.place || '] r/' || h.subreddit || ' by u/' || h.author || ' (score: ' || h.score || ')' || CHR(10)
         || 'Title: ' || h.title || CHR(10) || 'Content: ' || SUBSTRING(h.content, 1, 300) || CHR(10), CHR(10) || '---' || CHR(10)
         ORDER BY h.place) FILTER (h.place <= 10) AS context
       FROM topics q LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM hits) h USING (query_id)
       GROUP BY q.query_id, q.text""",
    "topics", "hits",
)
def _(tables):
    asked = tables.topic_queries()
    hits = search.search(asked, tables.vectors(), tables.posts(), 50)
    return search.search_report(asked, hits).select(
        "query_id", "query", "total_results", "summary", F.array_join("follow_up_queries", "|").alias("follow_up_queries"), "context"
    )


@query(
    "search_volume",
    "SELECT query_id, CAST(DATE_TRUNC('week', created_utc) AS DATE) AS date, COUNT(*) AS count FROM hits GROUP BY 1, 2",
    "hits",
)
def _(tables):
    hits = search.search(tables.topic_queries(), tables.vectors(), tables.posts(), 50)
    return search.search_volume(hits, "week")


# -- graph -------------------------------------------------------------------------------------


def _flat(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("subreddits", F.array_join("subreddits", ","))


@query("author_nodes", "SELECT * FROM authors", "authors")
def _(tables):
    return _flat(graph.author_nodes(tables.posts()))


@query("crosspost_pairs", "SELECT * FROM crossposts", "crossposts")
def _(tables):
    return graph.crosspost_pairs(tables.posts())


@query("coactivity_pairs", "SELECT src, dst, COUNT(*) AS shared FROM coactivity GROUP BY src, dst", "coactivity")
def _(tables):
    return graph.coactivity_pairs(tables.posts()).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared"))


@query("interaction_edges", "SELECT * FROM edges", "edges")
def _(tables):
    return graph.build_edges(tables.posts())


@query("pagerank", "SELECT * FROM ranks", "ranks")
def _(tables):
    from murmurlens.operators.pagerank import pagerank

    return pagerank(tables.authors(), tables.edges()).select("id", F.round("pagerank", 6).alias("pagerank"))


@query("connected_components", "SELECT * FROM components", "components")
def _(tables):
    from murmurlens.operators.components import connected_components

    return connected_components(tables.authors(), tables.edges())


@query(
    "component_table",
    """SELECT component, COUNT(*) AS size,
       (SELECT STRING_AGG(id, ',' ORDER BY id) FROM (SELECT id FROM components i WHERE i.component = c.component ORDER BY id LIMIT 20)) AS nodes
       FROM components c GROUP BY component""",
    "components",
)
def _(tables):
    return graph.component_table(tables.components()).withColumn("nodes", F.array_join("nodes", ","))


@query("louvain_communities")
def _(tables):
    from murmurlens.operators.louvain import louvain

    return louvain(tables.authors(), tables.edges())


@query("graph_nodes", "SELECT id, id AS label, * EXCLUDE (id) FROM nodes", "nodes")
def _(tables):
    return _flat(tables.nodes_by_component())


TOTALS = """SELECT (SELECT COUNT(*) FROM {n}) AS total_nodes, (SELECT COUNT(*) FROM {e}) AS total_edges,
   (SELECT COUNT(DISTINCT community) FROM {n}) AS num_communities,
   (SELECT id FROM {n} ORDER BY pagerank DESC, id LIMIT 1) AS top_influencer,
   COALESCE((SELECT MAX(pagerank) FROM {n}), 0) AS top_pagerank"""


@query("graph_totals", TOTALS.format(n="nodes", e="edges"), "nodes")
def _(tables):
    return graph.graph_totals(tables.nodes_by_component(), tables.edges())


@query("top_actors", "SELECT id, pagerank FROM nodes ORDER BY pagerank DESC, id LIMIT 5", "nodes")
def _(tables):
    return graph.top_nodes(tables.nodes_by_component(), 5).select("id", "pagerank")


FILTERED = """, chosen AS (SELECT * FROM nodes WHERE pagerank >= 0.0005 ORDER BY pagerank DESC, id LIMIT 250),
  inner_edges AS (SELECT * FROM edges WHERE src IN (SELECT id FROM chosen) AND dst IN (SELECT id FROM chosen)) """


@query("filtered_graph_nodes", FILTERED + "SELECT id, pagerank, community FROM chosen", "nodes")
def _(tables):
    kept = graph.filter_nodes(tables.nodes_by_component(), 0.0005)
    return graph.top_nodes(kept).select("id", "pagerank", "community")


@query("filtered_graph_edges", FILTERED + "SELECT * FROM inner_edges", "nodes")
def _(tables):
    kept = graph.top_nodes(graph.filter_nodes(tables.nodes_by_component(), 0.0005))
    return graph.induced_edges(tables.edges(), kept)


@query("filtered_graph_totals", FILTERED + TOTALS.format(n="chosen", e="inner_edges"), "nodes")
def _(tables):
    kept = graph.top_nodes(graph.filter_nodes(tables.nodes_by_component(), 0.0005))
    return graph.graph_totals(kept, graph.induced_edges(tables.edges(), kept))


STORY = """, story AS (SELECT post_id FROM people ORDER BY score DESC, post_id LIMIT 30),
  chosen AS (SELECT * FROM nodes WHERE id IN (SELECT author FROM posts WHERE post_id IN (SELECT post_id FROM story) AND author <> '[deleted]')),
  inner_edges AS (SELECT * FROM edges WHERE src IN (SELECT id FROM chosen) AND dst IN (SELECT id FROM chosen)) """
TOPIC = "Cross-community amplification"


def _stored_graph(tables: Inputs) -> reports.GraphResult:
    nodes, edges = tables.nodes_by_component(), tables.edges()
    components = graph.component_table(tables.components())
    return reports.GraphResult(nodes, edges, graph.graph_totals(nodes, edges), components)


def _case(tables: Inputs) -> reports.CaseStudy:
    if "case" not in tables.done:
        tables.done["case"] = reports.case_study(tables.posts(), _stored_graph(tables), TOPIC)
    return tables.done["case"]


@query("case_study_nodes", STORY + "SELECT id, pagerank, community FROM chosen", "nodes")
def _(tables):
    return _case(tables).network.nodes.select("id", "pagerank", "community")


@query("case_study_edges", STORY + "SELECT * FROM inner_edges", "nodes")
def _(tables):
    return _case(tables).network.edges


@query("case_study_totals", STORY + TOTALS.format(n="chosen", e="inner_edges"), "nodes")
def _(tables):
    return _case(tables).network.totals


@query(
    "case_study_key_posts",
    "SELECT post_id, score, author, subreddit FROM people ORDER BY score DESC, post_id LIMIT 15",
    "people",
)
def _(tables):
    return _case(tables).key_posts.select("post_id", "score", "author", "subreddit")


@query("case_study_timeline", STORY + _series_sql("day", where="WHERE post_id IN (SELECT post_id FROM story)"), "nodes")
def _(tables):
    return _case(tables).timeline.points


@query(
    "case_study_trend",
    STORY + _trend_sql(TOPIC, _series_sql("day", where="WHERE post_id IN (SELECT post_id FROM story)")),
    "nodes",
)
def _(tables):
    return _case(tables).timeline.trend


_STAMP = """CASE WHEN MICROSECOND(created_utc) % 1000000 = 0 THEN STRFTIME(created_utc, '%Y-%m-%d %H:%M:%S')
   ELSE STRFTIME(created_utc, '%Y-%m-%d %H:%M:%S.%f') END || '+00:00'"""


@query(
    "case_study_narrative",
    STORY
    + f""", told AS (SELECT p.* FROM people p JOIN story USING (post_id)), totals AS ({TOTALS.format(n="chosen", e="inner_edges")})
    SELECT '{TOPIC}' AS topic, 'Analysis of "{TOPIC}" reveals discussion across ' || (SELECT COUNT(DISTINCT subreddit) FROM told)
      || ' subreddits involving ' || (SELECT COUNT(DISTINCT author) FROM told) || ' unique authors.' AS narrative,
      (SELECT STRING_AGG('[' || {_STAMP} || '] r/' || subreddit || ' by u/' || author || ' (score: ' || score || ')' || CHR(10)
         || '  Title: ' || SUBSTRING(title, 1, 120) || CHR(10) || '  Content: ' || SUBSTRING(content, 1, 200), CHR(10) || CHR(10) ORDER BY score DESC, post_id)
       FROM (SELECT * FROM told ORDER BY score DESC, post_id LIMIT 15)) AS context,
      (SELECT 'Network analysis reveals:' || CHR(10) || '- ' || total_nodes || ' accounts involved' || CHR(10) || '- ' || total_edges
         || ' interactions' || CHR(10) || '- Top influencer: u/' || top_influencer || ' (PageRank: ' || PRINTF('%.4f', top_pagerank) || ')' || CHR(10)
         || '- ' || num_communities || ' distinct communities detected' || CHR(10) FROM totals) AS network_facts""",
    "nodes",
)
def _(tables):
    return _case(tables).narrative


# -- clusters ----------------------------------------------------------------------------------


@query(
    "cluster_summaries",
    """SELECT s.cluster_id, CASE WHEN s.cluster_id >= 0 THEN 'Cluster ' || s.cluster_id ELSE 'Noise/Outliers' END AS label, s.size,
       (SELECT STRING_AGG(post_id, ',' ORDER BY post_id) FROM placed p WHERE p.cluster_id = s.cluster_id AND place <= 20) AS post_ids
       FROM sizes s""",
    "sizes", "placed",
)
def _(tables):
    return clustering.cluster_summaries(tables.labelled()).withColumn("post_ids", F.array_join("post_ids", ","))


@query(
    "cluster_counts",
    """SELECT COUNT(*) AS total_points, COUNT(DISTINCT cluster) FILTER (cluster >= 0) AS n_clusters,
       COUNT(*) FILTER (cluster < 0) AS noise_points, COUNT(*) FILTER (cluster < 0) / COUNT(*)::DOUBLE AS noise_ratio FROM labelled""",
    "labelled",
)
def _(tables):
    return clustering.cluster_counts(tables.labelled())


@query(
    "cluster_members",
    """SELECT cluster_id AS cluster, CAST(place AS INT) AS place, post_id, title, SUBSTRING(selftext, 1, 300) AS selftext, author, created_utc,
       subreddit, score, num_comments, permalink FROM cluster_posts WHERE cluster_id >= 0""",
    "cluster_posts",
)
def _(tables):
    return labels.member_posts(tables.labelled(), tables.posts(), 10)


@query("cluster_keywords", "SELECT cluster_id AS cluster, label FROM keyword_labels", "keyword_labels")
def _(tables):
    return labels.keyword_labels(tables.labelled(), tables.posts())


@query(
    "cluster_names",
    """, base AS (SELECT s.cluster_id, s.size, CASE WHEN s.cluster_id < 0 THEN 'Noise/Outliers'
        ELSE k.label END AS base,
        (SELECT STRING_AGG(post_id, ',' ORDER BY place) FROM cluster_posts c WHERE c.cluster_id = s.cluster_id AND place <= 5 AND s.cluster_id >= 0) AS top_posts
      FROM sizes s LEFT JOIN keyword_labels k USING (cluster_id)
    ),
    numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY base ORDER BY size DESC, cluster_id) - 1 AS again FROM base)
    SELECT cluster_id, CASE WHEN again > 0 THEN base || ' (' || again || ')' ELSE base END AS label, size, top_posts FROM numbered""",
    "sizes", "keyword_labels", "cluster_posts",
)
def _(tables):
    named = labels.name_clusters(tables.labelled(), tables.posts())
    shown = F.array_join(F.transform("top_posts", lambda p: p["post_id"]), ",")
    return named.select("cluster_id", "label", "size", shown.alias("top_posts"))


@query(
    "posts_of_cluster",
    """SELECT p.post_id, p.title, SUBSTRING(p.selftext, 1, 300) AS selftext, p.author, p.created_utc, p.subreddit, p.score,
       p.num_comments, p.permalink FROM placed c JOIN posts p USING (post_id) WHERE c.cluster_id = 3 AND c.place <= 20""",
    "placed", "posts",
)
def _(tables):
    return labels.posts_of_cluster(tables.labelled(), tables.posts(), 3)


@query("posts_of_missing_cluster", "SELECT p.post_id FROM placed c JOIN posts p USING (post_id) WHERE c.cluster_id = 99", "placed", "posts")
def _(tables):
    return labels.posts_of_cluster(tables.labelled(), tables.posts(), 99).select("post_id")


@query(
    "nearest_centre",
    """SELECT post_id, CAST(ARG_MIN(query_id, (d, query_id)) AS INT) AS cluster, MIN(d) AS distance
       FROM (SELECT v.post_id, t.query_id, ROUND(LIST_DISTANCE(v.embedding, t.embedding), 6) AS d FROM vectors v, topics t) x GROUP BY post_id""",
    "vectors", "topics",
)
def _(tables):
    centres = tables.topic_queries().select(F.col("query_id").cast("int").alias("cluster"), "embedding")
    return clustering.nearest_centre(tables.vectors(), centres)


@query(
    "core_distances",
    """SELECT post_id, d AS core FROM (SELECT a.post_id, ROUND(LIST_DISTANCE(a.embedding, b.embedding), 6) AS d,
         ROW_NUMBER() OVER (PARTITION BY a.post_id ORDER BY ROUND(LIST_DISTANCE(a.embedding, b.embedding), 6)) AS r
       FROM vectors a JOIN vectors b ON a.post_id <> b.post_id) x WHERE r = 5""",
    "vectors",
)
def _(tables):
    return clustering.core_distances(tables.vectors())


@query(
    "density_clusters",
    """WITH RECURSIVE vectors AS MATERIALIZED (SELECT CAST(vec_id AS VARCHAR) AS post_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
    pairs AS MATERIALIZED (SELECT a.post_id AS a, b.post_id AS b, ROUND(LIST_DISTANCE(a.embedding, b.embedding), 6) AS d
      FROM vectors a JOIN vectors b ON a.post_id <> b.post_id),
    cores AS MATERIALIZED (SELECT a AS post_id, d AS core FROM (SELECT a, d, ROW_NUMBER() OVER (PARTITION BY a ORDER BY d) AS r FROM pairs) x WHERE r = 5),
    eps AS MATERIALIZED (SELECT core AS e FROM (SELECT core, ROW_NUMBER() OVER (ORDER BY core, post_id) - 1 AS i FROM cores) x
      WHERE i = (SELECT CAST(FLOOR(0.75 * (COUNT(*) - 1)) AS BIGINT) FROM cores)),
    dense AS MATERIALIZED (SELECT post_id FROM cores, eps WHERE core <= e),
    near AS MATERIALIZED (SELECT a, b FROM pairs, eps WHERE d <= e AND a IN (SELECT post_id FROM dense) AND b IN (SELECT post_id FROM dense)),
    reach AS (SELECT post_id AS id, post_id AS other FROM dense UNION SELECT r.id, n.b FROM reach r JOIN near n ON n.a = r.other),
    groups AS MATERIALIZED (SELECT id, MIN(other) AS component FROM reach GROUP BY id),
    numbered AS (SELECT component, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, component) - 1 AS number FROM groups GROUP BY component HAVING COUNT(*) >= 15)
    SELECT v.post_id, CAST(COALESCE(n.number, -1) AS INT) AS cluster FROM vectors v LEFT JOIN groups g ON g.id = v.post_id LEFT JOIN numbered n USING (component)""",
)
def _(tables):
    return clustering.density_clusters(tables.vectors())


@query("kmeans_clusters")
def _(tables):
    return clustering.kmeans(tables.vectors(), 10)


@query("projection")
def _(tables):
    return clustering.project_2d(tables.vectors())


@query("topic_clusters")
def _(tables):
    return reports.topic_clusters(tables.vectors(), tables.posts()).clusters.select("cluster_id", "label", "size")


@query(
    "systematic_sample",
    """SELECT post_id, cluster FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY post_id) - 1 AS i FROM labelled) x
       WHERE i % (SELECT CAST(CEIL(COUNT(*) / 100.0) AS BIGINT) FROM labelled) = 0""",
    "labelled",
)
def _(tables):
    return ordering.systematic_sample(tables.labelled(), wanted=100)


@query(
    "topic_words",
    f"""SELECT post_id, word, COUNT(*) AS n FROM (SELECT post_id, UNNEST(REGEXP_SPLIT_TO_ARRAY(LOWER(selftext), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM posts) t
       WHERE REGEXP_FULL_MATCH(word, '[a-z]{{4,}}') AND word NOT IN ({", ".join(f"'{word}'" for word in STOP_WORDS)}) GROUP BY post_id, word""",
    "posts",
)
def _(tables):
    words = tables.posts().select("post_id", F.explode(text.word_pieces(F.col("selftext"))).alias("word"))
    return words.filter(text.is_topic_word(F.col("word"))).groupBy("post_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "suggestion_lines",
    f"""SELECT doc_id, ARRAY_TO_STRING(LIST_SLICE(LIST_FILTER(LIST_TRANSFORM(STRING_SPLIT(text, CHR(10)), lambda x: TRIM(x, {BLANKS})),
       lambda x: LEN(x) > 5), 1, 3), '|') AS lines FROM documents""",
)
def _(tables):
    return tables.raw("documents").select("doc_id", F.array_join(text.parse_suggestions(F.col("text")), "|").alias("lines"))


@query(
    "tidy_labels",
    f"""SELECT doc_id, CASE WHEN LEN(words) > 7 THEN ARRAY_TO_STRING(words[1:5], ' ') ELSE bare END AS label
       FROM (SELECT doc_id, bare, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(bare, '\\s+'), lambda x: x <> '') AS words
             FROM (SELECT doc_id, TRIM(TRIM(TRIM(TRIM(text, {BLANKS}), '"'), ''''), {BLANKS}) AS bare FROM documents) t) u""",
)
def _(tables):
    return tables.raw("documents").select("doc_id", text.tidy_label(F.col("text")).alias("label"))


# -- encoding ----------------------------------------------------------------------------------


@query("encoded_posts", "SELECT post_id, 384 AS dimensions, CAST(1.0 AS DOUBLE) AS squared_length FROM posts", "posts")
def _(tables):
    encoded = tables.encoded_posts()
    return encoded.select("post_id", F.size("embedding").alias("dimensions"), F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("squared_length"))


@query("search_by_text")
def _(tables):
    from murmurlens.operators import encode

    asked = tables.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")
    encoded = encode.encode_hashed(tables.encoder(), asked, key="query_id", text="text")
    queries = encode.encode_queries(encoded, asked)
    return search.search(queries, tables.encoded_posts(), tables.posts(), 10).select("query_id", "rank", "post_id", "similarity_score")


@query(
    "text_to_encode",
    f"SELECT post_id, CASE WHEN TRIM(content, {BLANKS}) = '' THEN '[empty]' ELSE content END AS text FROM posts",
    "posts",
)
def _(tables):
    return tables.posts().select("post_id", text.text_to_encode(F.col("content")).alias("text"))


@query(
    "vector_gaps",
    """SELECT (SELECT COUNT(*) FROM posts WHERE post_id NOT IN (SELECT post_id FROM vectors)) AS missing,
       (SELECT COUNT(*) FROM vectors WHERE post_id NOT IN (SELECT post_id FROM posts)) AS orphaned,
       (SELECT COUNT(*) FROM vectors WHERE LEN(embedding) <> 64) AS wrong_length""",
    "posts", "vectors",
)
def _(tables):
    from murmurlens.sources.vectors import vector_gaps

    return vector_gaps(tables.vectors(), tables.posts(), 64)


def _marked(vectors: DataFrame, name: str) -> DataFrame:
    """``(post_id, name)``: two hashes that are equal for equal vectors; null for none."""
    bits = F.struct(*[F.xxhash64(F.lit(n), "embedding").alias(f"h{n}") for n in (0, 1)])
    return vectors.select("post_id", F.when(F.col("embedding").isNotNull(), bits).alias(name))


@query(
    "vectors_by_content",
    f""", texts AS (SELECT CAST(post_id AS BIGINT) AS n, CASE WHEN TRIM(content, {BLANKS}) = '' THEN '[empty]' ELSE content END AS text FROM posts)
       SELECT 1 AS round, COUNT(*) AS posts, COUNT(DISTINCT text) AS encoded, 0 AS other_vectors FROM texts
       UNION ALL SELECT 2, COUNT(*), COUNT(DISTINCT CASE WHEN n % 100 = 7 THEN text END), 0 FROM texts""",
    "posts",
)
def _(tables):
    """Encode all posts, then again after the text of one in a hundred changed; all other posts keep the
    vector that encoding them one by one gives."""
    from murmurlens.operators import encode
    from murmurlens.sources.content_vectors import vectors_by_content

    posts, path = tables.posts().select("post_id", "content"), f"{tables.stored.root}/content-vectors-{uuid.uuid4().hex}"
    number = F.col("post_id").cast("bigint") % 100
    changed = posts.withColumn("content", F.when(number == 7, F.concat("content", F.lit(" edited lately"))).otherwise(F.col("content")))
    done = []
    for n, given in enumerate((posts, changed), 1):
        found = vectors_by_content(given, path, lambda texts: encode.encode_hashed(tables.encoder(), texts), encode.DIMENSIONS)
        # Vectors are compared by 128 bits of each, so that only those are dealt out by post.
        both = _marked(found.vectors, "embedding").join(_marked(tables.encoded_posts(), "own"), "post_id")
        other = F.count_if((F.col("embedding") != F.col("own")) & ((number != 7) | F.lit(n == 1)))
        facts = both.agg(F.count(F.lit(1)).alias("posts"), other.alias("other")).first()
        done.append((n, facts["posts"], found.encoded, facts["other"]))
    return tables.spark.createDataFrame(done, "round int, posts long, encoded long, other_vectors int")


@query(
    "search_payload",
    """SELECT q.query_id, COUNT(h.post_id) AS results, ARG_MIN(h.post_id, h.rank) AS first_id, ARG_MAX(h.post_id, h.rank) AS last_id,
       MAX(h.similarity_score) AS best_score FROM topics q LEFT JOIN hits h USING (query_id) GROUP BY q.query_id""",
    "topics", "hits",
)
def _(tables):
    nested = reports.search_posts(tables.topic_queries(), tables.vectors(), tables.posts(), 50).payload()
    results = F.col("results")
    return nested.select(
        "query_id",
        F.coalesce(F.size(results), F.lit(0)).cast("bigint").alias("results"),
        F.try_element_at(results, F.lit(1))["post_id"].alias("first_id"),
        F.try_element_at(results, F.lit(-1))["post_id"].alias("last_id"),
        F.try_element_at(results, F.lit(1))["similarity_score"].alias("best_score"),
    )


_CHOICE_OF_50 = """CASE WHEN COUNT(*) < 50 THEN 'Requested 50 clusters, but dataset only has ' || COUNT(*) || ' points. Using ' || COUNT(*) || ' clusters instead.'
            WHEN 50 >= COUNT(*) // 2 THEN 'Warning: 50 clusters for ' || COUNT(*)
              || ' posts may produce very small or degenerate clusters. Results may not be meaningful.' END AS warning_for_50"""


def _choice(tables, density_limit: int | None):
    counted = tables.raw("embeddings").agg(F.count(F.lit(1)).alias("points"))
    points = counted.first()["points"]
    auto, fifty = clustering.choose_method(points, density_limit=density_limit), clustering.choose_method(points, 50)
    return counted.select(
        "points", F.lit(auto.method).alias("method"), F.lit(auto.warning).cast("string").alias("warning"),
        F.lit(fifty.warning).cast("string").alias("warning_for_50"),
    )


@query(
    "clustering_choice",
    f"""SELECT COUNT(*) AS points, CASE WHEN COUNT(*) = 0 THEN 'none' WHEN COUNT(*) > 1500 THEN 'kmeans' ELSE 'hdbscan' END AS method,
       CASE WHEN COUNT(*) = 0 THEN 'No embeddings available for clustering.'
            WHEN COUNT(*) > 1500 THEN 'Used KMeans (15 clusters) for performance on large dataset.' END AS warning,
       {_CHOICE_OF_50} FROM embeddings""",
)
def _(tables):
    """With the size limit of 1500 points for density clustering."""
    return _choice(tables, 1500)


@query(
    "clustering_choice_without_limit",
    f"""SELECT COUNT(*) AS points, CASE WHEN COUNT(*) = 0 THEN 'none' ELSE 'hdbscan' END AS method,
       CASE WHEN COUNT(*) = 0 THEN 'No embeddings available for clustering.' END AS warning, {_CHOICE_OF_50} FROM embeddings""",
)
def _(tables):
    """The default: density clustering at any size."""
    return _choice(tables, None)


# -- methods that SQL can't run: what must hold for their results, recomputed ------------------


@query("kmeans_check", "SELECT COUNT(*) AS points, 10 AS clusters, 0 AS misplaced FROM vectors", "vectors")
def _(tables):
    """After the last step every point is nearest to the mean of its own cluster."""
    found = clustering.kmeans(tables.vectors(), 10).join(tables.vectors(), "post_id")
    axes = found.select("cluster", F.posexplode("embedding").alias("axis", "x")).groupBy("cluster", "axis").agg(F.avg("x").alias("x"))
    centres = axes.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "x"))), lambda p: p["x"]).alias("embedding"))
    nearest = clustering.nearest_centre(tables.vectors(), centres).select("post_id", F.col("cluster").alias("nearest"))
    return found.join(nearest, "post_id").agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("cluster").cast("int").alias("clusters"),
        F.count_if(F.col("cluster") != F.col("nearest")).cast("int").alias("misplaced"),
    )


@query(
    "projection_check",
    """SELECT (SELECT COUNT(*) FROM vectors) AS points, TRUE AS centred, TRUE AS uncorrelated, TRUE AS ordered, TRUE AS widest""",
    "vectors",
)
def _(tables):
    """The plane is centred, its axes don't correlate, and no raw axis varies more than the first."""
    plane = clustering.project_2d(tables.vectors())
    raw = tables.vectors().select(F.posexplode("embedding").alias("axis", "v")).groupBy("axis").agg(F.var_pop("v").alias("v"))
    most = raw.agg(F.max("v")).first()[0]
    facts = plane.agg(
        F.count(F.lit(1)).alias("points"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.corr("x", "y").alias("r"),
        F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"),
    )
    return facts.select(
        "points", ((F.abs("mx") < 1e-4) & (F.abs("my") < 1e-4)).alias("centred"), (F.abs("r") < 1e-3).alias("uncorrelated"),
        (F.col("vx") >= F.col("vy")).alias("ordered"), (F.col("vx") >= F.lit(most * (1 - 1e-4))).alias("widest"),
    )


@query("topic_clusters_check", "SELECT 5 AS clusters, COUNT(*) AS points, 0 AS unnamed FROM vectors", "vectors")
def _(tables):
    """With a number asked for: as many clusters, every point in one, every cluster named."""
    found = reports.topic_clusters(tables.vectors(), tables.posts(), 5).clusters
    return found.agg(
        F.count(F.lit(1)).cast("int").alias("clusters"), F.sum("size").alias("points"),
        F.count_if(F.coalesce("label", F.lit("")) == "").cast("int").alias("unnamed"),
    )


@query(
    "search_by_text_check",
    "SELECT COUNT(*) * 10 AS hits, 0 AS wrong_scores, 0 AS gaps FROM benchmark",
)
def _(tables):
    """Each hit's score is the product of the two vectors; ranks run from 1 to 10 in score order."""
    from murmurlens.operators import encode

    asked = tables.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")
    queries = encode.encode_queries(encode.encode_hashed(tables.encoder(), asked, key="query_id", text="text"), asked)
    hits = search.search(queries, tables.encoded_posts(), tables.posts(), 10).select("query_id", "rank", "post_id", "similarity_score")
    asked_vectors = queries.select("query_id", F.col("embedding").alias("q"))
    post_vectors = tables.encoded_posts().select("post_id", F.col("embedding").alias("p"))
    product = F.aggregate(F.zip_with("q", "p", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    scored = hits.join(asked_vectors, "query_id").join(post_vectors, "post_id").withColumn("product", product)
    before = Window.partitionBy("query_id").orderBy("rank")
    placed = scored.withColumn("n", F.row_number().over(before)).withColumn("last", F.lag("similarity_score").over(before))
    return placed.agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if(F.abs(F.col("product") - F.col("similarity_score")) > 2e-6).cast("int").alias("wrong_scores"),
        F.count_if((F.col("n") != F.col("rank")) | (F.col("last") < F.col("similarity_score"))).cast("int").alias("gaps"),
    )


@query(
    "louvain_check",
    """SELECT (SELECT COUNT(*) FROM authors) AS nodes, 0 AS across_components, 0 AS misnamed, TRUE AS better_than_one""",
    "authors", "components",
)
def _(tables):
    """A community stays within a component and is named by its smallest member, and the partition
    is better than each component as one community."""
    from murmurlens.operators.louvain import louvain, modularity

    found = stage(louvain(tables.authors(), tables.edges()), "louvain-check")
    whole = tables.components().select("id", F.col("component").alias("community"))
    better = modularity(tables.edges(), found) >= modularity(tables.edges(), whole) - 1e-9
    per = found.join(tables.components(), "id").groupBy("community").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("component").alias("parts"), F.min("id").alias("least")
    )
    return per.agg(
        F.sum("n").alias("nodes"), F.count_if(F.col("parts") > 1).cast("int").alias("across_components"),
        F.count_if(F.col("least") != F.col("community")).cast("int").alias("misnamed"), F.lit(better).alias("better_than_one"),
    )
