"""Shared parts of the comparison SQL: each is one common table expression."""

from murmurlens.functions.clean import WHITESPACE
from murmurlens.functions.text import STOP_WORDS

CTES = {
    "parent": "SELECT text, MIN(doc_id) AS pid, COUNT(*) - 1 AS n FROM documents GROUP BY text",
    "posts": """
SELECT
  CAST(d.doc_id AS VARCHAR) AS post_id,
  SUBSTRING(d.text, 1, 80) AS title,
  d.text AS selftext,
  TRIM(CONCAT(SUBSTRING(d.text, 1, 80), ' ', d.text)) AS content,
  CASE WHEN e.user_id % 25 = 0 THEN '[deleted]'
       WHEN e.user_id % 25 = 1 THEN 'AutoModerator'
       ELSE CONCAT('u', CAST(e.user_id AS VARCHAR)) END AS author,
  e.ts AS created_utc,
  CONCAT(d.source, '-', d.lang) AS subreddit,
  'reddit' AS platform,
  CAST(FLOOR(e.value) AS INT) AS score,
  CAST(REGEXP_EXTRACT(e.props, '([0-9]+)', 1) AS INT) AS num_comments,
  CASE WHEN p.pid = d.doc_id THEN CAST(p.n AS INT) ELSE 0 END AS num_crossposts,
  CASE WHEN p.pid <> d.doc_id THEN CONCAT('t3_', CAST(p.pid AS VARCHAR)) ELSE '' END AS crosspost_parent,
  e.event_type AS domain,
  COALESCE(l.toxic, 0) = 1 AS over_18,
  '' AS permalink, '' AS url, 0.0::DOUBLE AS upvote_ratio
FROM documents d
JOIN events e ON e.event_id = d.doc_id * 5
JOIN parent p ON p.text = d.text
LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "people": "SELECT * FROM posts WHERE author NOT IN ('[deleted]', 'AutoModerator')",
    "members": "SELECT DISTINCT subreddit, author FROM people",
    "ranked_members": """
SELECT subreddit, author,
       ROW_NUMBER() OVER (PARTITION BY subreddit ORDER BY author) AS rn,
       COUNT(*) OVER (PARTITION BY subreddit) AS n
FROM members""",
    "coactivity": """
SELECT x.author AS src, y.author AS dst
FROM ranked_members x JOIN ranked_members y
  ON x.subreddit = y.subreddit AND y.rn BETWEEN x.rn + 1 AND x.rn + 24
WHERE x.n <= 2000""",
    "crossposts": """
SELECT LEAST(c.author, p.author) AS src, GREATEST(c.author, p.author) AS dst,
       CAST(COUNT(*) AS BIGINT) AS crossposts
FROM people c JOIN people p ON p.post_id = REPLACE(c.crosspost_parent, 't3_', '')
WHERE c.crosspost_parent <> '' AND c.author <> p.author AND c.author <> '' AND p.author <> ''
GROUP BY 1, 2""",
    "edges": """
SELECT src, dst, CAST(3 * SUM(xp) + SUM(co) AS BIGINT) AS weight,
       CAST(SUM(xp) AS BIGINT) AS crosspost_count, CAST(SUM(co) AS BIGINT) AS cosubreddit_count
FROM (SELECT src, dst, 0 AS xp, 1 AS co FROM coactivity
      UNION ALL SELECT src, dst, crossposts, 0 FROM crossposts) u
GROUP BY src, dst""",
    "authors": """
SELECT author AS id, CAST(COUNT(*) AS BIGINT) AS post_count, CAST(SUM(score) AS BIGINT) AS total_score,
       STRING_AGG(DISTINCT subreddit, ',' ORDER BY subreddit) AS subreddits
FROM people GROUP BY author""",
    "links": "SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges",
    "strength": "SELECT src, SUM(weight)::DOUBLE AS strength FROM links GROUP BY src",
    "size": "SELECT COUNT(*)::DOUBLE AS n FROM authors",
    "walk": """
SELECT 0 AS k, id, 1 / n AS r, 1e300 AS err FROM authors, size
UNION ALL
SELECT k + 1, id, nr, SUM(ABS(nr - r)) OVER () FROM (
  SELECT w.k, w.id, w.r, 0.15 / s.n + 0.85 * (COALESCE(i.inflow, 0) + d.dangling / s.n) AS nr
  FROM walk w CROSS JOIN size s
  CROSS JOIN (SELECT COALESCE(SUM(r), 0) AS dangling FROM walk WHERE id NOT IN (SELECT src FROM strength)) d
  LEFT JOIN (SELECT l.dst, SUM(l.weight * v.r / t.strength) AS inflow
             FROM walk v JOIN links l ON l.src = v.id JOIN strength t ON t.src = l.src GROUP BY l.dst) i
    ON i.dst = w.id
  WHERE w.err >= s.n * 1e-6 AND w.k < 100) step""",
    "ranks": "SELECT id, ROUND(r, 6) AS pagerank FROM walk WHERE k = (SELECT MAX(k) FROM walk)",
    "reach": """
SELECT id, id AS other FROM authors
UNION SELECT r.id, l.dst FROM reach r JOIN links l ON l.src = r.other""",
    "components": "SELECT id, MIN(other) AS component FROM reach GROUP BY id",
    "nodes": """
SELECT a.id, a.post_count, a.total_score, a.subreddits, r.pagerank, c.component AS community
FROM authors a JOIN ranks r USING (id) JOIN components c USING (id)""",
    "vectors": "SELECT CAST(vec_id AS VARCHAR) AS post_id, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "dimensions": """
SELECT label, i, AVG(embedding[i]) AS x
FROM (SELECT label, embedding, UNNEST(RANGE(1, LEN(embedding) + 1)) AS i FROM vectors) u
GROUP BY label, i""",
    "topics": """
SELECT CAST(label AS BIGINT) AS query_id, 'topic ' || label AS text,
       LIST(x / norm ORDER BY i) AS embedding
FROM (SELECT *, SQRT(SUM(x * x) OVER (PARTITION BY label)) AS norm FROM dimensions) d
GROUP BY label""",
    "scored": """
SELECT q.query_id, v.post_id, ROUND(LIST_DOT_PRODUCT(q.embedding, v.embedding), 6) AS similarity_score
FROM topics q, vectors v""",
    "topic_hits": """
SELECT * FROM (SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, post_id) AS INT)
                      AS rank, post_id, similarity_score FROM scored) s
WHERE rank <= 50""",
    "hits": "SELECT h.*, p.* EXCLUDE (post_id) FROM topic_hits h JOIN posts p USING (post_id)",
    "labelled": "SELECT post_id, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster FROM vectors",
    "sizes": "SELECT cluster AS cluster_id, COUNT(*) AS size FROM labelled GROUP BY cluster",
    "placed": """
SELECT cluster AS cluster_id, post_id, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY post_id) AS place
FROM labelled""",
    "cluster_posts": """
SELECT c.cluster_id, c.place, p.* FROM placed c JOIN posts p USING (post_id) WHERE c.place <= 10""",
    "words": f"""
SELECT cluster_id, word, place, pos FROM (
  SELECT cluster_id, place, UNNEST(parts) AS word, UNNEST(RANGE(LEN(parts))) AS pos
  FROM (SELECT cluster_id, place, REGEXP_SPLIT_TO_ARRAY(LOWER(title), '[^\\p{{L}}\\p{{N}}_]+') AS parts
        FROM placed JOIN posts USING (post_id) WHERE cluster_id >= 0) t) u
WHERE REGEXP_FULL_MATCH(word, '[a-z]{{4,}}')
  AND word NOT IN ({", ".join(f"'{word}'" for word in STOP_WORDS)})""",
    "top_words": """
SELECT cluster_id, word, n, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY n DESC, place, pos) AS r
FROM (SELECT cluster_id, word, COUNT(*) AS n, MIN(place) AS place, ARG_MIN(pos, (place, pos)) AS pos
      FROM words GROUP BY cluster_id, word) w""",
    "keyword_labels": """
SELECT cluster_id, STRING_AGG(UPPER(word[1]) || word[2:], ' & ' ORDER BY r) || ' Discussions' AS label
FROM top_words WHERE r <= 2 GROUP BY cluster_id""",
    "lines": """
SELECT CAST(post_id AS BIGINT) AS line_no, CAST(post_id AS BIGINT) % 70 = 0 AS is_bad, posts.* FROM posts
UNION ALL
SELECT CAST(post_id AS BIGINT) + 1000000000, FALSE, posts.* FROM posts WHERE CAST(post_id AS BIGINT) % 50 = 0""",
    "kept": """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY post_id ORDER BY line_no) AS copy FROM lines WHERE NOT is_bad) v
WHERE copy = 1""",
}
NEEDS = {
    "posts": ["parent"], "people": ["posts"], "members": ["people"], "ranked_members": ["members"],
    "coactivity": ["ranked_members"], "crossposts": ["people"], "edges": ["coactivity", "crossposts"],
    "authors": ["people"], "links": ["edges"], "strength": ["links"], "size": ["authors"],
    "walk": ["authors", "size", "links", "strength"], "ranks": ["walk"], "reach": ["authors", "links"],
    "components": ["reach"], "nodes": ["authors", "ranks", "components"],
    "dimensions": ["vectors"], "topics": ["dimensions"], "scored": ["topics", "vectors"],
    "topic_hits": ["scored"], "hits": ["topic_hits", "posts"], "labelled": ["vectors"], "sizes": ["labelled"],
    "placed": ["labelled"], "cluster_posts": ["placed", "posts"], "words": ["placed", "posts"],
    "top_words": ["words"], "keyword_labels": ["top_words"], "lines": ["posts"], "kept": ["lines"],
}
RECURSIVE = {"walk", "reach"}
BLANKS = "'" + WHITESPACE + "'"


def with_parts(body: str, *parts: str) -> str:
    """``body`` after the definitions of ``parts`` and all they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for need in NEEDS.get(name, []):
                visit(need)
            ordered.append(name)

    for part in parts:
        visit(part)
    head = "WITH RECURSIVE " if RECURSIVE & set(ordered) else "WITH "
    defined = ",\n".join(
        f"{name} AS {'' if name in RECURSIVE else 'MATERIALIZED '}({CTES[name].strip()})" for name in ordered
    )
    return f"{head}{defined}\n{body}"
