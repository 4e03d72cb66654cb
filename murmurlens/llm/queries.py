"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlens.llm import chats, context_tree, divergence, html, jaccard, language, packing, pivots, quality, sentencepieces, sharding, token_files, trie
from murmurlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
END_ID = 1


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = token_files.token_folder(docs)
    manifest = token_files.write_shards(docs, tokenizer("word_bpe_49k.json"), END_ID, folder)
    return token_files.read_documents(manifest, folder, token_files.crc_of, "long").withColumnRenamed("value", "ids_crc32")


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), END_ID)


CHATS_SQL = r"""
WITH cleaned AS (SELECT DISTINCT conv_id, turn, COALESCE(role, 'user') AS role, COALESCE(text, '') AS text,
    COALESCE(CAST(conv_id AS VARCHAR), 'row ' || md5(COALESCE(CAST(turn AS VARCHAR), '') || chr(1) || COALESCE(role, 'user') || chr(1) || COALESCE(text, ''))) AS conv
  FROM conversations),
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS n FROM cleaned),
prefixes AS (SELECT conv, conv_id, n, COUNT(*) OVER (PARTITION BY conv) AS turns,
  LIST(role || chr(1) || text) OVER (PARTITION BY conv ORDER BY n) AS said FROM numbered),
kept AS (SELECT ARG_MIN(conv, (conv_id IS NULL, COALESCE(conv_id, 0), conv)) AS conv, said FROM prefixes WHERE n = turns GROUP BY said),
longer AS (SELECT DISTINCT said FROM prefixes WHERE n < turns),
maximal AS (SELECT conv FROM kept ANTI JOIN longer USING (said))
SELECT conv_id, COUNT(*) AS turns,
  STRING_AGG('<|im_start|>' || role || chr(10) || replace(replace(text, '<|im_start|>', '<' || chr(8205) || '|im_start|>'), '<|im_end|>', '<' || chr(8205) || '|im_end|>')
    || '<|im_end|>' || chr(10), '' ORDER BY n) AS rendered
FROM numbered SEMI JOIN maximal USING (conv) GROUP BY conv, conv_id
"""


@query("op8_chat_format", CHATS_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.format_chats(table(spark, sf_dir, "conversations"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.drop("text")


@query("op10_html_main_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages))


@query("op5_ngram_jaccard")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents"))


@query("op2_context_tree")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_documents(table(spark, sf_dir, "documents"))


@query("op6_pivot_permutation")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op11_vector_shards")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS doc, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
hits AS (SELECT doc, lang, source, UNNEST(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, COUNT(*) AS hits FROM hits GROUP BY lang, term HAVING COUNT(DISTINCT doc) >= 3),
counted AS (SELECT lang, source, term, COUNT(*) AS hits FROM hits SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, COUNT(*) AS v, SUM(hits) AS n FROM kept GROUP BY lang),
totals AS (SELECT g.lang, g.source, COALESCE(SUM(c.hits), 0) AS n FROM groups g LEFT JOIN counted c USING (lang, source) GROUP BY ALL),
grid AS (SELECT k.lang, t.source, k.term, COALESCE(c.hits, 0) AS hits,
    1 + CAST(1000000000 AS HUGEINT) * (COALESCE(c.hits, 0) + 1) // CAST(t.n + s.v AS HUGEINT) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (k.hits + 1) // CAST(s.n + s.v AS HUGEINT) AS whole
  FROM kept k JOIN totals t USING (lang) JOIN sizes s USING (lang) LEFT JOIN counted c ON c.lang = k.lang AND c.source = t.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, SUM((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
joint AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - whole) * (p - whole) // whole FROM grid WHERE hits > 0 AND p > whole),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM joint)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op13_source_divergence", DIVERGENCE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


TRIE_SQL = r"""
WITH turns AS (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
    ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(COALESCE(role, ''))) || ':' || COALESCE(role, '') || COALESCE(text, ''))) - 1 AS n
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, b: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(crc, b)),
    CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h FROM turns),
rebuilt AS (
  SELECT i.conv_id, 0 AS side, t.n, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 5 AND t.n < i.h
  UNION ALL SELECT i.conv_id, 1, t.n, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.n >= i.h),
said AS (SELECT i.conv_id, COALESCE(LIST({'role': r.role, 'text': r.text} ORDER BY r.side, r.n) FILTER (r.n IS NOT NULL), []) AS said
  FROM ids i LEFT JOIN rebuilt r USING (conv_id) GROUP BY i.conv_id),
members AS (SELECT conv_id, d, said[1:d] AS first, d = len(said) AS ends FROM (SELECT conv_id, said, UNNEST(range(len(said) + 1)) AS d FROM said)),
nodes AS (SELECT d, first, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs,
    (COUNT(*) - 1) * COALESCE(octet_length(encode(first[d].text)), 0) AS saved,
    sha256(COALESCE(STRING_AGG(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY d, first),
children AS (SELECT d - 1 AS d, first[1:d - 1] AS first, COUNT(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT n.*, COALESCE(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (d, first)),
above AS (SELECT UNNEST(range(d + 1)) AS k, first, saved, n_children FROM known),
sums AS (SELECT k AS d, first[1:k] AS first, SUM(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, SUM(saved) AS saved_tokens FROM above GROUP BY ALL)
SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM known k JOIN sums s USING (d, first) LEFT JOIN nodes p ON p.d = k.d - 1 AND p.first = k.first[1:k.d - 1]
"""


@query("op12_prefix_trie", TRIE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))
