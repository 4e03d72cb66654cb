import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurlens.operators import encode, inner_product, search
from murmurlens.operators import vectors as vectors_module
from murmurlens.operators.vectors import l2_normalize, top_k
from murmurlens.plans import reports
from murmurlens.sources import content_vectors
from murmurlens.sources import vectors as store
from tests.test_graph import make_posts


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(300, 16))
    matrix[200:] = matrix[0]  # a third of all vectors are copies of one
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    rows = [(f"p{i:03d}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return matrix, spark.createDataFrame(rows, "post_id string, embedding array<float>").repartition(5).cache()


def brute_force(matrix, queries, k):
    kept = matrix.astype(np.float32).astype(np.float64)
    result = {}
    for q in queries:
        scores = np.floor(kept @ kept[q] * 1e6 + 0.5) / 1e6
        order = sorted(range(len(kept)), key=lambda i: (-scores[i], i))[:k]
        result[q] = [(f"p{i:03d}", scores[i]) for i in order]
    return result


@pytest.mark.parametrize("shared", [4096, 7])
def test_top_k_is_exact_with_copies(data, shared):
    matrix, vectors = data
    asked = list(range(0, 300, 6))
    queries = vectors.filter((F.substring("post_id", 2, 3).cast("int") % 6) == 0).select(
        F.substring("post_id", 2, 3).cast("int").alias("query_id"), "embedding"
    )
    rows = top_k(queries, vectors, 7, max_queries=shared, rows_per_cell=64).orderBy("query_id", "rank").collect()
    got = {}
    for row in rows:
        got.setdefault(row["query_id"], []).append((row["post_id"], row["similarity_score"]))
    want = brute_force(matrix, asked, 7)
    assert got.keys() == want.keys()
    for q in asked:
        assert [p for p, _ in got[q]] == [p for p, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9)


def test_top_k_beyond_corpus_and_empty(data, spark):
    _, vectors = data
    few = vectors.filter("post_id < 'p003'")
    queries = few.select(F.lit(1).alias("query_id"), "embedding").limit(1)
    assert top_k(queries, few, 100).count() == 3
    assert top_k(queries.limit(0), few, 5).count() == 0
    assert top_k(queries, few.limit(0), 5).count() == 0


def test_search_report_and_payload(data, spark):
    _, vectors = data
    posts = make_posts(spark, [{"post_id": f"p{i:03d}", "title": f"t{i}", "content": "c" * 600, "author": "ann", "subreddit": f"s{i % 3}", "score": i} for i in range(250)])
    embedding = vectors.filter("post_id = 'p001'").select("embedding").first()[0]
    asked = spark.createDataFrame([(1, " topic ", embedding), (2, "  ", embedding), (3, "ab", embedding), (4, None, embedding)], "query_id int, text string, embedding array<float>")
    found = reports.search_posts(asked, vectors, posts, 1000)
    report = {r["query_id"]: r for r in found.report.collect()}
    assert report[2]["error"] and report[4]["error"] and report[2]["total_results"] == 0 and report[2]["follow_up_queries"] == []
    assert report[3]["warning"].startswith("Very short query ('ab')")
    assert report[1]["total_results"] == found.hits.filter("query_id = 1").count() == 250
    assert report[1]["summary"].startswith(f'Found {report[1]["total_results"]} posts related to "topic" across 3 subreddits.')
    assert report[1]["context"].startswith("[Post 1] r/s1 by u/ann (score: 1)\nTitle: t1\nContent: " + "c" * 300 + "\n\n---\n[Post 2]")
    first = found.hits.filter("query_id = 1 AND rank = 1").first()
    assert first["post_id"] == "p001" and first["similarity_score"] == 1.0 and len(first["content"]) == 500
    nested = {r["query_id"]: r["results"] for r in found.payload().collect()}
    assert [h["rank"] for h in nested[1]] == sorted(h["rank"] for h in nested[1]) and nested[2] is None
    nothing = reports.search_posts(asked.limit(1), vectors, posts.limit(0), 5).report.first()
    assert nothing["summary"] == 'No results found for the query: "topic"' and len(nothing["follow_up_queries"]) == 2


def test_volume_of_search(data, spark):
    _, vectors = data
    posts = make_posts(spark, [{"post_id": f"p{i:03d}", "subreddit": "s"} for i in range(300)]).withColumn("created_utc", F.lit("2024-01-03 10:00:00").cast("timestamp"))
    asked = vectors.filter("post_id = 'p001'").select(F.lit(1).alias("query_id"), F.lit("what").alias("text"), "embedding")
    result = reports.volume_of_search(asked, vectors, posts, 20)
    assert [tuple(r)[1] for r in result.points.collect()] == [20]
    assert result.trend.first()["summary"].startswith('The query "what" returned 20 posts.')


def test_normalize(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(l2_normalize(F.col("v")))
    assert [list(r[0]) for r in rows.collect()] == [[0.6, 0.8], [0.0, 0.0]]


def load_letter_counter():
    def encode_texts(texts):
        assert len(texts) <= 4
        return np.array([[t.count(c) for c in "abcd"] for t in texts], dtype=float)

    return encode_texts


def test_encode_with_own_model(spark):
    texts = spark.createDataFrame([(str(i), "ab" * i) for i in range(11)], "post_id string, content string")
    rows = {r["post_id"]: r["embedding"] for r in encode.encode_with(texts, load_letter_counter, batch=4).collect()}
    assert len(rows) == 11 and rows["3"] == pytest.approx([0.5**0.5, 0.5**0.5, 0, 0], abs=1e-6)
    assert rows["0"] == [0.0, 0.0, 0.0, 0.0]


def test_hashed_encoder_finds_shared_words(spark):
    texts = ["storm hits coast", "election results today", "cat pictures daily", "storm damage on the coast", ""]
    posts = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "post_id string, content string")
    model = encode.fit_hashed_encoder(posts)
    vectors = encode.encode_hashed(model, posts)
    again = {r[0]: r[1] for r in encode.encode_hashed(model, posts).collect()}
    lengths = {}
    for row in vectors.collect():
        assert len(row["embedding"]) == encode.DIMENSIONS and row["embedding"] == again[row["post_id"]]
        lengths[row["post_id"]] = np.linalg.norm(row["embedding"])
    assert all(abs(n - 1) < 1e-5 for n in lengths.values())
    asked = spark.createDataFrame([(1, "coast storm"), (2, " ")], "query_id int, text string")
    queries = encode.encode_queries(encode.encode_hashed(model, asked, "query_id", "text"), asked)
    assert set(queries.filter("query_id = 2").first()["embedding"]) == {0.0}
    hits = top_k(queries.filter("query_id = 1"), vectors, 2).collect()
    assert {h["post_id"] for h in hits} == {"0", "3"}


def test_vector_store(spark, tmp_path, data):
    _, vectors = data
    path = str(tmp_path / "vectors")
    posts = make_posts(spark, [{"post_id": f"p{i:03d}", "content": "x"} for i in range(6)])
    stored = store.save_vectors(vectors.filter("post_id < 'p004'"), path)
    gaps = store.vector_gaps(stored, posts, 16).first()
    assert (gaps["missing"], gaps["orphaned"], gaps["wrong_length"]) == (2, 0, 0)
    calls = []

    def encode_missing(texts):
        calls.append(texts.count())
        return texts.select("post_id", F.array_repeat(F.lit(0.25).cast("float"), 16).alias("embedding"))

    done = store.complete_vectors(posts, path, encode_missing, 16)
    assert calls == [2] and done.count() == 6
    assert store.complete_vectors(posts, path, encode_missing, 16).count() == 6 and calls == [2]
    assert tuple(store.vector_gaps(done, posts, 16).first()) == (0, 0, 0)
    assert tuple(store.vector_gaps(done, posts.limit(0), 8).first()) == (0, 6, 6)
    fewer = store.complete_vectors(posts.filter("post_id <> 'p001'"), path, encode_missing, 16)
    assert sorted(r["post_id"] for r in fewer.collect()) == ["p000", "p002", "p003", "p004", "p005"]
    with pytest.raises(ValueError):
        store.save_vectors(vectors.limit(0), path)
    assert search.with_posts(vectors.filter("post_id < 'p006'").select("post_id"), posts).count() == 6


def test_blank_queries_and_negative_scores(spark):
    asked = spark.createDataFrame([(1, "\t\n"), (2, " "), (3, "word")], "query_id int, text string")
    encoded = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 3)], "query_id int, embedding array<float>")
    got = {r["query_id"]: list(r["embedding"]) for r in encode.encode_queries(encoded, asked, dimensions=2).collect()}
    assert got == {1: [0.0, 0.0], 2: [0.0, 0.0], 3: [1.0, 0.0]}
    assert vectors_module._rounded(np.array([-0.0000015, 0.0000015, -0.25])).tolist() == [-0.000002, 0.000002, -0.25]


def test_vectors_follow_the_content(spark, tmp_path):
    path = str(tmp_path / "by-content")
    rows = [{"post_id": f"p{i:03d}", "content": f"text {i % 20}"} for i in range(60)] + [{"post_id": "blank", "content": " "}]
    calls = []

    def encoder(dimensions):
        def encode_texts(texts):
            calls.append(texts.count())
            return texts.select("post_id", F.array_repeat(F.xxhash64("content").cast("float"), dimensions).alias("embedding"))

        return encode_texts

    def found(posts, dimensions=8, **how):
        done = content_vectors.vectors_by_content(make_posts(spark, posts), path, encoder(dimensions), dimensions, **how)
        return {r["post_id"]: tuple(r["embedding"]) for r in done.vectors.collect()}, done.encoded

    first, encoded = found(rows)
    assert len(first) == 61 and encoded == 21 and len(set(first.values())) == 21
    changed = [dict(row, content="a new text") if row["post_id"] == "p007" else row for row in rows]
    second, encoded = found(changed)
    assert encoded == 1 and calls == [21, 1]
    assert {k for k in first if first[k] != second[k]} == {"p007"}
    assert found(rows[:5] + changed)[1] == 0 and calls == [21, 1]
    store = content_vectors.vector_store(spark, path)
    assert store.snapshot().rows == 22
    content_vectors.forget_unused(make_posts(spark, rows[:10]), path)
    assert store.snapshot().rows == 10 and found(rows[:10]) == ({k: first[k] for k in list(first) if k in {r["post_id"] for r in rows[:10]}}, 0)
    other, encoded = found(rows, 4)
    assert encoded == 21 and {len(v) for v in other.values()} == {4}
    assert found(rows, 4, rebuild=True)[1] == 21
    nobody = content_vectors.vectors_by_content(make_posts(spark, rows).limit(0), path, encoder(4), 4)
    assert nobody.encoded == 0 and nobody.vectors.count() == 0


def test_many_queries_meet_few_blocks(spark):
    """Clustered items of very different lengths, a third of them copies of one vector."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(25, 12)) * 10
    points = centres[rng.integers(0, 25, 900)] + rng.normal(size=(900, 12)) * 0.3
    points = np.vstack([points * rng.uniform(0.5, 2.0, (900, 1)), np.repeat(points[:1], 450, axis=0), np.zeros((3, 12))]).astype(np.float32).astype(float)
    asked = np.vstack([centres[rng.integers(0, 25, 300)] + rng.normal(size=(300, 12)) * 0.3, np.zeros((1, 12)), -centres[:5]]).astype(np.float32).astype(float)
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "post_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(asked)], "query_id string, embedding array<float>").repartition(2)
    got = {(r["query_id"], r["rank"]): (r["post_id"], r["similarity_score"]) for r in top_k(queries, items, 6, max_queries=50, rows_per_cell=30).collect()}
    scores = asked @ points.T
    rounded = np.sign(scores) * np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6
    for i in range(len(asked)):
        order = np.lexsort((np.arange(len(points)), -rounded[i]))[:6]
        assert [got[f"q{i}", n + 1] for n in range(6)] == [(j, pytest.approx(rounded[i, j], abs=2e-6)) for j in order.tolist()]
    assert len(got) == 6 * len(asked)
    schema = T.StructType.fromDDL("query_id string, post_id long, similarity_score double")
    _, met, index = inner_product.pruned_scores(queries, items, 6, "query_id", "post_id", schema, 50, 30)
    assert met.count() < 0.2 * len(asked) * index.blocks.count()


def test_second_round_returns_what_reaches_the_first(spark):
    """Without structure each query meets most blocks; only items that reach its threshold come back."""
    rng = np.random.default_rng(11)
    points = rng.normal(size=(1500, 6)).astype(np.float32).astype(float)
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "post_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(points[:200])], "query_id string, embedding array<float>").repartition(2)
    schema = T.StructType.fromDDL("query_id string, post_id long, similarity_score double")
    partial, met, _ = inner_product.pruned_scores(queries, items, 6, "query_id", "post_id", schema, 50, 50)
    found = {}
    for row in partial.collect():
        found.setdefault(row["query_id"], []).append((-row["similarity_score"], row["post_id"]))
    floors = {row["query_id"]: row["floor"] for row in met.select("query_id", "floor").collect()}
    assert met.count() > 5 * 200 and len(floors) == 200
    assert all(-loss >= floors[query] for query, hits in found.items() for loss, _ in hits)
    scores = np.round(points[:200] @ points.T, 6)
    for i in range(200):
        assert [n for _, n in sorted(found[f"q{i}"])[:6]] == np.lexsort((np.arange(1500), -scores[i]))[:6].tolist()


def test_vectors_are_compared_by_hashes(spark):
    from checks.catalog import _marked

    vectors = [("a", [0.0, 0.5]), ("b", [-0.0, 0.5]), ("c", [0.5, 0.0]), ("d", []), ("e", None), ("f", [0.0, None]), (None, [0.5, 0.0])]
    frame = spark.createDataFrame(vectors, "post_id string, embedding array<float>")
    marked = _marked(frame, "own")
    assert marked.schema.simpleString() == "struct<post_id:string,own:struct<h0:bigint,h1:bigint>>"
    marks = {row.post_id: row.own for row in marked.collect()}
    assert marks["a"] == marks["b"] and marks["c"] == marks[None] and marks["e"] is None
    assert len({marks[k] for k in "acdf"}) == 4 and all(marks[k].h0 != marks[k].h1 for k in "acdf")
