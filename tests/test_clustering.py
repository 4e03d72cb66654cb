import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurlens.operators import clustering, labels, neighbours
from murmurlens.plans import reports
from tests.test_graph import make_posts


def frame(spark, points):
    rows = [(f"p{i:03d}", [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "post_id string, embedding array<float>").repartition(3)


def groups():
    rng = random.Random(1)
    near = [(cx + rng.uniform(-1, 1), cy + rng.uniform(-1, 1)) for cx, cy in ((0, 0), (50, 0), (0, 50)) for _ in range(20)]
    return near + [(200 + 90 * i, 300.0) for i in range(5)]


def as_dict(points):
    return {row["post_id"]: row["cluster"] for row in points.collect()}


@pytest.mark.parametrize("cell", [2000, 9])
def test_density_clusters(spark, cell):
    got = as_dict(clustering.density_clusters(frame(spark, groups()), eps=3.0, rows_per_cell=cell))
    sets = [sorted(set(got[f"p{i:03d}"] for i in range(a, a + 20))) for a in (0, 20, 40)]
    assert sets == [[0], [1], [2]] and all(got[f"p{i:03d}"] == -1 for i in range(60, 65))


@pytest.mark.parametrize("cell", [2000, 11])
def test_core_distances_and_links_match_brute_force(spark, cell):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(size=(60, 5)), np.zeros((30, 5))]).astype(np.float32).astype(float)
    vectors = frame(spark, points)
    distances = np.round(np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)), 6)
    want = {f"p{i:03d}": sorted(np.delete(distances[i], i))[4] for i in range(90)}
    got = {r["post_id"]: r["core"] for r in clustering.core_distances(vectors, rows_per_cell=cell).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    links = clustering.density_links(vectors, 1.6, rows_per_cell=cell).collect()
    parent = list(range(90))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(90):
        for j in range(i):
            if distances[i, j] <= 1.6:
                parent[root(i)] = root(j)
    want_groups = {frozenset(j for j in range(90) if root(j) == root(i)) for i in range(90)}
    parent = list(range(90))
    for link in links:
        i, j = int(link["src"][1:]), int(link["dst"][1:])
        assert distances[i, j] <= 1.6
        parent[root(i)] = root(j)
    assert {frozenset(j for j in range(90) if root(j) == root(i)) for i in range(90)} == want_groups
    assert len(links) < 90 * math.ceil(90 / cell) * 2


def test_kmeans_and_nearest_centre(spark):
    vectors = frame(spark, groups()[:60])
    got = as_dict(clustering.kmeans(vectors, 3, restarts=3))
    assert [len({got[f"p{i:03d}"] for i in range(a, a + 20)}) for a in (0, 20, 40)] == [1, 1, 1]
    assert got["p000"] == 0 and sorted(set(got.values())) == [0, 1, 2]
    centres = spark.createDataFrame([(0, [0.0, 0.0]), (1, [50.0, 0.0]), (2, [0.0, 50.0])], "cluster int, embedding array<double>")
    near = as_dict(clustering.nearest_centre(vectors, centres))
    assert all(near[f"p{i:03d}"] == i // 20 for i in range(60))
    assert set(as_dict(clustering.kmeans(frame(spark, groups()[:4]), 4, restarts=1)).values()) <= {0, 1, 2, 3}


def test_projection_keeps_most_variance(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(80, 6)) * np.array([1, 5, 1, 3, 0.1, 0.5]) + 7
    rows = clustering.project_2d(frame(spark, points)).orderBy("post_id").collect()
    plane = np.array([(r["x"], r["y"]) for r in rows])
    centred = points.astype(np.float32) - points.astype(np.float32).mean(axis=0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    for n in (0, 1):
        sign = np.sign(v[n][np.abs(v[n]).argmax()])
        assert plane[:, n] == pytest.approx(centred @ v[n] * sign, abs=1e-4)


def test_choice_of_method():
    choose = clustering.choose_method
    assert choose(0) == clustering.Choice("none", None, "No embeddings available for clustering.")
    assert choose(60, 2) == clustering.Choice("kmeans", 2, None)
    assert choose(60, 50).warning.startswith("Warning: 50 clusters for 60 posts may produce very small")
    assert choose(60, 70) == clustering.Choice(
        "kmeans", 50, "Requested 70 clusters, but dataset only has 60 points. Using 50 clusters instead."
    )
    large = clustering.Choice("kmeans", 15, "Used KMeans (15 clusters) for performance on large dataset.")
    assert choose(1501, density_limit=1500) == large
    assert choose(1500, density_limit=1500).method == choose(10**9).method == "hdbscan"


def test_run_clustering_paths(spark):
    vectors = frame(spark, groups())
    found = clustering.run_clustering(vectors, density=lambda v: clustering.density_clusters(v, eps=3.0))
    assert (found.method, found.n_clusters, found.warning, found.total_points) == ("hdbscan", 3, None, 65)
    assert found.points.columns == ["post_id", "cluster", "x", "y"] and found.points.count() == 65
    summary = {r["cluster_id"]: r for r in found.clusters.collect()}
    assert summary[-1]["label"] == "Noise/Outliers" and summary[0]["label"] == "Cluster 0" and summary[1]["size"] == 20
    quick = {"project": False, "restarts": 1}
    flat = clustering.run_clustering(frame(spark, [(1.0, 1.0)] * 30), **quick)
    assert (flat.method, flat.warning) == ("kmeans", clustering.DEGENERATE)

    def broken(_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        clustering.run_clustering(vectors, density=broken, **quick)
    with pytest.raises(ValueError):
        clustering.kmeans(vectors.limit(5), 6)
    large = clustering.run_clustering(vectors, density_limit=60, **quick)
    assert large.warning == clustering.LARGE_DATASET and large.n_clusters == 15
    empty = clustering.run_clustering(vectors.limit(0), project=True)
    assert (empty.method, empty.total_points, empty.clusters.count()) == ("none", 0, 0)


def test_names_and_posts(spark):
    sizes = {0: 30, 1: 20, 2: 10, 3: 5, 4: 4, -1: 6}
    rows, points, n = [], [], 0
    for cluster, size in sizes.items():
        for i in range(size):
            title = {0: "Storm storm coast", 1: "a b c", 2: "Election votes election"}.get(cluster, "Whatever title")
            key = f"p{n:03d}"
            n += 1
            points.append((key, cluster))
            rows.append({"post_id": key, "title": title, "subreddit": "news" if cluster >= 3 else f"s{cluster}", "author": "ann", "score": i, "selftext": "z" * 400})
    labelled = spark.createDataFrame(points, "post_id string, cluster int").repartition(4)
    posts = make_posts(spark, rows)
    all_named = {r["cluster_id"]: r["label"] for r in labels.name_clusters(labelled, posts).collect()}
    assert all_named[3] == "Whatever & Title Discussions" and all_named[4] == "Whatever & Title Discussions (1)"
    named = labels.name_clusters(labelled, posts, 3).collect()
    assert [(r["cluster_id"], r["label"], r["size"]) for r in named] == [
        (0, "Storm & Coast Discussions", 30), (1, "r/s1 Topics", 20), (2, "Election & Votes Discussions", 10),
        (-1, "Noise/Outliers", 6), (3, "r/news discussions", 5), (4, "r/news discussions (1)", 4),
    ]
    assert [p["post_id"] for p in named[0]["top_posts"]] == ["p000", "p001", "p002", "p003", "p004"]
    assert len(named[0]["post_ids"]) == 20 and len(named[0]["top_posts"][0]["selftext"]) == 300
    chosen = labels.posts_of_cluster(labelled, posts, 0, 25).collect()
    assert [r["post_id"] for r in chosen] == [f"p{i:03d}" for i in range(24, -1, -1)]
    assert labels.posts_of_cluster(labelled, posts, 9).count() == 0
    counts = clustering.cluster_counts(labelled).first()
    assert (counts["n_clusters"], counts["noise_points"], counts["total_points"]) == (5, 6, 75)


def test_keywords_count_all_members(spark):
    rows = [{"post_id": f"p{i:03d}", "title": "storm" if i < 10 else "election votes", "subreddit": "s"} for i in range(40)]
    labelled = spark.createDataFrame([(r["post_id"], 0) for r in rows], "post_id string, cluster int")
    assert labels.keyword_labels(labelled, make_posts(spark, rows)).first()["label"] == "Election & Votes Discussions"


def test_case_study(spark):
    rows = [{"post_id": str(i), "author": f"u{i % 3}", "subreddit": f"s{i % 2}", "score": i, "title": f"t{i}", "content": "c"} for i in range(40)]
    posts = make_posts(spark, rows).withColumn("created_utc", F.lit("2024-01-03 10:00:00").cast("timestamp"))
    full = reports.build_graph(posts)
    study = reports.case_study(posts, full, "topic")
    told = study.narrative.first()
    assert told["narrative"] == 'Analysis of "topic" reveals discussion across 2 subreddits involving 3 unique authors.'
    assert told["context"].startswith("[2024-01-03 10:00:00+00:00] r/s1 by u/u0 (score: 39)\n  Title: t39\n  Content: c")
    assert "- 3 accounts involved\n- 3 interactions" in told["network_facts"]
    assert study.key_posts.count() == 15 and study.timeline.trend.first()["total_posts"] == 30
    assert study.network.components.first()["size"] == 3 and study.breakdown.count() == 2
    nobody = reports.case_study(posts.limit(0), full, "topic").narrative.first()
    assert nobody["narrative"] == "Insufficient data to generate a case study narrative."


def clustered(n=1200, dim=8, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim)) * 40
    points = centres[rng.integers(0, 30, n)] + rng.normal(size=(n, dim))
    return np.vstack([points, np.repeat(points[:1], 400, axis=0), rng.normal(size=(20, dim)) * 400]).astype(np.float32).astype(float)


def test_ball_partition_prunes_and_stays_exact(spark):
    """Clustered points, a third as many copies of one of them, and far outliers."""
    points = clustered()
    vectors = frame(spark, points).cache()
    away = neighbours.distances(points, points)
    index = neighbours.ball_index(vectors, 40)
    assert index.points.count() == len(np.unique(points, axis=0)) and index.blocks.agg(F.max("rows")).first()[0] <= 40
    np.fill_diagonal(away, np.inf)
    want = np.sort(away, axis=1)[:, 4]
    got = {r["post_id"]: r["core"] for r in clustering.core_distances(vectors, rows_per_cell=40).collect()}
    assert got == pytest.approx({f"p{i:03d}": want[i] for i in range(len(points))}, abs=2e-6)
    looked, pairs = neighbours.visited(index, 4.0)
    assert 0 < looked < 0.1 * pairs
    assert neighbours.visited(index, 1e6) == (pairs, pairs)


def test_few_points_and_copies(spark):
    assert clustering.core_distances(frame(spark, [(0.0, 0.0)] * 4)).filter("core IS NOT NULL").count() == 0
    same = clustering.core_distances(frame(spark, [(1.0, 2.0)] * 7 + [(4.0, 6.0)]))
    cores = {r["post_id"]: r["core"] for r in same.collect()}
    assert cores["p000"] == 0.0 and cores["p007"] == 5.0
    links = clustering.density_links(frame(spark, [(1.0, 2.0)] * 7 + [(4.0, 6.0)]), 0.5).collect()
    assert len(links) == 6 and {x for link in links for x in link} == {f"p{i:03d}" for i in range(7)}
    assert clustering.core_distances(frame(spark, [(1.0, 1.0)]).limit(0)).count() == 0


def test_points_are_sent_to_some_tens_of_blocks(spark):
    """Without structure every block meets every other, so their number must not grow with the table."""
    points = np.random.default_rng(4).normal(size=(3000, 6)).astype(np.float32).astype(float)
    index = neighbours.ball_index(frame(spark, points).cache(), 5)
    assert index.blocks.count() <= 5 * neighbours.FEW_BLOCKS
    assert index.blocks.agg(F.sum("rows")).first()[0] == 3000
    assert neighbours.block_rows(10**9, 64, 2000) * 64 == neighbours.MOST_VALUES


def test_links_of_two_blocks_are_one_forest(spark, monkeypatch):
    """All points are near each other: each block and pair of blocks returns a forest, however it is tiled."""
    monkeypatch.setattr(neighbours, "TILE", 7)
    points = np.random.default_rng(6).normal(size=(90, 3))
    index = neighbours.ball_index(frame(spark, points).cache(), 40)
    links = [(r["src"], r["dst"]) for r in neighbours.close_links(index, 100.0).collect()]
    blocks = index.blocks.count()
    assert len(links) <= blocks * 90
    top = {f"p{i:03d}": f"p{i:03d}" for i in range(90)}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        top[root(a)] = root(b)
    assert len({root(x) for x in top}) == 1


def test_a_kmeans_step_is_one_job(spark):
    from murmurlens.operators import kmeans

    points = np.random.default_rng(8).normal(size=(400, 4))
    rows, context = frame(spark, points).repartition(3).cache(), spark.sparkContext
    rows.count()
    before = spark.conf.get("spark.sql.adaptive.enabled")
    context.setJobGroup("kmeans-step", "")
    try:
        found = kmeans._step(rows, {0: points[:3], 1: points[5:8]})
        jobs = len(context.statusTracker().getJobIdsForGroup("kmeans-step"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1 and spark.conf.get("spark.sql.adaptive.enabled") == before
    for turn, places in ((0, points[:3]), (1, points[5:8])):
        nearest = neighbours.distances(points, places).argmin(axis=1)
        sums, counts, _ = found[turn]
        assert counts.tolist() == np.bincount(nearest, minlength=3).tolist()
        assert np.allclose(sums, [points[nearest == i].sum(axis=0) for i in range(3)])
