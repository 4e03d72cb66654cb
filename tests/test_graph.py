import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from murmurlens.operators import graph
from murmurlens.operators.components import connected_components
from murmurlens.operators.louvain import louvain, modularity
from murmurlens.operators.pagerank import NotConverged, pagerank
from murmurlens.plans import reports
from murmurlens.schema import POSTS_SCHEMA


def as_graph(spark, edges, isolated=()):
    rows = [(min(a, b), max(a, b), w) for a, b, w in edges]
    names = sorted({n for a, b, _ in rows for n in (a, b)} | set(isolated))
    return (
        spark.createDataFrame([(n,) for n in names], "id string"),
        spark.createDataFrame(rows, "src string, dst string, weight long"),
    )


def plain_pagerank(nodes, edges, alpha=0.85, tolerance=1e-6):
    links = defaultdict(dict)
    for a, b, w in edges:
        links[a][b] = w
        links[b][a] = w
    n = len(nodes)
    rank = dict.fromkeys(nodes, 1.0 / n)
    for _ in range(100):
        dangling = sum(r for v, r in rank.items() if not links[v])
        new = dict.fromkeys(nodes, (1 - alpha) / n + alpha * dangling / n)
        for v, out in links.items():
            total = sum(out.values())
            for u, w in out.items():
                new[u] += alpha * rank[v] * w / total
        change = sum(abs(new[v] - rank[v]) for v in nodes)
        rank = new
        if change < n * tolerance:
            break
    return rank


def random_edges(seed, nodes=60, edges=150):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(edges)}
    return [(f"v{a:02d}", f"v{b:02d}", rng.randint(1, 5)) for a, b in sorted(pairs)]


STAR = [("hub", f"leaf{i}", 1) for i in range(10)]
CLIQUES = [(f"{side}{i}", f"{side}{j}", 4) for side in "ab" for i in range(4) for j in range(i + 1, 4)] + [("a0", "b0", 1)]


@pytest.mark.parametrize("heavy", [{}, {"max_heavy": 5, "min_heavy_rows": 3}])
@pytest.mark.parametrize("edges, isolated", [(STAR, ["alone", "alone too"]), (random_edges(1), ["alone"])])
def test_pagerank_matches_plain_iteration(spark, edges, isolated, heavy):
    nodes, frame = as_graph(spark, edges, isolated)
    got = {row["id"]: row["pagerank"] for row in pagerank(nodes, frame, **heavy).collect()}
    want = plain_pagerank(sorted(got), edges)
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-9)
    assert got == pytest.approx(want, abs=1e-12)


def test_pagerank_edge_cases(spark):
    nodes, edges = as_graph(spark, [], ["x", "y"])
    assert {r["pagerank"] for r in pagerank(nodes, edges).collect()} == {0.5}
    assert pagerank(nodes.limit(0), edges).count() == 0
    nodes, edges = as_graph(spark, STAR)
    with pytest.raises(NotConverged):
        pagerank(nodes, edges, max_iterations=1)


@pytest.mark.parametrize("heavy", [{}, {"max_heavy": 5, "min_heavy_rows": 3}])
def test_components(spark, heavy):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}", 1) for i in range(70)]
    triangle = [("t1", "t2", 1), ("t2", "t3", 1), ("t1", "t3", 1)]
    nodes, edges = as_graph(spark, chain + triangle + STAR + [("p", "q", 1)], ["alone"])
    got = defaultdict(set)
    for row in connected_components(nodes, edges, **heavy).collect():
        got[row["component"]].add(row["id"])
    assert {key: len(members) for key, members in got.items()} == {"c000": 71, "t1": 3, "hub": 11, "p": 2, "alone": 1}
    assert all(min(members) == key for key, members in got.items())


def test_components_begin_with_a_star_per_task(spark, monkeypatch):
    from murmurlens.operators import components

    sizes, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: sizes.append(df.count()) or cut(df))
    ids = [[f"{group}{n:02}" for n in range(40)] for group in ("é", "z", "日")]
    pairs = [(a, b, 1) for group in ids for a in group for b in group if a != b and (a, b) > ("z", "")] + [("é00", "é01", 1), ("é00", "é00", 1), ("z39", None, 1)]
    nodes = spark.createDataFrame([(x,) for group in ids for x in group] + [("alone",), (None,)], "id string")
    edges = spark.createDataFrame(pairs, "src string, dst string, weight long").repartition(3)
    found = {(row.id, row.component) for row in components.connected_components(nodes, edges).collect()}
    want = {(x, group[0]) for group in ids for x in group} | {("alone", "alone"), (None, None)}
    assert found == want and sizes[0] <= 3 * 3 * 39
    rows = edges.filter("src <> dst").selectExpr("greatest(src, dst) u", "least(src, dst) v")
    for most in (1, 7, 1000):
        stars = components.local_stars(rows, most).collect()
        assert all(row.u > row.v for row in stars)
        again = spark.createDataFrame(stars, "src string, dst string")
        assert {(row.id, row.component) for row in components.connected_components(nodes, again).collect()} == want


def test_hub_removed_and_tables(spark):
    nodes, edges = as_graph(spark, STAR)
    left = nodes.filter("id <> 'hub'")
    components = connected_components(left, graph.induced_edges(edges, left))
    assert components.select("component").distinct().count() == 10
    table = graph.component_table(connected_components(nodes, edges), members=4).first()
    assert (table["component"], table["size"], table["nodes"]) == ("hub", 11, ["hub", "leaf0", "leaf1", "leaf2"])


def test_louvain_finds_cliques(spark):
    nodes, edges = as_graph(spark, CLIQUES, ["alone"])
    got = {row["id"]: row["community"] for row in louvain(nodes, edges).collect()}
    assert {got[f"a{i}"] for i in range(4)} == {"a0"} and {got[f"b{i}"] for i in range(4)} == {"b0"}
    assert got["alone"] == "alone"


def test_louvain_beats_trivial_partitions(spark):
    blocks = random.Random(3)
    edges = {}
    for _ in range(700):
        a, b = blocks.sample(range(60), 2)
        if a % 4 == b % 4 or blocks.random() < 0.1:
            edges[tuple(sorted((f"n{a:02d}", f"n{b:02d}")))] = blocks.randint(1, 3)
    nodes, frame = as_graph(spark, [(a, b, w) for (a, b), w in edges.items()])
    found = louvain(nodes, frame)
    quality = modularity(frame, found)
    planted = nodes.select("id", (F.substring("id", 2, 2).cast("int") % 4).cast("string").alias("community"))
    assert quality >= modularity(frame, planted) - 0.02
    assert quality > modularity(frame, nodes.select("id", F.col("id").alias("community")))
    parts = found.join(connected_components(nodes, frame), "id").groupBy("community").agg(F.count_distinct("component").alias("n"))
    assert parts.agg(F.max("n")).first()[0] == 1


def make_posts(spark, rows):
    """Posts from dicts; fields left out get blanks."""
    blank = {"string": "", "int": 0, "double": 0.0, "boolean": False, "timestamp": None}
    full = [tuple(row.get(f.name, blank[f.dataType.simpleString()]) for f in POSTS_SCHEMA) for row in rows]
    return spark.createDataFrame(full, POSTS_SCHEMA)


def test_edges_weights_and_exclusions(spark):
    posts = make_posts(
        spark,
        [
            {"post_id": "1", "author": "ann", "subreddit": "s", "score": 5},
            {"post_id": "2", "author": "bob", "subreddit": "s", "crosspost_parent": "t3_1", "score": None},
            {"post_id": "3", "author": "bob", "subreddit": "t", "crosspost_parent": "t3_1"},
            {"post_id": "4", "author": "ann", "subreddit": "t", "crosspost_parent": "t3_1"},
            {"post_id": "5", "author": "[deleted]", "subreddit": "s", "crosspost_parent": "t3_1"},
            {"post_id": "6", "author": "cat", "subreddit": "u", "crosspost_parent": "t3_5"},
            {"post_id": "7", "author": "", "subreddit": "u", "crosspost_parent": "t3_1"},
            {"post_id": "8", "author": "dan", "subreddit": "v", "crosspost_parent": "t3_missing"},
        ],
    )
    edges = {(r["src"], r["dst"]): (r["weight"], r["crosspost_count"], r["cosubreddit_count"]) for r in graph.build_edges(posts).collect()}
    assert edges == {("ann", "bob"): (8, 2, 2), ("", "cat"): (1, 0, 1)}
    nodes = {r["id"]: (r["post_count"], r["total_score"], r["subreddits"]) for r in graph.author_nodes(posts).collect()}
    assert nodes["ann"] == (2, 5, ["s", "t"]) and nodes["bob"] == (2, 0, ["s", "t"])
    assert set(nodes) == {"ann", "bob", "cat", "", "dan"}


def test_coactivity_limits(spark):
    rows = [{"post_id": f"{c}{i}", "author": f"a{i:03d}", "subreddit": c} for c, n in (("small", 30), ("big", 41)) for i in range(n)]
    pairs = graph.coactivity_pairs(make_posts(spark, rows), max_authors=40, neighbours=3)
    got = sorted(map(tuple, pairs.collect()))
    assert got == sorted((f"a{i:03d}", f"a{j:03d}") for i in range(30) for j in range(i + 1, min(30, i + 4)))


def test_coactivity_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(graph, "BUCKET_ROWS", 7)
    rows = [{"post_id": f"{c}{i}", "author": f"a{i:04d}", "subreddit": c} for c, n in (("s", 5), ("t", 2600), ("u", 1)) for i in range(n)]
    got = sorted(map(tuple, graph.coactivity_pairs(make_posts(spark, rows), neighbours=3).collect()))
    assert got == sorted((f"a{i:04d}", f"a{j:04d}") for n in (5, 2600, 1) for i in range(n) for j in range(i + 1, min(n, i + 4)))


def test_empty_graph_reports(spark):
    full = reports.build_graph(make_posts(spark, [{"post_id": "1", "author": "[deleted]", "subreddit": "s"}]))
    assert full.totals.first().asDict() == {
        "total_nodes": 0, "total_edges": 0, "num_communities": 0, "top_influencer": None, "top_pagerank": 0.0,
    }
    assert full.components.count() == 0
    assert reports.filter_graph(full).message == reports.NO_INTERACTIONS
    posts = make_posts(spark, [{"post_id": "1", "author": "ann", "subreddit": "s"}])
    none = reports.graph_of_posts(full, posts, posts.select("post_id").limit(0))
    assert none.message == reports.NO_POSTS and none.nodes.count() == 0


def test_filtered_graph(spark):
    rows = [{"post_id": str(i), "author": f"u{i}", "subreddit": "s" if i < 4 else "t", "score": i} for i in range(8)]
    full = reports.build_graph(make_posts(spark, rows))
    assert full.totals.first()["num_communities"] == 2
    one = reports.filter_graph(full, community="u0")
    assert sorted(r["id"] for r in one.nodes.collect()) == ["u0", "u1", "u2", "u3"] and one.edges.count() == 6
    assert reports.filter_graph(full, max_nodes=3).nodes.count() == 3
    assert reports.filter_graph(full, min_pagerank=0.9).totals.first()["total_nodes"] == 0


def test_a_louvain_round_is_few_jobs_and_leaves_the_settings(spark, monkeypatch):
    from murmurlens.operators import louvain as module

    rounds, before = [], spark.conf.get("spark.sql.adaptive.enabled")
    cut, context = module.cut, spark.sparkContext
    monkeypatch.setattr(module, "cut", lambda df: rounds.append("own_gain" in df.columns) or cut(df))
    edges = [(f"{g}-{a}", f"{g}-{b}", 1) for g in range(6) for a in range(6) for b in range(a + 1, 6)]
    edges += [(f"{g}-0", f"{(g + 1) % 6}-1", 1) for g in range(6)]
    frame = spark.createDataFrame(edges, "src string, dst string, weight long")
    nodes = spark.createDataFrame([(f"{g}-{a}",) for g in range(6) for a in range(6)], "id string")
    context.setJobGroup("louvain-jobs", "")
    try:
        found = module.louvain(nodes, frame)
        jobs = len(context.statusTracker().getJobIdsForGroup("louvain-jobs"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 3 * sum(rounds) + 90  # 30 for each of three levels
    assert found.select("community").distinct().count() == 6
    assert {row["id"][0] == row["community"][0] for row in found.collect()} == {True}
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


def test_louvain_is_the_same_in_one_task_in_blocks_and_by_tables(spark, monkeypatch):
    from murmurlens.operators import louvain as module

    rng = random.Random(5)
    pairs = [rng.sample(range(30), 2) for _ in range(200)]
    edges = [(f"é{a}", f"é{b}", rng.choice([1, 1, 2, 300])) for a, b in pairs if a % 4 == b % 4 or rng.random() < 0.15]
    edges += edges[:20] + [("é1", "é1", 5), ("é2", None, 5), (None, None, 1), ("far", "away", 2), ("zero", "away", 0)]
    frame = spark.createDataFrame(edges, "src string, dst string, weight long").repartition(3)
    nodes = spark.createDataFrame([(f"é{i}",) for i in range(30)] + [(x,) for x in ("far", "away", "zero", "alone", "alone", None)], "id string")

    def found(**settings):
        for name, value in settings.items():
            monkeypatch.setattr(module, name, value)
        return sorted(map(tuple, module.louvain(nodes, frame).collect()), key=str)

    here = found()
    assert len(here) == 36 and here.count(("alone", "alone")) == 2 and (None, None) in here
    assert {community for name, community in here if name in ("far", "away", "zero")} == {"away", "zero"}
    assert found(ONE_TASK_LINKS=0, LEAST_LINKS=50, MAX_SHARED_IDS=0) == here
    assert found(MAX_SHARED_NODES=0) == here


def test_a_louvain_round_in_blocks_is_one_job_and_deals_out_nothing(spark, monkeypatch):
    from murmurlens.operators import louvain as module

    plans, each, context = [], module._Blocks._each, spark.sparkContext
    monkeypatch.setattr(module, "ONE_TASK_LINKS", 0)
    monkeypatch.setattr(module, "LEAST_LINKS", 10)
    monkeypatch.setattr(module._Blocks, "_each", lambda *args: plans.append(each(*args)) or plans[-1])
    edges = [(f"{g}-{a}", f"{g}-{b}", 1) for g in range(6) for a in range(6) for b in range(a + 1, 6)]
    edges += [(f"{g}-0", f"{(g + 1) % 6}-1", 1) for g in range(6)]
    frame = spark.createDataFrame(edges, "src string, dst string, weight long")
    nodes = spark.createDataFrame([(f"{g}-{a}",) for g in range(6) for a in range(6)], "id string")
    held = set(context._jsc.getPersistentRDDs())
    context.setJobGroup("louvain-blocks", "")
    try:
        found = module.louvain(nodes, frame)
        jobs = len(context.statusTracker().getJobIdsForGroup("louvain-blocks"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    rounds = [plan for plan in plans if "target" in plan.columns]
    assert jobs <= len(rounds) + 30
    assert not any("Exchange" in plan._jdf.queryExecution().sparkPlan().toString().split("InMemoryRelation")[0] for plan in rounds)
    assert found.select("community").distinct().count() == 6
    assert set(context._jsc.getPersistentRDDs()) <= held


def test_louvain_coins_are_those_of_the_tables(spark):
    import numpy as np

    from murmurlens.operators import louvain_arrays as arrays

    ids = spark.createDataFrame([(x,) for x in ("", "a", "u12", "日本", "a long name of more than thirty-two bytes")], "id string")
    for turn in (0, 9, 42, 199):
        coin = F.pmod(F.xxhash64("id", F.lit(str(turn))), F.lit(2)) == 0
        rows = ids.select(F.xxhash64("id").alias("hash"), coin.alias("coin")).collect()
        assert arrays.heads(np.array([row.hash for row in rows]), turn).tolist() == [row.coin for row in rows]
    for span in (3, 10**6):
        keys, sums = arrays.sums_by_key(np.array([2, 0, 2]), np.array([1.0, 0.0, 2.5]), span)
        assert keys.tolist() == [0, 2] and sums.tolist() == [0.0, 3.5]


def test_stars_of_tasks_are_joined_before_the_rounds(spark, monkeypatch):
    from murmurlens.operators import components

    monkeypatch.setattr(components, "TASK_IDS", 2000)
    monkeypatch.setattr(components, "TASK_PAIRS", 20)
    pairs = [(f"n{a:03}", f"n{(a * 7 + k) % 200 // 2 * 2 + a % 2:03}") for k in range(8) for a in range(200)]
    edges = spark.createDataFrame(pairs, "src string, dst string").repartition(8)
    started = components.local_stars(edges.filter("src <> dst").selectExpr("greatest(src, dst) u", "least(src, dst) v"))
    assert started.count() > 1000 and components._joined_stars(components.cut(started)).count() < 400
    nodes = spark.createDataFrame([(f"n{a:03}",) for a in range(200)], "id string")
    assert sorted(map(tuple, components.connected_components(nodes, edges).collect())) == [(f"n{a:03}", f"n00{a % 2}") for a in range(200)]


def test_modularity_joins_each_edge_once(spark, monkeypatch):
    plans, of = [], type(spark.range(0)).groupBy
    monkeypatch.setattr(type(spark.range(0)), "groupBy", lambda self, *keys: plans.append(self) or of(self, *keys))
    nodes, edges = as_graph(spark, CLIQUES)
    halves = nodes.select("id", F.substring("id", 1, 1).alias("community"))
    assert modularity(edges, halves) == pytest.approx(48 / 49 - 0.5)
    assert plans[0]._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
