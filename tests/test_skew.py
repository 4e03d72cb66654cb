from collections import Counter

import pytest
from pyspark.sql import functions as F

from murmurlens.operators import skew
from murmurlens.operators.ordering import systematic_sample, value_at_quantile, with_global_index


@pytest.fixture(scope="module")
def hot(spark):
    rows = [("hot", f"r{i}") for i in range(600)] + [(f"k{i % 80}", f"s{i}") for i in range(900)] + [(None, "n")]
    return spark.createDataFrame(rows, "k string, r string").cache()


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(60)], "k string, v int").cache()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(hot, lookup, how):
    plain = hot.join(lookup, "k", how)
    spread = skew.spread_join(hot, lookup, "k", "r", how, max_keys=4, min_rows=50)
    assert spread.columns == plain.columns
    assert Counter(map(tuple, spread.collect())) == Counter(map(tuple, plain.collect()))


def test_heavy_keys_are_bounded_and_spread(hot):
    counts = hot.groupBy("k").agg(F.count("*").alias("n"))
    heavy = skew.heavy_keys(counts, "k", "n", max_keys=4, min_rows=50)
    assert [(row["k"], row["fan"]) for row in heavy.collect()] == [("hot", 2)]
    assert skew.heavy_keys(counts, "k", "n") is None
    finer = skew.heavy_keys(counts, "k", "n", max_keys=30, min_rows=50)
    salted = skew.with_salt(hot, "k", finer, F.col("r"))
    largest = salted.groupBy("k", "salt").count().agg(F.max("count")).first()[0]
    assert largest < 120 and salted.count() == hot.count()


@pytest.mark.parametrize("limit", [1000, 3])
def test_first_wins_both_ways(spark, limit):
    rows = [(n, f"k{n % 40}" if n % 3 else "hot", n * 10) for n in range(400)]
    df = spark.createDataFrame(rows, "p long, k string, v long").repartition(5)
    expected = {}
    for p, k, v in rows:
        expected.setdefault(k, (p, v))
    got = {row["k"]: (row["p"], row["v"]) for row in skew.first_wins(df, "k", "p", limit).collect()}
    assert got == expected and skew.first_wins(df, "k", "p", limit).count() == len(expected)


def test_global_index_sample_and_quantile(spark):
    ids = [f"{(n * 7919) % 10007:05d}" for n in range(2000)]
    df = spark.createDataFrame([(key, float(int(key))) for key in ids], "post_id string, x double").repartition(7)
    indexed = {row["post_id"]: row["index"] for row in with_global_index(df, "post_id").collect()}
    assert indexed == {key: place for place, key in enumerate(sorted(ids))}
    sample = sorted(row["post_id"] for row in systematic_sample(df, wanted=300).collect())
    assert sample == sorted(ids)[::7]
    assert value_at_quantile(df, "x", "post_id", 0.25) == sorted(map(float, map(int, ids)))[int(0.25 * 1999)]
    assert value_at_quantile(df.limit(0), "x", "post_id", 0.5) is None


@pytest.mark.parametrize("limit", [0, 100])
def test_rows_without_a_key_are_kept(spark, limit):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, p int")
    assert sorted(r["p"] for r in skew.first_wins(df, "k", "p", limit).collect()) == [1, 2, 3]
