import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurlens.sources import keyed
from murmurlens.sources.keyed import KeyedStore

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def batch(spark, first, last, value, step=1):
    return spark.range(first, last, step).select(
        F.concat(F.lit("key"), F.col("id").cast("string")).alias("k"), F.lit(value).cast("long").alias("v"), F.col("id").alias("place")
    )


def contents(store, version=None):
    rows = [tuple(r) for r in store.read(version).collect()]
    assert len(rows) == len(set(rows))
    return dict(rows)


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store"), SCHEMA, "k", buckets=16)


def test_three_batches(spark, store):
    assert contents(store) == {} and store.snapshot().version == -1
    first = store.insert(batch(spark, 0, 1000, 1), "place")
    assert (first.offered, first.stored, first.parts_read) == (1000, 1000, 0)
    repeated = batch(spark, 900, 1100, 2).union(batch(spark, 900, 1100, 3).withColumn("place", F.col("place") + 5000))
    second = store.insert(repeated, "place")
    assert (second.offered, second.stored) == (200, 100)
    third = store.insert(batch(spark, 0, 1100, 4), "place")
    assert (third.stored, third.snapshot) == (0, second.snapshot)
    want = {f"key{i}": 1 if i < 1000 else 2 for i in range(1100)}
    assert contents(store) == want and store.snapshot().rows == 1100


def test_new_keys_read_next_to_nothing(spark, store):
    """Filters of 16 bits a key hit by chance about once in 400 keys and commit."""
    store.insert(batch(spark, 0, 20_000, 1), "place")
    one = store.insert(batch(spark, 50_000, 50_010, 2), "place")
    assert (one.stored, one.parts) == (10, 16) and one.parts_read <= 2
    few = store.insert(batch(spark, 0, 3, 3), "place")
    assert few.stored == 0 and 1 <= few.parts_read <= 4 and few.parts == 32


def test_only_hit_buckets_are_scanned(spark, store):
    store.insert(batch(spark, 0, 1000, 1), "place")
    named = batch(spark, 0, 2, 2).withColumn("bucket", store._bucket(16))
    known, read = store._known(store.snapshot(), named)
    assert sorted(r[0] for r in known.collect()) == ["key0", "key1"] and read <= 3
    scans = [line for line in known._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    stored = [line for line in scans if "ReadSchema: struct<k:string>" in line]  # no value column, no folder name
    assert stored and all(re.search(r"PartitionFilters: \[[^\]]*bucket#", line) for line in stored)


def test_no_false_negative(spark, store):
    """Every stored key is found again, whatever the sizes of the filters."""
    store.insert(batch(spark, 0, 40_000, 1), "place")
    assert store._filters([store.snapshot().commits[0][0]]).select(F.max("pages")).first()[0] > 1
    again = store.insert(batch(spark, 0, 40_000, 2, 3), "place")
    assert again.stored == 0


def test_a_killed_writer_leaves_the_old_version(spark, store, monkeypatch):
    store.insert(batch(spark, 0, 100, 1), "place")
    before = contents(store)

    def killed(*_):
        raise KeyboardInterrupt

    for step in ("_build_filters", "_switch"):
        with monkeypatch.context() as m:
            m.setattr(store, step, killed)
            with pytest.raises(KeyboardInterrupt):
                store.insert(batch(spark, 100, 200, 2), "place")
            with pytest.raises(KeyboardInterrupt):
                store.replace(batch(spark, 0, 5, 9))
        assert contents(store) == before
    # Killed while it wrote the manifest.
    Path(store.path, "manifest", "0000000001.json").write_text('{"buckets": 16, "comm')
    assert contents(store) == before
    assert store.insert(batch(spark, 100, 200, 2), "place").snapshot.version == 2
    assert len(contents(store)) == 200
    store.vacuum()
    assert len(list(Path(store.path, "data").iterdir())) == 2 and len(contents(store)) == 200


def test_a_writer_that_comes_second_looks_again(spark, store, monkeypatch):
    store.insert(batch(spark, 0, 10, 1), "place")
    real, met = store._switch, []

    def late(commits, buckets, seen):
        if not met:
            met.append(True)
            other = KeyedStore(spark, store.path, SCHEMA, "k")
            other.insert(batch(spark, 5, 15, 7), "place")
        return real(commits, buckets, seen)

    monkeypatch.setattr(store, "_switch", late)
    done = store.insert(batch(spark, 8, 20, 8), "place")
    assert done.stored == 5 and done.snapshot.version == 2
    assert contents(store) == {f"key{i}": 1 if i < 10 else 7 if i < 15 else 8 for i in range(20)}


def test_old_versions_replace_and_merge(spark, store):
    for n in range(5):
        store.insert(batch(spark, 10 * n, 10 * n + 10, n), "place")
    assert len(contents(store, 1)) == 20 and len(contents(store)) == 50
    merged = store.merge_commits(most=3)
    assert len(merged.commits) == 1 and merged.rows == 50 and store.merge_commits(most=3) == merged
    store.insert(batch(spark, 40, 60, 9), "place")
    assert contents(store)["key45"] == 4 and len(contents(store)) == 60
    store.replace(store.read().filter("v = 9"))
    assert contents(store) == {f"key{i}": 9 for i in range(50, 60)} and len(contents(store, 2)) == 30
    store.vacuum()
    assert len(contents(store)) == 10
    with pytest.raises(Exception):
        store.read(2).collect()
    assert store.replace(store.read().limit(0)).rows == 0 and contents(store) == {}


def test_rows_without_a_key_and_no_rows(spark, store):
    nothing = batch(spark, 0, 0, 1)
    assert store.insert(nothing, "place").stored == 0
    nameless = spark.createDataFrame([(None, 1, 0), (None, 2, 1), ("a", 3, 2)], "k string, v long, place long")
    assert store.insert(nameless, "place").stored == 3
    assert store.insert(nameless, "place").stored == 2
    assert store.insert(nothing, "place").offered == 0


def test_many_files_for_a_large_bucket(spark, store, monkeypatch):
    """Small neighbours are put together by the planner, so that is switched off to see how rows are dealt."""
    monkeypatch.setattr(keyed, "ROWS_PER_FILE", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.insert(batch(spark, 0, 1000, 1), "place")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = list(Path(store.path, "data").rglob("bucket=3/*.parquet"))
    assert len(files) > 1 and len(contents(store)) == 1000
