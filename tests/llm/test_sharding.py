import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurlens.llm import sharding


def rows_of(df):
    return [row.asDict() for row in df.collect()]


def check_slots(rows):
    slots = defaultdict(list)
    for row in rows:
        slots[row["shard"]].append(row["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def greedy(texts, shards):
    """The method on a list of texts in plain Python: the shard of every distinct text."""
    counts = Counter(texts)
    vectors = {t: (n * (len(t.encode()) + 1), n * len(t.split()), n) for t, n in counts.items()}
    totals = [sum(v[k] for v in vectors.values()) for k in range(3)]
    shares = {t: [x / max(total, 1) for x, total in zip(v, totals)] for t, v in vectors.items()}
    left, found = [[1 / shards] * 3 for _ in range(shards)], {}
    for text in sorted(shares, key=lambda t: (-max(shares[t]), -sum(shares[t]), t)):
        score = [sum(w * r * x for w, r, x in zip(sharding.WEIGHTS, room, shares[text])) for room in left]
        best = score.index(max(score))
        left[best] = [r - x for r, x in zip(left[best], shares[text])]
        found[text] = best
    return found


def test_as_one_by_one(spark):
    texts = ["w " * (3 + 7 * i % 400) + "x" * (i * i % 97) for i in range(300)] + ["twice the same"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, wanted = rows_of(sharding.assign(docs)), greedy(texts, 16)
    assert len(rows) == len(texts)
    assert {texts[r["doc_id"]]: r["shard"] for r in rows} == wanted
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    check_slots(rows)


def test_awkward_rows(spark, awkward):
    rows = rows_of(sharding.assign(awkward, 4))
    assert len(rows) == awkward.count()
    check_slots(rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert (by_id[100]["size"], by_id[100]["text_crc32"], by_id[100]["shard"]) == (1, 0, by_id[101]["shard"])
    same = defaultdict(set)
    for r in rows:
        same[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(shards) == 1 for shards in same.values())


def test_empty_table(spark, nothing):
    assert sharding.assign(nothing).collect() == []


def test_a_text_with_a_third_of_all_rows(spark):
    """It fills more than five shards, so it is dealt, and every dimension stays near equal."""
    hot = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the very same words again").alias("text"))
    rest = spark.range(12000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the text number "), F.md5(F.col("id").cast("string"))).alias("text"))
    rows = rows_of(sharding.assign(hot.union(rest).repartition(7)))
    check_slots(rows)
    assert len(rows) == 18000
    sizes, counts = Counter(), Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
    for held in (sizes, counts):
        assert max(held.values()) < 1.01 * sum(held.values()) / 16 and min(held.values()) > 0.99 * sum(held.values()) / 16


def test_bundles_balance_many_small_texts(spark):
    """Far more groups than may be placed one by one."""
    docs = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.concat(F.md5(F.col("id").cast("string")), F.lit(" ")), (F.col("id") % 9 + 1).cast("int")).alias("text")
    )
    sums = sharding.assign(docs).groupBy("shard").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    assert len(sums) == 16
    for name in ("bytes", "words", "rows"):
        held = np.array([row[name] for row in sums])
        assert np.abs(held / held.mean() - 1).max() < 0.005


def test_files_of_whole_texts(spark, awkward, tmp_path):
    assigned = sharding.assign(awkward, 4, F.col("text"), F.col("start").alias("slot"))
    sharding.write_shards(assigned, str(tmp_path / "shards"), rows_per_file=10)
    back = spark.read.parquet(str(tmp_path / "shards"))
    text = lambda rows: sorted((r[0] is None, r[0] or 0, r[1] is None, r[1] or "") for r in rows)
    assert text(back.select("doc_id", "rest.text").collect()) == text(awkward.select("doc_id", "text").collect())
    assert {r[0] for r in back.select("rest.slot").collect()} == {"x"}
    check_slots(rows_of(back.select("shard", "slot")))


@pytest.mark.parametrize("count, load, wanted", [(10, 0.4, [10]), (10, 1.0, [10]), (48, 1.5, [1, 2] * 16), (2, 5.5, [1, 1])])
def test_pieces(count, load, wanted):
    assert sharding.pieces_of(count, load, 2) == wanted
