"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Documents of equal text form a group, whose vector is its share of all bytes, words and rows. The
heaviest group is placed first; each goes to the shard where the dot product of its vector with the
shard's residual capacity is highest.

Placing one by one needs one place, so what comes there is bounded whatever the corpus:

- a group with more than ``1 / (shards * LARGE)`` of all bytes, words or rows is an item of its own;
  at most ``3 * shards * LARGE`` groups can be (12,288 for 16 shards);
- all other groups fall into at most ``LEVELS * BUCKETS * SHAPES`` bundles (4,096) by a hash of the
  text and by text length. Half of them lie in the bundles of level 0, a quarter in those of level 1
  and so on, so that the bundles of the last levels are small enough to even out what is left, and
  texts of different lengths lie in different bundles, so that there is something to even it out with.

A bundle keeps its groups together, so equal texts share a shard. Only a group above a whole shard's
capacity in bytes, words or rows (a third of all rows, say) is dealt: in ``PIECES`` equal pieces per
shard, by the exact rank of its rows. Fewer and larger pieces would fill shards with rows of one
shape, and bytes and rows could not both be balanced. Ranks in pieces and slots come from places within stored partitions plus a count per
partition; no shard and no group is ever sorted or counted in one task.

Groups are told apart by two 64-bit hashes of the text and its length.

Defined results: a null text is the empty one; null and repeated ids are rows of their own; equal
vectors are placed in the order of their hashes, equal scores go to the first shard; an empty table
gives no rows; other columns are read only where they are asked for (``more``), in a struct ``rest``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurlens.runtime import stage

SHARDS, LARGE, PIECES, LEVELS, BUCKETS, SHAPES = 16, 256, 16, 8, 64, 8
WEIGHTS = (4.0, 1.0, 1.0)  # of bytes, words and rows in the dot product; the law is that of bytes
GROUP = ["a", "b", "size"]
PLACE_BITS = (1 << 33) - 1


def _placed(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Stored with the partition each row was written from and its place there, in ``order``."""
    kept = df.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return stage(kept.withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE_BITS))), name)


def profile(docs: DataFrame, *more: Column | str) -> DataFrame:
    """``(doc_id, size, text_crc32, tokens, a, b, rest, part, place)``, copies next to each other in
    each partition."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.xxhash64(text).alias("a"),
        F.xxhash64(F.lit(1), text).alias("b"),
        *([F.struct(*more).alias("rest")] if more else []),
    )
    return _placed(rows, "sized", *GROUP)


def bundle(mean_size: float) -> Column:
    """A group's bundle, from the hash and the size of its text alone: level by the zeros that end the
    hash, one of ``SHAPES`` lengths around the mean, and a bucket."""
    bits = F.col("a").bitwiseAND(F.lit((1 << LEVELS - 1) - 1)).bitwiseOR(F.lit(1 << LEVELS - 1))
    level = F.bit_count(F.bitwise_not(bits).bitwiseAND(bits - 1))
    shape = F.least(F.lit(SHAPES - 1), F.greatest(F.lit(0), F.floor(F.log2(F.col("size") / F.lit(mean_size))) + F.lit(SHAPES // 2 + 1)))
    bucket = F.pmod(F.shiftright("a", 20), F.lit(BUCKETS))
    return ((level * SHAPES + shape) * BUCKETS + bucket).cast("int")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item, ``vectors`` being shares of the total per dimension, heaviest first."""
    weights = np.array(WEIGHTS)
    left, found = np.full((shards, vectors.shape[1]), 1.0 / shards), np.zeros(len(vectors), np.int64)
    for i, vector in enumerate(vectors):
        found[i] = best = int(np.argmax(left @ (weights * vector)))
        left[best] -= vector
    return found


def pieces_of(count: int, load: float, shards: int) -> list[int]:
    """Rows of each piece of a group with ``count`` rows that fills ``load`` of ``shards`` shards."""
    n = min(count, PIECES * shards) if load > 1 else 1
    return [(i + 1) * count // n - i * count // n for i in range(n)]


def assign(docs: DataFrame, shards: int = SHARDS, *more: Column | str) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens, rest)`` of every row."""
    spark = docs.sparkSession
    rows = profile(docs, *more)
    groups = stage(rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("tokens")), "text_groups")
    loads = {"bytes": F.col("n") * F.col("size"), "words": F.col("n") * F.col("tokens"), "n": F.col("n")}
    total = groups.agg(*[F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0)).cast("double").alias(k) for k, x in loads.items()]).first()
    # A dimension that is all zero weighs nothing.
    shares = [x / F.lit(max(total[k], 1.0)) for k, x in loads.items()]
    marked = groups.select(*GROUP, "n", F.array(*shares).alias("vector"), bundle(total["bytes"] / max(total["n"], 1.0)).alias("bundle"))
    large = F.array_max("vector") > F.lit(1.0 / (shards * LARGE))
    single = marked.filter(large).select(*GROUP, "n", "vector").collect()
    summed = [F.sum(F.col("vector")[k]).alias(f"v{k}") for k in range(3)]
    bundles = marked.filter(~large).groupBy("bundle").agg(*summed).collect()

    items = []  # (heaviest, all, name, vector, what it is)
    for row in single:
        parts = pieces_of(row["n"], max(row["vector"]) * shards, shards)
        for piece, count in enumerate(parts):
            vector = [x * count / row["n"] for x in row["vector"]]
            items.append((-max(vector), -sum(vector), (row["a"], row["b"], row["size"], piece), vector, len(parts), row["n"]))
    for row in bundles:
        vector = [row["v0"], row["v1"], row["v2"]]
        items.append((-max(vector), -sum(vector), (row["bundle"], 0, 0, -1), vector, 1, 0))
    items.sort(key=lambda x: x[:3])
    found = place(np.array([x[3] for x in items]).reshape(len(items), 3), shards).tolist()

    # Bounded: one item per large group or bundle, PIECES * shards for the 3 * shards groups that can fill a shard.
    plan = {True: [], False: []}
    for item, shard in zip(items, found):
        plan[item[2][3] < 0].append((*item[2], item[4], item[5], shard))
    singles = spark.createDataFrame(plan[False], "a long, b long, size long, piece long, pieces long, n long, single_shard int")
    bundled = spark.createDataFrame([(row[0], row[6]) for row in plan[True]], "bundle int, bundle_shard int")
    if any(row[4] > 1 for row in plan[False]):
        rows = _with_piece(rows, singles.filter("pieces > 1 and piece = 0").select(*GROUP, "pieces", "n"))
    else:
        rows = rows.withColumn("piece", F.lit(0).cast("long"))
    placed = (
        rows.withColumn("bundle", bundle(total["bytes"] / max(total["n"], 1.0)))
        .join(F.broadcast(singles.drop("pieces", "n")), [*GROUP, "piece"], "left")
        .join(F.broadcast(bundled), "bundle", "left")
        .withColumn("shard", F.coalesce("single_shard", "bundle_shard"))
        .select("doc_id", "size", "text_crc32", "tokens", "shard", *(["rest"] if more else []))
    )
    return _with_slot(_placed(placed, "sharded", "shard", "doc_id")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens", *(["rest"] if more else []),
    )


def _before(rows: DataFrame, key: str) -> DataFrame:
    """``(part, key, shift)``: what turns the place of a row into its rank among all rows of its key."""
    counted = rows.groupBy("part", key).agg(F.count(F.lit(1)).alias("held"), F.min("place").alias("first"))
    earlier = W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return counted.select("part", key, (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))


def _with_piece(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """Add ``piece``: rows of the groups in ``dealt`` (a few per shard at most) are dealt by rank, all
    other rows have piece 0."""
    named = dealt.withColumn("hot", F.row_number().over(W.orderBy(*GROUP)))
    marked = rows.join(F.broadcast(named), GROUP, "left")
    ranked = marked.join(_before(marked.filter("hot is not null"), "hot"), ["part", "hot"], "left")
    piece = F.expr("((place + shift + 1) * pieces - 1) div n")
    return ranked.withColumn("piece", F.coalesce(piece, F.lit(0)).cast("long")).drop("hot", "pieces", "n", "shift")


def _with_slot(placed: DataFrame) -> DataFrame:
    """Add ``slot``: the place of a row among all rows of its shard, in order of (partition, id)."""
    return placed.join(_before(placed, "shard"), ["part", "shard"]).withColumn("slot", F.col("place") + F.col("shift"))


def write_shards(assigned: DataFrame, folder: str, rows_per_file: int = 1_000_000) -> None:
    """Write rows with their ``rest`` as a folder per shard, in slot order, a shard in many files."""
    span = F.floor(F.col("slot") / F.lit(rows_per_file))
    assigned.repartition("shard", span).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
