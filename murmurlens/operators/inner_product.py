"""Exact maximum-inner-product join for many queries, pruned by a ball partition of the items.

The product of a query ``q`` with an item at distance ``r`` of a centre ``c`` is at most ``q·c + |q| r``.
In a first round each query meets the innermost block of the ball with the largest ``q·c``, which
gives it a threshold: its k-th best score so far. In the second it meets only those other blocks whose
bound reaches the threshold, and only items that reach it come back. Both the items of a block and the queries that meet it are dealt in
bounded groups; neither all items nor all queries are repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from murmurlens.operators.neighbours import BallIndex, ball_index, block_rows
from murmurlens.operators.vectors import _Best, _batch, _id_array, as_matrix
from murmurlens.runtime import stage

SLACK = 1e-5  # scores are rounded to six decimals, bounds are wider than that


def _with_ids(index: BallIndex, k: int) -> DataFrame:
    """``(cell, ring, embedding, ids)``: a row per distinct vector with its ``k`` smallest ids, since equal
    scores are ranked by id."""
    place = F.row_number().over(W.partitionBy("point").orderBy("post_id"))
    named = index.of_every_id(index.points.select("point", F.col("point").alias("of"))).select(F.col("of").alias("point"), "post_id")
    least = named.withColumn("place", place).filter(F.col("place") <= k)
    ids = least.groupBy("point").agg(F.array_sort(F.collect_list("post_id")).alias("ids"))
    return index.points.select("point", "cell", "ring", "embedding").join(ids, "point").drop("point")


def _score(pairs: DataFrame, items: DataFrame, k: int, query_id: str, schema: T.StructType, chunks: int) -> DataFrame:
    """The best ``k`` items of each block for each query of ``pairs(query_id, embedding, cell, ring)``, of those
    that reach its ``floor`` where there is one."""
    arrow_schema = to_arrow_schema(schema)
    chunk = F.pmod(F.xxhash64(query_id), F.lit(chunks)).cast("int").alias("chunk")
    floor = F.col("floor") if "floor" in pairs.columns else F.lit(float("-inf")).alias("floor")
    asked = pairs.select(F.col(query_id).alias("asked_id"), F.col("embedding").alias("asked_embedding"), "cell", "ring", chunk, floor)
    # An own name, so that the two sides share no column.
    met = asked.select("cell", "ring", F.col("chunk").alias("part")).distinct()
    spread = items.join(met, ["cell", "ring"])  # a block once per group of queries that meets it

    def run(mine: pa.Table, queries: pa.Table) -> pa.Table:
        best = _Best(queries.num_rows, k, queries.column("floor").to_numpy())
        if mine.num_rows and queries.num_rows:
            lists = mine.column("ids").combine_chunks()
            at = np.repeat(np.arange(mine.num_rows), np.diff(lists.offsets.to_numpy()))
            best.offer(as_matrix(queries.column("asked_embedding")), as_matrix(mine.column("embedding"))[at], _id_array(lists.flatten()))
        return _batch(best, queries.column("asked_id").to_pylist(), arrow_schema)

    return spread.groupBy("cell", "ring", "part").cogroup(asked.groupBy("cell", "ring", "chunk")).applyInArrow(run, schema)


def _seeds(index: BallIndex, queries: DataFrame, query_id: str) -> DataFrame:
    """``(query_id, embedding, cell, ring)``: the block each query begins with."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centres)
    schema = T.StructType([*queries.select(query_id, "embedding").schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("ring", T.LongType())])
    names = to_arrow_schema(schema).names

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                cell = (as_matrix(part.column(1)) @ shared.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(np.zeros(len(cell), np.int64))], names=names)

    return queries.select(query_id, "embedding").mapInArrow(run, schema)


def _reached(index: BallIndex, asked: DataFrame, query_id: str) -> DataFrame:
    """``(query_id, embedding, cell, ring, floor)``: blocks beyond the first whose bound reaches the threshold of
    ``asked(query_id, embedding, cell, ring, floor)``."""
    centres = index.centres
    outer = index.blocks.groupBy("cell").agg(F.max("hi")).collect()  # a row per centre
    radius = np.zeros(len(centres))
    for cell, hi in outer:
        radius[cell] = hi
    shared = asked.sparkSession.sparkContext.broadcast((centres, radius))
    kinds = [asked.schema[query_id], asked.schema["embedding"]]
    more = [("cell", T.IntegerType()), ("least", T.DoubleType()), ("seed", T.IntegerType()), ("floor", T.DoubleType())]
    schema = T.StructType([*kinds, *[T.StructField(*x) for x in more]])
    names = to_arrow_schema(schema).names

    def run(batches):
        centres, radius = shared.value
        sizes = np.linalg.norm(centres, axis=1)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = as_matrix(part.column(1))
                floor = part.column(3).to_numpy(zero_copy_only=False)
                length = np.linalg.norm(rows, axis=1)[:, None]
                wide = SLACK * (1 + length) + 1e-9 * length * sizes
                missing = floor[:, None] - rows @ centres.T - wide
                # The smallest distance from the centre at which an item could reach the threshold.
                least = np.where(missing <= 0, 0.0, missing / np.maximum(length, 1e-300))
                at, cell = np.nonzero(least <= radius + SLACK)
                take, seed = pa.array(at), part.column(2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(cell, pa.int32()), pa.array(least[at, cell]), seed.take(take), pa.array(floor[at])], names=names
                )

    wanted = asked.select(query_id, "embedding", "cell", "floor").mapInArrow(run, schema)
    blocks = index.blocks.select("cell", "ring", "hi")
    met = wanted.join(blocks, "cell").filter((F.col("hi") + SLACK >= F.col("least")) & ((F.col("cell") != F.col("seed")) | (F.col("ring") > 0)))
    return met.select(query_id, "embedding", "cell", "ring", "floor")


def pruned_scores(
    queries: DataFrame, vectors: DataFrame, k: int, query_id: str, item_id: str, schema: T.StructType, max_queries: int, rows_per_block: int
) -> tuple[DataFrame, DataFrame, BallIndex]:
    """Candidates ``(query_id, item_id, similarity_score)`` that hold every query's best ``k``, the second
    round's ``(query_id, embedding, cell, ring, floor)``, and the index."""
    stored = stage(vectors.select(F.col(item_id).alias("post_id"), "embedding"), "items")
    index = ball_index(stored, rows_per_block)
    items = stage(_with_ids(index, k), "items-with-ids")
    # Groups of queries grow with their number as blocks do, so that an item is sent to some tens of them.
    asked_rows, dimensions = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    chunks = max(1, -(-asked_rows // block_rows(asked_rows, dimensions, max_queries)))
    if len(index.centres) == 1:
        all_ = queries.select(query_id, "embedding", F.lit(0).alias("cell"), F.lit(0).cast("long").alias("ring"))
        return _score(all_, items, k, query_id, schema, chunks), all_.limit(0), index
    seeds = stage(_seeds(index, queries, query_id), "seeds")
    first = stage(_score(seeds, items, k, query_id, schema, chunks), "first-scores")
    held = first.groupBy(query_id).agg(F.count(F.lit(1)).alias("n"), F.min("similarity_score").alias("least"))
    floor = F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("floor")
    asked = seeds.join(held, query_id, "left").select(query_id, "embedding", "cell", "ring", floor)
    met = stage(_reached(index, asked, query_id), "second-round")
    return first.unionByName(_score(met, items, k, query_id, schema, chunks)), met, index
