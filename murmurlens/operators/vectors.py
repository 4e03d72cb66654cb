"""Exact nearest-neighbour work on vectors, split into tasks of bounded size.

Similarities are rounded before ranking, with the id as tie-break, so that results do not depend
on summation order or on how the data is split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MAX_SHARED_QUERIES = 4_096
ROWS_PER_CELL = 2_000
SCORES_PER_SLICE = 4_000_000
MERGE_SALTS = 64
DECIMALS = 6


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays zero."""

    def scaled(v):
        return _bind(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    return _bind(vector, scaled)


def mean_vectors(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per group. Sums are combined map-side per (group, dimension)."""
    return (
        vectors.select(group, F.posexplode(vector).alias("dimension", "x"))
        .groupBy(group, "dimension")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(group)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("dimension", "x"))), lambda p: p["x"]).alias(vector))
    )


def as_matrix(column) -> np.ndarray:
    """A list column of equal-length vectors as a float64 matrix, without a Python loop."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _rounded(scores: np.ndarray) -> np.ndarray:
    scale = 10.0**DECIMALS
    return np.sign(scores) * np.floor(np.abs(scores) * scale + 0.5) / scale


class _Best:
    """The k best (score desc, id asc) items per query seen so far, of those that reach its ``least`` score."""

    def __init__(self, n_queries: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.least = np.full(n_queries, -np.inf) if least is None else least
        self.n_queries = n_queries
        self.query = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0)
        self.item = np.zeros(0, dtype="U1")

    def offer(self, queries: np.ndarray, items: np.ndarray, ids: np.ndarray) -> None:
        rows = max(1, SCORES_PER_SLICE // max(1, self.n_queries))
        for start in range(0, len(ids), rows):
            part = slice(start, start + rows)
            self._offer_slice(queries @ items[part].T, ids[part])

    def _offer_slice(self, scores: np.ndarray, ids: np.ndarray) -> None:
        floor = self.least.copy()
        held = np.bincount(self.query, minlength=self.n_queries)
        last = np.cumsum(held) - 1
        full = held >= self.k
        floor[full] = np.maximum(floor[full], self.score[last[full]])
        if scores.shape[1] > self.k and (free := np.flatnonzero(np.isneginf(floor))).size:
            floor[free] = _rounded(np.partition(scores[free], -self.k, axis=1)[:, -self.k])
        # Few scores reach the floor, so only those are rounded.
        query, column = np.nonzero(scores >= floor[:, None] - 10.0**-DECIMALS)
        found = _rounded(scores[query, column])
        kept = found >= floor[query]
        query, column, found = query[kept], column[kept], found[kept]
        score = np.concatenate([self.score, found])
        item = np.concatenate([self.item, ids[column]]) if len(self.item) else ids[column]
        query = np.concatenate([self.query, query])
        order = np.lexsort((item, -score, query))
        query, score, item = query[order], score[order], item[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        keep = place < self.k
        self.query, self.score, self.item = query[keep], score[keep], item[keep]


def _id_array(column) -> np.ndarray:
    values = column.to_pylist()
    return np.array(values) if values else np.zeros(0, dtype="U1")


def _hits_schema(queries: DataFrame, vectors: DataFrame, query_id: str, item_id: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(item_id, vectors.schema[item_id].dataType),
            T.StructField("similarity_score", T.DoubleType()),
        ]
    )


def _batch(best: _Best, query_ids: list, schema: pa.Schema) -> pa.Table:
    columns = [
        pa.array([query_ids[q] for q in best.query], schema.field(0).type),
        pa.array(best.item.tolist(), schema.field(1).type),
        pa.array(best.score, schema.field(2).type),
    ]
    return pa.Table.from_arrays(columns, schema=schema)


def _scan_with_shared_queries(head, vectors, k, query_id, item_id, schema) -> DataFrame:
    ids = [row[0] for row in head]
    matrix = np.array([row[1] for row in head], dtype=np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))
    arrow_schema = to_arrow_schema(schema)

    def scan(batches):
        query_ids, query_matrix = shared.value
        best = _Best(len(query_ids), k)
        for batch in batches:
            if batch.num_rows:
                best.offer(query_matrix, as_matrix(batch.column(1)), _id_array(batch.column(0)))
        yield from _batch(best, query_ids, arrow_schema).to_batches()

    return vectors.mapInArrow(scan, schema)


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    query_id: str = "query_id",
    item_id: str = "post_id",
    max_queries: int = MAX_SHARED_QUERIES,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """``(query_id, rank, item_id, similarity_score)``: the k items with the highest inner product.

    Exact. Up to ``max_queries`` query vectors are shared with every task and the vectors are
    scanned where they lie, without a shuffle; more queries, with distinct ids, meet only the blocks of a
    ball partition that can hold one of their best. Every task returns at most k items per query, and
    these are merged in two steps.
    """
    queries = queries.select(query_id, "embedding").filter(F.col("embedding").isNotNull())
    vectors = vectors.select(item_id, "embedding").filter(F.col("embedding").isNotNull())
    schema = _hits_schema(queries, vectors, query_id, item_id)
    head = queries.limit(max_queries + 1).collect()
    if not head:
        partial = queries.sparkSession.createDataFrame([], schema)
    elif len(head) <= max_queries:
        partial = _scan_with_shared_queries(head, vectors, k, query_id, item_id, schema)
    else:
        from murmurlens.operators.inner_product import pruned_scores  # which builds on this module

        partial = pruned_scores(queries, vectors, k, query_id, item_id, schema, max_queries, rows_per_cell)[0]
    return _merge_ranked(partial, k, query_id, item_id)


def _merge_ranked(partial: DataFrame, k: int, query_id: str, item_id: str) -> DataFrame:
    best_first = [F.desc("similarity_score"), F.asc(item_id)]
    salted = partial.withColumn("salt", F.pmod(F.xxhash64(item_id), F.lit(MERGE_SALTS)))
    pruned = salted.withColumn(
        "place", F.row_number().over(W.partitionBy(query_id, "salt").orderBy(*best_first))
    ).filter(F.col("place") <= k)
    rank = F.row_number().over(W.partitionBy(query_id).orderBy(*best_first))
    return pruned.withColumn("rank", rank).filter(F.col("rank") <= k).select(query_id, "rank", item_id, "similarity_score")
