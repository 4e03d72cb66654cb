"""Exact neighbours over a ball partition of the vectors, pruned by the triangle inequality.

Equal vectors are one point with a count. Every point belongs to the ball of its nearest centre;
a ball is cut into rings by the distance to the centre, so that a block, a ring of a ball, holds a
bounded number of points (:func:`block_rows`) and far ones stand apart. A point ``x`` at distance ``d`` of another ball's
centre is at least ``|d - r|`` away from each point at distance ``r`` of that centre. So a block needs
to meet only the rings of a ball that can reach it, and most pairs of blocks of clustered vectors
are never looked at. Where nothing can be pruned, as for vectors without any structure, all pairs
are, and the result is the same.

Centres are picked from a bounded sample, at most ``MOST_CENTRES`` of them, and are all that is
broadcast; which rings a block has to meet follows from an equi-join on the ball.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from murmurlens.operators.ordering import with_global_index
from murmurlens.operators.skew import spread_join
from murmurlens.operators.vectors import as_matrix
from murmurlens.runtime import stage

MOST_CENTRES, SAMPLE_PER_CENTRE = 2048, 4
# Blocks grow with the table, so that a point is sent to some tens of other blocks and not to ever more
# of them, as long as a block stays within MOST_VALUES numbers. A task looks at PAIRS_AT_ONCE pairs a time.
FEW_BLOCKS, MOST_VALUES, PAIRS_AT_ONCE, TILE = 32, 1 << 21, 2_000_000, 2_000
DECIMALS, SLACK = 6, 1e-5  # distances are rounded, bounds are wider than that
CLASS = ["h1", "h2"]


def block_rows(rows: int, dimensions: int, least: int) -> int:
    """Rows of a block for a table of ``rows``: ``least``, and more where that makes more than ``FEW_BLOCKS``."""
    return max(least, min(rows // FEW_BLOCKS, MOST_VALUES // max(1, dimensions)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, rounded so that they do not depend on summation order."""
    return _rooted(_squared(a, b))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)


def _rooted(squared: np.ndarray) -> np.ndarray:
    scale = 10.0**DECIMALS
    return np.floor(np.sqrt(np.maximum(squared, 0.0)) * scale + 0.5) / scale


def _slices(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, PAIRS_AT_ONCE // max(1, columns))
    return (slice(start, start + step) for start in range(0, rows, step))


def spread_centres(sample: np.ndarray, wanted: int) -> np.ndarray:
    """At most ``wanted`` distinct rows of the sample: the first half as they come, so that there are more
    where the points are dense, then each the one farthest from all before it."""
    first = max(1, min(wanted, len(sample)) // 2)
    chosen, near = [0], distances(sample, sample[:1])[:, 0]
    for i in range(1, first):
        if near[i] > 0:
            chosen.append(i)
            near = np.minimum(near, distances(sample, sample[i : i + 1])[:, 0])
    while len(chosen) < min(wanted, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


@dataclass(frozen=True)
class BallIndex:
    """``points(point, embedding, copies, r, cell, ring)``, a row per distinct vector named by its smallest
    id; ``blocks(cell, ring, lo, hi, rows)``; ``named(post_id, h1, h2)`` and ``classes(h1, h2, point)`` lead
    from ids to points."""

    points: DataFrame
    blocks: DataFrame
    named: DataFrame
    classes: DataFrame
    centres: np.ndarray

    def of_every_id(self, values: DataFrame) -> DataFrame:
        """``(post_id, …)`` from ``values(point, …)``. One vector may stand for a large part of all ids."""
        known = self.classes.join(values, "point").drop("point")
        both = self.named.withColumn("class", F.struct(*CLASS))
        return spread_join(both, known.withColumn("class", F.struct(*CLASS)).drop(*CLASS), "class", "post_id").drop("class", *CLASS)

    def pairs(self, reach: DataFrame, ordered: bool) -> DataFrame:
        """``(cell, ring, other_cell, other_ring)``: blocks that ``reach(cell, ring, reach)`` may lead to,
        the block itself left out. With ``ordered`` each pair is there once."""
        shared = self.points.sparkSession.sparkContext.broadcast(self.centres)  # at most MOST_CENTRES rows

        def windows(batches):
            centres = shared.value
            between = {}
            for batch in batches:
                for row in batch.to_pylist():
                    a = row["cell"]
                    if a not in between:
                        between[a] = distances(centres[a : a + 1], centres)[0]
                    d, wide = between[a], row["reach"] + SLACK
                    nearest = np.maximum(np.maximum(d - row["hi"], row["lo"] - d), 0.0) - wide
                    farthest = d + row["hi"] + wide
                    n = len(centres)
                    columns = [[a] * n, [row["ring"]] * n, np.arange(n), nearest, farthest]
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["cell", "ring", "other_cell", "from", "to"])

        wanted = self.blocks.join(reach, ["cell", "ring"]).select("cell", "ring", "lo", "hi", "reach")
        met = wanted.mapInArrow(windows, "cell int, ring long, other_cell int, from double, to double")
        other = self.blocks.select(F.col("cell").alias("other_cell"), F.col("ring").alias("other_ring"), "lo", "hi")
        found = met.join(other, "other_cell").filter((F.col("hi") >= F.col("from")) & (F.col("lo") <= F.col("to")))
        here, there = F.struct("cell", "ring"), F.struct(F.col("other_cell").alias("cell"), F.col("other_ring").alias("ring"))
        return found.filter(here < there if ordered else here != there).select("cell", "ring", "other_cell", "other_ring")


def ball_index(vectors: DataFrame, rows_per_block: int) -> BallIndex:
    """Index ``vectors(post_id, embedding)``, which should be stored: they are read more than once. A block
    holds ``rows_per_block`` points, or more in a large table."""
    spark = vectors.sparkSession
    hashes = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    named = vectors.select("post_id", *hashes)
    distinct = vectors.select("post_id", "embedding", *hashes).groupBy(*CLASS).agg(
        F.min("post_id").alias("point"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")
    )
    distinct = stage(distinct, "distinct-vectors")
    n, dimensions = distinct.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    rows_per_block = block_rows(n, dimensions, rows_per_block)
    wanted = 1 if n <= rows_per_block else min(MOST_CENTRES, 2 * -(-n // rows_per_block))
    plain = distinct.select("point", "embedding", "copies")
    if wanted <= 1:
        points = plain.withColumns({"r": F.lit(0.0), "cell": F.lit(0), "ring": F.lit(0).cast("long")})
        blocks = points.groupBy("cell", "ring").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("rows"))
        return BallIndex(points, blocks, named, distinct.select(*CLASS, "point"), np.zeros((1, 1)))

    sample = distinct.orderBy(*CLASS).limit(SAMPLE_PER_CENTRE * wanted).select("embedding").collect()
    centres = spread_centres(np.array([row[0] for row in sample], np.float64), wanted)
    shared = spark.sparkContext.broadcast(centres)
    schema = T.StructType([*plain.schema.fields, T.StructField("r", T.DoubleType()), T.StructField("cell", T.IntegerType())])
    arrow_schema = to_arrow_schema(schema)

    def assign(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                away = distances(as_matrix(part.column(1)), shared.value)
                cell = away.argmin(axis=1)
                r = away[np.arange(len(cell)), cell]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(r), pa.array(cell, pa.int32())], names=arrow_schema.names)

    placed = with_global_index(plain.mapInArrow(assign, schema), "cell", "r", "point")
    # Rings also end where the distance is a multiple of the ball's mean, so that an outlier widens no block.
    means = placed.groupBy("cell").agg(F.avg("r").alias("mean"))  # at most MOST_CENTRES rows
    doublings = F.floor(F.log2(F.col("r") / (2 * F.col("mean"))))
    shell = F.when(F.col("r") > 4 * F.col("mean"), doublings).otherwise(0).alias("shell")
    placed = placed.join(F.broadcast(means), "cell").select("point", "embedding", "copies", "r", "cell", "index", shell)
    firsts = placed.groupBy("cell", "shell").agg(F.min("index").alias("first"))  # a few rows per centre
    ring = F.col("shell") * F.lit(1 << 40) + F.floor((F.col("index") - F.col("first")) / rows_per_block)
    ringed = placed.join(F.broadcast(firsts), ["cell", "shell"]).withColumn("ring", ring)
    points = stage(ringed.select("point", "embedding", "copies", "r", "cell", "ring"), "ball-points")
    blocks = points.groupBy("cell", "ring").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("rows"))
    return BallIndex(points, stage(blocks, "ball-blocks"), named, distinct.select(*CLASS, "point"), centres)


def _meet(index: BallIndex, pairs: DataFrame, points: DataFrame, function, schema):
    """Run ``function(mine, theirs)`` on the points of every pair of blocks."""
    key = ["cell", "ring", "other_cell", "other_ring"]
    left = points.join(pairs, ["cell", "ring"])
    right = index.points.select(
        F.col("cell").alias("other_cell"), F.col("ring").alias("other_ring"), F.col("point").alias("their_point"),
        F.col("embedding").alias("their_embedding"), F.col("copies").alias("their_copies"),
    ).join(pairs, ["other_cell", "other_ring"])
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(function, schema)


def _nearest_within(a: np.ndarray, b: np.ndarray, limit: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``a`` the ``k`` smallest distances to ``b`` within its limit, with their copies, padded
    with infinity. Few pairs are within the limit, so only those are rooted, rounded and sorted."""
    away, many = np.full((len(a), k), np.inf), np.zeros((len(a), k), dtype=np.int64)
    reach = (limit + SLACK) ** 2
    for part in _slices(len(a), len(b)):
        squared = _squared(a[part], b)
        row, column = np.nonzero(squared <= reach[part, None])
        found = _rooted(squared[row, column])
        row += part.start
        kept = found <= limit[row]
        row, column, found = row[kept], column[kept], found[kept]
        order = np.lexsort((found, row))
        row, column, found = row[order], column[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        kept = place < k
        away[row[kept], place[kept]], many[row[kept], place[kept]] = found[kept], copies[column[kept]]
    return away, many


def _lists(points: list, kind: pa.DataType, away: np.ndarray, copies: np.ndarray, schema: pa.Schema) -> pa.Table:
    rows = [[{"d": d, "n": n} for d, n in zip(x, m) if d < np.inf] for x, m in zip(away.tolist(), copies.tolist())]
    kept = [i for i, row in enumerate(rows) if row]
    return pa.Table.from_arrays([pa.array([points[i] for i in kept], kind), pa.array([rows[i] for i in kept], schema.field(1).type)], schema=schema)


def _kth(near, k: int):
    """The distance at which the copies of the sorted ``near(d, n)`` reach ``k``; null if they don't."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d"))
    step = lambda s, x: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + x["n"]).alias("n"), x["d"].alias("d")))
    return F.aggregate(F.array_sort(near), start, step, lambda s: F.when(s["n"] >= k, s["d"]))


def kth_neighbour(index: BallIndex, k: int) -> DataFrame:
    """``(point, core)``: distance to the ``k``-th nearest other id, copies counted. Null where there are
    fewer. A first round within blocks gives each block the farthest it has to look."""
    near = T.ArrayType(T.StructType([T.StructField("d", T.DoubleType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([index.points.schema["point"], T.StructField("near", near)])
    arrow_schema = to_arrow_schema(schema)

    def own(block: pa.Table) -> pa.Table:
        points, copies = block.column("point").to_pylist(), block.column("copies").to_numpy()
        matrix, found = as_matrix(block.column("embedding")), []
        for part in _slices(len(points), len(points)):
            away = distances(matrix[part], matrix)
            rows = np.arange(len(away))
            own = part.start + rows
            away[rows, own] = np.where(copies[own] > 1, 0.0, np.inf)
            kept = min(k, away.shape[1])
            at = np.argpartition(away, kept - 1, axis=1)[:, :kept]
            many = copies[at] - (at == own[:, None])  # without the point itself
            found.append((np.take_along_axis(away, at, axis=1), many))
        return _lists(points, arrow_schema.field(0).type, np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), arrow_schema)

    first = index.points.groupBy("cell", "ring").applyInArrow(own, schema)
    if len(index.centres) == 1:
        first = index.points.select("point").join(first, "point", "left")
        return first.select("point", _kth(F.coalesce("near", F.array().cast(near)), k).alias("core"))
    first = stage(first, "near-in-block")
    # A point without k others in its block has to look everywhere.
    limited = index.points.join(first, "point", "left").withColumn("limit", F.coalesce(_kth(F.coalesce("near", F.array().cast(near)), k), F.lit(float("inf"))))
    limited = stage(limited.drop("near"), "limits")
    pairs = stage(index.pairs(limited.groupBy("cell", "ring").agg(F.max("limit").alias("reach")), ordered=False), "block-pairs")

    def closer(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        points = mine.column("point").to_pylist()
        if not points or not theirs.num_rows:
            return arrow_schema.empty_table()
        limit, copies = mine.column("limit").to_numpy(), theirs.column("their_copies").to_numpy()
        away, copies = _nearest_within(as_matrix(mine.column("embedding")), as_matrix(theirs.column("their_embedding")), limit, copies, k)
        return _lists(points, arrow_schema.field(0).type, away, copies, arrow_schema)

    others = _meet(index, pairs, limited, closer, schema)
    gathered = first.unionByName(others).groupBy("point").agg(F.flatten(F.collect_list("near")).alias("near"))
    every = index.points.select("point").join(gathered, "point", "left")
    return every.select("point", _kth(F.coalesce("near", F.array().cast(near)), k).alias("core"))


def close_links(index: BallIndex, eps: float) -> DataFrame:
    """``(src, dst)``: enough links within ``eps`` to connect what is within ``eps``. A block, or a pair of
    blocks, returns a spanning forest of its own links, a point at most one link to its copies' name."""
    kind = index.points.schema["point"].dataType
    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind)])
    arrow_schema = to_arrow_schema(schema)

    def forest(near: np.ndarray) -> Iterator[tuple[int, int]]:
        """Row and column of each link of a spanning forest."""
        seen_a, seen_b = np.zeros(near.shape[0], dtype=bool), np.zeros(near.shape[1], dtype=bool)
        for root in np.flatnonzero(near.any(axis=1)):
            if seen_a[root]:
                continue
            seen_a[root] = True
            waiting = [(True, int(root))]
            while waiting:
                from_a, i = waiting.pop()
                found = np.flatnonzero(near[i] & ~seen_b if from_a else near[:, i] & ~seen_a)
                (seen_b if from_a else seen_a)[found] = True
                for j in found:
                    yield (i, int(j)) if from_a else (int(j), i)
                    waiting.append((not from_a, int(j)))

    def tiled(a: list, b: list, here: np.ndarray, there: np.ndarray) -> pa.Table:
        """A spanning forest of the links of two blocks: what tiles of them add to each other."""
        top: dict = {}

        def root(x):
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        links: list[tuple] = []
        for i in range(0, len(a), TILE):
            for j in range(0, len(b), TILE):
                for m, n in forest(distances(here[i : i + TILE], there[j : j + TILE]) <= eps):
                    pair = a[i + m], b[j + n]
                    x, y = root(pair[0]), root(pair[1])
                    if x != y:
                        top[x] = y
                        links.append((min(pair), max(pair)))
        columns = [pa.array([link[n] for link in links], arrow_schema.field(n).type) for n in (0, 1)]
        return pa.Table.from_arrays(columns, schema=arrow_schema)

    def within(block: pa.Table) -> pa.Table:
        names, matrix = block.column("point").to_pylist(), as_matrix(block.column("embedding"))
        return tiled(names, names, matrix, matrix)

    def across(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return arrow_schema.empty_table()
        here, there = as_matrix(mine.column("embedding")), as_matrix(theirs.column("their_embedding"))
        return tiled(mine.column("point").to_pylist(), theirs.column("their_point").to_pylist(), here, there)

    links = index.points.groupBy("cell", "ring").applyInArrow(within, schema)
    if len(index.centres) > 1:
        pairs = index.pairs(index.blocks.select("cell", "ring", F.lit(eps).alias("reach")), ordered=True)
        links = links.unionByName(_meet(index, stage(pairs, "block-pairs"), index.points, across, schema))
    copies = index.of_every_id(index.points.filter("copies > 1").select("point", F.col("point").alias("dst")))
    return links.unionByName(copies.filter("post_id <> dst").select(F.col("dst").alias("src"), F.col("post_id").alias("dst")))


def visited(index: BallIndex, reach: float) -> tuple[int, int]:
    """Pairs of blocks that a search within ``reach`` looks at, and all there are."""
    blocks = index.blocks.count()
    if len(index.centres) == 1:
        return 0, 0
    pairs = index.pairs(index.blocks.select("cell", "ring", F.lit(float(reach)).alias("reach")), ordered=True).count()
    return pairs, blocks * (blocks - 1) // 2
