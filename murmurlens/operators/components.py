"""Connected components by alternating large-star and small-star steps.

The method is that of Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014):
every step hooks neighbours to the smallest id in reach, and the edge set shrinks to one star per
component in a logarithmic number of rounds. Before the first step every task replaces its own
edges by stars, and fewer tasks do the same to what comes of it as long as that makes it much less, so
that the rounds don't begin with all edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlens.operators.skew import MAX_HEAVY_KEYS, MIN_HEAVY_ROWS, heavy_keys, with_fan, with_salt
from murmurlens.runtime import cut

# Ids that a task holds before it writes what it has and starts anew.
TASK_IDS = 250_000
# Pairs that it joins at a time.
TASK_PAIRS = 100_000


def _stars_of(pairs: list[pa.Array], numbers: dict, parents: list[int]) -> None:
    """Join the trees of each pair; all first ends come first, then all second ends. ``numbers`` numbers the
    ids, ``parents`` holds the tree of each number."""
    coded = pa.concat_arrays(pairs).dictionary_encode()
    names = [numbers.setdefault(name, len(numbers)) for name in coded.dictionary.to_pylist()]
    parents.extend(range(len(parents), len(numbers)))
    at, roots = np.array(names, np.int64)[coded.indices.to_numpy()], np.array(parents, np.int64)
    while not np.array_equal(above := roots[roots], roots):
        roots = above
    # Most pairs lie in one tree already.
    ends = np.sort(roots[at].reshape(2, -1), axis=0)
    apart = np.unique((ends[0] * len(roots) + ends[1])[ends[0] != ends[1]])
    parents[:] = roots.tolist()
    for a, b in zip(*(each.tolist() for each in np.divmod(apart, len(roots)))):
        while parents[a] != a:
            parents[a] = a = parents[parents[a]]
        while parents[b] != b:
            parents[b] = b = parents[parents[b]]
        parents[max(a, b)] = min(a, b)


def _named_stars(numbers: dict, parents: list[int], schema: pa.Schema) -> pa.RecordBatch:
    """``(u, v)``: each id that isn't the smallest of its tree, with the smallest."""
    names, least = list(numbers), {}
    for number, name in enumerate(names):
        # A parent's number is never above its own, so it has been resolved.
        root = parents[number] = parents[parents[number]]
        least[root] = min(least.get(root, name), name)
    rows = [(name, least[root]) for name, root in zip(names, parents) if name != least[root]]
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], schema.field(i).type) for i in (0, 1)], schema=schema)


def local_stars(pairs: DataFrame, most: int = TASK_IDS) -> DataFrame:
    """``pairs(u, v)`` without nulls as pairs with the same components: within each task, and within what it
    reads until it holds ``most`` ids, one star per component. No more rows than there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, parents, schema, waiting = {}, [], None, []
        for batch in batches:
            schema = batch.schema
            waiting.append(batch)
            if sum(each.num_rows for each in waiting) < min(most, TASK_PAIRS):
                continue
            _stars_of([each.column(i) for i in (0, 1) for each in waiting], numbers, parents)
            waiting = []
            if len(numbers) >= most:
                yield _named_stars(numbers, parents, schema)
                numbers, parents = {}, []
        if waiting:
            _stars_of([each.column(i) for i in (0, 1) for each in waiting], numbers, parents)
        if numbers:
            yield _named_stars(numbers, parents, schema)

    return pairs.select("u", "v").mapInArrow(run, pairs.select("u", "v").schema)


def _joined_stars(stars: DataFrame) -> DataFrame:
    """Stars with the same components, a third or less of the rows each time: fewer tasks see more of a component."""
    rows = stars.count()
    while rows > TASK_IDS // 10:
        joined = cut(local_stars(stars.repartition(-(-rows // TASK_IDS))))
        left = joined.count()
        if left > rows // 3:
            return joined
        stars, rows = joined, left
    return stars


def _hook(pairs: DataFrame, rows: int, max_heavy: int, min_heavy_rows: int) -> DataFrame:
    """``(u, v, least)``: each pair with the smallest neighbour of ``u``. The centre of a large
    star is a heavy key, so beyond ``min_heavy_rows`` pairs its rows are dealt over salts."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("degree"))
    if rows <= min_heavy_rows:
        return pairs.join(least.drop("degree"), "u")
    least = cut(least)
    heavy = heavy_keys(least, "u", "degree", max_heavy, min_heavy_rows)
    least, keys = least.drop("degree"), ["u"]
    if heavy is not None:
        pairs, least, keys = with_salt(pairs, "u", heavy, F.col("v")), with_fan(least, "u", heavy), ["u", "salt"]
    # One row per key on the right: hashing it spares sorting all pairs.
    return pairs.join(least.hint("shuffle_hash"), keys).drop("salt")


def _large_star(stars: DataFrame, rows: int, max_heavy: int, min_heavy_rows: int) -> DataFrame:
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hooked = _hook(both, 2 * rows, max_heavy, min_heavy_rows)
    return hooked.filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()


def _small_star(stars: DataFrame, rows: int, max_heavy: int, min_heavy_rows: int) -> DataFrame:
    hooked = _hook(stars, rows, max_heavy, min_heavy_rows)
    moved = hooked.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(hooked.select("u", F.col("least").alias("v"))).distinct()


def connected_components(
    nodes: DataFrame,
    edges: DataFrame,
    max_heavy: int = MAX_HEAVY_KEYS,
    min_heavy_rows: int = MIN_HEAVY_ROWS,
) -> DataFrame:
    """``(id, component)``; a component is named by its smallest id, isolated nodes included."""
    pairs = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    stars = _joined_stars(cut(local_stars(pairs)))
    # Order-free fingerprint of the edge set; the sum stays exact as a decimal.
    fingerprint = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))]
    seen = tuple(stars.agg(*fingerprint).first())
    while seen[0]:
        large = _large_star(stars, seen[0], max_heavy, min_heavy_rows)
        if seen[0] > min_heavy_rows:
            large = cut(large)
        stars = cut(_small_star(large, seen[0], max_heavy, min_heavy_rows))
        now = tuple(stars.agg(*fingerprint).first())
        if now == seen:
            break
        seen = now
    labels = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("id").join(labels, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
