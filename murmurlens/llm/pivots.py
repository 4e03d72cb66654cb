"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Close vectors have close
descriptions, so each pivot keeps an inverted list of the vectors that name it, and two vectors of
a list are candidates when they share ``MIN_SHARED`` pivots at least. A pair is looked at in the
list of the smallest pivot it shares only, then verified by its cosine in double precision. Where
there are fewer pivots than that, as for vectors in one narrow cone, sharing all of them is enough,
which compares all pairs: near copies as further pivots would be named at random and lose links.

Pivots are fitted on a bounded sample, the first ``4 m`` vectors in the order of a hash of their
values, from which ``m`` are taken that are no near copies of each other; ``m`` grows with the root
of the number of vectors, so lists and pivots grow alike. Every vector is indexed. Equal vectors
are one entry with a count. Lists longer than ``BLOCK`` are cut into blocks and pairs of blocks,
each a task of its own. A task returns a count and one link per vector, never its pairs.

Defined results: null and zero vectors and those with null or non-finite components link with
nothing, like vectors of different lengths with each other; rows with equal vectors link; a null id
takes part and is never a component's name unless it is alone; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlens.llm.common import column
from murmurlens.operators.components import connected_components
from murmurlens.runtime import stage

MIN_COSINE = 0.9
NEAREST, MIN_SHARED = 8, 2
LEAST_PIVOTS, LIST_SCALE = 64, 2.8
TOO_CLOSE = 0.8
BLOCK, TILE = 16_384, 1024


def choose_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """At most ``wanted`` unit vectors of the sample, in order, none within ``TOO_CLOSE`` of another.
    In a narrow cone that is one."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen: list[int] = []
    for i in range(len(unit)):
        if len(chosen) == wanted:
            break
        if not chosen or (unit[chosen] @ unit[i]).max() < TOO_CLOSE:
            chosen.append(i)
    return unit[chosen]


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, nearest first."""
    near = unit @ pivots.T
    k = min(nearest, len(pivots))
    some = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def _index(pivots: dict[int, np.ndarray], nearest: int, single: bool):
    """A row for each vector and each pivot it names."""
    kind = "<f4" if single else "<f8"

    def run(batches):
        for batch in batches:
            lists, sizes = column(batch, "vector"), np.diff(column(batch, "vector").offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                raw = flat[cuts[rows][:, None] + np.arange(dim)]
                values = raw.astype(float)
                unit = values / np.linalg.norm(values, axis=1, keepdims=True)
                names = nearest_pivots(unit, pivots[dim], nearest)
                k = names.shape[1]
                body = raw.astype(kind)
                vectors = pa.array([x.tobytes() for x in body], pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), k)))
                orders = pa.array([x.tobytes() for x in names.astype("<i4")], pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), k)))
                take = pa.array(np.repeat(rows, k))
                columns = [pa.array(np.full(len(take), dim), pa.int32()), pa.array(names.ravel(), pa.int32()), column(batch, "class").take(take), column(batch, "copies").take(take), orders, vectors]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "pivot", "class", "copies", "order", "vector"])

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many pivots each pair of rows shares, and the smallest of them. Rows are sorted."""
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return both.sum(axis=1), a[np.arange(len(a)), both.argmax(axis=1)]


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked rows the smallest label in reach."""
    while True:
        least = np.minimum(labels[i], labels[j])
        if (labels[i] == least).all() and (labels[j] == least).all():
            return
        for at in (labels[i], labels[j], i, j):
            np.minimum.at(labels, at, least)
        labels[:] = labels[labels]


def _verify(min_cosine: float, min_shared: int, single: bool):
    kind = "<f4" if single else "<f8"

    def run(key, group):
        _, pivot, first, second = (x.as_py() for x in key)
        n = group.num_rows
        values = np.frombuffer(b"".join(group.column("vector").to_pylist()), kind).reshape(n, -1).astype(float)
        unit = values / np.linalg.norm(values, axis=1, keepdims=True)
        orders = np.sort(np.frombuffer(b"".join(group.column("order").to_pylist()), "<i4").reshape(n, -1), axis=1)
        copies, block = group.column("copies").to_numpy(), group.column("block").to_numpy()
        names = group.column("class").to_numpy()
        rows = np.argsort(block, kind="stable")
        unit, orders, copies, names = unit[rows], orders[rows], copies[rows], names[rows]
        split = n if first == second else int((block == first).sum())
        needed = min(min_shared, orders.shape[1])
        links, labels = np.zeros(n, np.int64), np.arange(n)
        for a in range(0, split, TILE):
            for b in range(a if first == second else split, n, TILE):
                close = unit[a : min(a + TILE, split)] @ unit[b : b + TILE].T >= min_cosine
                if a == b:
                    close = np.triu(close, 1)
                i, j = np.nonzero(close)
                i, j = i + a, j + b
                good = np.zeros(len(i), bool)
                for s in range(0, len(i), 100_000):
                    some = slice(s, s + 100_000)
                    count, least = _shared(orders[i[some]], orders[j[some]])
                    good[some] = (count >= needed) & (least == pivot)
                i, j = i[good], j[good]
                links += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
                _merge(labels, i, j)
        found = links > 0
        return pa.table([pa.array(names[found]), pa.array(links[found]), pa.array(names[labels[found]])], ["class", "links", "root"])

    return run


def with_classes(vectors: DataFrame) -> DataFrame:
    """``(vec_id, vector, class)``: equal vectors have one class, those that can't link a null."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    can_link = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    known = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"))
    return known.withColumn("class", F.when(can_link, F.xxhash64(F.transform("vector", lambda x: x + 0))))


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, nearest: int = NEAREST, min_shared: int = MIN_SHARED) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    known = with_classes(vectors)
    usable = known.filter("class IS NOT NULL")
    classes = stage(
        usable.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"), F.first("vector").alias("vector")), "vector-classes"
    )
    pivots, counts = {}, {row[0]: row[1] for row in classes.groupBy(F.size("vector")).count().collect()}
    for dim, n in counts.items():
        wanted = max(LEAST_PIVOTS, math.ceil(math.sqrt(LIST_SCALE * n)))
        sample = classes.filter(F.size("vector") == dim).orderBy("class").limit(4 * wanted).select("vector").collect()
        pivots[dim] = choose_pivots(np.array([row[0] for row in sample], float), wanted)
    shared = spark.sparkContext.broadcast(pivots)  # grows with the root of the number of vectors
    rows = stage(
        classes.select("class", "copies", "vector").mapInArrow(
            lambda batches: _index(shared.value, nearest, single)(batches),
            "dim int, pivot int, class long, copies long, order binary, vector binary",
        ),
        "pivot-lists",
    )
    # A row per pivot.
    blocks = rows.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = rows.join(F.broadcast(blocks), ["dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("class", F.lit(5)), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    found = stage(paired.groupBy("dim", "pivot", "i", "j").applyInArrow(_verify(min_cosine, min_shared, single), "class long, links long, root long"), "vector-links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    edges = found.filter("class <> root").select(F.col("class").alias("src"), F.col("root").alias("dst")).distinct()
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    components = stage(connected_components(nodes, edges), "vector-components")
    named = (
        classes.select("class", "copies", "first").join(links, "class", "left")
        .join(components.withColumnRenamed("id", "class"), "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    facts = named.join(least, "component").select("class", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = usable.select("vec_id", "class").join(facts, "class").select("vec_id", "n_links", "component_id")
    rest = known.filter("class IS NULL")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
