"""Weighted PageRank on the undirected interaction graph."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlens.operators.graph import symmetric
from murmurlens.operators.skew import MAX_HEAVY_KEYS, MIN_HEAVY_ROWS, heavy_keys, with_fan, with_salt
from murmurlens.runtime import cut, even_tasks, stage

# Damping, iteration limit and tolerance per node.
ALPHA = 0.85
MAX_ITERATIONS = 100
TOLERANCE = 1e-6


class NotConverged(RuntimeError):
    pass


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    alpha: float = ALPHA,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    iterations: int | None = None,
    max_heavy: int = MAX_HEAVY_KEYS,
    min_heavy_rows: int = MIN_HEAVY_ROWS,
) -> DataFrame:
    """``(id, pagerank)`` for ``nodes(id)`` and ``edges(src, dst, weight)``.

    Power iteration until the summed change is below ``nodes * tolerance``; with ``iterations`` a
    fixed number of steps. Fails where ``max_iterations`` steps do not suffice.

    The links stay partitioned by source for the whole run and the vertex state by id, so a step
    shuffles nothing but the combined inflow per vertex. Hubs are split: their links carry a salt
    and their state row is repeated once per salt. Nodes without links all share one rank, which
    is a number on the driver.
    """
    spark = nodes.sparkSession
    total_nodes = nodes.count()
    if total_nodes == 0:
        return spark.createDataFrame([], "id string, pagerank double")
    links = symmetric(edges, "weight")
    vertices = stage(
        links.groupBy(F.col("src").alias("id")).agg(
            F.sum("weight").cast("double").alias("strength"), F.count(F.lit(1)).alias("degree")
        ),
        "vertices",
    )
    linked, ends = vertices.agg(F.count(F.lit(1)), F.coalesce(F.sum("degree"), F.lit(0))).first()
    parts = even_tasks(spark, ends)
    start = 1.0 / total_nodes
    heavy = heavy_keys(vertices.withColumnRenamed("id", "src"), "src", "degree", max_heavy, min_heavy_rows)
    keys = ["src"] if heavy is None else ["src", "salt"]
    if heavy is not None:
        links = with_salt(links, "src", heavy, F.col("dst"))
    links = links.repartition(parts, *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)
    state = cut(vertices.select("id", "strength", F.lit(start).alias("rank")).repartition(parts, "id"))

    isolated, lonely_rank = total_nodes - linked, start
    try:
        for _ in range(iterations if iterations is not None else max_iterations):
            base = (1.0 - alpha) / total_nodes + alpha * isolated * lonely_rank / total_nodes
            sent = state.select(F.col("id").alias("src"), (F.col("rank") / F.col("strength")).alias("flow"))
            if heavy is not None:
                sent = with_fan(sent, "src", heavy)
            inflow = links.join(sent, keys).groupBy(F.col("dst").alias("id")).agg(
                F.sum(F.col("weight") * F.col("flow")).alias("inflow")
            )
            state = cut(
                state.join(inflow, "id").select(
                    "id",
                    "strength",
                    (F.lit(base) + alpha * F.col("inflow")).alias("rank"),
                    F.abs(F.lit(base) + alpha * F.col("inflow") - F.col("rank")).alias("change"),
                )
            )
            lonely_change, lonely_rank = abs(base - lonely_rank), base
            if iterations is None:
                change = (state.agg(F.sum("change")).first()[0] or 0.0) + isolated * lonely_change
                if change < total_nodes * tolerance:
                    break
        else:
            if iterations is None:
                raise NotConverged(f"no convergence within {max_iterations} iterations")
    finally:
        links.unpersist()
    return nodes.select("id").join(state.select("id", "rank"), "id", "left").select(
        "id", F.coalesce("rank", F.lit(lonely_rank)).alias("pagerank")
    )
