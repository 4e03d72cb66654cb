"""Community detection by modularity: distributed Louvain.

Nodes move at the same time, each to the neighbouring community with the largest gain. On the first
level half of the nodes, picked by hash, may move in a round. Once communities are contracted to
nodes, a single move changes much, so there every community is, by hash, either open or closed and
only members of closed ones move, to open ones: no community both loses and wins members. The best
partition seen is kept, and a round that lowers modularity is taken back. Levels repeat until
modularity gains less than the threshold.

Up to ``MAX_SHARED_NODES`` nodes are numbered, the links of a level lie in blocks by their first end,
and a round hands every block the communities of all nodes: no link is dealt out again. A level
of up to ``ONE_TASK_LINKS`` links is one block, and the task that has it does all that is left. Larger
graphs go through joins of tables. All ways make the same moves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from murmurlens.operators import louvain_arrays as arrays
from murmurlens.operators.graph import symmetric
from murmurlens.operators.louvain_arrays import MAX_LEVELS, MAX_ROUNDS, MIN_GAIN, PATIENCE, ROUND_GAIN
from murmurlens.operators.ordering import with_global_index
from murmurlens.operators.skew import MIN_HEAVY_ROWS, heavy_keys, spread_join, with_fan, with_salt
from murmurlens.runtime import cut, fixed_plans, level_tasks, stage

# Fixed value.
RESOLUTION = 1.0

# So many nodes at most share the totals of their communities by broadcast, which spares two shuffles a round.
MAX_SHARED_TOTALS = 50_000
# Up to so many nodes the driver holds a number each for what a round changes, some 50 bytes a node in all.
MAX_SHARED_NODES = 2_000_000
# Up to so many nodes their numbers get to the edges by broadcast.
MAX_SHARED_IDS = 200_000
# A level of so many links is left to one task, with all levels above it.
ONE_TASK_LINKS = 500_000
# Links of a block: as many blocks as there are cores, or twice as many and so on, within these bounds.
LEAST_LINKS, BLOCK_LINKS = 150_000, 2_000_000


def _with_totals(assigned: DataFrame, rows: int) -> DataFrame:
    """Add the summed strength of each node's community. A community may hold most nodes."""
    totals = assigned.groupBy("community").agg(
        F.sum("strength").alias("total"), F.count(F.lit(1)).alias("members")
    )
    if rows <= MAX_SHARED_TOTALS:
        return assigned.join(F.broadcast(totals.drop("members")), "community")
    if rows > MIN_HEAVY_ROWS:
        totals = cut(totals)
        heavy = heavy_keys(totals, "community", "members")
        if heavy is not None:
            salted = with_salt(assigned, "community", heavy, F.col("id"))
            return salted.join(with_fan(totals.drop("members"), "community", heavy), ["community", "salt"]).drop("salt")
    return assigned.join(totals.drop("members").hint("shuffle_hash"), "community")


def _options(links: DataFrame, heavy: DataFrame | None, assigned: DataFrame, graph_weight: float, resolution: float) -> DataFrame:
    """Per node and reachable community: links into it and the gain of belonging to it."""
    keys = ["dst"] if heavy is None else ["dst", "salt"]
    there = assigned.select(F.col("id").alias("dst"), "community", "total")
    if heavy is not None:
        there = with_fan(there, "dst", heavy)
    # One row per key on the right: hashing it spares sorting the links in every round.
    per_community = links.join(there.hint("shuffle_hash"), keys).groupBy(F.col("src").alias("id"), "community").agg(
        F.sum("weight").alias("inside"), F.max("total").alias("total"), F.max("src_strength").alias("strength"),
        F.max("own").alias("own"),
    )
    others = F.col("total") - F.col("own") * F.col("strength")
    gain = F.col("inside") - resolution * F.col("strength") * others / F.lit(graph_weight)
    return per_community.withColumn("gain", gain)


def _with_stays(links: DataFrame, vertices: DataFrame) -> DataFrame:
    """The links and one of weight 0 from every node to itself, which stands for staying where it is."""
    stays = vertices.select(
        F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight"), F.col("strength").alias("src_strength"), F.lit(1).alias("own")
    )
    return links.select("src", "dst", "weight", "src_strength", F.lit(0).alias("own")).unionByName(stays)


def _level(links: DataFrame, vertices: DataFrame, graph_weight: float, resolution: float, kind: str) -> tuple[DataFrame, float]:
    """Best partition of one level: ``(id, community)`` and its modularity.

    ``links(src, dst, weight, src_strength)`` holds both directions without loops; ``vertices(id, strength,
    loop)`` has the total link weight of a node and the part of it that is internal.

    Links stay where they are for the whole level. A level that fits one task needs no shuffle at all.
    """
    rows = vertices.count()
    degrees = links.groupBy("dst").agg(F.count(F.lit(1)).alias("degree"))
    link_rows = links.count()
    heavy = heavy_keys(degrees, "dst", "degree") if link_rows > MIN_HEAVY_ROWS else None
    keys = ["dst"] if heavy is None else ["dst", "salt"]
    parts = level_tasks(links.sparkSession, link_rows + rows)
    links = _with_stays(links, vertices)
    if heavy is not None:
        links = with_salt(links, "dst", heavy, F.col("src"))
    links = (links.repartition(1) if parts == 1 else links.repartition(parts, *keys)).persist(StorageLevel.MEMORY_AND_DISK)
    loops = vertices.agg(F.sum("loop")).first()[0] or 0.0
    assigned = vertices.select("id", F.col("id").alias("community"), "strength")
    assigned = assigned.repartition(1) if parts == 1 else assigned.repartition(parts, "id")
    try:
        with fixed_plans(links.sparkSession, parts):
            return _rounds(links, heavy, assigned, rows, loops, graph_weight, resolution, kind)
    finally:
        links.unpersist()


def _rounds(
    links: DataFrame, heavy: DataFrame | None, assigned: DataFrame, rows: int, loops: float, graph_weight: float, resolution: float, kind: str
) -> tuple[DataFrame, float]:
    best, best_quality, stalled = None, float("-inf"), 0
    for turn in range(MAX_ROUNDS):
        assigned = _with_totals(assigned, rows)
        options = _options(links, heavy, assigned, graph_weight, resolution)
        mine = F.col("own") == 1
        # The round enters the hash as text: a number would change the generated code each time.
        heads = lambda column: F.pmod(F.xxhash64(column, F.lit(str(turn))), F.lit(2)) == 0  # noqa: B023, E731
        is_target = F.lit(True) if kind == "nodes" else heads("community")
        facts = Observation()
        chosen = (
            options.groupBy("id").agg(
                F.min(F.when(is_target & ~mine, F.struct((-F.col("gain")).alias("loss"), "community"))).alias("best"),
                F.max(F.when(mine, F.col("gain"))).alias("own_gain"),
                F.max(F.when(~mine, F.col("gain"))).alias("any_gain"),
                F.max(F.when(mine, F.col("community"))).alias("community"),
                F.max(F.when(mine, F.col("inside"))).alias("inside"),
                F.max(F.when(mine, F.col("total"))).alias("total"),
                F.max("strength").alias("strength"),
            )
        )
        wants_move = F.coalesce(F.col("any_gain") > F.col("own_gain") + 1e-12, F.lit(False))
        # Each member's strength times the total of its community adds up to the squares of the totals.
        squares = F.sum(F.col("strength") * F.col("total")).alias("squares")
        chosen = cut(chosen.observe(facts, F.sum("inside").alias("inside"), squares, F.max(wants_move).alias("unsettled")))
        sums = facts.get
        quality = (sums["inside"] + loops) / graph_weight - resolution * sums["squares"] / graph_weight**2
        stalled = stalled + 1 if quality - best_quality < ROUND_GAIN else 0
        if quality > best_quality:
            best, best_quality = chosen, quality
        if stalled > PATIENCE[kind] or not sums["unsettled"]:
            return best.select("id", "community"), best_quality
        better = (-F.col("best.loss") > F.col("own_gain") + 1e-12) & ~heads("id" if kind == "nodes" else "community")
        moved = F.when(better, F.col("best.community")).otherwise(F.col("community"))
        if quality < best_quality:
            chosen, moved = best, F.col("community")
        assigned = chosen.select("id", moved.alias("community"), "strength")
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")


def _contract(links: DataFrame, vertices: DataFrame, partition: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Communities become nodes; links inside one become its loop."""
    named = partition.select(F.col("id"), F.col("community"))
    ends = links.select("src", "dst", "weight")
    rows = ends.count()
    ends = spread_join(ends, named.select(F.col("id").alias("src"), F.col("community").alias("new_src")), "src", "dst", rows=rows)
    ends = spread_join(ends, named.select(F.col("id").alias("dst"), F.col("community").alias("new_dst")), "dst", "src", rows=rows)
    lifted = (
        ends.groupBy(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
        .agg(F.sum("weight").alias("weight"))
    )
    lifted = cut(lifted)
    inner = lifted.filter("src = dst").select(F.col("src").alias("id"), F.col("weight").alias("inner"))
    summed = (
        vertices.join(named, "id")
        .groupBy(F.col("community").alias("id"))
        .agg(F.sum("strength").alias("strength"), F.sum("loop").alias("loop"))
    )
    new_vertices = cut(
        summed.join(inner, "id", "left").select(
            "id", "strength", (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop")
        )
    )
    strengths = new_vertices.select(F.col("id").alias("src"), F.col("strength").alias("src_strength"))
    return spread_join(lifted.filter("src <> dst"), strengths, "src", "dst"), new_vertices


def _arrays(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """``(src, dst, weight)`` of all batches."""
    found = [[column.to_numpy(zero_copy_only=False) for column in batch.columns] for batch in batches if batch.num_rows]
    return [np.concatenate(parts) for parts in zip(*found)]


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{key: value.tobytes() if isinstance(value, np.ndarray) else value for key, value in values.items()}])


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold them all: every round reads all blocks."""
    for kind in (np.uint8, np.uint16, np.int32, np.float32):
        with np.errstate(invalid="ignore"):
            tried = values.astype(kind)
        if np.array_equal(tried, values):
            return tried
    return values


def _links_in(batches: Iterator[pa.RecordBatch]) -> Iterator[arrays.Links]:
    for batch in batches:
        for i in range(batch.num_rows):
            kinds = batch.column("kinds")[i].as_py().split()
            yield arrays.Links(*(np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in zip(arrays.Links._fields, kinds)))


class _Blocks:
    """A graph in blocks: ``links(src, dst, weight)`` of numbered nodes, both directions, no loops, ``rows`` of them."""

    def __init__(self, links: DataFrame, rows: int):
        self.links, self.rows, self.blocks, self.strengths = links, rows, None, None

    def _each(self, task: Callable[..., pa.RecordBatch], schema: str, *shared: Broadcast) -> DataFrame:
        """What ``task`` makes of each block and of the values of ``shared``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for links in _links_in(batches):
                yield task(links, *(each.value for each in shared))

        return self.blocks.mapInArrow(run, schema)

    def _dealt(self) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if found := _arrays(batches):
                links = [_narrow(values) for values in arrays.links_of(*found)]
                yield _row(kinds=" ".join(values.dtype.str for values in links), **dict(zip(arrays.Links._fields, links)))

        cores = max(1, min(self.links.sparkSession.sparkContext.defaultParallelism, self.rows // LEAST_LINKS))
        parts = cores * -(-self.rows // (cores * BLOCK_LINKS))
        return self.links.repartition(parts, "src").mapInArrow(run, "kinds string, nodes binary, degrees binary, ends binary, weights binary")

    def judge(self, strength: np.ndarray, graph_weight: float, resolution: float) -> arrays.Judge:
        self.blocks = self._dealt().persist(StorageLevel.MEMORY_AND_DISK)

        context = self.links.sparkSession.sparkContext
        self.strengths = context.broadcast(strength)

        def task(links, strength, state):
            target, inside, unsettled = arrays.judge(links, strength, *state, graph_weight, resolution)
            return _row(nodes=links.nodes.astype(np.int32), target=target, inside=inside, unsettled=unsettled)

        def run(*state) -> tuple[np.ndarray, float, bool]:
            shared = context.broadcast(state)
            with fixed_plans(self.links.sparkSession, 1):
                judged = self._each(task, "nodes binary, target binary, inside double, unsettled boolean", self.strengths, shared).collect()
            shared.destroy()
            target = np.full(len(strength), -1, np.int32)
            for row in judged:
                target[np.frombuffer(row["nodes"], np.int32)] = np.frombuffer(row["target"], np.int32)
            return target, math.fsum(row["inside"] for row in judged), any(row["unsettled"] for row in judged)

        return run

    def contract(self, groups: np.ndarray, count: int) -> tuple[_Blocks, float]:
        def task(links, groups):
            src, dst, weights = arrays.contracted(links, groups, count)
            return pa.RecordBatch.from_pydict({"src": src.astype(np.int32), "dst": dst.astype(np.int32), "weight": weights})

        shared = self.links.sparkSession.sparkContext.broadcast(groups)
        pairs = self._each(task, "src int, dst int, weight double", shared)
        lifted = cut(pairs.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
        shared.destroy()
        loop = F.col("src") == F.col("dst")
        sums = lifted.agg(F.sum(F.when(loop, F.col("weight"))).alias("inner"), F.count_if(~loop).alias("rows")).first()
        return _Blocks(lifted.filter(~loop), sums["rows"]), sums["inner"] or 0.0

    def close(self) -> None:
        if self.blocks is not None:
            self.blocks.unpersist()
            self.strengths.destroy()
            self.blocks = None

    def rest(self, *state) -> np.ndarray | None:
        """The communities of all nodes, where one task can find them by itself."""
        if self.rows > ONE_TASK_LINKS:
            return None
        held = self.links.sparkSession.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _row(groups=arrays.levels(arrays.Here(arrays.links_of(*_arrays(batches))), *held.value).astype(np.int32))

        found = self.links.repartition(1).mapInArrow(run, "groups binary").collect()
        held.destroy()
        return np.frombuffer(found[0]["groups"], np.int32)


def _by_number(edges: DataFrame, vertices: DataFrame, nodes: int, rows: int, top: int, graph_weight: float, resolution: float) -> DataFrame:
    """``(id, community)`` with nodes as numbers, in the order of their ids."""
    numbered = with_global_index(vertices.select("id", "strength"), "id")
    numbered = stage(numbered.select("id", F.col("index").cast("int").alias("number"), "strength", F.xxhash64("id").alias("hash")), "louvain-nodes")
    ends = edges.select("src", "dst", "weight")
    for end, other in (("src", "dst"), ("dst", "src")):
        numbers = numbered.select(F.col("id").alias(end), F.col("number").alias(f"{end}_number"))
        ends = ends.join(F.broadcast(numbers), end) if nodes <= MAX_SHARED_IDS else spread_join(ends, numbers, end, other)
    both = F.array(*(F.struct(F.col(f"{a}_number").alias("src"), F.col(f"{b}_number").alias("dst"), "weight") for a, b in (("src", "dst"), ("dst", "src"))))
    links = ends.select(F.inline(both))
    if top > nodes:
        # Edges repeat: without that a node has no more links than there are nodes.
        links = links.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    known = numbered.select("number", "strength", "hash").toArrow()
    order = np.argsort(known["number"].to_numpy())
    strength, hashes = (known[name].to_numpy()[order] for name in ("strength", "hash"))
    group = arrays.levels(_Blocks(links, rows), strength, hashes, 0.0, graph_weight, resolution)
    _, first, place = np.unique(group, return_index=True, return_inverse=True)
    names = vertices.sparkSession.sparkContext.broadcast(first[place].astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(names.value[batch.column("number").to_numpy(zero_copy_only=False)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], ["id", "name"])

    named = cut(numbered.select("id", "number").mapInArrow(run, numbered.select("id", F.col("number").alias("name")).schema))
    names.destroy()
    return named.join(numbered.select(F.col("number").alias("name"), F.col("id").alias("community")), "name").select("id", "community")


def _by_tables(both: DataFrame, vertices: DataFrame, graph_weight: float, resolution: float) -> DataFrame:
    """``(id, community)`` by joins of tables, for any number of nodes."""
    strengths = vertices.select(F.col("id").alias("src"), F.col("strength").alias("src_strength"))
    links = spread_join(both, strengths, "src", "dst")
    membership, quality = None, float("-inf")
    for _ in range(MAX_LEVELS):
        partition, level_quality = _level(
            links, vertices, graph_weight, resolution, "nodes" if membership is None else "contracted"
        )
        if membership is not None and level_quality - quality < MIN_GAIN:
            break
        quality = level_quality
        if membership is None:
            membership = partition
        else:
            step = partition.select(F.col("id").alias("community"), F.col("community").alias("next"))
            membership = cut(
                membership.join(step, "community").select("id", F.col("next").alias("community"))
            )
        links, vertices = _contract(links, vertices, partition)
    else:
        raise RuntimeError(f"no end after {MAX_LEVELS} levels")
    names = membership.groupBy("community").agg(F.min("id").alias("name"))
    return membership.join(names, "community").select("id", F.col("name").alias("community"))


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """``(id, community)``; a community is named by its smallest member. Nodes without edges are
    communities of their own."""
    linked = edges.filter("src <> dst").withColumn("weight", F.col("weight").cast("double"))
    both = symmetric(linked, "weight")
    counts = [F.count(F.lit(1)).alias("degree"), F.count("weight").alias("weighed")]
    vertices = cut(both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("strength"), *counts).withColumn("loop", F.lit(0.0)))
    sums = ("sum(strength) AS weight", "count(*) AS nodes", "sum(degree) AS links", "max(degree) AS top", "sum(weighed) AS weighed")
    facts = vertices.selectExpr(*sums).first()
    graph_weight = facts["weight"]
    if not graph_weight:
        return nodes.select("id", F.col("id").alias("community"))
    # Links without a weight, or with one that is no number, are left to the rules of tables.
    if facts["nodes"] <= MAX_SHARED_NODES and facts["weighed"] == facts["links"] and math.isfinite(graph_weight):
        named = _by_number(linked, vertices, facts["nodes"], facts["links"], facts["top"], graph_weight, resolution)
    else:
        named = _by_tables(both, vertices.drop("degree", "weighed"), graph_weight, resolution)
    return nodes.select("id").join(named, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = RESOLUTION) -> float:
    """Modularity of a partition ``(id, community)`` of the weighted undirected graph."""
    ends = edges.select("src", "dst", "weight").filter("src <> dst")
    named = (
        ends.join(communities.select(F.col("id").alias("src"), F.col("community").alias("a")), "src")
        .join(communities.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    )
    # Each edge counts for the communities of both its ends; a union would join everything twice.
    inside = F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0).alias("inside")
    halves = named.select(F.inline(F.array(*(F.struct(F.col(end).alias("community"), inside, "weight") for end in ("a", "b")))))
    per = halves.groupBy("community").agg(F.sum("inside").alias("inside"), F.sum("weight").alias("total"))
    sums = per.agg(F.sum("inside"), F.sum("total"), F.sum(F.col("total").cast("double") ** 2)).first()
    if not sums[1]:
        return 0.0
    return sums[0] / sums[1] - resolution * sums[2] / sums[1] ** 2
