"""Prefix trie of conversations: a node for every distinct sequence of first turns.

Sequences become rows of turn ids, are dealt by range of the whole row, so that the members of a node
lie next to each other, and each range shard is one padded matrix: a lexsort orders it, masks of
changed columns, OR-accumulated from left to right, mark where nodes start, and ``reduceat`` over the
starts aggregates every depth. Only nodes that may lie in more than one shard, those on the path of
a shard's first or last row, are put together afterwards.

Turn ids are two 64-bit hashes of (position, md5 of role and text), side by side in the matrix; the
exclusive-or of a prefix's ids names the prefix, again in 128 bits.

A conversation of any length is cut into bands of ``BAND`` turns, each a row of its own under the name
of the prefix before it, so that no row grows with a conversation and a conversation with a third of
all turns is spread. Nodes above a deeper band are put together like those at shard borders. Sums over
their subtrees go up the path of a band in one step and from band to band by pointer doubling, so the
rounds grow with the logarithm of the longest conversation; conversations of one band need none. Positions of turns, and
names of prefixes, come from places in range-sorted partitions and one row per partition and
conversation; a conversation is never in one task. Digests of very many members are fed to SHA-256
from sorted blocks of ids as a stream.

Defined results: turns are taken in order of (turn, md5 of role and text), null turns first; null role
and text are empty; repeated rows are turns of their own; rows without a conversation id belong to
no conversation and are left out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurlens.runtime import stage

BAND, SHARD_ROWS, BLOCK_IDS, MOST_SHARED, FAMILY = 16, 100_000, 500, 8, 5
PLACE_BITS, PAD = (1 << 33) - 1, np.iinfo(np.int64).min
NO_ENDS = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "x", "y"]
FOUND = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "shard long, up long, x long, y long, path_x array<long>, path_y array<long>, bytes long, first long, ids string, kind string"
)


def _sorted(df: DataFrame, name: str, tasks: int, *order: Column | str) -> DataFrame:
    """Range-sorted and stored, with the partition of each row and its place there."""
    dealt = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return stage(dealt.withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE_BITS))), name)


def _tasks(df: DataFrame, rows: int, per_task: int) -> int:
    """By size, and no fewer than the session has, unless they would get next to no rows."""
    set_ = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // per_task), min(set_, rows // 2000))


def rebuilt(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conversations, turns)`` of the rebuilt conversations: ``(conv_id, length)`` and ``(conv_id, p,
    id, bytes, length)``. The first ``h`` turns are those of the family's first conversation,
    ``conv_id - conv_id % 5``, ``h`` being the id's crc32 modulo 9; own turns follow after the first ``h``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = chats.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), named.alias("id"), F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),  # so that a range can end between equal rows
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id"), F.col("row")]
    placed = _sorted(rows, "turns", _tasks(chats, chats.count(), 1_000_000), *order)

    held = placed.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("held"), F.min("place").alias("first"))
    conv, before = W.partitionBy("conv_id"), W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift")
    shifts = held.select("part", "conv_id", shift, F.sum("held").over(conv).alias("own"))
    numbered = placed.join(shifts, ["part", "conv_id"]).withColumn("n", F.col("place") + F.col("shift"))
    numbered = numbered.select("conv_id", "part", "n", "id", "bytes")
    heads = numbered.filter((F.col("n") < MOST_SHARED) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("n", "id", "bytes"))).alias("head"))  # at most MOST_SHARED

    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    convs = shifts.groupBy("conv_id").agg(F.max("own").alias("own")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    convs = convs.join(heads, "base", "left").withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array()))
    convs = stage(convs.select("conv_id", "h", "head", (F.size("head") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length")), "conversations")

    moved = shifts.select("part", "conv_id").join(convs.select("conv_id", "h", F.size("head").alias("m"), "length"), "conv_id")
    own = numbered.join(moved, ["part", "conv_id"]).filter("n >= h").select("conv_id", (F.col("n") - F.col("h") + F.col("m")).alias("p"), "id", "bytes", "length")
    shared = convs.select("conv_id", F.posexplode("head").alias("p", "turn"), "length").select("conv_id", F.col("p").cast("long"), "turn.id", "turn.bytes", "length")
    return convs.select("conv_id", "length"), own.unionByName(shared)


def banded(convs: DataFrame, turns: DataFrame, band: int = BAND) -> DataFrame:
    """``(band, x, y, cells, sizes, conv_id, goes_on)``: ``band`` turns at most per row, under the name of
    the prefix before them. A conversation without turns has one empty row."""
    cell = lambda seed: F.xxhash64(F.lit(seed), "p", "id")
    cells = turns.select("conv_id", F.floor(F.col("p") / band).alias("band"), "p", cell(1).alias("a"), cell(2).alias("b"), "bytes", "length")
    rows = cells.groupBy("conv_id", "band").agg(
        F.sort_array(F.collect_list(F.struct("p", "a", "b", "bytes"))).alias("turns"),  # at most ``band``
        F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.max("length").alias("length"),
    )
    rows = stage(
        rows.select(
            "conv_id", "band", "xa", "xb", "length", F.flatten(F.transform("turns", lambda t: F.array(t.a, t.b))).alias("cells"),
            F.transform("turns", lambda t: t.bytes).alias("sizes"), (F.col("length") > (F.col("band") + 1) * band).alias("goes_on"),
        ), "bands",
    )
    zero, kept = F.lit(0).cast("long"), ["band", "x", "y", "cells", "sizes", "conv_id", "goes_on"]
    whole = rows.filter(F.col("length") <= band).withColumns({"x": zero, "y": zero}).select(kept)
    long = rows.filter(F.col("length") > band)
    dealt = _sorted(long, "long_bands", _tasks(long, long.count(), 200_000), "conv_id", "band")
    carried = dealt.groupBy("conv_id", "part").agg(F.bit_xor("xa").alias("pa"), F.bit_xor("xb").alias("pb"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    above = W.partitionBy("part", "conv_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda name, window: F.coalesce(F.bit_xor(name).over(window), zero)
    carried = carried.select("conv_id", "part", so_far("pa", before).alias("pa"), so_far("pb", before).alias("pb"))
    deep = dealt.join(carried, ["conv_id", "part"]).withColumns({"x": so_far("xa", above).bitwiseXOR(F.col("pa")), "y": so_far("xb", above).bitwiseXOR(F.col("pb"))})
    none = F.array().cast("array<bigint>")
    bare = convs.filter("length = 0").select(zero.alias("band"), zero.alias("x"), zero.alias("y"), none.alias("cells"), none.alias("sizes"), "conv_id", F.lit(False).alias("goes_on"))
    return whole.unionByName(deep.select(kept)).unionByName(bare)


def _matrix(lists: pa.Array, per: int, width: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """A padded matrix of lists, and their lengths in units of ``per`` values."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(lengths), width * per), fill, np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, lengths // per


def shard_nodes(rows: pa.Table, shard: int, band_width: int = BAND) -> pa.Table:
    """All nodes of one range shard: ``closed`` ones are complete, ``open`` ones are the part of a node
    that this shard has, with the sums of the complete subtrees right below it; ``ends`` are blocks of
    ids of conversations that end at an open node."""
    get = lambda name: rows.column(name).combine_chunks()
    numbers = lambda name: get(name).to_numpy(zero_copy_only=False)
    band, bx, by, conv, goes_on = (numbers(name) for name in ("band", "x", "y", "conv_id", "goes_on"))
    n, width = len(conv), int(pc.max(pc.list_value_length(get("sizes"))).as_py() or 0)
    cells, lengths = _matrix(get("cells"), 2, width, PAD)
    sizes, _ = _matrix(get("sizes"), 1, width, 0)
    order = np.lexsort((conv, *cells.T[::-1], by, bx, band))
    band, bx, by, conv, goes_on, cells, lengths, sizes = (x[order] for x in (band, bx, by, conv, goes_on, cells, lengths, sizes))

    # Level 0 is the prefix that a group of rows stands under, level l its first l turns.
    new = np.ones((n, width + 1), bool)
    new[1:, 0] = (band[1:] != band[:-1]) | (bx[1:] != bx[:-1]) | (by[1:] != by[:-1])
    differs = cells[1:] != cells[:-1]
    new[1:, 1:] = differs[:, ::2] | differs[:, 1::2]
    new = np.logical_or.accumulate(new, axis=1)
    real = np.arange(width + 1) <= lengths[:, None]
    start, level = np.nonzero(new & real)
    nodes, index = len(start), np.full((n, width + 1), -1, np.int64)
    index[start, level] = np.arange(nodes)
    # The node of each row at each level.
    owner = index[np.maximum.accumulate(np.where(new, np.arange(n)[:, None], 0), axis=0), np.arange(width + 1)]

    end, members, least, going = (np.zeros(nodes, np.int64) for _ in range(4))
    starts = [np.flatnonzero(new[:, k]) for k in range(width + 1)]
    for k, at in enumerate(starts):
        own = real[at, k]
        node = index[at[own], k]
        ends = np.append(at[1:], n)
        end[node], members[node] = ends[own], (ends - at)[own]
        least[node] = np.minimum.reduceat(conv, at)[own]
        going[node] = np.add.reduceat(goes_on.astype(np.int64), at)[own]
    parent = np.where(level > 0, owner[start, np.maximum(level - 1, 0)], -1)
    last = np.where(level > 0, sizes[start, np.maximum(level - 1, 0)] if width else 0, 0)
    opened = (level == 0) | (start == 0) | (end == n) | (going > 0)
    below = level > 0
    children = np.bincount(parent[below & ~opened], minlength=nodes)

    # What closed nodes add stands at the row where they start, summed over a row's deeper levels.
    sums = []
    for value in (np.where(~opened & (children == 0), 1, 0), np.where(opened, 0, (members - 1) * last)):
        grid = np.zeros((n, width + 1), np.int64)
        grid[start, level] = value
        grid = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1]
        total = np.zeros(nodes, np.int64)
        for k, at in enumerate(starts):
            own = real[at, k]
            total[index[at[own], k]] = np.add.reduceat(grid[:, k], at)[own]
        direct = total.copy()  # an open node leaves out what its open children have
        under = below & opened
        np.subtract.at(direct, parent[under], total[under])
        sums.append(np.where(opened, direct, total))
    leaves, saved = sums

    x, y = (np.concatenate([b[:, None], np.bitwise_xor.accumulate(cells[:, i::2], axis=1) ^ b[:, None]], axis=1) for i, b in ((0, bx), (1, by)))
    depth = band[start] * band_width + level
    digests, blocks = _endings(conv, owner[np.arange(n), lengths], ~goes_on, opened)

    number = np.cumsum(opened) - 1  # of the open nodes in this shard
    under_closed = below & ~opened[parent]
    base = below == False  # noqa: E712
    out = {
        "conv_id": least, "depth": depth, "n_convs": np.where(base & (band[start] > 0), 0, members), "n_children": children, "n_leaves": leaves,
        "saved_tokens": saved, "shard": np.full(nodes, shard), "x": x[start, level], "y": y[start, level], "bytes": last,
    }
    names = [field.split()[0] for field in FOUND.split(", ")]
    columns = {k: pa.array(v.astype(np.int64)) for k, v in out.items()}
    where = lambda values, known: pa.array(values.astype(np.int64), mask=~known)
    columns["parent_conv_id"] = where(least[parent], under_closed)
    columns["up"] = where(np.where(opened, number, number[parent]), opened | (below & ~under_closed))
    # Names of all prefixes from the band's start to an open node.
    steps = np.where(opened, level + 1, 0)
    cuts = np.concatenate([[0], np.cumsum(steps)])
    row, at = np.repeat(start, steps), np.arange(cuts[-1]) - np.repeat(cuts[:-1], steps)
    columns |= {k: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v[row, at])) for k, v in (("path_x", x), ("path_y", y))}
    columns["ends_sha256"] = pa.array([None if o else digests.get(i, NO_ENDS) for i, o in enumerate(opened.tolist())], pa.string())
    columns["first"], columns["ids"] = pa.nulls(nodes, pa.int64()), pa.nulls(nodes, pa.string())
    columns["kind"] = pa.array(np.where(opened, "open", np.where(under_closed, "closed", "closed_under_open")).astype(object), pa.string())
    found = pa.table([columns[name] for name in names], names=names)
    if not blocks:
        return found
    at = np.array([b[0] for b in blocks])
    ends = {name: pa.nulls(len(at), found.schema.field(name).type) for name in names}
    ends |= {name: columns[name].take(pa.array(at)) for name in KEY}
    ends |= {"first": pa.array([b[1] for b in blocks], pa.int64()), "ids": pa.array([b[2] for b in blocks], pa.string()), "kind": pa.array(["ends"] * len(at), pa.string())}
    return pa.concat_tables([found, pa.table([ends[name] for name in names], names=names)])


def _endings(conv: np.ndarray, node: np.ndarray, ends: np.ndarray, opened: np.ndarray) -> tuple[dict[int, str], list]:
    """Digests of the ids that end at closed nodes, and blocks of those that end at open ones."""
    at = np.flatnonzero(ends)
    at = at[np.argsort(node[at], kind="stable")]  # rows of one sequence are in order of their ids
    cuts = np.flatnonzero(np.diff(node[at], prepend=-1))
    digests, blocks = {}, []
    ids = conv[at].tolist()
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
        owner = int(node[at[a]])
        if opened[owner]:
            blocks += [(owner, ids[i], ",".join(map(str, ids[i : min(b, i + BLOCK_IDS)]))) for i in range(a, b, BLOCK_IDS)]
        else:
            digests[owner] = hashlib.sha256(",".join(map(str, ids[a:b])).encode()).hexdigest()
    return digests, blocks


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each open node's ids, fed block by block in the order of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[name] for name in KEY)
                if key != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256(row["ids"].encode())
                else:
                    state.update(b"," + row["ids"].encode())
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], [*KEY, "ends_sha256"])
                done = []
        if at is not None:
            done.append((*at, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], [*KEY, "ends_sha256"])

    sorted_ = ends.select(*KEY, "first", "ids").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return sorted_.mapInArrow(run, "depth long, x long, y long, ends_sha256 string")


def _subtree_sums(opens: DataFrame, band: int) -> DataFrame:
    """Replace ``n_leaves`` and ``saved_tokens`` of open nodes, their own and those of the closed subtrees
    right below, by the sums over all open nodes of their subtree.

    Within a band a node adds to every prefix of its path. What stands below the end of a band first
    goes to that node, and from there, by pointer doubling over the ends of bands, up the paths."""
    sums = ["n_leaves", "saved_tokens"]
    at = F.posexplode(F.arrays_zip("path_x", "path_y")).alias("i", "of")
    spread = opens.select("depth", F.size("path_x").alias("length"), *sums, at)
    parts = spread.select((F.col("depth") - F.col("length") + 1 + F.col("i")).alias("depth"), F.col("of.path_x").alias("x"), F.col("of.path_y").alias("y"), *sums, "i", "length")
    below = (F.col("i") == 0) & (F.col("depth") > 0)  # the end of the band above
    added = parts.filter(~below).select(*KEY, *sums)
    deepest = opens.agg(F.max("depth")).first()[0] or 0
    if deepest > band:
        added = added.unionByName(_from_deeper_bands(opens, parts.filter(below & (F.col("length") > 1)), sums, band, deepest))
    total = added.groupBy(*KEY).agg(*[F.sum(name).alias(name) for name in sums])
    return opens.drop(*sums).join(total, KEY)


def _from_deeper_bands(opens: DataFrame, below: DataFrame, sums: list[str], band: int, deepest: int) -> DataFrame:
    """What the nodes at the ends of bands hand up to the prefixes of their paths."""
    held = below.groupBy(*KEY).agg(*[F.sum(name).alias(name) for name in sums])
    ends = opens.drop(*sums).join(held, KEY)
    above = F.col("depth") >= 2 * band
    state = ends.select(*KEY, *sums, F.when(above, F.col("path_x")[0]).alias("ax"), F.when(above, F.col("path_y")[0]).alias("ay"))
    state, step = stage(state, "band-ends"), band  # (ax, ay) names the end of a band ``step`` above
    while step + band <= deepest:
        more = state.filter(F.col("depth") >= step + band).groupBy((F.col("depth") - step).alias("depth"), F.col("ax").alias("x"), F.col("ay").alias("y"))
        more = more.agg(*[F.sum(name).alias(f"more_{name}") for name in sums])
        grown = state.join(more, KEY, "left").select(
            *KEY, *[(F.col(name) + F.coalesce(f"more_{name}", F.lit(0))).alias(name) for name in sums], "ax", "ay", (F.col("depth") - step).alias("ad")
        )
        up = state.select(F.col("depth").alias("ad"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
        # Ends with no other end two steps above go without the join.
        far, none = F.col("depth") >= 2 * step + band, F.lit(None).cast("long")
        state = grown.filter(~far).select(*KEY, *sums, none.alias("ax"), none.alias("ay")).unionByName(
            grown.filter(far).join(up, ["ad", "ax", "ay"]).select(*KEY, *sums, F.col("bx").alias("ax"), F.col("by").alias("ay"))
        )
        state, step = stage(state, "band-ends"), 2 * step
    whole = state.drop("ax", "ay").join(opens.drop(*sums), KEY)
    spread = whole.select("depth", *sums, F.size("path_x").alias("length"), F.posexplode(F.arrays_zip("path_x", "path_y")).alias("i", "of"))
    spread = spread.select((F.col("depth") - F.col("length") + 1 + F.col("i")).alias("depth"), F.col("of.path_x").alias("x"), F.col("of.path_y").alias("y"), *sums, "i")
    return spread.filter((F.col("i") > 0) | (F.col("depth") == 0)).select(*KEY, *sums)


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(convs: DataFrame, turns: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of conversations ``(conv_id, length)`` with turns ``(conv_id, p, id, bytes, length)``, ``p``
    counting from 0 without gaps: a row ``RESULT`` per distinct sequence of first turns."""
    rows = stage(banded(convs, turns, band), "rows")
    tasks = _tasks(rows, rows.count(), shard_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            yield from shard_nodes(pa.Table.from_batches(held), TaskContext.get().partitionId(), band).to_batches(10_000)

    dealt = rows.repartitionByRange(tasks, "band", "x", "y", "cells", "conv_id")
    found = stage(dealt.mapInArrow(run, FOUND), "nodes", ["kind"])
    kind = lambda name: found.filter(F.col("kind") == name)

    parts = kind("open").select(
        "shard", "up", *KEY, "path_x", "path_y", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "bytes"
    )
    merged = parts.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"),
        F.max_by(F.struct("path_x", "path_y"), F.size("path_x")).alias("path"),  # not that of the band that begins here
        *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    up = lambda name: F.when(F.size(f"path.{name}") > 1, F.element_at(f"path.{name}", -2))
    merged = stage(merged.select("*", "path.path_x", "path.path_y", up("path_x").alias("parent_x"), up("path_y").alias("parent_y")).drop("path"), "open_nodes")
    of = [(F.col("depth") - 1).alias("depth"), F.col("parent_x").alias("x"), F.col("parent_y").alias("y")]
    open_children = merged.filter("depth > 0").groupBy(*of).agg(F.count(F.lit(1)).alias("more"))
    counted = merged.join(open_children, KEY, "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    counted = counted.withColumns({
        "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"),
        "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes"),
    })
    opens = _subtree_sums(stage(counted, "open_counted"), band)
    named = merged.select(F.col("depth").alias("above"), F.col("x").alias("parent_x"), F.col("y").alias("parent_y"), F.col("conv_id").alias("parent_conv_id"))
    opens = opens.withColumn("above", F.col("depth") - 1).join(named, ["above", "parent_x", "parent_y"], "left")
    opens = opens.join(_digests(kind("ends")), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))

    parents = parts.select("shard", "up", *KEY).join(merged.select(*KEY, F.col("conv_id").alias("parent")), KEY).select("shard", "up", "parent")
    under = kind("closed_under_open").join(parents, ["shard", "up"]).withColumn("parent_conv_id", F.col("parent"))
    return kind("closed").select(RESULT).unionByName(under.select(RESULT)).unionByName(opens.select(RESULT))


def conversation_trie(chats: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    return trie(*rebuilt(chats), band, shard_rows)
