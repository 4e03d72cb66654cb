"""The rounds and levels of Louvain over numbered nodes, as arrays.

Nodes are numbered in the order of their ids, so that the smallest number stands for the smallest id.
Nothing here knows of Spark: a graph is anything that can judge all nodes and contract itself.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

# Fixed value: the modularity gain below which a level ends.
MIN_GAIN = 1e-7

# A level ends when nobody wants to move or this many rounds in a row gain less than ``ROUND_GAIN``.
ROUND_GAIN = 1e-5
PATIENCE = {"nodes": 3, "contracted": 5}
# More than that is an error, not a result.
MAX_ROUNDS = 200
MAX_LEVELS = 50

# Sums by key go into a table with a place for every key that might occur, where it has so many places a row at most.
DENSE = 4

Judge = Callable[[np.ndarray, np.ndarray, np.ndarray | None], tuple[np.ndarray, float, bool]]


class Links(NamedTuple):
    """All links of some nodes: of the first node first, as many as its degree says, then of the next."""

    nodes: np.ndarray
    degrees: np.ndarray
    ends: np.ndarray
    weights: np.ndarray


def links_of(src: np.ndarray, dst: np.ndarray, weights: np.ndarray) -> Links:
    order = np.argsort(src, kind="stable")
    nodes, degrees = np.unique(src, return_counts=True)
    return Links(nodes.astype(np.int32), degrees.astype(np.int32), dst[order].astype(np.int32), weights[order])


def firsts_of(keys: np.ndarray) -> np.ndarray:
    """Where each key of the sorted ``keys`` comes first."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def sums_by_key(keys: np.ndarray, weights: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``keys``, all below ``span``, in order and the sum of the weights of each."""
    if span <= DENSE * len(keys):
        found = np.flatnonzero(np.bincount(keys))
        return found, np.bincount(keys, weights)[found]
    order = np.argsort(keys)
    keys = keys[order]
    starts = firsts_of(keys)
    return keys[starts], np.add.reduceat(weights[order], starts)


def heads(hashes: np.ndarray, turn: int) -> np.ndarray:
    """``pmod(xxhash64(id, turn as text), 2) = 0`` of Spark, from ``xxhash64(id)``: texts of under four bytes go in byte by byte."""
    text, whole = str(turn).encode(), 2**64 - 1
    if len(text) > 3:
        raise ValueError("turns have three digits at most")
    first, second, third, fifth = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    mixed = hashes.view(np.uint64) + np.uint64(fifth + len(text))
    for byte in text:
        mixed = mixed ^ np.uint64(byte * fifth & whole)
        mixed = (mixed << np.uint64(11) | mixed >> np.uint64(53)) * np.uint64(first)
    mixed = (mixed ^ mixed >> np.uint64(33)) * np.uint64(second)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(third)
    return (mixed ^ mixed >> np.uint64(32)) & np.uint64(1) == 0


def judge(
    links: Links, strength: np.ndarray, community: np.ndarray, totals: np.ndarray, is_open: np.ndarray | None, graph_weight: float, resolution: float
) -> tuple[np.ndarray, float, bool]:
    """For each node of ``links`` the open community with the largest gain, of equal ones the smallest, or -1
    where staying is as good; the weight of links inside communities; whether a node would go anywhere, open or not."""
    count, span = len(links.nodes), len(totals)
    own, mine_strength = community[links.nodes].astype(np.int64), strength[links.nodes]
    # A link of weight 0 from every node to itself stands for staying.
    rows = np.concatenate([np.repeat(np.arange(count), links.degrees), np.arange(count)])
    keys = rows * span + np.concatenate([community[links.ends], own])
    keys, inside = sums_by_key(keys, np.concatenate([links.weights, np.zeros(count)]), count * span)
    row, there = np.divmod(keys, span)
    mine = there == own[row]
    node_strength = mine_strength[row]
    others = totals[there] - mine * node_strength
    gain = inside - resolution * node_strength * others / graph_weight
    stay = gain[mine] + 1e-12
    firsts = firsts_of(row)
    away = np.where(mine, -np.inf, gain)
    unsettled = bool((np.maximum.reduceat(away, firsts) > stay).any())
    if is_open is not None:
        away = np.where(is_open[there], away, -np.inf)
    most = np.maximum.reduceat(away, firsts)
    best = np.flatnonzero(away == most[row])
    target = np.where(most > stay, there[best[firsts_of(row[best])]], -1)
    return target.astype(np.int32), float(inside[mine].sum()), unsettled


def rounds(
    judge_all: Judge, strength: np.ndarray, hashes: np.ndarray, loops: float, graph_weight: float, resolution: float, kind: str
) -> tuple[np.ndarray, float]:
    """The best partition of one level, as a community for every node, and its modularity.

    ``judge_all`` gets the communities in use, numbered from 0 in their order."""
    community = np.arange(len(strength))
    best, best_quality, stalled, judged = None, float("-inf"), 0, None
    for turn in range(MAX_ROUNDS):
        used = np.bincount(community, minlength=len(strength)) > 0
        in_use, compact = np.flatnonzero(used), (np.cumsum(used) - 1)[community]
        totals = np.bincount(compact, strength)
        flips = heads(hashes, turn)
        # After a step back the same partition is judged; on the first level nothing else goes into it.
        if judged is None or kind != "nodes":
            target, inside, unsettled = judge_all(compact.astype(np.int32), totals, None if kind == "nodes" else flips[in_use])
        else:
            target, inside, unsettled = judged
        quality = (inside + loops) / graph_weight - resolution * float((totals**2).sum()) / graph_weight**2
        stalled = stalled + 1 if quality - best_quality < ROUND_GAIN else 0
        if quality > best_quality:
            best, best_quality, best_judged = community, quality, (target, inside, unsettled)
        if stalled > PATIENCE[kind] or not unsettled:
            return best, best_quality
        if quality < best_quality:
            community, judged = best, best_judged
            continue
        moves = (target >= 0) & ~(flips if kind == "nodes" else flips[community])
        community, judged = np.where(moves, in_use[target], community), None
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")


class Here:
    """A graph whose links are all in this process."""

    def __init__(self, links: Links):
        self.links, self.rows = links, len(links.ends)

    def judge(self, strength: np.ndarray, graph_weight: float, resolution: float) -> Judge:
        def run(community, totals, is_open):
            target = np.full(len(strength), -1, np.int32)
            target[self.links.nodes], inside, unsettled = judge(self.links, strength, community, totals, is_open, graph_weight, resolution)
            return target, inside, unsettled

        return run

    def contract(self, groups: np.ndarray, count: int) -> tuple[Here, float]:
        src, dst, weights = contracted(self.links, groups, count)
        loop = src == dst
        return Here(links_of(src[~loop], dst[~loop], weights[~loop])), float(weights[loop].sum())

    def rest(self, *state) -> None:
        """There is no other task to leave the rest to."""

    def close(self) -> None:
        """There is nothing to give back."""


def contracted(links: Links, groups: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links between groups, and from a group to itself, with summed weights."""
    keys = np.repeat(groups[links.nodes].astype(np.int64), links.degrees) * count + groups[links.ends]
    keys, weights = sums_by_key(keys, links.weights.astype(np.float64), count * count)
    return *np.divmod(keys, count), weights


def levels(graph, strength: np.ndarray, hashes: np.ndarray, loops: float, graph_weight: float, resolution: float, quality: float | None = None) -> np.ndarray:
    """The number of its community for every node. ``quality`` is the modularity that a level before has come to."""
    member = np.arange(len(strength))
    try:
        for _ in range(MAX_LEVELS):
            # Without links between nodes nobody can move.
            if not graph.rows:
                return member
            rest = graph.rest(strength, hashes, loops, graph_weight, resolution, quality)
            if rest is not None:
                return rest[member]
            judge_all = graph.judge(strength, graph_weight, resolution)
            community, reached = rounds(judge_all, strength, hashes, loops, graph_weight, resolution, "nodes" if quality is None else "contracted")
            if quality is not None and reached - quality < MIN_GAIN:
                return member
            quality = reached
            kept, groups = np.unique(community, return_inverse=True)
            member, strength, hashes = groups[member], np.bincount(groups, strength), hashes[kept]
            finer = graph
            graph, inner = finer.contract(groups.astype(np.int32), len(kept))
            finer.close()
            loops += inner
    finally:
        graph.close()
    raise RuntimeError(f"no end after {MAX_LEVELS} levels")
