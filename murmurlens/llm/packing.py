"""Packing by minimum bin slack over the histogram of lengths.

Documents longer than a window are cut into whole windows and a rest. All rests of one length are
alike, so the packing problem is a histogram with fewer lengths than the window has places,
whatever the number of documents. For each window a subset-sum dynamic programme over bitsets,
with the counts as multiplicities, starts from the longest rest left and finds the multiset that
comes closest to the capacity; backtracking gives its counts, and the same multiset is used as
often as the counts allow. Documents then find their window by their rank among the rests of their
length: a range join against the short list of multisets, without moving any text or id.

Defined results: a null text counts as empty and is packed as its end id alone; repeated rows,
documents of the same length and null ids are pieces of their own; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurlens.llm.common import column, slices, texts_of
from murmurlens.llm.wordbpe import word_table
from murmurlens.runtime import stage

CAPACITY = 2048
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, place long"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of at most ``counts`` items of each length whose sum comes closest to
    ``capacity`` from below. Bit ``s`` of a set says that sum ``s`` can be reached; multiplicities
    are taken as powers of two, and the sets before each step allow the way back."""
    whole, reached, steps = (1 << capacity + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, power = min(counts[length], capacity // length), 1
        while left:
            times = min(power, left)
            steps.append((reached, length, times))
            reached |= reached << length * times & whole
            left, power = left - times, power * 2
        if reached >> capacity & 1:
            break
    total, used = reached.bit_length() - 1, {}
    for before, length, times in reversed(steps):
        if not before >> total & 1:
            total -= length * times
            used[length] = used.get(length, 0) + times
    return used


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """``(multiset, times)`` until every item of the histogram is used."""
    left, plan = {length: n for length, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fill({length: n for length, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[length] // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        plan.append((used, times))
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Documents as ids, cut at whole windows: a row per piece, with its rank (``place``) among the
    pieces of its length within its task (``part``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = word_table(tokenizer), np.array([end_id], np.uint32)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in slices(batches, most=3 << 20):
            ids, cuts = known.encode(column(batch, "text"))
            rows = []
            for doc_id, a, b in zip(column(batch, "doc_id").to_pylist(), cuts.tolist(), cuts[1:].tolist()):
                doc = np.concatenate([ids[a:b], end])
                for start in range(0, len(doc), capacity):
                    piece = doc[start : start + capacity]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(doc), part, seen[len(piece)]))
                    seen[len(piece)] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"])

    return texts_of(docs).mapInArrow(run, PIECE)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces ``(length, part, place, …)`` of at most
    ``capacity`` each. Sequences are numbered from 0 without gaps."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = counted.select("length", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_rank"))
    # At most ``capacity`` rows, whatever the input.
    histogram = {row[0]: row[1] for row in counted.groupBy("length").agg(F.sum("rows")).collect()}
    spans, sequence, taken = [], 0, dict.fromkeys(histogram, 0)
    for used, times in plan_windows(histogram, capacity):
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            spans.append((length, taken[length], taken[length] + n * times, n, sequence, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    # A few rows for each multiset, and each multiset uses up a length: bounded by the capacity.
    found = spark.createDataFrame(spans, "span_length long, lo long, hi long, per long, base long, first_offset long")
    grouped = found.groupBy("span_length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "per", "base", "first_offset"))).alias("spans"))
    ranked = pieces.join(firsts, ["length", "part"]).withColumn("rank", F.col("first_rank") + F.col("place"))
    span = F.filter("spans", lambda s: (s.lo <= F.col("rank")) & (F.col("rank") < s.hi))[0]
    return (
        ranked.join(F.broadcast(grouped), F.col("length") == F.col("span_length"))
        .withColumn("span", span)
        .withColumn("sequence_id", F.col("span.base") + F.floor((F.col("rank") - F.col("span.lo")) / F.col("span.per")))
        .withColumn("offset", F.col("span.first_offset") + (F.col("rank") - F.col("span.lo")) % F.col("span.per") * F.col("length"))
        .drop("span", "spans", "span_length", "rank", "first_rank", "part", "place")
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and their offset in it."""
    return pack(stage(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
