"""KMeans with all restarts in one pass.

Every step is one job: a task assigns its rows to the centres of all restarts that still move and returns
a sum and a count per restart and centre, which the JVM adds up. Restarts begin with centres that are
already settled on a bounded sample, each from a seeding of its own, so that few passes over all rows
are left. Centres are all that is shared: ``restarts * k`` vectors, k being 50 at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from murmurlens.operators.vectors import as_matrix
from murmurlens.runtime import fixed_plans

SAMPLE_PER_CENTRE, ROWS_PER_SLICE = 200, 2048
SETTLED = 1e-9  # squared movement below which a centre stands still


def _squared(rows: np.ndarray, centres: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Squared distances; ``lengths`` are the squared lengths of the rows where known."""
    if lengths is None:
        lengths = (rows * rows).sum(axis=1)
    return np.maximum(lengths[:, None] - 2.0 * (rows @ centres.T) + (centres * centres).sum(axis=1), 0.0)


def seeded(sample: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """``k`` rows, each drawn with a chance that grows with the squared distance to those before it."""
    chosen = [int(random.integers(len(sample)))]
    away = _squared(sample, sample[chosen])[:, 0]
    while len(chosen) < k:
        total = away.sum()
        chosen.append(int(random.choice(len(sample), p=away / total)) if total > 0 else int(random.integers(len(sample))))
        away = np.minimum(away, _squared(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _sums(rows: np.ndarray, centres: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum, number and cost of the rows nearest to each centre."""
    away = _squared(rows, centres, lengths)
    nearest = away.argmin(axis=1)
    member = np.zeros((len(rows), len(centres)))
    member[np.arange(len(rows)), nearest] = 1.0
    return member.T @ rows, member.sum(axis=0), np.bincount(nearest, away[np.arange(len(rows)), nearest], len(centres))


def _moved(centres: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The means; a centre without rows stays."""
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)


def settled(sample: np.ndarray, centres: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        sums, counts, _ = _sums(sample, centres)
        moved = _moved(centres, sums, counts)
        if ((moved - centres) ** 2).sum(axis=1).max() <= SETTLED:
            break
        centres = moved
    return centres


def _step(rows: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Sums, counts and cost of every restart's centres, from one job."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        known, held = shared.value, {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_SLICE):
                part = as_matrix(batch.column(0).slice(start, ROWS_PER_SLICE))
                lengths = (part * part).sum(axis=1)
                for turn, places in known.items():
                    found = _sums(part, places, lengths)
                    held[turn] = [a + b for a, b in zip(held[turn], found)] if turn in held else list(found)
        for turn, (sums, counts, cost) in held.items():
            k = len(counts)
            columns = [pa.array([turn] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(counts), pa.array(cost)]
            yield pa.RecordBatch.from_arrays(columns, ["turn", "centre", "sums", "n", "cost"])

    parts = rows.select("embedding").mapInArrow(run, "turn int, centre int, sums array<double>, n double, cost double")
    added = parts.groupBy("turn", "centre").agg(
        vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"), F.sum("n").alias("n"), F.sum("cost").alias("cost")
    )
    out = {turn: (np.zeros_like(places), np.zeros(len(places)), 0.0) for turn, places in centres.items()}
    # A step is short and always the same: with a fixed plan and one task that adds up it is a single job.
    with fixed_plans(rows.sparkSession, 1):
        found = added.collect()  # one row per restart and centre
    for row in found:
        sums, counts, cost = out[row["turn"]]
        sums[row["centre"]], counts[row["centre"]] = row["sums"], row["n"]
        out[row["turn"]] = (sums, counts, cost + row["cost"])
    return out


def best_centres(rows: DataFrame, points: int, k: int, restarts: int, max_iterations: int, seed: int) -> np.ndarray:
    """The centres of the cheapest of ``restarts`` runs over ``rows(post_id, embedding)``, which should be
    kept in memory. Equal costs go to the first run."""
    wanted = SAMPLE_PER_CENTRE * k
    by = F.pmod(F.xxhash64("post_id", F.lit(seed)), F.lit(1 << 40))
    few = rows.filter(by < F.lit(min(1.0, 4.0 * wanted / max(1, points)) * (1 << 40)))
    sample = np.array([row[0] for row in few.orderBy(by, "post_id").limit(wanted).select("embedding").collect()], np.float64)
    centres = {turn: settled(sample, seeded(sample, k, np.random.default_rng(seed + turn)), max_iterations) for turn in range(restarts)}
    moving, cost = dict(centres), {}
    for _ in range(max_iterations):
        for turn, (sums, counts, spent) in _step(rows, moving).items():
            moved = _moved(centres[turn], sums, counts)
            still = ((moved - centres[turn]) ** 2).sum(axis=1).max() <= SETTLED
            centres[turn], cost[turn] = moved, spent
            if still:
                del moving[turn]
            else:
                moving[turn] = moved
        if not moving:
            break
    return centres[min(cost, key=lambda turn: (round(cost[turn], 6), turn))]


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``(post_id, cluster)``: the nearest centre of every row, the first of equally near ones."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([rows.schema["post_id"], T.StructField("cluster", T.IntegerType())])
    names = to_arrow_schema(schema).names

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_SLICE):
                part = batch.slice(start, ROWS_PER_SLICE)
                nearest = _squared(as_matrix(part.column(1)), shared.value).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nearest, pa.int32())], names=names)

    return rows.select("post_id", "embedding").mapInArrow(run, schema)
