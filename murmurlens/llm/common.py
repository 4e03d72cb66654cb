"""Helpers shared by the text operators: column picking, bounded slices, worker-wide resources."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: Column | str) -> DataFrame:
    """``(doc_id, text, …)`` with a null text as the empty one; all other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def in_fold(key: str, folds: int, wanted: int) -> Column:
    """Whether crc32 of the key as text leaves ``wanted`` when divided by ``folds``."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds == wanted


def worker_cache(name: str, build: Callable[[], object]) -> object:
    """A resource built once per worker process and kept for its later tasks, until a task of another
    kind asks for its own or calls :func:`start_afresh`. A worker holds one at a time."""
    holder = sys.modules.setdefault("_murmurlens_worker", types.ModuleType("_murmurlens_worker"))
    if getattr(holder, "held", (None, None))[0] != name:
        start_afresh()
        holder.held = (name, build())
    return holder.held[1]


def start_afresh() -> None:
    """Let go of what an earlier task of another kind kept in this worker."""
    holder = sys.modules.get("_murmurlens_worker")
    if holder is not None and hasattr(holder, "held"):
        del holder.held
        gc.collect()
    give_back()


def give_back() -> None:
    """Return freed memory to the system; allocators keep it for the life of the process otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than glibc


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices with about ``most`` bytes of text each (one row at least), so that what a task
    holds as Python objects doesn't depend on the batch size. No row is lost or repeated."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size + 64
        yield batch.slice(start)
        give_back()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def total_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, from the lengths alone."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def thinned(df: DataFrame, by: str, wanted: int, total: int | Column) -> DataFrame:
    """About four times ``wanted`` of ``total`` rows, or all where there are fewer: those with the
    smallest hashes ``by``. Taking a bounded sample from these instead of from all rows keeps what
    tasks send to the driver bounded however many tasks there are."""
    share = F.lit(4.0 * wanted) / F.greatest(F.lit(1), total if isinstance(total, Column) else F.lit(total))
    return df.filter(F.pmod(F.col(by), F.lit(1 << 40)) < share * F.lit(float(1 << 40)))
