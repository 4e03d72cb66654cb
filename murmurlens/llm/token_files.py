"""Token-id output: Arrow stream files of fixed-size-list batches.

The documents are laid out in ascending id order (ties by text, null ids first) over shards. A
shard is one stream file whose batches hold ``sequence_length`` ids and as many mask bits per row,
and a second, small stream with a row per document: its id, its place in the shard and its length.
All sequences of a file have the same size and all batches but the last the same rows, so sequence
``i`` is found by division, and a memory-mapped file gives it without a copy. Ids take 16 bits
where the vocabulary allows it, 32 otherwise. Only the last row of a shard is padded (id 0, mask
false).

A shard is written under a name of its own attempt and then renamed, so a task that is run again
after a lost executor replaces nothing by halves; the manifest holds the names that count. Files
go to ``folder`` through :mod:`pyarrow.fs`, that is to a shared disk, HDFS or an object store.

Defined results: a null text counts as empty and gives its end id alone; repeated rows are kept as
documents of their own; an empty table gives no shard; extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurlens.llm.common import column, slices, texts_of
from murmurlens.llm.wordbpe import word_table
from murmurlens.runtime import checkpoint_root, stage

SEQUENCE_LENGTH = 2048
ROWS_PER_BATCH = 256
MANIFEST = "shard long, name string, documents long, tokens long, sequences long"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


class ShardWriter:
    """Collects documents and writes whole batches as soon as they are full."""

    def __init__(self, files: fs.FileSystem, path: str, name: str, id_type: pa.DataType, length: int, rows: int):
        self.length, self.rows, self.id_type = length, rows, id_type
        self.schema = pa.schema([("input_ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = files.open_output_stream(f"{path}/{name}.arrow")
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.waiting, self.held = [], 0
        self.documents: list[tuple[int | None, int, int]] = []
        self.tokens = self.sequences = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.waiting.append(ids.astype(self.id_type.to_pandas_dtype()))
        self.held += len(ids)
        if self.held >= self.rows * self.length:
            self._flush(whole=True)

    def _flush(self, whole: bool) -> None:
        flat, full = np.concatenate(self.waiting), self.rows * self.length
        place = 0
        while len(flat) - place >= full or not whole and place < len(flat):
            self._write(flat[place : place + full])
            place += full
        self.waiting, self.held = [flat[place:]], max(0, len(flat) - place)

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        mask = np.arange(rows * self.length) < len(ids)
        ids = np.concatenate([ids, np.zeros(rows * self.length - len(ids), ids.dtype)])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.sequences += rows

    def close(self) -> None:
        if self.held:
            self._flush(whole=False)
        self.out.close()
        self.sink.close()


class TokenShard:
    """Random access to a written shard; ``sequence(i)`` and ``mask(i)`` are views of the file."""

    def __init__(self, files: fs.FileSystem, path: str):
        source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(source))
        self.per_batch = self.batches[0].num_rows if self.batches else 0

    def __len__(self) -> int:
        return sum(batch.num_rows for batch in self.batches)

    def _row(self, name: str, i: int) -> pa.Array:
        batch = self.batches[i // self.per_batch]
        return batch.column(name).slice(i % self.per_batch, 1).flatten()

    def sequence(self, i: int) -> np.ndarray:
        return self._row("input_ids", i).to_numpy()

    def mask(self, i: int) -> np.ndarray:
        return self._row("mask", i).to_numpy(zero_copy_only=False)

    def span(self, start: int, length: int) -> np.ndarray:
        """Ids ``start`` to ``start + length``, across sequences and batches."""
        if not length:
            return np.zeros(0, np.uint32)
        width = len(self.sequence(0))
        per, parts = self.per_batch * width, []
        while length:
            flat = self.batches[start // per].column("input_ids").flatten().to_numpy()
            parts.append(flat[start % per : start % per + length])
            start, length = start + len(parts[-1]), length - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_shards(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str,
    sequence_length: int = SEQUENCE_LENGTH, rows_per_batch: int = ROWS_PER_BATCH,
) -> DataFrame:
    """Write all documents below ``folder``; returns the manifest, one row per shard."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_table(tokenizer)
        id_type = pa.uint16() if max(known.vocabulary, end_id + 1) <= 1 << 16 else pa.uint32()
        shard, end, out = TaskContext.get().partitionId(), np.array([end_id], np.uint32), None
        files, path = open_folder(folder)
        name = f"shard-{shard:07d}-{uuid.uuid4().hex[:12]}"
        for batch in slices(batches, most=8 << 20):
            ids, cuts = known.encode(column(batch, "text"))
            for doc_id, a, b in zip(column(batch, "doc_id").to_pylist(), cuts.tolist(), cuts[1:].tolist()):
                if out is None:
                    files.create_dir(path, recursive=True)
                    out = ShardWriter(files, path, f"{name}.part", id_type, sequence_length, rows_per_batch)
                out.add(doc_id, np.concatenate([ids[a:b], end]))
        if out is None:
            return
        out.close()
        keys, starts, lengths = zip(*out.documents)
        index = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], ["doc_id", "start", "n_tokens"])
        with files.open_output_stream(f"{path}/{name}.docs.arrow") as sink, pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_batch(index)
        files.move(f"{path}/{name}.part.arrow", f"{path}/{name}.arrow")
        row = [[shard], [name], [len(keys)], [out.tokens], [out.sequences]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["shard", "name", "documents", "tokens", "sequences"])

    ordered = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInArrow(write, MANIFEST), "token-shards")


def read_documents(manifest: DataFrame, folder: str, of_ids: Callable[[np.ndarray], object], kind: str) -> DataFrame:
    """``(doc_id, start, n_tokens, value)`` from the files alone: ``value`` is ``of_ids`` of the
    document's ids, ``start`` the number of ids in all documents before it. A task per shard."""
    spark, shards = manifest.sparkSession, manifest.count()
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.select("shard", "name", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    placed = stage(placed, "token-places").repartitionByRange(max(1, shards), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        for batch in batches:
            for name, base in zip(column(batch, "name").to_pylist(), column(batch, "base").to_pylist()):
                shard = TokenShard(files, f"{path}/{name}.arrow")
                with files.open_input_file(f"{path}/{name}.docs.arrow") as source:
                    index = pa.ipc.open_stream(source).read_all().combine_chunks()
                for some in index.to_batches(max_chunksize=5000):
                    starts, lengths = column(some, "start").to_pylist(), column(some, "n_tokens").to_pylist()
                    values = [of_ids(shard.span(a, n)) for a, n in zip(starts, lengths)]
                    yield pa.RecordBatch.from_arrays(
                        [column(some, "doc_id"), pa.array([base + a for a in starts], pa.int64()), column(some, "n_tokens"), pa.array(values)],
                        ["doc_id", "start", "n_tokens", "value"],
                    )

    return placed.select("name", "base").mapInArrow(read, f"doc_id long, start long, n_tokens long, value {kind}")


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_folder(docs: DataFrame) -> str:
    """A new folder for token files in the shared checkpoint folder."""
    return f"{checkpoint_root(docs.sparkSession)}/tokens/{uuid.uuid4().hex}"
