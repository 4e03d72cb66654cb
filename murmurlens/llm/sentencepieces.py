"""SentencePiece ids by a table of distinct marked words, and decoding.

White space becomes a marker in front of the next word. When no piece of the vocabulary has a
marker behind another character, no merge can cross the front of a marked word, so a text's ids
are those of its marked words in order. Every task keeps a table of the distinct marked words it
has met, segments each new one once with the library and joins the ids back by position. The scan
is not shuffled: the table is built where the texts lie.

Defined results: a null text counts as empty and has no ids; repeated rows give repeated rows;
extra columns are not read. A model that could merge across markers is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from murmurlens.llm.common import column, slices, texts_of, worker_cache
from murmurlens.llm.wordbpe import Kept, gather

MARK = "▁"
MOST_CHUNKS = 120_000
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")


class ChunkTable:
    """Ids of marked words. A chunk is kept without its first marker, which the library's own
    dummy prefix stands for; the empty chunk is a marker alone."""

    def __init__(self, path: str, most: int = MOST_CHUNKS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in piece.lstrip(MARK) for piece in pieces) or self.model.encode("a  b ", out_type=str)[-1] != MARK:
            raise ValueError("pieces of this model can cross white-space markers")
        self.alone = self.model.piece_to_id(MARK)
        self.chunks = Kept(most)

    def _learn(self, chunks: list[str]) -> None:
        lost = self.chunks.missing(chunks)
        for chunk, ids in zip(lost, self.model.encode(lost, num_threads=1)):
            self.chunks.young[chunk] = np.array(ids if chunk else [self.alone], np.uint32).tobytes()

    def _flat(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self._learn(chunks)
        raw = [*map(self.chunks.young.__getitem__, chunks)]
        return np.frombuffer(b"".join(raw), np.uint32), np.fromiter(map(len, raw), np.int64, len(raw)) // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the place where each text begins in them. Texts are cut at single spaces;
        runs of spaces and literal markers, which are rare, are cut by pattern instead."""
        strange = pc.match_substring_regex(texts, f"^$|  |^ | $|{MARK}").to_numpy(zero_copy_only=False)
        single = pc.split_pattern(texts.filter(pa.array(~strange)) if strange.any() else texts, " ")
        coded = single.flatten().dictionary_encode()
        flat, lengths = self._flat(coded.dictionary.to_pylist())
        starts = np.cumsum(lengths) - lengths
        at = coded.indices.to_numpy(zero_copy_only=False)
        per_chunk = lengths[at]
        ids, ends = gather(flat, starts[at], per_chunk), np.concatenate([[0], np.cumsum(per_chunk)])
        cuts = ends[single.offsets.to_numpy() - single.offsets[0].as_py()] if len(single) else np.zeros(1, np.int64)
        if not strange.any():
            return ids, cuts
        parts, plain = [], zip(cuts.tolist(), cuts[1:].tolist())
        for i, by_pattern in enumerate(strange.tolist()):
            if by_pattern:
                text = texts[i].as_py()
                parts.append(self._flat_in_order([x[1:].replace(MARK, " ") for x in CHUNK.findall(" " + text)] if text else []))
            else:
                a, b = next(plain)
                parts.append(ids[a:b])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)

    def _flat_in_order(self, chunks: list[str]) -> np.ndarray:
        self._learn([*dict.fromkeys(chunks)])
        return np.frombuffer(b"".join(map(self.chunks.young.__getitem__, chunks)), np.uint32)


def chunk_table(path: str) -> ChunkTable:
    return worker_cache(f"chunks:{path}", lambda: ChunkTable(path))


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_table(path)
        for batch in slices(batches, most=6 << 20):
            ids, cuts = known.encode(column(batch, "text"))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` for every text."""
    return texts_of(docs).mapInArrow(_encoded(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null ids count as none."""

    def run(batches):
        for batch in batches:
            lists = column(batch, "ids")
            for start in range(0, batch.num_rows, 200):
                some = lists.slice(start, 200).to_pylist()
                texts = chunk_table(path).model.decode([x or [] for x in some])
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(start, 200), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


ROUND_TRIP = "doc_id long, ids array<int>, decoded string"


def _round_trip(path: str):
    def run(batches):
        model = chunk_table(path).model
        for batch in _encoded(path)(batches):
            lists = column(batch, "ids")
            for start in range(0, batch.num_rows, 200):
                some = lists.slice(start, 200)
                texts = model.decode(some.to_pylist())
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(start, 200), some, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: both directions in one pass over the texts."""
    return texts_of(docs).mapInArrow(_round_trip(path), ROUND_TRIP)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of what :func:`round_trip` gives, taken
    where the ids are made, so that they need not leave the task."""

    def run(batches):
        for batch in _round_trip(path)(batches):
            lists = column(batch, "ids")
            flat = lists.flatten().to_numpy()
            cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            names = np.unique(flat)
            joined = pc.cast(pa.array(names), pa.string()).to_numpy(zero_copy_only=False)
            words = joined[np.searchsorted(names, flat)].tolist()
            sums = [hashlib.sha256(",".join(words[a:b]).encode()).hexdigest() for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            texts = column(batch, "decoded").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array(np.diff(cuts), pa.int64()),
                    pa.array(sums),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
