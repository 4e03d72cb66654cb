"""Vectorised hashes of words and n-grams over the bytes of many texts at once.

A group of texts is one byte array with the place where each text begins. White space is the six
ASCII characters of ``[\\x20\\x09-\\x0D]``, which never occur inside a longer UTF-8 character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_HASHES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (no nulls) and the place where each begins; the last place is the end."""
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    cuts = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, cuts - cuts[0]


def word_spans(flat: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word, and the place in them where each text begins."""
    inside = ~SPACE[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[cuts] = True
    before = np.concatenate([[False], inside[:-1]]) if len(flat) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(flat) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, cuts)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    powers = np.cumprod(np.full(int(lengths.max()), STEP | np.uint64(1)), dtype=np.uint64)
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    inner = at - np.repeat(starts, lengths)
    summed = np.cumsum(BYTE_HASHES[flat[at]] * powers[inner], dtype=np.uint64)
    last = summed[np.cumsum(lengths) - 1]
    return mix(np.diff(last, prepend=np.uint64(0)) + lengths.astype(np.uint64))


def runs(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` values in a row; a text's last ``width - 1`` places are not runs."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    n = len(values) - width + 1
    summed = np.zeros(n, np.uint64)
    for i in range(width):
        summed = summed * STEP + values[i : i + n]
    return mix(summed)


def byte_runs(flat: np.ndarray, width: int) -> np.ndarray:
    """Each ``width`` (at most 7) bytes in a row as one number, no hash."""
    if len(flat) < width:
        return np.zeros(0, np.uint64)
    n = len(flat) - width + 1
    found = np.zeros(n, np.uint64)
    for i in range(width):
        found = (found << np.uint64(8)) | flat[i : i + n]
    return found


def starts_of_runs(cuts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of the ``total - width + 1`` runs over concatenated texts lie within one text."""
    n = max(0, total - width + 1)
    inside = np.ones(n, bool)
    for i in range(1, width):
        at = cuts[1:-1] - i
        inside[at[(at >= 0) & (at < n)]] = False
    return inside
