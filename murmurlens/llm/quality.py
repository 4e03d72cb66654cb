"""Quality rules: fixed rules, then a calibrated classifier over hashed n-grams.

The classifier is a logistic regression over hashed words, word pairs and byte trigrams, each as
its share of the text's n-grams. It is fitted by AdaGrad on a bounded, documented sample of
labelled documents (at most ``sample``, half per class, in the order of a hash of their ids, each
class weighted to its true share); a fifth of the sample is kept apart to fit the two parameters of
Platt's calibration. Texts are scored whole, in Arrow batches, against a fixed threshold.

Defined results: a null text has no words and fails the rules; documents whose labels contradict
each other are not used for fitting; without labels of both classes the rules alone decide;
repeated rows give repeated rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlens.llm.common import column, slices, start_afresh, thinned
from murmurlens.llm.hashing import SPACE, byte_runs, bytes_of, mix, runs, starts_of_runs, word_hashes, word_spans

FEATURE_BITS = 18
SAMPLE, PASSES, RATE, SHRINK = 3000, 12, 0.5, 1e-6
SLICE = 512 << 10
MIN_WORDS, MOST_REPEATED_PERCENT, MIN_QUALITY = 50, 50, 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


@dataclass
class QualityModel:
    weights: np.ndarray | None
    bias: float
    slope: float
    """Calibrated probability: 1 / (1 + exp(-(slope * raw + bias)))."""


def features(flat: np.ndarray, cuts: np.ndarray, words: np.ndarray, word_cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words, word pairs and byte trigrams: the feature numbers of all texts with repetition, text
    after text, and where each text begins."""
    for salt, (values, at, width) in enumerate([(words, word_cuts, 1), (words, word_cuts, 2), (None, cuts, 3)]):
        grams = byte_runs(flat, width) if values is None else runs(values, width)
        total = len(flat) if values is None else len(words)
        inside = starts_of_runs(at, width, total)
        numbers = (mix(grams[inside] + np.uint64(salt * 7919)) >> np.uint64(64 - FEATURE_BITS)).astype(np.uint32)
        yield numbers, np.concatenate([[0], np.cumsum(inside)])[np.minimum(at, len(inside))]


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct feature numbers of each text with their share of all its features."""
    out = []
    for text in texts:
        flat, cuts = bytes_of(pa.array([text]))
        starts, ends, at = word_spans(flat, cuts)
        numbers = np.concatenate([x for x, _ in features(flat, cuts, word_hashes(flat, starts, ends), at)])
        names, times = np.unique(numbers, return_counts=True)
        out.append((names, (times / max(1, len(numbers))).astype(np.float32)))
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[str], good: list[int], weight: list[float], passes: int = PASSES) -> QualityModel:
    """Fit on four fifths of the rows, calibrate on the rest; rows come in hash order."""
    rows, y, weight = counted(texts), np.array(good, float), np.array(weight, float)
    apart = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~apart)
    w, squares, bias, bias_square = np.zeros(1 << FEATURE_BITS), np.full(1 << FEATURE_BITS, 1e-8), 0.0, 1e-8
    scale = 30.0  # shares are small; this puts raw scores in the range of the logistic curve
    for turn in range(passes):
        for batch in np.array_split(np.random.default_rng(turn).permutation(train), max(1, len(train) // 50)):
            raw = np.array([scale * (w[rows[i][0]] @ rows[i][1]) for i in batch]) + bias
            slope = weight[batch] * (_sigmoid(raw) - y[batch])
            at = np.concatenate([rows[i][0] for i in batch])
            by = np.concatenate([scale * g * rows[i][1] for i, g in zip(batch, slope)]) / len(batch)
            step = np.bincount(at, by, 1 << FEATURE_BITS)
            step += SHRINK * w * (step != 0)
            squares += step * step
            w -= RATE * step / np.sqrt(squares)
            bias_square += slope.mean() ** 2
            bias -= RATE * slope.mean() / np.sqrt(bias_square)
    raw = np.array([scale * (w[names] @ share) for names, share in rows]) + bias
    held = np.flatnonzero(apart) if len(set(y[apart])) == 2 else np.arange(len(rows))
    slope, shift = _calibrate(raw[held], y[held], weight[held])
    return QualityModel((scale * slope * w).astype(np.float32), slope * bias + shift, slope)


def _calibrate(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's two parameters by damped Newton steps, with his softened targets."""
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x, found = np.stack([raw, np.ones_like(raw)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ found)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weight * (p - target)) + 1e-3 * (found - [1.0, 0.0]))
        found = found - np.clip(step, -1, 1)
        if abs(step).max() < 1e-9:
            break
    return max(float(found[0]), 1e-3), float(found[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[int], list[float]]:
    """At most ``sample`` texts with their label and the weight that restores the classes' shares."""
    agreed = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("labelled_id"))
        .agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
        .filter("least = most")
        .select("labelled_id", F.col("least").cast("int").alias("good"), F.xxhash64("labelled_id").alias("by"))
    )
    totals = {row[0]: row[1] for row in agreed.groupBy("good").count().collect()}
    half = sample // 2
    firsts = [
        thinned(agreed.filter(F.col("good") == c), "by", half, totals.get(c, 0)).orderBy(F.pmod("by", F.lit(1 << 40)), "labelled_id").limit(half)
        for c in (0, 1)
    ]
    picked = firsts[0].union(firsts[1])
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("labelled_id"), "text")
    # Bounded by ``sample`` rows of three numbers.
    found = texts.join(F.broadcast(picked), "labelled_id").orderBy("by", "labelled_id", "text").limit(sample).select("text", "good").collect()
    have = {c: sum(row[1] == c for row in found) for c in totals}
    share = {c: totals[c] / max(1, have[c]) for c in totals}
    mean = sum(share[row[1]] for row in found) / max(1, len(found))
    return [row[0] for row in found], [row[1] for row in found], [share[row[1]] / mean for row in found]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    texts, good, weight = labelled_sample(docs, labels, sample)
    if len(set(good)) < 2:
        return QualityModel(None, 0.0, 1.0)
    return fit(texts, good, weight)


def repeated_words(words: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Per text: words inside three-word windows that its text has twice or more."""
    n = len(words)
    inside = starts_of_runs(cuts, 3, n)
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    place = np.flatnonzero(inside)
    keys = mix(runs(words, 3)[place] + owner[place].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(place), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered, first = np.zeros(n, bool), place[twice]
    for i in range(3):
        covered[first + i] = True
    return np.diff(np.concatenate([[0], np.cumsum(covered)])[cuts])


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def score(docs: DataFrame, model: QualityModel, *more: Column | str, min_quality: float = MIN_QUALITY) -> DataFrame:
    """``(doc_id, text, …, the rules' columns, p_quality, kept)`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 2**FEATURE_BITS numbers
    known = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_afresh()
        weights, bias = shared.value
        for batch in slices(batches, most=SLICE):
            texts = column(batch, "text")
            flat, cuts = bytes_of(texts)
            starts, ends, word_cuts = word_spans(flat, cuts)
            words = word_hashes(flat, starts, ends)
            n_words = np.diff(word_cuts)
            counts = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[cuts])
            word_chars = counts(~SPACE[flat] & ((flat & 0xC0) != 0x80))
            again = repeated_words(words, word_cuts)
            lines = [repeated_lines(x) for x in texts.to_pylist()]
            failed = (n_words < MIN_WORDS) | (100 * again > MOST_REPEATED_PERCENT * n_words)
            if weights is None:
                quality = np.ones(len(texts))
            else:
                summed, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                for numbers, at in features(flat, cuts, words, word_cuts):
                    summed += np.diff(np.concatenate([[0.0], np.cumsum(weights[numbers], dtype=np.float64)])[at])
                    sizes += np.diff(at)
                quality = _sigmoid(summed / np.maximum(1, sizes) + bias)
            added = [
                *(pa.array(x, pa.int64()) for x in (n_words, word_chars, counts(SYMBOLS[flat]), lines, again)),
                pa.array(failed), pa.array(quality, pa.float64()), pa.array(~failed & (quality >= min_quality)),
            ]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_quality", "kept"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields)
    return known.mapInArrow(run, f"{fields}, {RULES}, p_quality double, kept boolean")
