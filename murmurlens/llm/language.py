"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (of ``ORDERS`` lengths, blended) present in
both, divided by the geometric mean of their own numbers. A Nyström map over a few landmark texts
makes it finite: ``k(x, landmarks) K^(-1/2)``. On it a kernel ridge regression per language (+1
against -1 for the rest) is solved in closed form. A kernel row is a product of the text's presence
row with the landmarks' presence matrix, so landmarks and dual weights are multiplied once into a
matrix of n-gram by language, and a batch is scored by one product of presence rows with it.

Fitting reads at most ``sample`` texts, the same number per language (``PER_LANGUAGE`` at most) in
the order of a hash of their ids (``landmarks`` of them are landmarks); where there are more languages
than that, one text of each, which then is its landmark. Every language with a text is learnt. Weights
are kept in blocks of ``BLOCK_LANGUAGES`` columns; a text is scored by one block after another, so that
a worker holds one block. N-grams are told apart by ``GRAM_BITS`` bits of a hash. Scoring reads every
text whole.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and every text when
there is nothing to learn from; ties go to the first language in name order; repeated rows give
repeated rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurlens.llm.common import column, in_fold, slices, start_afresh, thinned
from murmurlens.llm.hashing import LOWER, byte_runs, bytes_of, mix, starts_of_runs
from murmurlens.runtime import stage

ORDERS = (1, 2, 3, 4)
GRAM_BITS = 18
SAMPLE, PER_LANGUAGE, LANDMARKS, RIDGE = 1200, 600, 240, 1e-3
BLOCK_LANGUAGES = 256
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    weights: list[np.ndarray]
    """Blocks of at most ``BLOCK_LANGUAGES`` languages; row: n-gram, column: language."""


def presence(flat: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """The distinct n-gram numbers of each text."""
    flat = LOWER[flat]
    found = []
    for order in ORDERS:
        grams = byte_runs(flat, order)
        grams = (mix(grams + np.uint64(order << 56)) >> np.uint64(64 - GRAM_BITS)).astype(np.uint32)
        inside = starts_of_runs(cuts, order, len(flat))
        firsts = np.concatenate([[0], np.cumsum(inside)])
        found.append((grams[inside], firsts[np.minimum(cuts, len(inside))]))
    parts = zip(*[[g[a:b] for a, b in zip(at.tolist(), at[1:].tolist())] for g, at in found])
    sets = []
    for part in parts:
        grams = np.sort(np.concatenate(part))
        sets.append(grams[np.concatenate([[True], grams[1:] != grams[:-1]])] if len(grams) else grams)
    return sets


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Closed-form fit on a list of texts; every ``n / landmarks``-th is a landmark, or the first text of
    each language where there are more languages than landmarks."""
    languages = sorted(set(langs))
    sets = []
    for text in texts:
        sets += presence(*bytes_of(pa.array([text])))
    kept = [i for i, grams in enumerate(sets) if len(grams)]
    if not kept:
        return LanguageModel([], [])
    sets, langs = [sets[i] for i in kept], [langs[i] for i in kept]
    if len(languages) > landmarks:
        chosen = np.unique([langs.index(lang) for lang in sorted(set(langs))])
    else:
        chosen = np.unique(np.linspace(0, len(sets) - 1, min(landmarks, len(sets))).astype(int))
    marks = np.zeros((1 << GRAM_BITS, len(chosen)), np.uint8)
    for j, i in enumerate(chosen):
        marks[sets[i], j] = 1
    own = np.sqrt([len(grams) for grams in sets])
    kernel = np.array([marks[grams].sum(axis=0, dtype=np.float64) for grams in sets]) / own[:, None] / own[chosen]
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-8 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = kernel @ root
    targets = np.where(np.array(langs)[:, None] == np.array(languages), 1.0, -1.0)
    solved = np.linalg.solve(mapped.T @ mapped + ridge * len(sets) * np.eye(mapped.shape[1]), mapped.T @ targets)
    dual = (root @ solved) / own[chosen][:, None]
    weights = []
    for first in range(0, len(languages), BLOCK_LANGUAGES):
        part = dual[:, first : first + BLOCK_LANGUAGES]
        weights.append(np.concatenate([(marks[a : a + 8192].astype(np.float64) @ part).astype(np.float32) for a in range(0, len(marks), 8192)]))
    return LanguageModel(languages, weights)


def training_sample(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> tuple[list[str], list[str]]:
    """At most ``sample`` texts with their language, alike many per language, sorted by a hash."""
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    known = known.select("text", F.col("lang").cast("string"), F.xxhash64(F.col("doc_id").cast("string")).alias("by"))
    counts = stage(known.groupBy("lang").agg(F.count(F.lit(1)).alias("texts")), "languages")
    languages = counts.count()
    wanted, sample = min(PER_LANGUAGE, max(1, sample // max(1, languages))), max(sample, languages)
    some = thinned(known.join(counts, "lang"), "by", wanted, F.col("texts"))
    order = W.partitionBy("lang").orderBy(F.pmod("by", F.lit(1 << 40)), "text")
    ranked = some.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= wanted)
    rows = ranked.orderBy("place", "lang").limit(sample).select("text", "lang").collect()
    return [row[0] for row in rows], [row[1] for row in rows]


def _best_of_block(shared, batch: pa.RecordBatch, names: list[str]) -> tuple[list[str], list[float]]:
    """The best language of a block for each text, and its value; texts without a letter get -2."""
    texts, weights = column(batch, "text"), shared.value
    langs, values = [UNDETERMINED] * len(texts), [-2.0] * len(texts)
    lettered = [i for i, text in enumerate(texts.to_pylist()) if names and LETTER.search(text)]
    if lettered:
        sets = presence(*bytes_of(texts.take(pa.array(lettered))))
        sizes = np.array([len(grams) for grams in sets])
        summed = np.add.reduceat(weights[np.concatenate(sets)].astype(np.float64), np.cumsum(sizes) - sizes, axis=0)
        found = summed / np.sqrt(sizes)[:, None]
        best = found.argmax(axis=1)
        for i, k, value in zip(lettered, best.tolist(), found[np.arange(len(best)), best].tolist()):
            langs[i], values[i] = names[k], value
    return langs, values


def predict(docs: DataFrame, model: LanguageModel, *more: Column | str) -> DataFrame:
    """``(doc_id, text, …, lang_pred, score)`` of every text."""
    context = docs.sparkSession.sparkContext
    known = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *more)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields)
    if not model.languages:
        return known.select("*", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def scored_by(number: int):
        shared = context.broadcast(model.weights[number])  # 2**GRAM_BITS rows, a column per language of the block
        names = model.languages[number * BLOCK_LANGUAGES : (number + 1) * BLOCK_LANGUAGES]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start_afresh()
            for batch in slices(batches, most=512 << 10):
                langs, values = _best_of_block(shared, batch, names)
                if number:  # an earlier block wins where it is as good
                    before, held = column(batch, "lang_pred").to_pylist(), column(batch, "score").to_pylist()
                    both = [(a, x) if x >= y else (b, y) for a, x, b, y in zip(before, held, langs, values)]
                    langs, values = [x for x, _ in both], [x for _, x in both]
                columns = batch.columns[:-2] if number else batch.columns
                names_ = batch.schema.names[:-2] if number else batch.schema.names
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(values, pa.float64())], [*names_, "lang_pred", "score"])

        return run

    for number in range(len(model.weights)):
        known = known.mapInArrow(scored_by(number), f"{fields}, lang_pred string, score double")
    sure = F.when(F.col("score") < -1.5, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("score") + 1) / 2)))
    return known.withColumn("score", sure)


def identify(docs: DataFrame, folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> DataFrame:
    """Fit on all folds of crc32(doc_id) but one and predict every document:
    ``(doc_id, held_out, lang_pred, score)``."""
    out = in_fold("doc_id", folds, held_out)
    model = fit(*training_sample(docs, ~out, sample))
    found = predict(docs.select("doc_id", "text", out.alias("held_out")), model, "held_out")
    return found.select("doc_id", "held_out", "lang_pred", "score")
