"""Language-model scoring by context-tree weighting over bytes.

A byte is coded as eight binary decisions. For every decision, given the last ``0 … DEPTH`` bytes,
training counts zeros and ones, from which the Krichevsky-Trofimov estimator gives both a
probability of all training decisions at that context and the next one's. A context's weighted
probability is half its own and half the product of those of the contexts that extend it by one
older byte; the ratio of the two is the posterior weight of stopping there. A decision is then
predicted by the mixture over all depths along its context. Contexts that training never saw have
no evidence to add: the mixture ends at the deepest one seen. A text is its lower-cased (A-Z)
bytes and one end byte (0xFF, which UTF-8 never uses) after a context of end bytes, so the scores
are log-probabilities of a proper distribution over texts.

How it runs: documents are dealt into parts of about ``PART_BYTES`` by a hash of their id. A part
sends each distinct byte run (and each distinct word, for the unigram base) once, with its training
count, to the shelf that its last context bytes (or its hash) name. Shelves add the counts up and
weight the contexts they hold; only sums per last context byte, 256 rows at most, go on to the
driver for the two shallowest levels. Then every shelf answers the requests of every part, and the
parts score their documents from the answers. Answers come in the order of the keys, which a part knows. Nothing whole passes through one place: a shelf's
requests are split by groups of ``PARTS_PER_GROUP`` parts, and counts are added up per group first.

Defined results: a null text counts as empty: its only token is the end; without training documents
every byte has eight even decisions; repeated rows are texts of their own; a null id is hashed as
an empty string; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlens.llm.common import column, in_fold, slices, total_bytes
from murmurlens.llm.hashing import LOWER, byte_runs, bytes_of, mix, word_hashes, word_spans
from murmurlens.runtime import stage

DEPTH = 5
PART_BYTES = 16 << 20
PARTS_PER_GROUP = 64
END = 255
COUNTS = "part long, group long, shelf long, keys binary, counts binary"
LOG_HALF = float(np.log(0.5))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight above the argument."""
    shift = np.prod([x + i for i in range(8)], axis=0)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-probability of that many zeros and ones, in any one order."""
    zeros, ones = np.asarray(zeros, float), np.asarray(ones, float)
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - 2 * log_gamma(np.array(0.5))


def decisions(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each gram (context bytes, then the coded byte) and each of its eight decisions: context
    and place in the byte's tree as one number, and the decision."""
    byte, context = grams & np.uint64(255), grams >> np.uint64(8) << np.uint64(8)
    places, bits = [], []
    for i in range(8):
        places.append(context | (np.uint64(1 << i) | byte >> np.uint64(8 - i)))
        bits.append(byte >> np.uint64(7 - i) & np.uint64(1))
    return np.stack(places, axis=1), np.stack(bits, axis=1)


class Level:
    """The contexts of one depth: sorted numbers, counts, and log of the weighted probability."""

    def __init__(self, names, zeros, ones, below):
        self.names, self.zeros, self.ones = names, zeros, ones
        own = log_kt(zeros, ones)
        self.weighted = own if below is None else np.logaddexp(LOG_HALF + own, LOG_HALF + below)
        self.stop = np.ones(len(names)) if below is None else np.exp(np.minimum(LOG_HALF + own - self.weighted, 0))
        self.next_one = (ones + 0.5) / (zeros + ones + 1)

    def shorter(self, depth: int) -> Level:
        """The level of contexts with ``depth`` bytes, one less than here."""
        parent, at = np.unique(self.names & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        add = lambda values: np.bincount(at, values, len(parent))
        return Level(parent, add(self.zeros), add(self.ones), add(self.weighted))

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.names, names), max(0, len(self.names) - 1))
        return at, self.names[at] == names if len(self.names) else np.zeros(len(names), bool)


def levels_of(grams: np.ndarray, counts: np.ndarray, depth: int, least: int) -> list[Level]:
    """Levels ``depth`` down to ``least``, deepest first, from distinct grams with counts."""
    seen = counts > 0
    places, bits = decisions(grams[seen])
    names, at = np.unique(places, return_inverse=True)
    weight = np.repeat(counts[seen], 8).astype(float)
    ones = np.bincount(at.ravel(), weight * bits.ravel(), len(names))
    found = [Level(names, np.bincount(at.ravel(), weight, len(names)) - ones, ones, None)]
    for d in range(depth - 1, least - 1, -1):
        found.append(found[-1].shorter(d))
    return found


class Top:
    """The two shallowest levels, from sums per (last context byte, place): dense and small."""

    def __init__(self, names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        one = Level(names, zeros, ones, below)
        root = one.shorter(0)
        self.reach, self.mixed, self.leaf = np.ones(1 << 16), np.zeros(1 << 16), np.full(1 << 16, 0.5)
        for last in range(256):
            at = (root.names + np.uint64(last << 8)).astype(int)
            self.leaf[at] = root.next_one
        at = one.names.astype(int)
        up, _ = root.find(one.names & np.uint64(255))
        reach, mixed = 1 - root.stop[up], root.stop[up] * root.next_one[up]
        self.leaf[at] = mixed + reach * one.next_one
        self.reach[at], self.mixed[at] = reach * (1 - one.stop), mixed + reach * one.stop * one.next_one

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.reach, self.mixed, self.leaf


def answer(requests: np.ndarray, grams: np.ndarray, counts: np.ndarray, top: tuple, depth: int) -> np.ndarray:
    """log10 of the mixture's probability of each requested gram's last byte."""
    reach_1, mixed_1, leaf_1 = top
    places, bits = decisions(requests)
    flat = places.ravel()
    chance = leaf_1[(flat & np.uint64(0xFFFF)).astype(int)]
    above = None
    for d, level in zip(range(2, depth + 1), reversed(levels_of(grams, counts, depth, 2))):
        if above is None:
            at = (level.names & np.uint64(0xFFFF)).astype(int)
            reach, mixed = reach_1[at], mixed_1[at]
        else:
            up, _ = above.find(level.names & np.uint64((1 << 8 * d) - 1))
            reach, mixed = reach_up[up], mixed_up[up]
        leaf = mixed + reach * level.next_one
        at, seen = level.find(flat & np.uint64((1 << 8 * (d + 1)) - 1))
        chance = np.where(seen, leaf[at] if len(leaf) else chance, chance)
        reach_up, mixed_up, above = reach * (1 - level.stop), mixed + reach * level.stop * level.next_one, level
    chance = np.where(bits.ravel() == 1, chance, 1 - chance)
    return np.log10(chance).reshape(-1, 8).sum(axis=1)


def grams_of(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram at every byte and end of all texts, and the place where each text begins."""
    flat, cuts = bytes_of(texts)
    n = len(cuts) - 1
    padded = np.full(len(flat) + depth * (n + 1), END, np.uint8)
    sizes = np.diff(cuts)
    at = np.arange(len(flat)) + np.repeat(depth * (np.arange(n) + 1), sizes)
    padded[at] = LOWER[flat]
    grams = byte_runs(padded, depth + 1)
    scored = np.zeros(len(grams) + depth, bool)
    scored[at - depth] = True
    scored[cuts[1:] + depth * np.arange(n)] = True
    places = np.concatenate([[0], np.cumsum(sizes + 1)])
    return grams[scored[: len(grams)]], places


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, cuts = bytes_of(texts)
    flat = LOWER[flat]
    starts, ends, at = word_spans(flat, cuts)
    return word_hashes(flat, starts, ends), at


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(np.concatenate(keys), return_inverse=True)
    return names, np.bincount(at, np.concatenate(counts), len(names)).astype(np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    firsts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return values[firsts], np.diff(np.append(firsts, len(values)))


def _shelf(keys: np.ndarray, kind: int, shelves: int) -> np.ndarray:
    """Even shelves hold byte runs, by their last two context bytes; odd ones hold words."""
    names = mix(keys >> np.uint64(8) & np.uint64(0xFFFF)) if kind == 0 else keys
    return ((names >> np.uint64(32)) * np.uint64(shelves) >> np.uint64(32)).astype(np.int64) * 2 + kind


def _kinds_of(group: pa.Table, depth: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a part's texts in order, and their counts in training texts."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for batch in slices(group.to_batches(), most=2 << 20):
        train = ~column(batch, "held_out").to_numpy(zero_copy_only=False).astype(bool)
        values, at = grams_of(column(batch, "text"), depth) if kind == 0 else words_of(column(batch, "text"))
        learnt = np.repeat(train, np.diff(at))
        keys, counts = _distinct(values[learnt])
        rest, _ = _distinct(values[~learnt])
        found += [(keys, counts), (rest, np.zeros(len(rest), np.int64))]
    return _counted([x for x, _ in found], [n for _, n in found])


def _by_shelf(keys: np.ndarray, kind: int, shelves: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts keys on their shelves, each in key order, and the shelves."""
    shelf = _shelf(keys, kind, shelves)
    order = np.argsort(shelf, kind="stable")
    return order, shelf[order]


def _count(depth: int, shelves: int):
    def run(group: pa.Table) -> pa.Table:
        part, rows = group.column("part")[0].as_py(), []
        for kind in (0, 1):
            keys, counts = _kinds_of(group, depth, kind)
            order, shelf = _by_shelf(keys, kind, shelves)
            keys, counts = keys[order], counts[order].astype("<u4")
            names, firsts = np.unique(shelf, return_index=True)
            for name, a, b in zip(names.tolist(), firsts.tolist(), np.append(firsts[1:], len(keys)).tolist()):
                rows.append((part, part // PARTS_PER_GROUP, name, keys[a:b].tobytes(), counts[a:b].tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["part", "group", "shelf", "keys", "counts"])

    return run


def _added(group: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    return _counted(
        [np.frombuffer(x, np.uint64) for x in group.column("keys").to_pylist()],
        [np.frombuffer(x, kind) for x in group.column("counts").to_pylist()],
    )


def _add(group: pa.Table) -> pa.Table:
    keys, counts = _added(group, "<u4")
    return pa.table([group.column("shelf").slice(0, 1), pa.array([keys.tobytes()]), pa.array([counts.tobytes()])], ["shelf", "keys", "counts"])


def _weigh(depth: int):
    """Add up a shelf; byte runs also give the sums for the shallow levels, words their totals."""

    def run(group: pa.Table) -> pa.Table:
        keys, counts = _added(group, "<i8")
        keys, counts = keys[counts > 0], counts[counts > 0]
        shelf, top = group.column("shelf")[0].as_py(), None
        if shelf % 2 == 0 and len(keys):
            two = levels_of(keys, counts, depth, 2)[-1]
            names, at = np.unique(two.names & np.uint64(0xFFFF), return_inverse=True)
            sums = [np.bincount(at, x, len(names)) for x in (two.zeros, two.ones, two.weighted)]
            top = np.concatenate([names.astype(float), *sums]).tobytes()
        rows = [[shelf], [keys.tobytes()], [counts.tobytes()], [top], [int(counts.sum())], [len(keys)]]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(x, k) for x, k in zip(rows, kinds)], ["shelf", "keys", "counts", "top", "total", "kinds"])

    return run


def _top_rows(batches):
    """Sums of the shallow levels as rows (place, zeros, ones, weighted)."""
    for batch in batches:
        for raw in column(batch, "top").to_pylist():
            values = np.frombuffer(raw).reshape(4, -1)
            yield pa.RecordBatch.from_arrays([pa.array(values[0].astype(np.int64)), *(pa.array(x) for x in values[1:])], ["place", "zeros", "ones", "weighted"])


def _respond(top: tuple, depth: int):
    def run(key, requests: pa.Table, model: pa.Table) -> pa.Table:
        grams, counts = _added(model, "<i8") if model.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        wanted = [np.frombuffer(x, np.uint64) for x in requests.column("keys").to_pylist()]
        word = key[0].as_py() % 2
        names = _distinct(np.concatenate(wanted))[0] if wanted else grams[:0]
        if word:
            at = np.minimum(np.searchsorted(grams, names), max(0, len(grams) - 1))
            values = np.where(grams[at] == names, counts[at], 0) if len(grams) else np.zeros(len(names), np.int64)
        else:
            values = answer(names, grams, counts, top, depth)
        values = [values[np.searchsorted(names, x)].tobytes() for x in wanted]
        return pa.table([requests.column("part"), requests.column("shelf"), pa.array(values, pa.binary())], ["part", "shelf", "value"])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def _score(depth: int, shelves: int, train_tokens: int, kinds: int, ends: int):
    whole = train_tokens + 0.5 * (kinds + 1)
    log_of = lambda counts: np.log10((counts + 0.5) / whole)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kept = []
        rows = sorted(zip(answers.column("shelf").to_pylist(), answers.column("value").to_pylist()))
        for kind, number in ((0, "<f8"), (1, "<i8")):
            keys, _ = _kinds_of(docs, depth, kind)
            order, _ = _by_shelf(keys, kind, shelves)
            values = np.empty(len(keys), number)
            values[order] = np.frombuffer(b"".join(value for shelf, value in rows if shelf % 2 == kind), number)
            kept.append((keys, values))
        (grams, chances), (words, counts) = kept
        logs = log_of(counts)
        out = []
        for batch in slices(docs.to_batches(), most=1 << 20):
            found, at = grams_of(column(batch, "text"), depth)
            summed = np.concatenate([[0.0], np.cumsum(chances[np.searchsorted(grams, found)])])
            score, size = np.diff(summed[at]), np.diff(at) - 1
            found, at = words_of(column(batch, "text"))
            place = np.searchsorted(words, found)
            base = np.diff(np.concatenate([[0.0], np.cumsum(logs[place])])[at]) + log_of(ends)
            known = np.diff(np.concatenate([[0], np.cumsum(counts[place] > 0)])[at]) + (ends > 0)
            per_byte = -score / np.log10(2.0) / np.maximum(1, size)
            columns = [np.diff(at) + 1, known, np.full(len(known), train_tokens), base, score, size, per_byte]
            out.append(pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), *map(pa.array, columns)], [x.split()[0] for x in SCORES.split(", ")]))
        return pa.Table.from_batches(out)

    return run


def score_documents(docs: DataFrame, folds: int = 5, held_out: int = 1, depth: int = DEPTH) -> DataFrame:
    """Scores of every document by a model of those outside the held-out fold (see ``SCORES``):
    ``base_score`` by unigram words, ``score`` by context-tree weighting, both log10; and the code
    length per byte in bits."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be from 2 to 6")
    spark = docs.sparkSession
    known = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), in_fold("doc_id", folds, held_out).alias("held_out")
    )
    parts = max(1, -(-total_bytes(known) // PART_BYTES))
    dealt = known.withColumn("part", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(parts)))
    counts = stage(dealt.groupBy("part").applyInArrow(_count(depth, parts), COUNTS), "counts-of-parts")
    summed = counts.groupBy("shelf", "group").applyInArrow(_add, "shelf long, keys binary, counts binary")
    shelves = stage(
        summed.groupBy("shelf").applyInArrow(_weigh(depth), "shelf long, keys binary, counts binary, top binary, total long, kinds long"), "shelves"
    )
    tops = shelves.filter("top IS NOT NULL").select("top").mapInArrow(_top_rows, "place long, zeros double, ones double, weighted double")
    # At most 65,536 rows: a last context byte and a place in a byte's tree.
    rows = tops.groupBy("place").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).orderBy("place").toPandas().to_numpy(float)
    top = Top(rows[:, 0].astype(np.uint64), rows[:, 1], rows[:, 2], rows[:, 3]).arrays() if len(rows) else (np.ones(1 << 16), np.zeros(1 << 16), np.full(1 << 16, 0.5))
    ends = known.filter(~F.col("held_out")).count()
    words = shelves.filter("shelf % 2 = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    shared = spark.sparkContext.broadcast(top)  # three times 65,536 numbers
    groups = counts.select(F.col("shelf").alias("of_shelf"), F.col("group").alias("of_group")).distinct()
    models = shelves.join(groups, F.col("shelf") == F.col("of_shelf")).select("of_shelf", "of_group", "keys", "counts")
    answers = counts.groupBy("shelf", "group").cogroup(models.groupBy("of_shelf", "of_group")).applyInArrow(
        lambda key, requests, model: _respond(shared.value, depth)(key, requests, model), "part long, shelf long, value binary"
    )
    scoring = _score(depth, parts, words[0] + ends, words[1] + (ends > 0), ends)
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(scoring, SCORES)
