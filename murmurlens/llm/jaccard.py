"""N-gram Jaccard join with parity sketches.

A document is the set of its distinct word shingles. Sets that are equal are one class from the
start. For a size band, the range of shingle hashes is cut into as many blocks as the band's
largest set has shingles, and a set's sketch has one word per block: the exclusive-or of the hashes
that fall in it. A shingle that only one of two sets has changes one word at most, so the number of
differing words is a lower bound of the symmetric difference, which for similar sets is at most a
seventh of both sizes together (at 3/4). By the pigeonhole principle, of any ``d + 1`` words that
one set has, one is also a word of the other. Sets pick those ``d + 1`` by a common order, rarest
words first: words of one set only come first and need not be joined at all, so a passage shared
by very many documents doesn't bring these together unless it makes up most of them.

How it runs: (1) one pass gives sizes and set hashes, and classes by aggregation; (2) a second pass
over the classes' texts packs sketch words by hash range, and each range finds the words that
several sets have; words of more than one in ``HEAVY_SHARE`` documents are counted in the first
pass and skip this exchange, so no range grows with one word; (3) the words that are left are
joined. Pairs from lists of up to ``BUSY`` sets are verified on the whole sets. Longer lists come
from large groups of near copies: sets connected by them form a group, whose pairs are compared
block by block in tasks that return a spanning forest, not pairs.

Set elements and words are hashes of 48 to 64 bits; apart from collisions of those the result is
exact. Defined results: null and empty texts and those without words have no shingles and link
with nothing; a text with fewer words than a shingle is one element; repeated rows are copies;
rows without an id are documents too, and link like others; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlens.llm.common import column, slices, total_bytes
from murmurlens.llm.hashing import LOWER, bytes_of, mix, runs, word_hashes, word_spans
from murmurlens.llm.wordbpe import gather
from murmurlens.operators.components import connected_components
from murmurlens.runtime import stage

WIDTH = 5
HEAVY_SHARE = 512
SMALL_SET = 32
RANGE_BYTES = 16 << 20
HELD_WORDS = 1_200_000
BUSY, BLOCK = 8, 512
NO_ID = (1 << 63) - 1
LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, cuts = bytes_of(texts)
    flat = LOWER[flat]
    starts, ends, at = word_spans(flat, cuts)
    words = word_hashes(flat, starts, ends)
    whole, sets = runs(words, width), []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= width:
            found = np.sort(whole[a : b - width + 1])
            sets.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        else:
            sets.append(runs(words[a:b], b - a) if b > a else words[:0])
    return sets


def set_hash(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    mixed = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    total = (int(mixed.sum(dtype=np.uint64)) + 3 * int(np.bitwise_xor.reduce(mixed)) + len(shingles)) % (1 << 64)
    return int(mix(np.array([total], np.uint64)).astype(np.int64)[0])


def bands_of(n: int) -> list[tuple[int, int]]:
    """``(band, d)``: the size bands that a set of ``n`` takes part in, with the largest symmetric
    difference to a similar set there. Band ``j`` joins sets of ``2**j`` to ``2**(j+1) - 1`` with
    each other and with larger similar ones."""
    own = n.bit_length() - 1
    found = [(own, (n + 4 * n // 3) // 7)]
    if own and 3 * n <= 4 * ((1 << own) - 1):
        found.append((own - 1, (n + (1 << own) - 1) // 7))
    return found


def sketch_words(shingles: np.ndarray, band: int) -> np.ndarray:
    """The sketch of a set in a band: a word for each block that has shingles, in block order."""
    if 1 << band >= SMALL_SET:
        blocks = shingles >> np.uint64(63 - band)
        shingles = np.bitwise_xor.reduceat(shingles, np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])))
    return mix(shingles + np.uint64((band + 1) * 0xA0761D6478BD642F % (1 << 64)))


def pack48(values: np.ndarray) -> bytes:
    values = values & LOW48
    return (values >> np.uint64(16)).astype("<u4").tobytes() + values.astype("<u2").tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) << np.uint64(16) | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64)


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names.split())


PROFILE = "id key n class band own_words own_d low_words low_d word seen"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set sizes and hashes, and, as rows with a word, words seen in many documents of a slice."""

    def rows(values, width):
        columns = [*zip(*values)] if values else [()] * width
        return [pa.array(x, pa.int64()) for x in columns]

    for batch in slices(batches, most=2 << 20):
        sets = shingle_sets(column(batch, "text"))
        n, found, sketches = len(sets), [], []
        for s in sets:
            bands = bands_of(len(s)) if len(s) else []
            words = [sketch_words(s, band) for band, _ in bands]
            sketches += words
            sizes = [x for w, (_, d) in zip(words, bands) for x in (len(w), d)] + [None] * (4 - 2 * len(bands))
            found.append((len(s), set_hash(s), bands[0][0] if bands else None, *sizes))
        yield _batch(PROFILE, column(batch, "id"), column(batch, "key"), *rows(found, 7), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()))
        if sketches:
            words = np.sort(np.concatenate(sketches))
            firsts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            seen = np.diff(np.append(firsts, len(words)))
            many = seen >= max(4, n // HEAVY_SHARE)
            nothing = [pa.nulls(int(many.sum()), pa.int64())] * 9
            yield _batch(PROFILE, *nothing, pa.array(words[firsts[many]].astype(np.int64)), pa.array(seen[many]))


def _packed(keys: np.ndarray, units: np.ndarray, words: np.ndarray, counts: np.ndarray | None) -> list[tuple]:
    """A row for each key: its units, how many words each has, and all these words (and counts)."""
    order = np.lexsort((units, keys))
    keys, units, words = keys[order], units[order], words[order]
    counts = None if counts is None else counts[order]
    names, firsts = np.unique(keys, return_index=True)
    rows = []
    for key, a, b in zip(names.tolist(), firsts.tolist(), np.append(firsts[1:], len(keys)).tolist()):
        own, sizes = np.unique(units[a:b], return_counts=True)
        many = None if counts is None else np.minimum(counts[a:b], (1 << 32) - 1).astype("<u4").tobytes()
        rows.append((key, own.tobytes(), sizes.astype("<i4").tobytes(), pack48(words[a:b]), many))
    return rows


PACKED = "place long, units binary, sizes binary, words binary, counts binary"


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return _batch("place units sizes words counts", *(pa.array(x, k) for x, k in zip(zip(*rows), kinds)))


def _words(heavy: tuple[np.ndarray, np.ndarray], ranges: int):
    """Packed sketch words of the classes by hash range. Heavy words, whose counts are known, go
    straight to the place of their unit, written as ``-1 - place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, spans = [], []

        def sorted_rows() -> Iterator[pa.RecordBatch]:
            flat, owner = np.concatenate(spans), np.repeat(np.array(units, np.int64), [len(s) for s in spans])
            if len(heavy[0]):
                at = np.minimum(np.searchsorted(heavy[0], flat), len(heavy[0]) - 1)
                hit = heavy[0][at] == flat
                if hit.any():
                    yield _packed_batch(_packed(-1 - np.mod(owner[hit], ranges), owner[hit], flat[hit], heavy[1][at[hit]]))
                flat, owner = flat[~hit], owner[~hit]
            if len(flat):
                place = ((flat >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                yield _packed_batch(_packed(place, owner, flat, None))

        for batch in slices(batches, most=2 << 20):
            sets = shingle_sets(column(batch, "text"))
            for s, wanted in zip(sets, column(batch, "class").to_pylist()):
                if not len(s) or set_hash(s) != wanted:
                    continue
                for band, d in bands_of(len(s)):
                    words = sketch_words(s, band)
                    if len(words) <= d:
                        raise ValueError("a sketch has too few words for its band")
                    units.append(wanted ^ band)
                    spans.append(words)
            if sum(map(len, spans)) > HELD_WORDS:
                yield from sorted_rows()
                units, spans = [], []
        if units:
            yield from sorted_rows()

    return run


def _unpacked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Units and words of packed rows, word by word."""
    units = [np.repeat(np.frombuffer(u, np.int64), np.frombuffer(s, "<i4")) for u, s, _ in rows]
    return np.concatenate(units), np.concatenate([unpack48(w) for _, _, w in rows])


def _shared(ranges: int):
    """Words that several units have, with their number of units, packed by the units' places."""

    def of(rows):
        units, words = _unpacked(rows)
        order = np.argsort(words, kind="stable")
        words, units = words[order], units[order]
        firsts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        counts = np.diff(np.append(firsts, len(words)))
        counts = np.repeat(counts, counts)
        many = counts > 1
        if many.any():
            yield _packed_batch(_packed(np.mod(units[many], ranges), units[many], words[many], counts[many]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            for row in zip(*(column(batch, x).to_pylist() for x in ("place", "units", "sizes", "words", "counts"))):
                if row[0] < 0:
                    yield _packed_batch([(-1 - row[0], *row[1:])])
                    continue
                if row[0] != current and rows:
                    yield from of(rows)
                    rows = []
                current = row[0]
                rows.append(row[1:4])
        if rows:
            yield from of(rows)

    return run


def _prefixes(shared: pa.Table, known: pa.Table) -> pa.Table:
    """The words by which units are joined: the ``d + 1`` rarest of each, without those it has
    alone, which come first."""
    rows = [*zip(*(shared.column(x).to_pylist() for x in ("units", "sizes", "words")))]
    out = [np.zeros(0, np.int64)] * 2
    if rows and known.num_rows:
        units, words = _unpacked(rows)
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in shared.column("counts").to_pylist()])
        order = np.lexsort((words, counts, units))
        units, words = units[order], words[order]
        fresh = np.concatenate([[True], (units[1:] != units[:-1]) | (words[1:] != words[:-1])])
        units, words = units[fresh], words[fresh]
        firsts = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]]))
        sizes = np.diff(np.append(firsts, len(units)))
        names, order = known.column("unit").to_numpy(), np.argsort(known.column("unit").to_numpy())
        at = order[np.searchsorted(names[order], units[firsts])]
        alone = known.column("total").to_numpy()[at] - sizes
        need = known.column("d").to_numpy()[at] + 1 - alone
        kept = np.arange(len(units)) - np.repeat(firsts, sizes) < np.repeat(need, sizes)
        classes = np.repeat(known.column("class").to_numpy()[at], sizes)[kept]
        bands = (units[kept] ^ classes).astype(np.uint64)
        out = [mix(words[kept] + bands * np.uint64(0xE7037ED1A0B428DB)).astype(np.int64), classes]
    return pa.table([pa.array(x, pa.int64()) for x in out], ["word", "class"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the texts of joined classes, as packed 48-bit hashes in order of the hash."""
    for batch in slices(batches, most=2 << 20):
        sets = shingle_sets(column(batch, "text"))
        keep = [i for i, (s, wanted) in enumerate(zip(sets, column(batch, "class").to_pylist())) if set_hash(s) == wanted]
        if keep:
            yield _batch("class shingles", column(batch, "class").take(pa.array(keep)), pa.array([pack48(np.sort(sets[i] & LOW48)) for i in keep], pa.binary()))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(column(batch, "x").to_pylist(), column(batch, "y").to_pylist()):
            a, b = len(x) // 6, len(y) // 6
            both = len(np.intersect1d(unpack48(x), unpack48(y), assume_unique=True)) if 4 * min(a, b) >= 3 * max(a, b) else 0
            good.append(100 * both >= 75 * (a + b - both))
        yield _batch("src dst linked", column(batch, "src"), column(batch, "dst"), pa.array(good))


def _verify(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """``(src, dst, linked)`` of distinct class pairs, on their whole sets."""
    left = sets.select(F.col("class").alias("src"), F.col("shingles").alias("x"))
    right = sets.select(F.col("class").alias("dst"), F.col("shingles").alias("y"))
    both = pairs.join(left, "src").join(right, "dst").select("src", "dst", "x", "y")
    return stage(both.mapInArrow(_linked, "src long, dst long, linked boolean"), name)


def _links_of_block(key, group):
    """Links within a block of a busy group, or between two: for every set, the smallest row that
    it is linked with through rows of the task."""
    _, first, second = (x.as_py() for x in key)
    rows = np.argsort(group.column("block").to_numpy(), kind="stable")
    names, block = group.column("class").to_numpy()[rows], group.column("block").to_numpy()[rows]
    raw = group.column("shingles").to_pylist()
    sets = [unpack48(raw[i]) for i in rows]
    n, sizes = len(sets), np.array([len(s) for s in sets])
    split = n if first == second else int((block == first).sum())
    flat, owner = np.concatenate([np.zeros(0, np.uint64), *sets[:split]]), np.repeat(np.arange(split), sizes[:split])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    labels = np.arange(n)
    for j in range(1, n) if first == second else range(split, n):
        least = min(j, split)
        if (labels[:least] == labels[j]).all():
            continue
        lo, hi = np.searchsorted(flat, sets[j], "left"), np.searchsorted(flat, sets[j], "right")
        both = np.bincount(gather(owner, lo, hi - lo), minlength=split)[:least]
        linked = np.flatnonzero(100 * both >= 75 * (sizes[:least] + sizes[j] - both))
        if len(linked):
            reached = np.unique(np.append(labels[linked], labels[j]))
            labels[np.isin(labels, reached)] = reached[0]
    moved = labels != np.arange(n)
    return pa.table([pa.array(names[moved], pa.int64()), pa.array(names[labels[moved]], pa.int64())], ["src", "dst"])


def _components(edges: DataFrame, name: str) -> DataFrame:
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return stage(connected_components(nodes, edges), name)


def _link_small(joined: DataFrame, words: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified pairs of the lists of ``BUSY`` sets at most."""
    small = joined.join(words.filter(F.col("sets") <= BUSY).select("word"), "word")
    pairs = small.withColumnRenamed("class", "src").join(small.withColumnRenamed("class", "dst"), "word").filter("src < dst")
    return _verify(pairs.select("src", "dst").distinct(), sets, "small-pairs").filter("linked").select("src", "dst")


def _link_busy(joined: DataFrame, words: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of longer lists. Sets reachable through such lists form a group, all of whose pairs
    are compared, by blocks of about ``BLOCK`` sets and pairs of blocks."""
    busy = joined.join(words.filter(F.col("sets") > BUSY).select("word", F.col("least").alias("dst")), "word")
    stars = stage(busy.select(F.col("class").alias("src"), "dst").distinct(), "busy-stars")
    groups = _components(stars, "busy-groups").select(F.col("id").alias("class"), F.col("component").alias("of"))
    blocks = groups.groupBy("of").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = groups.join(blocks, "of").withColumn("block", F.pmod(F.xxhash64("class", F.lit(3)), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("of", "class", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return stage(paired.join(sets, "class").groupBy("of", "i", "j").applyInArrow(_links_of_block, "src long, dst long"), "busy-links")


def rows_of(docs: DataFrame, *more: Column) -> DataFrame:
    """``(id, key, text, …)`` of ``docs(doc_id, text)``: equal ids and keys are repeats of one row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), *more)


def once(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose id and key are in ``wanted``, without repeats and with its columns. Repeats go
    before the exchange, so that no number of them comes to one task."""
    return rows.dropDuplicates(["id", "key"]).join(wanted.hint("shuffle_hash"), ["id", "key"])


def link_classes(texts: DataFrame, profile: DataFrame, classes: DataFrame) -> DataFrame:
    """``(id, component)`` of those classes that link, for ``texts(id, key, text)``."""
    docs = profile.filter("word IS NULL").count()
    found = profile.filter("word IS NOT NULL").groupBy("word").agg(F.sum("seen").alias("seen"))
    # Words in one of HEAVY_SHARE documents: at most HEAVY_SHARE times the mean number of words.
    heavy = found.filter(F.col("seen") >= max(4, docs // HEAVY_SHARE)).collect()
    heavy = sorted((row[0] & (1 << 64) - 1, row[1]) for row in heavy)
    heavy = np.array([h[0] for h in heavy], np.uint64), np.array([h[1] for h in heavy], np.int64)
    ranges = max(1, -(-total_bytes(texts) // RANGE_BYTES))
    of_class = once(texts, classes.select("id", "key", "class")).select("class", "text")
    packed = of_class.mapInArrow(_words(heavy, ranges), PACKED)
    # Rows of a unit's place may lie anywhere; they only pass through.
    spread = F.when(F.col("place") < 0, F.xxhash64("units")).otherwise(F.col("place"))
    shared = packed.repartition(spread).sortWithinPartitions("place").mapInArrow(_shared(ranges), PACKED)
    own = classes.select(F.expr("class ^ band").alias("unit"), "class", F.col("own_d").alias("d"), F.col("own_words").alias("total"))
    low = classes.filter("low_d IS NOT NULL").select(F.expr("class ^ (band - 1)").alias("unit"), "class", F.col("low_d").alias("d"), F.col("low_words").alias("total"))
    known = own.union(low).withColumn("at", F.pmod("unit", F.lit(ranges)))
    joined = shared.groupBy("place").cogroup(known.groupBy("at")).applyInArrow(_prefixes, "word long, class long")
    joined = stage(joined, "joined-words").distinct()
    words = joined.groupBy("word").agg(F.count(F.lit(1)).alias("sets"), F.min("class").alias("least")).filter("sets > 1")
    joined = stage(joined.join(words, "word"), "common-words")
    words, joined = joined.select("word", "sets", "least").distinct(), joined.select("word", "class")
    wanted = classes.join(joined.select("class").distinct(), "class", "left_semi").select("id", "key", "class")
    sets = once(texts, wanted).select("class", "text").mapInArrow(_sets, "class long, shingles binary")
    sets = stage(sets.dropDuplicates(["class"]), "joined-sets")
    links = _link_small(joined, words, sets).union(_link_busy(joined, words, sets))
    return _components(stage(links, "class-links"), "linked-classes")


def classed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(id, key, n, class, …)`` of every row, ``(class, component)`` of every class, and
    ``(component, id, key)`` of the first row of every component."""
    texts = rows_of(docs)
    kinds = ", ".join(f"{name} long" for name in PROFILE.split())
    profile = stage(texts.mapInArrow(_profile, kinds), "shingle-profile")
    rows = profile.filter("word IS NULL")
    sizes = ["n", "band", "own_words", "own_d", "low_words", "low_d"]
    firsts = F.min(F.struct("id", "key")).alias("first")
    classes = rows.filter("n > 0").groupBy("class").agg(firsts, *[F.max(name).alias(name) for name in sizes])
    classes = stage(classes.select("class", "first.id", "first.key", *sizes), "shingle-classes")
    linked = link_classes(texts, profile, classes)
    named = classes.select("class", "id", "key").join(linked.withColumnRenamed("id", "class"), "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(firsts).select("component", "first.id", "first.key")
    return rows, named.select("class", "component"), least


def first_rows(docs: DataFrame) -> DataFrame:
    """``(id, key)``, as in ``rows_of``, of the first row of every component that has shingles."""
    return classed(docs)[2].select("id", "key")


def components_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``."""
    rows, named, least = classed(docs)
    names = named.join(least, "component").select("class", F.col("id").alias("component_id"))
    placed = rows.select("id", "n", "class").join(names, "class", "left")
    no_id = lambda name: F.when(F.col(name) != NO_ID, F.col(name))
    return placed.select(
        no_id("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, no_id("id")).otherwise(no_id("component_id")).alias("component_id"),
    )
