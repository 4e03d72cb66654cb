"""Source divergence audit: how far the term counts of each source lie from those of the others.

Per language every source has a smoothed term distribution in billionths,
``p = 1 + floor(10^9 * (count + 1) / (N + V))``; a pair of sources is priced by the sum over all
kept terms of ``floor((p - q)^2 / q)``, a term of one source by the same against the whole language.

Counts are gathered per (language, source, term), combined in every task before they are shuffled.
The kept terms of a language are dealt by hash over blocks of about ``BLOCK`` terms, the subtrees of
its segment trees. In a block every source has a tree over the block's terms, the frequent ones
first, built bottom up with hash-consing: a node is the pair of its children's numbers, and equal
pairs get one number whichever source or place they come from, so runs of equal counts (zeros above
all) are one node per size. Two trees are walked down together, level by level, for all pairs of
sources at once; equal pairs of nodes of one pair of sources are merged with their multiplicity and
go on, and are priced, once. Blocks then sum up.

A task sees one block of terms and two blocks of at most about ``SOURCES`` sources, whatever the
number of documents, terms or sources; every source belongs to every block, since its missing terms
have a price too. Of the terms of a source a block returns its best ``RANKS``, which hold all that
can be among the best over all blocks. All arithmetic is in integers: ``10^9 * x / m`` is divided in
three steps of a thousand, so totals may reach 10^15 occurrences.

Defined results: null text, language and source are empty ones; every row is a document, repeated
ones too; a group without terms has counts of zero; a language without kept terms has pairs of
value 0; ties are ranked by the bytes of the item; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurlens.llm.common import column, slices
from murmurlens.llm.hashing import LOWER, bytes_of
from murmurlens.runtime import stage

MIN_DOCS, RANKS, BLOCK, SOURCES, SCALE = 3, 200, 2048, 128, 1_000_000_000
KEEP = LOWER.copy()
KEEP[np.r_[0:65, 91:97, 123:128]] = 32  # all that is no letter and no byte of a longer character


def _lists(texts: pa.Array) -> pa.Array:
    """The terms of each text: bytes that belong to none become blanks, which then split."""
    flat, cuts = bytes_of(texts)
    clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(KEEP[flat]))
    return pc.ascii_split_whitespace(clean)


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, hits, docs)``: occurrences, and documents that have the term."""
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(name), empty).alias(name) for name in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _lists(column(batch, "text"))
            coded = found.flatten().dictionary_encode()
            # An empty text gives one empty string, which is no term.
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            real = pc.not_equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            inside = real[codes]
            codes, owner, width = codes[inside], owner[inside], max(1, len(real))
            groups = pa.StructArray.from_arrays([column(batch, "lang"), column(batch, "source")], ["lang", "source"])
            keys = groups.to_pylist()
            numbers: dict[tuple, int] = {}
            group = np.array([numbers.setdefault((k["lang"], k["source"]), len(numbers)) for k in keys], np.int64)
            cells, hits = np.unique(owner * width + codes, return_counts=True)
            cells, at = np.unique(group[cells // width] * width + cells % width, return_inverse=True)
            held = np.bincount(at, minlength=len(cells))
            hits = np.bincount(at, hits, minlength=len(cells)).astype(np.int64)
            names = [pa.array([key[i] for key in numbers]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[x.cast(pa.string()).take(pa.array(cells // width)) for x in names],
                    coded.dictionary.cast(pa.string()).take(pa.array(cells % width)),
                    pa.array(hits, pa.int64()),
                    pa.array(held, pa.int64()),
                ],
                ["lang", "source", "term", "hits", "docs"],
            )

    parts = rows.mapInArrow(run, "lang string, source string, term string, hits long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("hits").alias("hits"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10^9 * (count + 1) / total)``, exactly, for totals below 9 * 10^15."""
    whole, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def consed_trees(counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Trees over the rows of ``counts`` (the width a power of two), from the leaves up. Each level is
    ``(number of the node at each place, left, right)``; at the leaves ``left`` holds the counts."""
    values, numbers = np.unique(counts, return_inverse=True)
    levels = [(numbers.reshape(counts.shape), values, values)]
    while levels[-1][0].shape[1] > 1:
        below, size = levels[-1][0], len(levels[-1][1])
        pairs, numbers = np.unique(below[:, ::2] * size + below[:, 1::2], return_inverse=True)
        levels.append((numbers.reshape(below.shape[0], -1), pairs // size, pairs % size))
    return levels


def walk(levels: list, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Walk the trees ``left[i]`` and ``right[i]`` down together: ``(i, count, count, times)`` for each
    distinct pair of counts that they have at one place, with the number of such places."""
    top = levels[-1][0][:, 0]
    pair, u, v, times = np.arange(len(left)), top[left], top[right], np.ones(len(left), np.int64)
    for (_, lefts, rights), (_, below, _) in zip(levels[:0:-1], levels[-2::-1]):
        size = len(below)
        keys = np.concatenate([(pair * size + side[u]) * size + side[v] for side in (lefts, rights)])
        keys, at = np.unique(keys, return_inverse=True)
        times = np.bincount(at, np.concatenate([times, times]), len(keys)).astype(np.int64)
        pair, u, v = keys // size // size, keys // size % size, keys % size
    values = levels[0][1]
    return pair, values[u], values[v], times


def _block(batch: pa.Table) -> pa.Table:
    """Prices of one block of terms for two blocks of sources (or one, with itself)."""
    get = lambda name: batch.column(name).combine_chunks()
    term = get("term")
    marks = pc.is_null(term).to_numpy(zero_copy_only=False)
    number = lambda name: pc.fill_null(get(name), 0).to_numpy(zero_copy_only=False)
    own, other, side = number("i")[0], number("j")[0], number("side")
    # Sources in the order of their names, each marked once.
    sources, names = get("source"), np.array(get("source").filter(pa.array(marks)).to_pylist(), object)
    order = np.argsort(names)
    names, total, block = names[order], number("total")[marks][order], side[marks][order]
    row = pc.index_in(sources, value_set=pa.array(names, pa.string())).to_numpy(zero_copy_only=False)[~marks]
    coded = term.filter(pa.array(~marks)).dictionary_encode()
    code, hits = coded.indices.to_numpy(zero_copy_only=False), number("hits")[~marks]
    terms = len(coded.dictionary)
    known = np.zeros(terms, np.int64)
    known[code] = number("lang_hits")[~marks]
    # Frequent terms first, equal ones by name: rare ones lie together and share their nodes.
    by_name = pc.rank(coded.dictionary).to_numpy(zero_copy_only=False)
    ranked = np.lexsort((by_name, -known))
    place = np.empty(terms, np.int64)
    place[ranked] = np.arange(terms)
    of_block = int(number("hits")[marks].max())  # with terms that no source of these folds has
    width = 1 << max(0, (of_block - 1).bit_length())
    counts = np.full((len(names) + 1, width), -1, np.int64)  # past the last term: no leaf, no price
    counts[:, :of_block] = 0
    counts[row, place[code]] = hits
    counts[-1, :terms] = known[ranked]
    levels = consed_trees(counts)

    left, right = np.triu_indices(len(names), 1)
    if own != other:
        across = block[left] != block[right]
        left, right = left[across], right[across]
    pair, a, b, times = walk(levels, left, right)
    real = a >= 0
    pair, a, b, times = pair[real], a[real], b[real], times[real]
    p, q = shares(a, total[left[pair]]), shares(b, total[right[pair]])
    forth, back = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    np.add.at(forth, pair, price(p, q) * times)
    np.add.at(back, pair, price(q, p) * times)
    out = [("pair", names[left], names[right], forth), ("pair", names[right], names[left], back)]

    if own == other and terms:
        whole = np.full(len(names), number("lang_total")[0])
        pair, a, b, _ = walk(levels, np.arange(len(names)), np.full(len(names), len(names)))
        p, q = shares(np.maximum(a, 0), total[pair]), shares(np.maximum(b, 0), whole[pair])
        # The price of every (source, count, count) that the walk met, found again for each term of the source.
        values, value = levels[0][1], price(p, q)
        memo = (pair * len(values) + np.searchsorted(values, a)) * len(values) + np.searchsorted(values, b)
        first = np.argsort(by_name[ranked], kind="stable")
        words = coded.dictionary.take(pa.array(ranked))
        for i, name in enumerate(names):
            at = first[counts[i, first] > 0]
            met = np.searchsorted(memo, (i * len(values) + np.searchsorted(values, counts[i, at])) * len(values) + np.searchsorted(values, counts[-1, at]))
            at, met = at[p[met] > q[met]], met[p[met] > q[met]]
            best = np.argsort(-value[met], kind="stable")[:RANKS]
            out.append(("term", [name] * len(best), words.take(pa.array(at[best])), value[met[best]]))
    lang = get("lang")[0].as_py()
    tables = [
        pa.table({"lang": pa.array([lang] * len(x[1]), pa.string()), "source": pa.array(x[1], pa.string()), "part": pa.array([x[0]] * len(x[1]), pa.string()), "item": x[2] if isinstance(x[2], pa.Array) else pa.array(x[2], pa.string()), "value": pa.array(x[3], pa.int64())})
        for x in out
    ]
    return pa.concat_tables(tables)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS, block: int = BLOCK, per_task: int = SOURCES) -> DataFrame:
    """``(lang, source, part, item, value, rank)``."""
    found = stage(term_counts(docs), "terms")
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    kept = found.groupBy("lang", "term").agg(F.sum("hits").alias("lang_hits"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    counts = stage(found.drop("docs").join(kept, ["lang", "term"]), "kept_terms")
    sums = counts.groupBy("lang", "source").agg(F.sum("hits").alias("hits"))
    sizes = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    per_lang = sums.groupBy("lang").agg(F.sum("hits").alias("lang_hits"))
    of_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(sizes, "lang", "left").join(per_lang, "lang", "left")
    terms = F.coalesce("terms", F.lit(0))
    of_lang = of_lang.select(
        "lang",
        (terms + F.coalesce("lang_hits", F.lit(0))).alias("lang_total"),
        terms.alias("terms"),
        F.greatest(F.lit(1), F.ceil(terms / block)).alias("blocks"),
        F.ceil(F.col("sources") / per_task).alias("folds"),
    )
    of_lang = stage(of_lang, "languages")
    fold = F.pmod(F.xxhash64("source"), F.col("folds")).alias("side")
    block_of = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    held = counts.select("lang", "term").distinct().join(of_lang, "lang").groupBy("lang", block_of).agg(F.count(F.lit(1)).alias("held"))
    rows = counts.join(of_lang, "lang").select(
        "lang", block_of, "source", "term", "hits", "lang_hits",
        F.lit(None).cast("long").alias("total"), "lang_total", fold, "folds",
    )
    marks = groups.join(sums, ["lang", "source"], "left").join(of_lang, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"),
        F.lit(0).alias("lang_hits"), (F.coalesce("hits", F.lit(0)) + F.col("terms")).alias("total"), "lang_total", fold, "folds",
    )
    # A mark carries the number of the block's terms in place of a count.
    marks = marks.join(held, ["lang", "block"], "left").withColumn("hits", F.coalesce("held", F.lit(0))).drop("held")
    # A row of one fold of sources meets all folds, itself included; there is one up to ``per_task`` sources.
    met = rows.unionByName(marks).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("folds") - 1)))
    met = met.withColumns({"i": F.least("side", "with"), "j": F.greatest("side", "with")}).drop("with", "folds")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * docs.sparkSession.sparkContext.defaultParallelism)
    priced = met.repartition(tasks, "lang", "block", "i", "j").groupBy("lang", "block", "i", "j").applyInArrow(_block, "lang string, source string, part string, item string, value long")
    summed = priced.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= ranks)).select("lang", "source", "part", "item", "value", "rank")
