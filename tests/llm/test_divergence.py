import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from murmurlens.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, ranks=200):
    """The audit of ``(text, lang, source)`` rows, term by term in Python's integers."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(term for d in own for term in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if held[t] >= min_docs)
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for source, c in counts.items():
            found = {"pair": [], "term": []}
            for other, d in counts.items():
                if other != source:
                    found["pair"].append((-sum(f(p(c, t), p(d, t)) for t in kept), other.encode(), other))
            for t in kept:
                if c[t] and p(c, t) > p(whole, t):
                    found["term"].append((-f(p(c, t), p(whole, t)), t.encode(), t))
            for part, items in found.items():
                for rank, (value, _, item) in enumerate(sorted(items), 1):
                    if part == "pair" or rank <= ranks:
                        out.add((lang, source, part, item, -value, rank))
    return out


def made_rows(n=160):
    chosen = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "É", "zo", "日本", "Q") for b in ("x", "Yy", "ß", "w", "é", "LL")]
    rows = [(" ".join(chosen.choices(words, range(30, 0, -1), k=chosen.randint(0, 60))), chosen.choice(["en", "fr"]), f"s{chosen.randint(0, 6)}") for _ in range(n)]
    rows += [(None, "en", "s9"), ("", None, None), ("12 34 _ ~", "xx", "s1"), ("kax kax", "xx", None), ("a1b\x00c`D[e{F", "en", ""), (rows[0][0], "en", "s0")]
    return rows + [("kax " * 5000, "en", "s1"), ("İstanbul ſ", "en", "s2"), ("İstanbul ſ", "en", "s2"), ("İstanbul ſ", "en", "s3")]


def frame(spark, rows):
    return spark.createDataFrame([(i % 7, *row, "x", 1) for i, row in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, hits int")


def test_as_brute_force(spark):
    rows = made_rows()
    got = divergence.audit(frame(spark, rows).repartition(3))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_many_blocks_and_folds(spark):
    """Blocks of 4 terms and folds of 2 sources: every source meets all others, over all blocks, once."""
    rows = made_rows(60)
    got = [tuple(r) for r in divergence.audit(frame(spark, rows), ranks=5, block=4, per_task=2).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, ranks=5)


def test_no_terms_kept(spark):
    rows = [("one two", "en", "a"), (None, "en", "b"), ("three", "en", None)]
    got = {tuple(r) for r in divergence.audit(frame(spark, rows)).collect()}
    assert got == brute(rows) and len(got) == 6


def test_empty_table(spark):
    assert divergence.audit(frame(spark, [("a", "b", "c")]).limit(0)).collect() == []


@given(st.lists(st.tuples(st.integers(0, 10**12), st.integers(1, 10**15)), min_size=1))
def test_shares_are_exact(cells):
    counts, totals = (np.array(x, np.int64) for x in zip(*[(min(c, t - 1), t) for c, t in cells]))
    assert divergence.shares(counts, totals).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts.tolist(), totals.tolist())]


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=8, max_size=8), min_size=2, max_size=5))
def test_walk_counts_every_place_once(rows):
    counts = np.array(rows)
    levels = divergence.consed_trees(counts)
    left, right = np.triu_indices(len(rows), 1)
    got = Counter()
    for i, a, b, times in zip(*[x.tolist() for x in divergence.walk(levels, left, right)]):
        assert (i, a, b) not in got
        got[i, a, b] = times
    assert got == Counter((i, rows[x][k], rows[y][k]) for i, (x, y) in enumerate(zip(left, right)) for k in range(8))


def test_equal_subtrees_are_one_node():
    counts = np.zeros((50, 1024), np.int64)
    counts[:, 0] = np.arange(50)
    levels = divergence.consed_trees(counts)
    assert [len(lefts) for _, lefts, _ in levels[:-1]] == [50] + [50] * 9 and len(levels[-1][1]) == 50
    # One path and one node of zeros per level: some 11 distinct pairs, not 1024.
    _, _, _, times = divergence.walk(levels, np.array([3]), np.array([7]))
    assert sorted(times.tolist()) == [1, 1023]
