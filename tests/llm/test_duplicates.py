"""Near-duplicate texts and vectors against all pairs."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from murmurlens.llm import jaccard, pivots
from murmurlens.llm.common import table

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def all_pairs(rows):
    """Components by rows, linked when 100 * both >= 75 * either, and through equal ids."""
    sets, label = [shingles(text) for _, text in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(((key, len(s), least.get(root(i)) if s else key) for i, (key, s) in enumerate(zip([k for k, _ in rows], sets))), key=repr)


def found(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components_of(docs).collect()), key=repr)


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(awkward) == all_pairs(rows)
    assert jaccard.components_of(nothing).count() == 0


@pytest.mark.parametrize("words, copies", [(12, 14), (60, 40), (300, 40)])
def test_edited_copies_around_the_threshold(spark, words, copies):
    """A large group of copies, edited so that many pairs link and many don't, a passage shared by
    half of the documents, and pairs at exactly 3/4."""
    chosen, rows = random.Random(words), []
    base = [f"w{chosen.randrange(10_000)}" for _ in range(words)]
    passage = [f"p{i}" for i in range(30)]
    for i in range(copies):
        text = base.copy()
        for _ in range(chosen.randrange(0, max(2, words // 25))):
            text[chosen.randrange(words)] = f"e{chosen.randrange(10_000)}"
        rows.append((i, " ".join(text)))
        own = [f"o{chosen.randrange(10_000)}" for _ in range(40)]
        rows.append((1000 + i, " ".join(own + passage)))
    rows += [(5000, " ".join(f"x{i}" for i in range(10))), (5001, " ".join(f"x{i}" for i in range(10)) + " y1 y2")]
    rows += [(5002, "z1 z2 z3 z4 z5 z6 z7"), (5003, "z1 z2 z3 z4 z5 z6 z7 z8")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == all_pairs(rows)


def test_heavy_words_and_blocks(spark, monkeypatch):
    chosen, base, rows = random.Random(3), [f"w{i}" for i in range(50)], []
    for i in range(60):
        text = base.copy()
        text[chosen.randrange(50)] = f"e{i}"
        text[chosen.randrange(50)] = f"f{i}"
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == all_pairs(rows)


def test_words_that_differ_bound_the_difference():
    random_, a = np.random.default_rng(1), np.unique(np.random.default_rng(2).integers(0, 1 << 63, 200, dtype=np.uint64))
    for taken in (1, 5, 40):
        b = np.unique(np.concatenate([a[taken:], random_.integers(0, 1 << 63, 7, dtype=np.uint64)]))
        for band in (6, 7, 8):
            x, y = jaccard.sketch_words(a, band), jaccard.sketch_words(b, band)
            assert len(np.setdiff1d(x, y)) <= len(np.setxor1d(a, b)) >= len(np.setdiff1d(y, x))
    assert (jaccard.unpack48(jaccard.pack48(a)) == a & jaccard.LOW48).all()


def test_documents_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert found(docs) == all_pairs([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_rows_without_an_id_meet_their_own_class_only(spark, monkeypatch):
    seen, words = spark.sparkContext.accumulator(0), jaccard._words

    def counted(*args):
        def pass_on(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        run = words(*args)
        return lambda batches: run(pass_on(batches))

    monkeypatch.setattr(jaccard, "_words", counted)
    rows = [(None, " ".join(f"w{i}_{k}" for k in range(8))) for i in range(30)] * 2
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == all_pairs(rows)
    assert 30 <= seen.value <= 2 * 30


def brute(rows, least=0.9):
    good = [i for i, (_, v) in enumerate(rows) if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, label = [0] * len(rows), list(range(len(rows)))
    for i, j in itertools.combinations(good, 2):
        a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
        if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
            links[i] += 1
            links[j] += 1
            x, y = label[i], label[j]
            label = [min(x, y) if k in (x, y) else k for k in label]
    names = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            names[label[i]] = min(key, names.get(label[i], key))
    return links, [names.get(x) for x in label]


def test_vectors(spark, monkeypatch):
    random_ = np.random.default_rng(4)
    rows = []
    for i in range(150):
        centre = random_.normal(size=16)
        rows.append((i, [float(np.float32(x)) for x in centre]))
        for k in range(i % 4):
            rows.append((1000 + 10 * i + k, [float(np.float32(x)) for x in centre + random_.normal(size=16) * (0.1 + 0.1 * k)]))
    centre = random_.normal(size=16)
    rows += [(5000 + k, [float(np.float32(x)) for x in centre + random_.normal(size=16) * 0.02]) for k in range(60)]
    rows += [(6000, None), (6001, []), (6002, [0.0] * 16), (6003, [float("nan")] * 16), (6004, [1.0] * 15 + [float("inf")]), (6005, [1.0] * 15 + [None])]
    rows += [(6006, rows[0][1]), (6007, rows[0][1]), (None, rows[1][1]), (6008, [2.0 * x for x in rows[2][1]]), (6009, [1.0, 2.0]), (6010, [1.0, 2.0])]
    monkeypatch.setattr(pivots, "BLOCK", 40)
    vectors = spark.createDataFrame([(*row, 1, "x") for row in rows], "vec_id long, embedding array<float>, class int, pivot string")
    got = {(r.vec_id, i): r for i, r in enumerate(pivots.near_duplicates(vectors).collect())}
    assert len(got) == len(rows)
    links, names = brute(rows)
    want = {key: (n, name) for (key, _), n, name in zip(rows, links, names)}
    seen = sum(r.n_links for r in got.values())
    assert 0.9 * sum(links) <= seen <= sum(links)
    assert all(r.n_links <= want[r.vec_id][0] for r in got.values())
    assert sum(r.component_id == want[r.vec_id][1] for r in got.values()) >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert pivots.near_duplicates(vectors.limit(0)).count() == 0


def planted(n, dim, seed=8):
    """``n`` random vectors with a partner for every fourth, at a cosine from 0.90 to 0.99."""
    random_ = np.random.default_rng(seed)
    unit = random_.normal(size=(n, dim))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    some = unit[::4]
    away = random_.normal(size=some.shape)
    away -= (away * some).sum(axis=1, keepdims=True) * some
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = random_.uniform(0.9, 0.99, (len(some), 1))
    return np.concatenate([unit, some * cosine + away * np.sqrt(1 - cosine * cosine)]).astype(np.float32)


@pytest.mark.parametrize("n, dim", [(20_000, 64), (4_000, 384)])
def test_recall_against_all_vectors(spark, tmp_path, n, dim):
    """Queries are the vectors whose id is divisible by 100, against all vectors by brute force."""
    values = planted(n, dim)[np.random.default_rng(1).permutation(n + n // 4)]
    lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), dim).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(len(values)), "embedding": lists}), tmp_path / "vectors.parquet")
    found = {r.vec_id: r.n_links for r in pivots.near_duplicates(spark.read.parquet(str(tmp_path / "vectors.parquet"))).collect()}
    wide = values.astype(float) / np.linalg.norm(values.astype(float), axis=1, keepdims=True)
    asked = np.arange(0, len(values), 100)
    true = (wide[asked] @ wide.T >= 0.9).sum(axis=1) - 1
    seen = np.array([found[i] for i in asked.tolist()])
    assert true.sum() > 0.003 * n and (seen <= true).all() and seen.sum() >= 0.95 * true.sum()
    everything = sum((wide[i : i + 1000] @ wide.T >= 0.9).sum() for i in range(0, len(wide), 1000)) - len(wide)
    assert 0.95 * everything <= sum(found.values()) <= everything


def narrow(case):
    random_ = np.random.default_rng(6)
    if case == "two vectors":
        return [[1.0, 0.0, 0.0], [0.95, 0.3125, 0.0]]
    centre = random_.normal(size=32)
    width = {"near copies": 0.02, "cone": 0.3}[case]
    return [list(centre + width * random_.normal(size=32)) for _ in range(60)]


@pytest.mark.parametrize("case", ["two vectors", "near copies", "cone"])
def test_vectors_in_one_narrow_cone(spark, monkeypatch, case):
    """The sample leaves one pivot, so that no two vectors share two."""
    monkeypatch.setattr(pivots, "BLOCK", 40)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(narrow(case))]
    unit = np.array([np.array(v) / np.linalg.norm(v) for _, v in rows])
    assert (unit @ unit.T).min() > pivots.TOO_CLOSE
    rows.append((5000, [0.5, -0.5]))
    links, names = brute(rows)
    assert sum(links) > 0
    found = {r.vec_id: r for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [(found[key].n_links, found[key].component_id) for key, _ in rows] == [*zip(links, names)]
