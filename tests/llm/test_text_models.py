"""Language identification, quality rules and context-tree scores."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from murmurlens.llm import context_tree, language, quality
from murmurlens.llm.common import table

TABLES = "/root/testdata/sf0.01"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_of_awkward_rows(spark, awkward, nothing):
    found = language.identify(awkward).collect()
    assert len(found) == awkward.count() and {r.lang_pred for r in found} == {"en", "fr", "und"}
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102, 104))
    assert all(0 <= r.score <= 1 for r in found)
    assert all(by[i].lang_pred == ("en" if i % 2 else "fr") for i in range(40))
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert language.identify(nothing).count() == 0
    unlabelled = language.identify(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_language_on_held_out_documents(spark):
    docs = table(spark, TABLES, "documents")
    found = language.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.filter("lang_pred = lang").count() >= 0.98 * found.count()


def test_presence_kernel_by_hand():
    one, two = language.presence(np.frombuffer(b"abABxyz", np.uint8), np.array([0, 4, 7]))
    assert len(one) == len({"a", "b", "ab", "ba", "aba", "bab", "abab"}) and len(two) == 3 + 2 + 1
    assert len(np.intersect1d(one, two)) == 0


def test_kernel_ridge_by_brute_force(spark):
    """With every text a landmark, the answer is that of kernel ridge regression on the whole kernel."""
    random_ = np.random.default_rng(2)
    texts = ["".join(random_.choice(list("abcde fg" if i % 3 else "hij éè k"), 40 + i)) + " x" for i in range(30)]
    langs = [("p", "q", "r")[i % 3] for i in range(30)]
    model = language.fit(texts, langs, landmarks=30, ridge=1e-2)
    asked = texts[:5] + ["abc hij", "éé aa bb", "zzz"]
    grams = lambda text: set(language.presence(*language.bytes_of(pa.array([text])))[0].tolist())
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    known = [grams(x) for x in texts]
    whole = np.array([[kernel(a, b) for b in known] for a in known])
    targets = np.where(np.array(langs)[:, None] == np.array(["p", "q", "r"]), 1.0, -1.0)
    dual = np.linalg.solve(whole + 1e-2 * 30 * np.eye(30), targets)
    want = np.array([[kernel(grams(x), b) for b in known] for x in asked]) @ dual
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "doc_id long, text string")
    found = sorted(language.predict(docs, model).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in found] == [("p", "q", "r")[k] for k in want.argmax(axis=1)]
    assert np.allclose([r.score for r in found], np.clip((want.max(axis=1) + 1) / 2, 0, 1), atol=1e-4)


def test_every_language_is_learnt(spark, monkeypatch):
    """More languages than landmarks and than columns of a block, most with one text."""
    monkeypatch.setattr(language, "BLOCK_LANGUAGES", 40)
    random_ = np.random.default_rng(3)
    words = {f"l{i:03d}": ["".join(random_.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)] for i in range(110)}
    rows = [(i * 7 + n, " ".join(random_.permutation(own)), lang) for i, (lang, own) in enumerate(words.items()) for n in range(1 + (i % 10 == 0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(*language.training_sample(docs, F.lit(True), sample=100), landmarks=50)
    assert len(model.languages) == 110 and [w.shape[1] for w in model.weights] == [40, 40, 30]
    found = language.predict(docs, model, "lang").collect()
    assert len(found) == len(rows) and all(r.lang_pred == r.lang for r in found)


def rules(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules_by_hand(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] + [(None, 1), (5, None), (7, 0), (7, 1), (900, 1)], "doc_id long, quality int")
    texts = {(r.doc_id, r.text or "") for r in awkward.collect()}
    model = quality.train(awkward, labels)
    found = quality.score(awkward, model).collect()
    assert len(found) == awkward.count()
    for r in found:
        assert (r.doc_id, r.text) in texts
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules(r.text)
        assert not (r.base_failed and r.kept) and 0 <= r.p_quality <= 1
    assert quality.score(nothing, quality.train(nothing, labels)).count() == 0
    alone = quality.score(awkward, quality.train(awkward, labels.limit(0))).collect()
    assert all(r.kept != r.base_failed for r in alone)


def test_repeated_lines_and_windows():
    text = "a b c\n\na b c \na b c\n x a b c #%"
    assert quality.repeated_lines(text) == rules(text)[3] == 1
    flat, cuts = quality.bytes_of(pa.array([text, "", "a b c a b"]))
    starts, ends, at = quality.word_spans(flat, cuts)
    again = quality.repeated_words(quality.word_hashes(flat, starts, ends), at)
    assert again.tolist() == [rules(text)[4], 0, 0]


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, TABLES, "documents"), table(spark, TABLES, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    found = quality.score(docs, quality.train(docs, labels.filter(~fold))).join(labels.filter(fold), "doc_id").filter("NOT base_failed")
    rows = found.select("quality", "kept").collect()
    assert sum(r.kept for r in rows if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in rows)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.2 * sum(r.quality == 0 for r in rows)


def slow_tree(train, text, depth):
    """Context-tree weighting decision by decision, with dictionaries."""
    counts = [collections.defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]

    def steps(raw):
        raw = bytes([255] * depth) + raw + b"\xff"
        for i in range(depth, len(raw)):
            for k in range(8):
                yield raw[i - depth : i], (1 << k) | raw[i] >> (8 - k), raw[i] >> (7 - k) & 1

    for raw in train:
        for context, place, bit in steps(raw):
            for d in range(depth + 1):
                counts[d][context[depth - d :], place][bit] += 1
    gamma = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)
    weighted, stop = [{} for _ in range(depth + 1)], [{} for _ in range(depth + 1)]
    for d in range(depth, -1, -1):
        below = collections.defaultdict(float)
        if d < depth:
            for (context, place), value in weighted[d + 1].items():
                below[context[1:], place] += value
        for key, (a, b) in counts[d].items():
            own = gamma(a, b)
            weighted[d][key] = own if d == depth else math.log(0.5) + np.logaddexp(own, below[key])
            stop[d][key] = 1.0 if d == depth else math.exp(math.log(0.5) + own - weighted[d][key])
    total = 0.0
    for context, place, bit in steps(text):
        reach, mixed, chance = 1.0, 0.0, 0.5
        for d in range(depth + 1):
            key = context[depth - d :], place
            if key not in counts[d]:
                break
            a, b = counts[d][key]
            p = (b + 0.5) / (a + b + 1)
            chance = mixed + reach * p
            mixed, reach = mixed + reach * stop[d][key] * p, reach * (1 - stop[d][key])
        total += math.log10(chance if bit else 1 - chance)
    return total


def test_context_tree_by_hand(spark, awkward, nothing):
    small = awkward.filter("doc_id IS NULL OR doc_id < 12 OR doc_id BETWEEN 100 AND 104 OR doc_id = 108")
    found = context_tree.score_documents(small, depth=3).collect()
    rows = [(r.doc_id, (r.text or "").translate(LOWER)) for r in small.collect()]
    held = lambda key: zlib.crc32(b"" if key is None else str(key).encode()) % 5 == 1
    train = [text.encode() for key, text in rows if not held(key)]
    counts = collections.Counter(word for raw in train for word in WORD.findall(raw.decode()))
    counts[None] = len(train)
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for key, text in rows:
        tokens = [*WORD.findall(text), None]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens)
        want.append((key, held(key), len(tokens), sum(counts[t] > 0 for t in tokens), total, base, slow_tree(train, text.encode(), 3)))
    order = lambda x: (x[0] is not None, x[0] or 0, x[2], x[5])
    got = sorted((tuple(r)[:7] for r in found), key=order)
    for a, b in zip(got, sorted(want, key=order), strict=True):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-9)
    assert context_tree.score_documents(nothing).count() == 0


def test_scores_are_a_distribution():
    grams, counts = context_tree._distinct(context_tree.grams_of(pa.array(["abcabcabd", "xyz abc"] * 3), 3)[0])
    two = context_tree.levels_of(grams, counts, 3, 2)[-1]
    names, at = np.unique(two.names & np.uint64(0xFFFF), return_inverse=True)
    top = context_tree.Top(names, *[np.bincount(at, x, len(names)) for x in (two.zeros, two.ones, two.weighted)]).arrays()
    for context in (b"abc", b"zzz", b"\xff\xff\xff"):
        asked = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs((10 ** context_tree.answer(asked, grams, counts, top, 3)).sum() - 1) < 1e-9
