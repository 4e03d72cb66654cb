"""Token files, SentencePiece and packing against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs

from murmurlens.llm import packing, sentencepieces, token_files, wordbpe
from murmurlens.llm.queries import tokenizer
from murmurlens.llm.wordbpe import WordTable

WORD_BPE, PIECES = tokenizer("word_bpe_49k.json"), tokenizer("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", " a", "a ", "a  b  ", "▁", "a▁b", "▁▁x  ▁ y", "a\n b\t c", "\n", "日本 語　x", "á ̈b", "a\0 b",
    "<s> </s> <unk> x", "😀 😃​ ", "Don't I'll İstanbul ΣΑΣ ﬁx", "12a3 <|endoftext|> x<|startoftext|>y", "ß ẞ Straße THE,!!", "a\x1cb \x85 c",
]


def whole_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids + [1] for e in Tokenizer.from_file(WORD_BPE).encode_batch(texts, add_special_tokens=False)]


def expected(docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    return rows, [np.array(ids, "<u4") for ids in whole_ids([text for _, text in rows])]


def test_word_table_equals_the_tokenizer_and_forgets_safely():
    table = WordTable(WORD_BPE, most=5)
    for _ in range(3):
        ids, cuts = table.encode(pa.array(ODD))
        assert [ids[a:b].tolist() + [1] for a, b in zip(cuts, cuts[1:])] == whole_ids(ODD)


def test_words_of_one_core_are_looked_up_as_one(monkeypatch):
    asked, missing = [], wordbpe.Kept.missing
    monkeypatch.setattr(wordbpe.Kept, "missing", lambda kept, keys: asked.extend(keys) or missing(kept, keys))
    table = WordTable(WORD_BPE)
    texts = [f"{core}{tail}" for core in ("Straße", "straße", "STRAßE", "ÿes", "Élan") for tail in ("", ".", ",", "!?", "$%&", "|")] + ["a1", "", "a1 Élan."]
    ids, cuts = table.encode(pa.array(texts))
    assert [ids[a:b].tolist() + [1] for a, b in zip(cuts, cuts[1:])] == whole_ids(texts)
    assert len(asked) == 3 + 6 + 2  # cores, tails, and the odd "a1" and ""
    for empty in ([], ["", " "]):
        ids, cuts = table.encode(pa.array(empty, pa.string()))
        assert not len(ids) and cuts.tolist() == [0] * (len(empty) + 1)


def test_chunk_table_equals_the_library():
    table = sentencepieces.ChunkTable(PIECES, most=4)
    ids, cuts = table.encode(pa.array(ODD))
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == table.model.encode(ODD)


def test_token_files_hold_all_ids(spark, awkward):
    folder = token_files.token_folder(awkward)
    manifest = token_files.write_shards(awkward, WORD_BPE, 1, folder, sequence_length=64, rows_per_batch=4)
    found = token_files.read_documents(manifest, folder, token_files.crc_of, "long").collect()
    rows, ids = expected(awkward)
    starts = np.cumsum([0] + [len(x) for x in ids])
    want = [(row[0], int(a), len(x), zlib.crc32(x.tobytes())) for row, a, x in zip(rows, starts, ids)]
    assert sorted(map(tuple, found), key=lambda x: x[1]) == want
    files, path = fs.FileSystem.from_uri(f"file://{folder.removeprefix('file:')}") if "://" not in folder else fs.FileSystem.from_uri(folder)
    place = 0
    for row in manifest.orderBy("shard").collect():
        shard = token_files.TokenShard(files, f"{path}/{row['name']}.arrow")
        assert len(shard) == row.sequences and all(len(shard.sequence(i)) == 64 for i in range(len(shard)))
        assert sum(int(shard.mask(i).sum()) for i in range(len(shard))) == row.tokens
        flat = np.concatenate(ids)[place : place + row.tokens]
        assert (shard.span(0, row.tokens) == flat).all()
        place += row.tokens


def test_sentencepiece_round_trip(spark, awkward, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for row in awkward.collect():
        ids = model.encode(row.text or "")
        want.append((row.doc_id, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    key = lambda x: (x[0] or -1, x[2])
    assert sorted(map(tuple, sentencepieces.digests(awkward, PIECES).collect()), key=key) == sorted(want, key=key)
    back = sentencepieces.decode(sentencepieces.encode(awkward, PIECES), PIECES)
    assert sorted(sha(r.text) for r in back.collect()) == sorted(x[3] for x in want)
    assert sentencepieces.digests(nothing, PIECES).count() == 0


def test_packing_is_whole_and_gapless(spark, awkward, nothing):
    found = packing.pack_documents(awkward, WORD_BPE, 1, capacity=256).collect()
    _, ids = expected(awkward)
    assert sum(r.length for r in found) == sum(map(len, ids))
    known = sorted((len(x), zlib.crc32(x[a : a + 256].tobytes()), a) for x in ids for a in range(0, len(x), 256))
    assert sorted((r.doc_tokens, r.ids_crc32, r.start) for r in found) == known
    windows = {}
    for r in found:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    for pieces in windows.values():
        place = 0
        for offset, length in sorted(pieces):
            assert offset == place
            place += length
        assert place <= 256
    assert packing.pack_documents(nothing, WORD_BPE, 1).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_fill_is_optimal(seed):
    random = np.random.default_rng(seed)
    counts = {int(x): int(random.integers(1, 4)) for x in random.integers(3, 40, 6)}
    items = [x for x, n in counts.items() for _ in range(n)]
    reach = {0}
    for x in items:
        reach |= {y + x for y in reach}
    used = packing.fill(counts, 71)
    assert sum(x * n for x, n in used.items()) == max(x for x in reach if x <= 71)
    assert all(n <= counts[x] for x, n in used.items())
    plan = packing.plan_windows(counts, 71)
    total = {}
    for used, times in plan:
        for x, n in used.items():
            total[x] = total.get(x, 0) + n * times
    assert total == counts
