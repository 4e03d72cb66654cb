"""Ids of whole texts by a word-level BPE tokenizer, each distinct word of a slice looked up once.

The tokenizer drops white space and never merges across it, so the ids of a text are those of its
white-space separated words in order. Words of Latin letters, with or without punctuation behind
them, go through the same BPE model without the general normaliser; every other word is encoded
by the unchanged tokenizer. Words are told apart, lower-cased and put together from the ids of their
letters and of their punctuation as columns, so that Python sees each distinct run of letters alone.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from murmurlens.llm.common import worker_cache

MOST_WORDS, MOST_CHARS = 80_000, 4 << 20
# Letters whose lower case is one letter of the same block and that no normal form changes.
PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,!?;:$%&#*|]*)$"


class Kept:
    """A dictionary of two generations: what is not asked for while ``most`` new entries, or entries of
    ``MOST_CHARS`` characters, come in is forgotten. Bounds memory; forgotten entries are simply
    computed again."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys) -> list:
        young, old = self.young, self.old
        if len(young) >= self.most or sum(map(len, young)) >= MOST_CHARS:
            self.old, self.young = old, young = young, {}
        lost = []
        for key in keys:
            if key not in young:
                if key in old:
                    young[key] = old[key]
                else:
                    lost.append(key)
        return lost


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated runs ``values[start : start + length]``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts - (ends - lengths), lengths)
    return values[at + np.arange(total)]


def strings(words: pa.Array) -> list[str]:
    """What ``to_pylist`` gives for words without nulls, in half the time."""
    return words.to_numpy(zero_copy_only=False).tolist()


class WordTable:
    """``encode(texts)`` gives all ids (uint32) and the place where each text begins in them."""

    def __init__(self, path: str, most: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        suffix = self.whole.model.end_of_word_suffix or ""
        self.can_join = bool(suffix)
        self.vocabulary = self.whole.get_vocab_size()
        self.ends = np.array(
            [bool(suffix) and (self.whole.id_to_token(i) or "").endswith(suffix) for i in range(self.vocabulary)]
        )
        self.odd, self.cores, self.tails = Kept(most // 2), Kept(most), Kept(10_000)

    def _encode_cores(self, cores: list[str]) -> None:
        """Ids of plain lower-case words: many words per call, cut again at the word-end pieces."""
        joined = [" ".join(cores[i : i + 500]) for i in range(0, len(cores), 500)]
        ids = [i for e in self.plain.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids]
        flat = np.array(ids, np.uint32)
        cuts = (np.flatnonzero(self.ends[flat]) + 1) * 4 if len(flat) else np.zeros(0, int)
        if len(cuts) != len(cores):
            raise ValueError("the model's pieces don't mark where its words end")
        raw, last = flat.tobytes(), 0
        for core, cut in zip(cores, cuts.tolist()):
            self.cores.young[core] = raw[last:cut]
            last = cut

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has. Only distinct cores, tails and
        odd words become Python objects."""
        if self.can_join:
            parts = pc.extract_regex(words, PLAIN)
            plain = pc.is_valid(parts)
            parts = parts.filter(plain)
            cores, tails = (x.dictionary_encode() for x in (pc.utf8_lower(parts.field("core")), parts.field("tail")))
            odd = strings(words.filter(pc.invert(plain)))
            plain = plain.to_numpy(zero_copy_only=False)
        else:
            cores = tails = pa.array([], pa.string()).dictionary_encode()
            odd, plain = strings(words), np.zeros(len(words), bool)
        core_words, tail_words = strings(cores.dictionary), strings(tails.dictionary)
        self._encode_cores(self.cores.missing(core_words))
        for kept, keys in ((self.tails, tail_words), (self.odd, odd)):
            lost = kept.missing(keys)
            kept.young.update(zip(lost, self._encode(lost)))
        raw = [*map(self.cores.young.__getitem__, core_words), *map(self.odd.young.__getitem__, odd), *map(self.tails.young.__getitem__, tail_words), b""]
        flat = np.frombuffer(b"".join(raw), np.uint32)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        # A plain word is the run of its core and that of its tail, an odd one its own run and the empty one.
        runs = np.empty((len(words), 2), np.int64)
        runs[plain, 0] = cores.indices.to_numpy()
        runs[plain, 1] = tails.indices.to_numpy() + (len(core_words) + len(odd))
        runs[~plain, 0] = len(core_words) + np.arange(len(odd))
        runs[~plain, 1] = len(raw) - 1
        starts = np.cumsum(lengths) - lengths
        return gather(flat, starts[runs.ravel()], lengths[runs.ravel()]), lengths[runs].sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        flat, lengths = self._ids_of(coded.dictionary)
        starts = np.cumsum(lengths) - lengths
        at = coded.indices.to_numpy(zero_copy_only=False)
        per_word = lengths[at]
        ends = np.concatenate([[0], np.cumsum(per_word)])
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        return gather(flat, starts[at], per_word), ends[offsets]


def word_table(path: str) -> WordTable:
    return worker_cache(f"words:{path}", lambda: WordTable(path))
