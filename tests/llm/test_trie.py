import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from murmurlens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, x int, shard string, length int"


def brute(rows):
    """The contract turn by turn: every node as a tuple of first turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, mark, role, text))
    said = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(said.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        last = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * last + sum(saved[x] for x in children[node])
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(x), min(members[x[:-1]]) if x else -1, len(m), len(children[x]), leaves[x], saved[x], digest(ends[x]))
        for x, m in members.items()
    )


def nodes(spark, rows, **how):
    chats = spark.createDataFrame([(*row, "d", 1, "s", 2) for row in rows], SCHEMA).repartition(3)
    found = trie.conversation_trie(chats, **how)
    assert found.columns == trie.RESULT
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in found.collect())


def made_rows(conversations=60, seed=3):
    chosen, rows = random.Random(seed), []
    for c in range(conversations):
        for t in range(chosen.randint(0, 14)):
            rows.append((c, t, chosen.choice(["user", "bot"]) if t > 3 else "user", chosen.choice(["hi", "yes", "né", ""]) if t else "hello"))
    rows += [(-3, 0, "user", "x"), (-5, 0, "bot", "y"), (None, 0, "user", "left out"), (200, None, None, None), (200, None, None, None), (200, 5, "user", "b")]
    rows += [(201, 5, "user", "tie b"), (201, 5, "user", "tie a"), (201, 5, None, "tie a"), (202, 1, "bot", "long " * 40_000)]
    return rows


@pytest.mark.parametrize("how", [{}, {"band": 3, "shard_rows": 11}, {"band": 1, "shard_rows": 40}])
def test_as_brute_force(spark, how):
    rows = made_rows()
    assert nodes(spark, rows, **how) == brute(rows)


def test_a_conversation_with_most_turns_and_its_copies(spark):
    """700 turns in one conversation, more than a third of all rows, and copies of it, in bands over many shards."""
    long = [(c, t, "user" if t % 2 else "bot", f"turn {t % 50}") for c in (20, 21, 22) for t in range(700)]
    rows = long + [(23, t, "bot", f"turn {t}") for t in range(300)] + made_rows(20)
    assert nodes(spark, rows, shard_rows=25) == brute(rows)


def test_hot_copies_span_shards(spark):
    """1500 equal conversations, ends of one node in many shards, fed to its digest in the order of ids."""
    rows = [(c, t, "user", "same") for c in range(0, 7500, 5) for t in range(9)] + [(7501 + c, 0, "user", f"other {c % 7}") for c in range(400)]
    assert nodes(spark, rows, shard_rows=100) == brute(rows)


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "user", "one") for c in range(2, 400) if c % 5]
    found = nodes(spark, rows)
    assert found == brute(rows) and found[0][1] == 0 and found[0][7] != trie.NO_ENDS


def test_empty_table(spark):
    assert nodes(spark, []) == [] and nodes(spark, [(None, 1, "user", "x")]) == []


def test_one_shard_is_the_whole_trie():
    """A shard alone: nodes off the paths of its first and last row are complete."""
    rows = {
        "band": [0] * 4, "x": [0] * 4, "y": [0] * 4, "conv_id": [4, 3, 2, 1], "goes_on": [False] * 4,
        "cells": [[1, 1], [2, 2, 5, 5], [2, 2], [3, 3]], "sizes": [[7], [10, 20], [10], [8]],
    }
    kinds = {"band": pa.int64(), "x": pa.int64(), "y": pa.int64(), "conv_id": pa.int64(), "goes_on": pa.bool_(), "cells": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64())}
    found = trie.shard_nodes(pa.table({k: pa.array(v, kinds[k]) for k, v in rows.items()}), 0)
    by = {(r["depth"], r["conv_id"], r["kind"]): r for r in found.to_pylist()}
    assert set(by) == {(0, 1, "open"), (1, 4, "open"), (1, 1, "open"), (1, 2, "closed_under_open"), (2, 3, "closed"), (1, None, "ends")}
    inner = by[1, 2, "closed_under_open"]
    assert (inner["n_convs"], inner["n_children"], inner["n_leaves"], inner["saved_tokens"]) == (2, 1, 1, 10)
    assert by[2, 3, "closed"]["parent_conv_id"] == 2 and by[0, 1, "open"]["n_leaves"] == 1
