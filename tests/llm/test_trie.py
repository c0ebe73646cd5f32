import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslake.llm import trie
from accesslake.llm.trie import decomposed, prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, graft=True):
    """Nodes of the trie of ``rows`` (conv_id, turn, role, text), turns of one conversation distinct."""
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(conv, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if graft else 0
        built[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in under if n)
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in under) for n in under)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        children = sum(len(n) == len(node) + 1 for n in under)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def collected(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def grafted(df, **how):
    conv = F.col("conv_id")
    return prefix_trie(df, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3, **how)


@pytest.fixture(scope="module")
def made(llm):
    """Conversations that share beginnings, copies, a hot first turn, one long chain, nulls and empty texts."""
    rng = random.Random(2)
    rows = []
    for c in range(0, 240, 2):
        for i in range(rng.randrange(1, 7)):
            text = "hot first turn" if i == 0 and c % 3 else f"say {rng.randrange(3)} again"
            rows.append((c - 20, i, rng.choice(["user", "assistant"]) if i > 1 else "user", text))
    rows += [(500, i, "user", f"t{i}") for i in range(60)] + [(501, i, "user", f"t{i}") for i in range(40)]
    rows += [(502, None, None, None), (502, 1, "user", ""), (503, None, "", ""), (503, 5, "user", None), (None, 1, "user", "lost"), (None, 2, None, None)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("room,span", [(4096, 4096), (40, 4096), (3, 7), (1, 1)])
def test_nodes_as_brute_force(llm, made, monkeypatch, room, span):
    monkeypatch.setattr(trie, "RANGE", span)
    assert collected(grafted(llm.createDataFrame(made, SCHEMA), room=room)) == brute(made)


def test_given_conversations(small):
    rows = [tuple(r) for r in small.conversations.select("conv_id", "turn", "role", "text").collect()]
    assert collected(grafted(small.conversations)) == brute(rows)
    assert collected(prefix_trie(small.conversations, room=10)) == brute(rows, graft=False)


def test_odd_tables(llm, made):
    assert grafted(llm.createDataFrame([], SCHEMA)).collect() == []
    assert grafted(llm.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
    alone = [(7, 0, "user", "gone"), (9, 0, "user", " \t"), (9, 0, "user", " \t")]
    assert collected(grafted(llm.createDataFrame(alone, SCHEMA))) == brute(alone)
    df = llm.createDataFrame(made, SCHEMA)
    clash = df.select("*", *(F.lit(1).alias(c) for c in ("node", "parent", "depth", "comp", "n_convs", "_range", "place", "length")))
    assert collected(grafted(clash)) == collected(grafted(df))
    long = [(1, 0, "user", "word " * 300000), (2, 0, "user", "word " * 300000)]
    assert collected(prefix_trie(llm.createDataFrame(long, SCHEMA))) == brute(long, graft=False)


def test_forests_in_a_task():
    rng = random.Random(3)
    for trial in range(150):
        n, kind = rng.randrange(1, 80), trial % 4
        parent = [-1]
        for i in range(1, n):
            near = [i - 1, rng.randrange(i), rng.randrange(max(0, i - 3), i), rng.randrange(min(i, 3))][kind]
            parent.append(-1 if rng.random() < 0.05 else near)
        shuffled = list(range(n))
        rng.shuffle(shuffled)
        up = np.full(n, -1)
        for i, p in enumerate(parent):
            up[shuffled[i]] = shuffled[p] if p >= 0 else -1
        values = np.array([[rng.randrange(100), 1] for _ in range(n)], np.int64)
        want = values.copy()
        for i in range(n):
            at = up[i]
            while at >= 0:
                want[at] += values[i]
                at = up[at]
        sums, rounds = decomposed(up, values)
        assert (sums == want).all() and 1 <= rounds.min() and rounds.max() <= np.log2(n) + 1
