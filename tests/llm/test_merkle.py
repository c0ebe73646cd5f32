import hashlib
import random

import pytest
from pyspark.sql import functions as F

from accesslake.llm.merkle import butterfly, fold, leaf_of, prove


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def ways(leaves, fanout):
    """The root and each leaf's (place, siblings) by level."""
    found, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, a in enumerate(at):
            low = a - a % fanout
            found[i].append((a % fanout, nodes[low:a] + nodes[a + 1 : low + fanout]))
        nodes = [sha("".join(nodes[j : j + fanout])) for j in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], found


def brute(rows, fanout=8):
    """``rows`` (tree, order, leaf); (leaf, subroot, root, proof) of each."""
    out, trees = [], sorted({r[0] for r in rows}, key=lambda t: (t is not None, (t or "").encode()))
    grown = {t: (own := sorted((r for r in rows if r[0] == t), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), ways([r[2] for r in own], fanout)) for t in trees}
    root, tops = ways([grown[t][1][0] for t in trees], fanout)
    for t, top in zip(trees, tops):
        own, (subroot, found) = grown[t]
        out += [(r[2], subroot, root, tuple((p, tuple(s)) for p, s in way + top)) for r, way in zip(own, found)]
    return sorted(out)


def collected(df):
    return sorted((r.leaf, r.subroot, r.root, tuple((s.place, tuple(s.siblings)) for s in r.proof)) for r in df.collect())


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def proved(docs, **how):
    return prove(docs, leaf_of([F.col(c) for c in COLUMNS]), F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id")}, **how)


@pytest.mark.parametrize("fanout,levels", [(2, 1), (3, 1), (3, 2), (8, 3)])
def test_proofs_as_brute_force(small, fanout, levels):
    rows = [(r.lang, r.doc_id, leaf([r[c] for c in COLUMNS])) for r in small.documents.collect()]
    df = proved(small.documents, fanout=fanout, levels=levels)
    assert collected(df) == brute(rows, fanout)
    assert df.where(fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert df.where(fold(F.sha2(F.col("leaf"), 256), F.col("proof")) == F.col("root")).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 8, 9, 10, 26, 27, 28, 50, 81])
def test_every_member_gets_its_proof_by_exchange(llm, count):
    roots = [sha(str(i)) for i in range(count)]
    df = llm.createDataFrame([("a", i, count, r) for i, r in enumerate(roots)] + [(None, 0, 1, "x")], "tree string, block long, count long, root string")
    got = {(r.tree, r.block): (r.root, [(s.place, list(s.siblings)) for s in r.proof]) for r in butterfly(df, 3).collect()}
    root, found = ways(roots, 3)
    assert got.pop((None, 0)) == ("x", [])
    assert got == {("a", i): (root, way) for i, way in enumerate(found)}


def test_odd_rows(odd, empty):
    rows = [(r.lang, r.doc_id, leaf([r[c] for c in COLUMNS])) for r in odd.collect()]
    for how in ({}, {"fanout": 2, "levels": 1}):
        assert collected(proved(odd, **how)) == brute(rows, how.get("fanout", 8))
    assert proved(empty).collect() == []
    clash = odd.select("*", *(F.lit(1).alias(c) for c in ("tree", "block", "root", "proof", "leaf", "kept", "_tree", "pos")))
    assert collected(proved(clash)) == collected(proved(odd))


def test_a_tree_a_row_and_one_row(llm):
    rows = [(random.Random(i).randbytes(2).hex(), i % 7 or None, leaf([i])) for i in range(40)]
    df = llm.createDataFrame(rows, "t string, o long, l string")
    got = prove(df, F.col("l"), F.col("t"), F.col("o"), {"o": F.col("o")})
    assert collected(got) == brute(rows)
    one = prove(df.limit(1), F.col("l"), F.col("t"), F.col("o"), {"o": F.col("o")}).first()
    assert one.leaf == one.subroot == one.root and one.proof == []
