import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslake.llm import minhash, sets
from accesslake.llm.minhash import band_keys, first_permutation, maybe_wanted, near_duplicates, second_permutation, signature
from accesslake.llm.sets import WordHashes, confirmed, shingle_set, sized_pairs


def brute_set(text, size=5):
    words = (text or "").encode().lower().split()
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, percent=85):
    """Per row (doc_id, set size, component): classes are sets, named by their least id."""
    found = [(d, frozenset(brute_set(t))) for d, t in rows]
    classes = list({s for _, s in found if s})
    label = list(range(len(classes)))
    for i, j in combinations(range(len(classes)), 2):
        shared = len(classes[i] & classes[j])
        if 100 * shared >= percent * (len(classes[i]) + len(classes[j]) - shared):
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    root = dict(zip(classes, label))
    least = {}
    for d, s in found:
        if s and d is not None:
            least[root[s]] = min(least.get(root[s], d), d)
    return sorted(((d, len(s), least.get(root[s]) if s else d) for d, s in found), key=repr)


def got(docs, **how):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, **how).collect()), key=repr)


def edited(words, share, rng):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words)


@pytest.fixture(scope="module")
def copies(llm):
    """Groups of copies of all degrees around the limit, chains, exact copies and a large group."""
    rng = random.Random(7)
    texts = []
    for group in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        texts += [edited(words, rng.choice([0, 0.005, 0.02, 0.03, 0.05]), rng) for _ in range(12)]
    chain = [f"c{i}" for i in range(300)]
    texts += [" ".join(chain[i : i + 200]) for i in range(0, 100, 5)]
    base = [f"b{i}" for i in range(80)]
    texts += [" ".join(base[:i] + [f"x{i}"] + base[i:]) for i in range(0, 80)]
    rng.shuffle(texts)
    return [(i * 3 % 401, t) for i, t in enumerate(texts)]


def test_classes_as_brute_force(llm, copies, small, monkeypatch):
    df = llm.createDataFrame(copies, "doc_id long, text string").repartition(5)
    want = brute(copies)
    assert len({c for _, _, c in want}) < len(want) - 50
    assert got(df) == want
    rows = [(r.doc_id, r.text) for r in small.documents.collect()]
    assert got(small.documents) == brute(rows)


def test_a_map_of_bits_loses_no_wanted_id(llm, monkeypatch):
    rows = llm.createDataFrame([(i * 7919 - 10**6,) for i in range(3000)] + [(None,), (2**63 - 1,), (-(2**63),)], "doc_id long")
    wanted = llm.createDataFrame([(i * 7919 - 10**6,) for i in range(0, 3000, 10)] + [(None,), (-(2**63),)], "_id long")
    names = {r[0] for r in wanted.collect()}
    for bits, most in ((minhash.BITS, 310), (1 << 9, 3003)):
        monkeypatch.setattr(minhash, "BITS", bits)
        got = [r[0] for r in maybe_wanted(rows, "doc_id", wanted, "_id").collect()]
        assert names <= set(got) and len(got) == len(set(got)) <= most
    assert maybe_wanted(rows, "doc_id", wanted.limit(0), "_id").collect() == []


def test_groups_too_large_for_a_task(llm, copies, monkeypatch):
    monkeypatch.setattr(sets, "ROOM", 300)
    df = llm.createDataFrame(copies, "doc_id long, text string").repartition(5)
    assert got(df) == brute(copies)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd) == brute(rows)
    assert got(empty) == []
    clash = odd.select("*", *(F.lit(1).alias(c) for c in ("node", "keys", "digest", "_id", "root", "size")))
    assert got(clash) == got(odd)


def test_signature_is_two_permutations_and_a_shift():
    values = np.unique(np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64))
    least = signature(values, 5)
    for k in (0, 4):
        assert least[k] == min(int(second_permutation(np.array([(int(p) - k) % 2**64], np.uint64))[0]) for p in first_permutation(values))
    assert len(np.unique(first_permutation(values))) == len(np.unique(second_permutation(values))) == len(values)
    assert len(set(band_keys(np.repeat(least[:1], 6), 2).tolist())) == 3


def test_agreement_estimates_likeness():
    rng = np.random.default_rng(5)
    for likeness in (0.5, 0.8, 0.9):
        agree = []
        for _ in range(40):
            both = rng.integers(0, 2**64, int(300 * likeness), dtype=np.uint64)
            rest = rng.integers(0, 2**64, (2, int(150 * (1 - likeness))), dtype=np.uint64)
            agree.append(np.mean(signature(np.concatenate([both, rest[0]]), 72) == signature(np.concatenate([both, rest[1]]), 72)))
        assert abs(np.mean(agree) - likeness) < 0.03


def test_forest_joins_what_links_join():
    rng = random.Random(1)
    for _ in range(30):
        groups = [np.unique(np.array([rng.randrange(40) for _ in range(rng.randrange(1, 30))], np.int64)) for _ in range(25)]
        ends = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
        roots = np.array([rng.randrange(20) for _ in groups])
        a, b = confirmed(roots, np.concatenate(groups), ends, 60, sized_pairs(np.diff(ends), 60))
        real = [(i, j) for i, j in combinations(range(25), 2) if 100 * len(np.intersect1d(groups[i], groups[j])) >= 60 * len(np.union1d(groups[i], groups[j]))]

        def classes(pairs):
            label = roots.tolist()
            for i, j in pairs:
                x, y = label[i], label[j]
                label = [x if v == y else v for v in label]
            return [label.index(v) for v in label]

        assert set(map(frozenset, zip(a, b))) <= set(map(frozenset, real)) and classes(zip(a, b)) == classes(real)


def test_words_are_remembered_within_a_bound():
    known = WordHashes(most=3)
    texts = ["a b c d e f g", "A  b\tC d\ne f g", "a b", ""]
    found = [shingle_set(t, 5, known) for t in texts]
    assert len(known) <= 3 and np.array_equal(found[0], found[1]) and [len(f) for f in found] == [3, 3, 1, 0]


def test_sets_go_straight_to_their_groups(llm, copies, monkeypatch):
    """With no side broadcast, texts stay where they are and sets move by their digest and to their groups, no third time."""
    plans = []
    real = sets._verified
    monkeypatch.setattr(sets, "_verified", lambda groups, *rest: plans.append(groups._jdf.queryExecution().executedPlan().toString()) or real(groups, *rest))
    llm.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near_duplicates(llm.createDataFrame(copies, "doc_id long, text string")).count()
    finally:
        llm.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans
    for text in plans:
        assert sorted(re.findall(r"Exchange hashpartitioning\((\w+)#", text)) == ["_bucket", "_digest", "digest"]
