import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from accesslake.llm import suffix
from accesslake.llm.links import agreeing_blocks, components, links, tile_links
from accesslake.llm.queries import QUERIES
from accesslake.llm.simhash import keep_one, near_duplicates, similar
from accesslake.llm.suffix import Shard, common_prefixes, cut_texts, remove_repeats, repeated_spans, sliding, suffix_array, windows, without
from corpus_pipeline import drop_near_copies


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(text, size=4):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = np.array([xxhash.xxh64_intdigest(x, 42) for x in s], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


def brute(rows, radius=4):
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    fps = [simhash(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    return {rows[i][0]: (fps[i], rows[r][0]) for i, r in enumerate(roots(len(fps), pairs))}


def test_classes_as_brute_force(small):
    rows = [(r.doc_id, r.text) for r in small.documents.collect()]
    got = {r.doc_id: (r.words[0] % 2**64, r.component_id) for r in near_duplicates(small.documents).collect()}
    assert got == brute(rows)


def test_odd_rows_have_classes(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = near_duplicates(odd).collect()
    assert len(got) == len(rows)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert {r.doc_id: (r.words[0] % 2**64, r.component_id) for r in got if r.doc_id is not None} == brute(rows)
    assert near_duplicates(empty).collect() == []


def test_wide_fingerprints_find_near_copies(llm):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(60):
        words = [word() for _ in range(200)]
        rows.append((2 * i, " ".join(words)))
        for at in rng.sample(range(200), 3):
            words[at] = word()
        rows.append((2 * i + 1, " ".join(words) if i % 2 else " ".join(word() for _ in range(200))))
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    classes = near_duplicates(docs, radius=48, shingle=5, words=4, least=6)
    kept = {r.doc_id for r in keep_one(docs, classes).collect()}
    assert kept == {i for i in range(120) if i % 2 == 0 or i // 2 % 2 == 0}


def similar_texts(rng, bases, copies):
    """Texts in which a run of words is replaced, so that pairs are 0.6 to 0.9 alike."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for i in range(bases):
        words = [word() for _ in range(rng.choice([8, 9, 60, 120, 400]))]
        texts.append(words)
        for _ in range(copies):
            n = round(len(words) * rng.uniform(0.04, 0.24))
            at = rng.randrange(len(words) - n + 1)
            texts.append(words[:at] + [word() for _ in range(n)] + words[at + n :] if rng.random() < 0.7 else words[: len(words) - n])
    return [" ".join(t) for t in texts]


def brute_similar(texts, least=0.8):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    jaccard = lambda x, y: len(x & y) / len(x | y)
    return roots(len(texts), [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= least])


@pytest.mark.parametrize("bases,copies", [(120, 1), (3, 60)])
def test_similar_documents_as_brute_force(llm, bases, copies):
    texts = similar_texts(random.Random(8), bases, copies) + ["la " * 500 + "one two three four five six", "la " * 700 + "seven eight nine ten eleven"]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_similar(texts)
    assert 10 < sum(i != r for i, r in enumerate(expected)) < len(texts) - 10
    assert {r.doc_id: r.component_id for r in similar(docs).collect()} == dict(enumerate(expected))
    assert {r.doc_id for r in drop_near_copies(llm, docs, "").collect()} == set(expected)


def test_similar_odd_rows(llm, odd, empty):
    got = similar(odd).collect()
    assert len(got) == odd.count() and all((r.component_id is None) == (r.doc_id is None) for r in got)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None}[5] == 4
    assert similar(empty).collect() == []


def test_near_copies_are_told_apart_by_id_and_text(llm, odd, empty):
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in "bcde"]
    b, c, d, e = texts
    rows = [(2, b), (5, c), (5, b), (7, d), (7, d), (None, d), (None, e), (None, e + " more"), (9, None), (8, "")]
    docs = llm.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, text_key string, component long, at string")
    kept = drop_near_copies(llm, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(2, b), (5, c), (7, d), (8, ""), (None, min(e, e + " more", key=lambda t: hashlib.md5(t.encode()).hexdigest()))], key=repr)
    assert drop_near_copies(llm, empty, "").collect() == []
    ids = [(r.doc_id, r.text) for r in drop_near_copies(llm, odd, "").collect()]
    assert len(ids) == len(set(ids)) and (0, None) in ids and (4, "one two three") in ids


def test_blocks_keep_every_link(llm):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40)
    rows = [(i * 2, int(x)) for i, x in enumerate(base)] + [(i * 2 + 1, int(x) ^ int(sum(1 << int(b) for b in rng.choice(63, 4, replace=False)))) for i, x in enumerate(base)]
    nodes = llm.createDataFrame([(i, [x]) for i, x in rows], "id long, words array<long>")
    got = {(r.a, r.b) for r in links(nodes, agreeing_blocks([F.col("words")[0]], 4), 4).collect()}
    assert {(2 * i + 1, 2 * i) for i in range(40)} <= got
    with pytest.raises(ValueError):
        agreeing_blocks([F.col("words")[0]], 4, blocks=5)


@pytest.mark.parametrize("sizes", [(700, None), (530, 600)])
def test_tiles_as_all_pairs(sizes):
    rng = np.random.default_rng(1)
    left = rng.integers(0, 2**12, (sizes[0], 1)).astype(np.uint64)
    right = None if sizes[1] is None else rng.integers(0, 2**12, (sizes[1], 1)).astype(np.uint64)
    got = {tuple(sorted(p)) if right is None else p for a, b in tile_links(left, right, 1) for p in zip(a.tolist(), b.tolist())}
    other = left if right is None else right
    near = np.argwhere(np.bitwise_count(left[:, None, 0] ^ other[None, :, 0]) <= 1)
    assert got == {tuple(sorted(p)) if right is None else tuple(p) for p in near.tolist() if right is not None or p[0] != p[1]}


def test_large_groups_meet_in_parts(llm, monkeypatch):
    from accesslake.llm import links as module

    monkeypatch.setattr(module, "GROUP", 50)
    nodes = llm.range(400).select("id", F.array(F.col("id")).alias("words"))
    got = components(links(nodes, [F.lit(7).cast("long")], 1)).collect()
    assert {r.id for r in got} == set(range(1, 400)) and {r.root for r in got} == {0}


def test_components_of_a_chain_and_a_star(llm):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(7, 7), (5, 4)]
    got = {r.id: r.root for r in components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {i: 100 for i in range(101, 140)}
    assert components(llm.createDataFrame([], "a long, b long")).collect() == []


TEXTS = [b"a", b"aaaa", b"banana", b"mississippi" * 3, bytes(50), b"\0a\0\0a" * 9, b"xy" * 500 + b"\0" * 20, bytes(random.Random(1).choice(b"ab\0") for _ in range(2000))]


@pytest.mark.parametrize("text", TEXTS)
def test_suffix_array_and_prefixes(text):
    data = np.frombuffer(text, np.uint8)
    order, rank = suffix_array(data)
    expected = sorted(range(len(text)), key=lambda i: text[i:])
    assert order.tolist() == expected and rank[order].tolist() == list(range(len(text)))
    for cap in (3, 400):
        shared = common_prefixes(data, order, rank, cap)
        for k in range(1, len(text)):
            a, b = text[expected[k] :], text[expected[k - 1] :]
            n = next((c for c in range(min(len(a), len(b), cap)) if a[c] != b[c]), min(len(a), len(b), cap))
            assert shared[k] == n


def test_sliding():
    x = np.random.default_rng(1).integers(0, 9, 300)
    for n in (1, 5, 64, 100):
        assert sliding(np.minimum, x, n).tolist() == [x[i : i + n].min() for i in range(300 - n + 1)]


def test_equal_strings_have_equal_keys():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd ") for _ in range(3000))
    copy = b"zz" + text[500:1500] + b"yy"
    spread = lambda t: {t[s : s + 400]: k for k, f, n, _ in zip(*windows(np.frombuffer(t, np.uint8), 400)) for s in range(f, f + n)}
    one, two = spread(text), spread(copy)
    shared = set(one) & set(two)
    assert len(shared) == 601 and all(one[s] == two[s] for s in shared)


def counted(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mark = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        covered = np.cumsum(mark)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        out.append((d, edge.reshape(-1, 2).tolist()))
    return out


def spans_of(docs, length):
    return {(r.doc_id, r.text_hash): [[s["from"], s["to"]] for s in r.spans] for r in repeated_spans(docs, length).collect()}


def check_spans(docs, length):
    rows = [(r.doc_id, r.text, r.h) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    got = spans_of(docs, length)
    for (doc, _, h), (_, spans) in zip(rows, counted([r[:2] for r in rows], length)):
        assert got.get((doc, h), []) == spans


def test_spans_as_brute_force(small):
    check_spans(small.documents.limit(120), 400)


def test_spans_of_odd_rows(odd, empty):
    check_spans(odd.where("length(text) < 10000 or text is null"), 50)
    assert repeated_spans(empty).collect() == []


@pytest.mark.parametrize("shard,key", [(700, 1 << 20), (1 << 20, 100), (300, 2000)])
def test_shards_and_large_keys(llm, monkeypatch, shard, key):
    """Small shards are merged by binary search, large keys compared by digests, with the same result."""
    monkeypatch.setattr(suffix, "SHARD", shard)
    monkeypatch.setattr(suffix, "KEY_BYTES", key)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage = text(150)
    rows = [(i, text(rng.randrange(0, 200)) + passage[rng.randrange(20) :] + text(rng.randrange(0, 200))) for i in range(40)] + [(50, "q" * 700), (51, "ab" * 200)]
    check_spans(llm.createDataFrame(rows, "doc_id long, text string"), 60)


def test_merging_by_binary_search():
    rng = random.Random(6)
    parts = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(12)]
    one, two = Shard(parts[:6], np.ones(6, int), 8), Shard(parts[6:], np.ones(6, int), 8)
    one.merge(two)
    seen = Counter(p[i : i + 8] for p in parts for i in range(53))
    for half, found in ((parts[:6], one.repeated()), (parts[6:], two.repeated())):
        for p, (low, high) in zip(half, found):
            twice = [seen[p[i : i + 8]] > 1 for i in range(53)]
            assert [any(a <= i < b for a, b in zip(low, high)) for i in range(53)] == twice


def test_cut_texts_and_whole_characters(llm):
    passage = "é" * 5 + "0123456789" * 12
    docs = llm.createDataFrame([(1, "é" + passage + "è", "x"), (2, "ö" + passage + "ü", "x"), (3, "alone", "x"), (None, None, "x")], "doc_id long, text string, kept string")
    cut = {r.doc_id: r for r in cut_texts(docs, 60).collect()}
    expected = counted([(r.doc_id, r.text) for r in docs.collect()], 60)
    for doc, (data, spans) in zip((1, 2), expected):
        assert hashlib.sha256(without(data, [{"from": a, "to": b} for a, b in spans])).digest() == hashlib.sha256(bytes(cut[doc].kept)).digest()
    left = {r.doc_id: r.text for r in remove_repeats(docs, 60).collect()}
    assert left[3] == "alone" and left[None] is None and left[1].endswith("è") and len(left[1]) <= 3


def test_repeats_leave_when_names_clash(llm, empty):
    passage = "0123456789" * 12
    rows = [(1, f"a{passage}b", 1, 2, "s", "f"), (None, f"c{passage}d", 1, 2, "s", "f"), (3, None, 1, 2, "s", "f"), (4, "", 1, 2, None, None)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, _id int, _hash int, spans string, text_hash string")
    out = remove_repeats(docs, 60)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, [r.__class__(**{**r.asDict(), "text": {1: "ab", None: "cd", 3: None, 4: ""}[r.doc_id]}) for r in docs.collect()]))
    assert remove_repeats(empty, 60).collect() == []


def test_many_rows_of_one_id_and_text(llm):
    """Every row counts for what repeats; the runs of equal rows are held once."""
    text = "".join(random.Random(8).choice("abcdef") for _ in range(500))
    rows = [(1, text)] * 300 + [(2, "z" * 90), (3, text[100:250] + "!"), (None, text)]
    check_spans(llm.createDataFrame(rows, "doc_id long, text string"), 60)
    assert [(r.doc_id, r.n_removed) for r in cut_texts(llm.createDataFrame(rows[:301], "doc_id long, text string"), 60).orderBy("doc_id").collect()] == [(1, 500), (2, 90)]


def test_the_query_cuts_strings_of_400_bytes_and_no_shorter_passage(llm, tmp_path):
    """All columns of op4 as by brute force; a shared passage of more than 50 words stays if it is shorter than 400 bytes."""
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(n)).encode()
    passage = lambda n: b"<" + prose(200)[: n - 2].decode(errors="ignore").encode().ljust(n - 2, b".") + b">"
    short, exact, twice = passage(399), passage(400), passage(450)
    assert len(short.split()) > 50
    middle = {1: short, 2: short, 3: exact, 4: exact, 5: twice + prose(20) + twice, 6: prose(90), None: exact}
    rows = [(i, (prose(9) + f"{i}".encode() + m + f"{i}".encode() + prose(9)).decode()) for i, m in middle.items()] + [(7, None), (8, "")]
    llm.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op4_suffix_array_dedup"](llm, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    expected = {}
    for (i, _), (data, spans) in zip(rows, counted(rows, 400)):
        kept = without(data, [{"from": a, "to": b} for a, b in spans])
        expected[i] = (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert got == expected
    assert {i: r[1:3] for i, r in got.items()} == {1: (0, 0), 2: (0, 0), 3: (400, 1), 4: (400, 1), 5: (900, 2), 6: (0, 0), 7: (0, 0), 8: (0, 0), None: (400, 1)}
