import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslake.llm.kdtree import shard
from accesslake.llm.mixing import BUCKETS, Domains, fit_rates, learn_domains, memberships, mix, resample
from accesslake.llm.topk import top_k
from accesslake.llm.toxicity import Model, fit, held_out, keep_clean, score, text_features, train
from accesslake.llm.urltree import Rule, host_and_path, judge, rule_of, templates

# toxicity


def toxic_tables(llm, n=900):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, 30))
        bad = i % 6 == 0
        if bad:
            text += rng.choice([" grobian!", f" schurk{rng.choice(['en', 'isch', 'erei'])}"])
        rows.append((i, text, "en"))
        if i % 3 != 1:
            labels.append((i, int(bad), 1))
    return llm.createDataFrame(rows, "doc_id long, text string, score string"), llm.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_confirmed_and_unlabelled_texts_make_a_classifier(llm):
    docs, labels = toxic_tables(llm)
    got = score(docs, train(docs, labels)).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.98
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    kept = keep_clean(docs, train(docs, labels))
    assert kept.columns == docs.columns and 0.8 < kept.count() / docs.count() < 0.86


def test_labels_of_the_held_out_fifth_are_not_used(llm):
    docs, labels = toxic_tables(llm, 300)
    other = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert train(docs, labels) == train(docs, other)


def test_the_risk_stays_non_negative():
    rows = [[0]] * 50 + [[1]] * 400 + [[0]] * 50
    w, b = fit(rows, np.array([1] * 50 + [0] * 450), 2, prior=0.1)
    p = 1 / (1 + np.exp(-(w + b)))
    assert p[0] > 0.8 > 0.2 > p[1]


def test_toxicity_of_odd_rows(llm, odd, empty):
    docs, labels = toxic_tables(llm, 300)
    model = train(docs, labels)
    got = score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert score(empty, model).collect() == []
    none = train(docs, labels.where("toxic = 0"))
    assert not none.weights and train(empty, labels.limit(0)).weights == {}
    assert keep_clean(odd, Model(-9.0)).count() == odd.count()


def test_scores_are_sums_of_present_features():
    model = Model(-1.0, {"schurke": 1.0, "schu*": 2.0, "schur*": 4.0, "schurk*": 8.0, "ein": 16.0})
    for text in ("Schurke schurkisch", "schu", "schur!", "EIN, ein", "", "a"):
        z = -1.0 + sum(model.weights.get(f, 0.0) for f in text_features(text))
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-z)))


# mixing


def language_docs(llm):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        lang = ["a", "b", "c"][0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]
        rows.append((i, " ".join(f"{lang}{x}" for x in rng.integers(0, 50, rng.integers(1, 60))), lang))
    return llm.createDataFrame(rows, "doc_id long, text string, domain string")


def test_expected_tokens_match_the_targets(llm):
    docs = language_docs(llm)
    rates, model, fitted = mix(docs, docs.where("doc_id % 2 = 0"), {"a": 0.2, "b": 0.3, "c": 0.5})
    rows = rates.collect()
    total = sum(r.tokens for r in rows)
    for d, share in enumerate((0.2, 0.3, 0.5)):
        assert sum(r.rate * r.tokens * r.p[d] for r in rows) == pytest.approx(share * total, rel=1e-4)
    assert all(r.rate >= 0 and sum(r.p) == pytest.approx(1) for r in rows)
    assert all(fitted.of(np.array(r.p)) == pytest.approx(r.rate) for r in rows)


def test_a_floor_loses_no_document(llm):
    docs = language_docs(llm)
    _, model, rates = mix(docs, docs, {"a": 0.4, "b": 0.3, "c": 0.3}, floor=1.0)
    out = resample(docs, model, rates)
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == 400 < out.count()
    tokens = defaultdict(int)
    for r in out.collect():
        tokens[r.domain] += len(r.text.split())
    assert tokens["c"] / sum(tokens.values()) == pytest.approx(0.3, abs=0.05)


def test_projection_holds_rates_at_the_floor(llm):
    members = llm.createDataFrame([(10, [0.9, 0.1]), (10, [0.5, 0.5]), (10, [0.0, 1.0])], "tokens long, p array<double>")
    rates = fit_rates(members, [0.05, 0.95], total=30.0, rounds=60)
    got = [r.rate for r in members.withColumn("rate", rates.column("p")).collect()]
    assert min(got) == 0 and rates.expected == pytest.approx([1.5, 28.5], rel=0.02)


def skewed(sharpness):
    rng = np.random.default_rng(4)
    rows = []
    for d in rng.choice(4, 3000, p=[0.97, 0.01, 0.01, 0.01]):
        z = rng.normal(size=4)
        z[d] += sharpness
        rows.append((int(rng.integers(20, 400)), (np.exp(z) / np.exp(z).sum()).tolist()))
    return rows


@pytest.mark.parametrize("sharpness,floor,weights", [(2, 0.0, [10, 30, 30, 30]), (4, 0.0, [10, 30, 30, 30]), (4, 0.0, [25, 25, 25, 25]), (4, 1.0, [55, 15, 15, 15])])
def test_targets_are_met_where_the_floor_binds(llm, sharpness, floor, weights):
    rows = skewed(sharpness)
    rates = fit_rates(llm.createDataFrame(rows, "tokens long, p array<double>").coalesce(1).cache(), weights, floor=floor)
    got = np.array([np.array(p) * t * rates.of(np.array(p)) for t, p in rows]).sum(axis=0)
    assert rates.met and got / got.sum() == pytest.approx(np.array(weights) / 100, abs=1e-5)
    assert min(rates.of(np.array(p)) for _, p in rows) == floor


def by_projected_gradient(rows, weights, floor, rounds=20000):
    """Plain projected gradient of least squares: the gradients' sum is projected, every step is as short as the safe one."""
    tokens, p = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    off = np.eye(p.shape[1])
    if floor >= 1:
        off = off - np.outer(np.array(weights) / sum(weights), np.ones(len(off)))
    goal = np.zeros(len(off)) if floor >= 1 else np.array(weights) / sum(weights) * tokens.sum()
    length, way = 1 / np.linalg.eigvalsh(off @ ((p * tokens[:, None]).T @ p) @ off.T)[-1], np.zeros(len(off))
    for _ in range(rounds):
        rate = np.maximum(floor, max(floor, 1.0) - p @ way)
        way += length * (off.T @ (off @ ((tokens * rate) @ p) - goal))
    return rate


@pytest.mark.parametrize("floor,weights", [(0.0, [10, 30, 30, 30]), (0.0, [25, 25, 25, 25]), (1.0, [55, 15, 15, 15])])
def test_rates_as_by_plain_projected_gradient(llm, floor, weights):
    rows = skewed(4)
    rates = fit_rates(llm.createDataFrame(rows, "tokens long, p array<double>").coalesce(1).cache(), weights, floor=floor)
    expected = by_projected_gradient(rows, weights, floor)
    assert [rates.of(np.array(p)) for _, p in rows] == pytest.approx(expected, abs=2e-3)


def test_targets_out_of_reach_are_reported(llm):
    members = llm.createDataFrame([(10, [0.9, 0.1]), (20, [0.6, 0.4])], "tokens long, p array<double>").coalesce(1).cache()
    with pytest.warns(UserWarning, match="miss the targets"):
        rates = fit_rates(members, [0.1, 0.9])
    assert not rates.met and all(np.isfinite(rates.expected))


def test_mixing_odd_rows(llm, odd, empty):
    model = learn_domains(llm.createDataFrame([("a", "x y"), ("b", None), (None, "z"), ("other", "x")], "domain string, text string"), ["a", "b"])
    rows = memberships(odd, model).collect()
    assert len(rows) == odd.count() and all(sum(r.p) == pytest.approx(1) for r in rows)
    _, model, rates = mix(empty, empty.withColumn("domain", F.lit("a")), {"a": 1.0})
    assert rates.steps == [] and resample(empty, model, rates).count() == 0
    assert isinstance(model, Domains) and model.weights.shape == (1, BUCKETS)


# top-k


def brute_top(rows, k, ask, scale=256):
    good = [(i, [int(np.floor(scale * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in sorted(good, key=lambda r: (r[0], r[1]), reverse=True):
        if ask(i):
            scored = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i))[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return {(i, *x) for i, found in out.items() for x in found}


def test_top_k_as_brute_force(small):
    rows = [(r.vec_id, r.embedding) for r in small.embeddings.collect()]
    got = {tuple(r) for r in top_k(small.embeddings, F.col("vec_id") % 50 == 0).collect()}
    assert got == brute_top(rows, 5, lambda i: i % 50 == 0)


def test_top_k_of_odd_vectors(llm, monkeypatch):
    from accesslake.llm import topk

    monkeypatch.setattr(topk, "ROW_BLOCK", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 20) / 8]) for i in range(60)]
    rows += [(100, None), (101, [None, 1.0]), (102, [float("nan")] * 20), (103, [float("inf")]), (None, [1.0] * 20), (104, [2.0, 2.0]), (105, []), (7, [1.0] * 20), (10, [0.5] * 20)]
    rows += [(i, [0.25] * 20) for i in range(200, 230)]
    docs = llm.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    assert {tuple(r) for r in top_k(docs, F.col("vec_id") % 5 == 0).collect()} == brute_top(rows, 5, lambda i: i % 5 == 0)
    assert top_k(docs.limit(0), F.lit(True)).collect() == []
    assert top_k(docs.where("vec_id = 104"), F.lit(True)).collect() == []


def test_blocks_are_written_before_they_are_paired(llm, small):
    plan = top_k(small.embeddings, F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plan and plan.count("MapInArrow") == 1


# k-d tree


def test_shards_are_even(small):
    rows = {r.doc_id: r.text for r in small.documents.collect()}
    got = shard(small.documents, 16).collect()
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        text = rows[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text))
        size[r.shard] += r.size
        slots[r.shard].append((r.doc_id, r.slot))
    assert sorted(size) == list(range(16)) and len(got) == len(rows)
    assert max(size.values()) - min(size.values()) <= 2 * max(len(t.encode()) + 1 for t in rows.values())
    for found in slots.values():
        assert [s for _, s in sorted(found)] == list(range(len(found)))


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_a_hot_source_is_split(llm, shards):
    rows = [(i, "x" * (i % 7), "en", "hot" if i % 3 else f"s{i}") for i in range(900)]
    got = shard(llm.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(got) == shards and max(r.n for r in got) - min(r.n for r in got) < 30


def test_shards_of_odd_rows(odd, empty):
    got = shard(odd, 4).collect()
    assert len(got) == odd.count() and {r.shard for r in got} <= set(range(4))
    assert shard(empty, 4).collect() == []
    plan = shard(odd, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


# addresses

RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]
URLS = [
    ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/"),
    ("https://example.org", "example.org", "", None),
    ("https://example.org/", "example.org", "/", "org/"),
    ("https://notexample.org/es/1", "notexample.org", "/es/1", "org/"),
    ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1"),
    ("https://x.com/FR/", "x.com", "/FR/", None),
    ("https://com/de/", "com", "/de/", "com/de/"),
    ("https://h?a=/b://c", "h", "", None),
    ("no address", "", "", None),
    ("x://", "", "", None),
    ("a://b://c/d", "b:", "//c/d", None),
    ("ftp://U@H:80/p\nq", "u@h:80", "/p\nq", None),
    (None, "", "", None),
]


def test_hosts_paths_and_rules(llm):
    df = llm.createDataFrame([(u,) for u, *_ in URLS], "url string")
    host, path = host_and_path(F.col("url"))
    got = df.select("url", host.alias("h"), path.alias("p")).withColumn("r", rule_of(F.col("h"), F.col("p"), RULES)).collect()
    assert [(r.url, r.h, r.p, r.r and r.r.rule) for r in got] == [tuple(x) for x in URLS]


def test_variable_segments_become_wildcards_and_bad_templates_go(llm):
    rows = [(i, f"http://h.net/news/{i}") for i in range(60)] + [(i, f"http://h.net/spam/{i}/x") for i in range(100, 160)] + [(i, f"http://k.net/only/{i % 2}") for i in range(200, 204)]
    pages = llm.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string")
    labels = llm.createDataFrame([(i, int(i < 100)) for i, _ in rows if i % 2 == 0 and i < 200] + [(100, None)], "page_id long, good int")
    got = {r.page_id: r for r in judge(pages, labels).collect()}
    assert {got[i].template for i in range(60)} == {"/news/*"} and {got[i].template for i in range(100, 160)} == {"/spam/*/x"}
    assert {r.verdict for i, r in got.items() if i < 60} == {"allow"} and {r.verdict for i, r in got.items() if 100 <= i < 160} == {"block"}
    assert {got[i].template for i in range(200, 204)} == {"/only/~"}  # alike: no label tells them apart
    assert len(got) == len(rows)


def test_small_sections_are_judged_by_their_labels(llm):
    rows = [(i, f"http://h.net/s{i % 100}/{i}") for i in range(1000)] + [(i, f"http://k.net/{i}") for i in range(2000, 2020)]
    pages = llm.createDataFrame(rows, "page_id long, url string")
    labels = llm.createDataFrame([(i, int(i % 100 != 7 and i != 2003)) for i, _ in rows], "page_id long, good int")
    got = {r.page_id: r for r in judge(pages, labels).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {i for i in range(1000) if i % 100 == 7}
    assert {got[i].template for i in range(7, 1000, 100)} == {"/s7/*"} and {got[i].template for i in range(2000, 2020)} == {"/*"}


def test_deep_paths_and_odd_addresses(llm):
    pages = llm.createDataFrame([(i, u) for i, (u, *_) in enumerate(URLS)] + [(None, "http://d.net/" + "a/" * 3000), (3, None), (3, None)], "page_id long, url string")
    got = judge(pages, None, RULES).collect()
    assert len(got) == len(URLS) + 3 and all(r.verdict in ("allow", "block") for r in got)
    assert judge(pages.limit(0), None).collect() == []
    deep = templates(llm.createDataFrame([("h", "/" + "/".join("abcdefghijkl"), 1, 0, 0)], "host string, path string, n long, known long, good long"), depth=3).first()
    assert deep.template == "/a/b/" + "/".join("cdefghijkl")


def test_labelled_rows_with_clashing_names(llm):
    from accesslake.llm.mixing import labelled_rows

    docs = llm.createDataFrame([(1, "a", "x", 7, 8), (1, "a", "x", 7, 8), (None, "b", "y", 7, 8), (3, None, None, 7, 8)], "doc_id long, domain string, text string, _id int, `of` int")
    ids = llm.createDataFrame([(1,), (3,), (None,), (9,)], "doc_id long")
    assert sorted(map(tuple, labelled_rows(docs, ids, "domain").collect()), key=str) == [("a", "x"), ("a", "x"), (None, None)]


def test_labelled_rows_are_bounded(llm):
    from accesslake.llm.mixing import labelled_rows

    docs = language_docs(llm)
    ids = docs.select("doc_id").union(llm.createDataFrame([(None,), (5,), (5,), (99999,)], "doc_id long"))
    assert labelled_rows(docs, ids, "domain").count() == 400
    few = labelled_rows(docs, ids, "domain", max_rows=50)
    assert 49 <= few.count() <= 50 and few.columns == ["domain", "text"]
    assert sorted(map(str, few.collect())) == sorted(map(str, labelled_rows(docs, ids, "domain", max_rows=50).collect()))
