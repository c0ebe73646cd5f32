import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslake.llm.common import bucket_of, running
from accesslake.llm.winnow import GRAM, WINDOW, hashes_of, neighbours, positions, with_marks


def grams(text):
    words = [w[i : i + 16] for w in text.split() for i in range(0, len(w), 16)]
    return [" ".join(words[i : i + GRAM]) for i in range(max(1, len(words) - GRAM + 1))] if words else []


def marks_of(llm, texts):
    df = with_marks(llm.createDataFrame(list(enumerate(texts)), "id long, t string"), {"m": "t"})
    return {r.id: [(x.hash, x.place) for x in r.p] for r in df.select("id", positions(F.col("m")).alias("p")).collect()}


def test_each_window_has_its_lowest_and_rightmost_gram(llm):
    texts = ["a b c d e f g h i j k l m n o p", "x " * 30, "one", "a b c d e f", "la la la la la di la la la la la la", "z" * 200]
    got = marks_of(llm, texts)
    for i, text in enumerate(texts):
        found, n = dict((p, h) for h, p in got[i]), len(grams(text))
        assert len(found) == len(got[i]) and sorted(found) == [p for _, p in got[i]]
        value = {}
        for h, p in got[i]:
            assert value.setdefault(grams(text)[p], h) == h  # equal grams have equal hashes
        for s in range(max(1, n - WINDOW + 1)):
            assert any(s <= p < s + WINDOW for p in found)
    assert [p for _, p in got[1]] == list(range(WINDOW - 1, len(grams(texts[1]))))  # all equal: the rightmost of each window
    assert [p for _, p in got[2]] == [0]


def test_shared_runs_share_a_mark(llm):
    run = " ".join(f"w{i}" for i in range(GRAM + WINDOW - 1))
    texts = [f"a b c {run} d e", f"{run}", f"q {run} r s t u v", "nothing of it here at all my friend"]
    got = [{h for h, _ in m} for _, m in sorted(marks_of(llm, texts).items())]
    assert got[0] & got[1] and got[0] & got[2] and got[1] & got[2] and not got[0] & got[3]


def expected(rows):
    rows = [(d, t or "") for d, t in rows]
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        yield d, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest(), t == n


def test_edits_follow_the_next_document(small):
    rows = sorted((r.doc_id, r.text) for r in small.documents.collect())
    got = {r.doc_id: r for r in neighbours(small.documents).collect()}
    assert len(got) == len(rows)
    same = {}
    for (doc, n, sha, next_equal), (_, text) in zip(expected(rows), rows):
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_next == 1 or not next_equal)
        assert same.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(same.values())) == len(same)
    assert np.mean([r.near_edited for r in got.values()]) > 0.25 > np.mean([r.near_next for r in got.values()])


def test_odd_documents(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = neighbours(odd).collect()
    assert len(got) == len(rows) and sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t in rows)
    known = sorted(r for r in rows if r[0] is not None and r[0] != 3)
    shas = {r.doc_id: r.edited_sha256 for r in got}
    for (doc, _, sha, _), (after, _) in zip(expected(known), known[1:]):
        if after - doc == 1:
            assert shas[doc] == sha
    assert neighbours(empty).collect() == []
    assert neighbours(odd.where("doc_id = 2")).select("near_next").first()[0] == 1


def test_running_totals_over_buckets(llm):
    rows = [(None if i % 11 == 0 else i * 37 % 101, i, i % 3 if i % 7 else None) for i in range(500)]
    df = llm.createDataFrame(rows, "k long, v long, g int").coalesce(2).cache()
    for group in ([], ["g"]):
        got = running(df, ["k", "v"], {"before": F.col("v"), "n": F.lit(1)}, group, parts=13).collect()
        key = lambda r: (r.k is not None, r.k or 0, r.v)
        state = {}
        for r in sorted(got, key=key):
            g = r.g if group else 0
            total, n = state.get(g, (0, 0))
            assert (r.before, r.n) == (total, n)
            state[g] = (total + r.v, n + 1)
        assert len(got) == 500
    assert df.select(bucket_of(df, F.col("k"), 1)).distinct().count() == 1


def test_marks_of_nothing(llm):
    df = with_marks(llm.createDataFrame([(1, None), (2, ""), (3, " \t")], "id long, t string"), {"m": "t"})
    assert [r.n for r in df.select(F.size(hashes_of(F.col("m"))).alias("n")).collect()] == [0, 0, 0]


@pytest.mark.parametrize("name", ["ArrowEval", "Python", "Pandas", "MapIn"])
def test_no_python_in_the_plan(small, name):
    plan = neighbours(small.documents)._jdf.queryExecution().executedPlan().toString()
    assert name not in plan
