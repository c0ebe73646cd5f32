"""The pipeline on planted cases, and stage by stage."""

import random
import shutil

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from accesslake.llm import minhash, mixing, simhash, toxicity
from accesslake.llm.common import ROWS, slices, written
from accesslake.llm.packing import pack


@pytest.fixture(scope="module")
def planted(llm, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = {lang: [f"{lang}{''.join(rng.choice('aeioulmnrst') for _ in range(5))}" for _ in range(900)] for lang in ("en", "fr", "de", "es")}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    passage = text("en", 60)
    rows, labels = [], []
    for i in range(600):
        lang = ["en", "en", "en", "fr", "de", "es"][i % 6]
        words = text(lang, 80 + i % 50)
        if i % 10 == 9:
            words += " grobian schurke"
        if i % 100 == 50:
            words = text(lang, 30) + " " + passage + " " + text(lang, 40)
        rows.append((i, words, lang, "s"))
        labels.append((i, 1, int(i % 10 == 9)))
    rows += [(1000 + i, rows[i][1], rows[i][2], "copy") for i in (1, 2, 3)]
    near = rows[4][1].split()
    near[40] = "changed"
    rows.append((1004, " ".join(near), rows[4][2], "near"))
    rows += [(2000, None, "en", "s"), (2001, "", None, None)]
    folder = str(tmp_path_factory.mktemp("planted"))
    llm.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    llm.createDataFrame([(i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, passage


def test_stages(llm, planted):
    folder, rows, passage = planted
    docs = llm.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(llm, docs, folder), name)
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    ids = {n: [r.doc_id for r in seen[n].select("doc_id").collect()] for n in seen if n != "packing"}
    toxic = {i for i in range(600) if i % 10 == 9}
    assert set(ids["toxicity"]) == {r[0] for r in rows} - toxic
    assert set(ids["near_copies"]) == set(ids["toxicity"]) - {1001, 1002, 1003, 1004, 2001} or set(ids["near_copies"]) == set(ids["toxicity"]) - {1001, 1002, 1003, 1004, 2000, 2001}
    texts = {r.doc_id: r.text for r in seen["repeats"].collect()}
    assert all(passage[20:-20] not in (t or "") for t in texts.values())
    original = {r[0]: r[1] for r in rows}
    assert all(texts[i] == original[i] for i in texts if i % 100 != 50)
    assert set(ids["mixing"]) == set(ids["repeats"])
    counts = {r.lang: r.n for r in seen["mixing"].groupBy("lang").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    total = sum(v for k, v in counts.items() if k)
    for lang, share in corpus_pipeline.TARGETS.items():
        assert counts[lang] / total == pytest.approx(share, abs=0.04)
    pieces = seen["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in pieces) <= 4096
    assert set(r.doc_id for r in seen["packing"].select("doc_id").collect()) == set(ids["mixing"])


def test_run_is_the_stages_in_turn(llm):
    got = corpus_pipeline.run(llm, "/root/testdata/sf0.001")
    assert got.columns[0] == "doc_id" and got.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "mixing", "packing"]
    assert np.all([callable(f) for _, f in corpus_pipeline.STAGES])


def test_slices_hold_every_row_once():
    batches = [pa.record_batch({"x": pa.array(range(low, high))}) for low, high in ((0, 600), (600, 600), (600, 601), (601, 857))]
    parts = list(slices(batches))
    assert [x for part in parts for x in part.column(0).to_pylist()] == list(range(857)) and max(part.num_rows for part in parts) <= ROWS


def test_workers_take_few_texts_at_once(llm, monkeypatch):
    """Arrow hands a worker ten thousand texts; they, their words and their sets are Python objects slice by slice."""
    big = pa.record_batch({"doc_id": pa.array(range(1000)), "text": pa.array([f"one two three four five {i % 7}" if i % 9 else None for i in range(1000)]), "lang": pa.array(["en"] * 1000)})
    docs, runs = llm.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string"), []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *rest: runs.append(run) or real(self, run, *rest))
    model = mixing.Domains(["en"], np.zeros(1), np.zeros((1, mixing.BUCKETS)))
    minhash.sketches(docs.select("doc_id", "text"), 5, 3, 4)
    simhash.sketches(docs, 5, 4, 4)
    toxicity.keep_clean(docs, toxicity.Model(-1.0))
    mixing.memberships(docs, model)
    mixing.resample(docs, model, mixing.Rates(1.0, [], [1.0], [1.0]))
    assert len(runs) == 5
    for run in runs:
        out = list(run(iter([big])))
        assert sum(x.num_rows for x in out) == 1000 and max(x.num_rows for x in out) <= ROWS


def test_workers_keep_no_words_after_packing(llm, tmp_path):
    path = shutil.copy(public_tokenizers.path("word_bpe_49k.json"), tmp_path / "words.json")
    docs = llm.createDataFrame([(i, f"the word{i} and word{i + 1}") for i in range(64)], "doc_id long, text string")
    assert pack(docs, str(path), end_id=2).count() == 64

    def held(batches):
        from accesslake.llm.tokens import _ENCODERS

        for _ in batches:
            own = _ENCODERS.get(str(path))
            yield pa.record_batch({"encoders": pa.array([int(own is not None)]), "words": pa.array([len(own.cache) + len(own.cores) if own else 0])})

    found = llm.range(0, 64, 1, 16).mapInArrow(held, "encoders long, words long").collect()
    assert sum(r["encoders"] for r in found) and not sum(r["words"] for r in found)
