import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from accesslake.llm.bitpack import Reader, Writer, pack_bits, read_documents, unpack_bits, width_for, write_ids
from accesslake.llm.packing import Packer, pack
from accesslake.llm.tokens import Encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.json"]
BYTES, WORDS = (public_tokenizers.path(n) for n in FILES[:2])
PARTS = [" ", "  ", "\n", "\n\n", "\t", "\0", "a", "The", "été", "ß", "'s", "I'll", ".", ",.", "123", "日本", "<|endoftext|>", "Σ", "İ", "é", "\x1c", "　"]


@pytest.fixture(scope="module", params=[BYTES, WORDS])
def encoder(request):
    return Encoder(request.param)


@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_words_give_the_ids_of_the_whole(encoder, text):
    assert encoder.encode([text]) == encoder._whole([text])


@pytest.mark.parametrize("path", FILES[:2])
def test_ids_do_not_depend_on_earlier_texts(path):
    used = Encoder(public_tokenizers.path(path))
    for texts in (["İ", "İ."], ["TARİ", "TARİ,"], ["the", "the."], ["é", "é!"], [".", "İ.", "İ"]):
        for text in texts:
            assert used.encode([text]) == Encoder(public_tokenizers.path(path)).encode([text]) == used._whole([text])


def ids_of(path, rows, end):
    tokenizer = Encoder(path).tokenizer
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4") for _, t in rows]


@given(st.integers(1, 32).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(0, (1 << w) - 1), max_size=70))))
@settings(max_examples=200, deadline=None)
def test_bits_round_trip(given_ids):
    width, ids = given_ids
    packed = pack_bits(np.array(ids, np.uint32), width)
    assert len(packed) == -(-len(ids) // 8) * width
    assert unpack_bits(packed, width, len(ids)).tolist() == ids


def test_widths():
    assert [width_for(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50257, n).astype(np.uint32) for n in (0, 5, 100, 3000, 1, 64)]
    writer = Writer(str(tmp_path / "x.idbits"), 17, 64)
    for i, ids in enumerate(docs):
        writer.add(None if i == 4 else i, ids)
    writer.close()
    reader = Reader(str(tmp_path / "x.idbits"))
    assert reader.docs == [0, 1, 2, 3, None, 5]
    for k in (3, 0, 5, 1, 4, 2):
        assert reader.document(k).tolist() == docs[k].tolist()
    everything = np.concatenate(docs)
    assert reader.span(60, 2000).tolist() == everything[60:2000].tolist()


def test_ids_too_wide(tmp_path):
    with pytest.raises(ValueError):
        Writer(str(tmp_path / "y"), 4, 64).add(1, np.array([16], np.uint32))


def test_files_hold_every_document(small):
    rows = sorted((r.doc_id, r.text) for r in small.documents.select("doc_id", "text").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_documents(write_ids(small.documents, BYTES, 0)).collect()}
    at = 0
    for (doc, _), ids in zip(rows, ids_of(BYTES, rows, 0)):
        assert got[doc] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_odd_rows_in_files(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(read_documents(write_ids(odd, BYTES, 0, block_ids=64, files=3), window_ids=1000).collect(), key=lambda r: r.start)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(i), zlib.crc32(i.tobytes())) for (d, _), i in zip(rows, ids_of(BYTES, rows, 0)))
    known = [r.doc_id for r in got]
    assert known[:2] == [None, None] and known[2:] == sorted(known[2:])
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert read_documents(write_ids(empty, BYTES, 0)).collect() == []


def check_pieces(rows, pieces, capacity):
    by_sequence, whole = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        whole[p.doc_id].append(p)
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
        assert 0 < sum(p.length for p in parts) <= capacity
    expected = defaultdict(int)
    for (doc, _), ids in zip(rows, ids_of(WORDS, rows, 2)):
        expected[doc] += len(ids)
    assert {d: sum(p.length for p in ps) for d, ps in whole.items()} == dict(expected)
    return by_sequence, whole


def test_packing_holds_every_id_once(small):
    rows = [(r.doc_id, r.text) for r in small.documents.collect()]
    _, whole = check_pieces(rows, pieces := pack(small.documents, WORDS, 2).collect(), 4096)
    for (doc, _), ids in zip(rows, ids_of(WORDS, rows, 2)):
        at = 0
        for p in sorted(whole[doc], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
    sequences = len({p.sequence_id for p in pieces})
    assert sum(p.length for p in pieces) > 4096 * (sequences - 8)


def test_packing_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_pieces(rows, pack(odd, WORDS, 2, capacity=64).collect(), 64)
    assert pack(empty, WORDS, 2).collect() == []


def test_level_that_makes_the_squares_least():
    packer = Packer(10)

    def best(size):
        options = {}
        for h in [0, *(h for h in range(1, 11 - size) if packer.level[h])]:
            after = packer.level.copy()
            if h:
                after[h] -= 1
            after[h + size] += 1
            options[h] = int((after[1:10] ** 2).sum())
        least = min(options.values())
        return max(h for h, v in options.items() if v == least)

    rng = np.random.default_rng(3)
    for size in rng.integers(1, 10, 400).tolist():
        assert packer.place(size) == best(size)
        packer.add((0, 0, np.zeros(size, np.uint32), size), size)
