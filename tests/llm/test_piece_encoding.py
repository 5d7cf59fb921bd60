"""Piece encoding and decoding: equal to the library on odd texts, edge rows, the query."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from skiff.llm import piece_encoding as M

SF = "/root/testdata/sf0.001"
_BITS = [*"ab cde  \t\n▁éß中文字👍🏽‍\x00'.,☃ñ́", "<0x41>", "</s>", "the ", "ing", "  ", "▁▁", "한국어", "\U0001F468", " the", "qu", "ation"]


@pytest.fixture(scope="module")
def model():
    return open(public_tokenizers.path(M.MODEL), "rb").read()


@pytest.fixture(scope="module")
def lib(model):
    return SentencePieceProcessor(model_proto=model)


def texts(n, seed):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(_BITS) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return out + ["", " ", "  ", "▁", " a", "a ", "\n", "a" * 500, "ab" * 3000, " " * 77, "中" * 200 + "☃" * 50]


def test_encoding_equals_the_library(model, lib):
    cases = texts(3000, 1)
    codec = M.PieceCodec(model)
    for t, ids, back, (mine, text) in zip(cases, lib.encode(cases), lib.decode(lib.encode(cases)), codec.encode_texts(cases, check=True)):
        assert np.frombuffer(mine, "<i4").tolist() == ids, repr(t)
        assert text == back and codec.decode(ids) == back
        # the heap alone, over the whole text, gives the same
        assert not t or codec.merge(" " + t.replace("▁", " ")) == ids
    assert not codec.differ and codec.agrees(["a b"], [b""], [""]) == [True]


def test_decoding_of_any_ids(model, lib):
    rnd = random.Random(4)
    codec = M.PieceCodec(model)
    cases = [[rnd.randrange(32000) if rnd.random() < 0.5 else rnd.randrange(259) for _ in range(rnd.randint(0, 20))] for _ in range(3000)]
    for ids, back in zip(cases, lib.decode(cases)):
        assert codec.decode(ids) == back, ids


def test_memory_of_words_changes_nothing(model, lib, monkeypatch):
    monkeypatch.setattr(M, "CACHED_WORDS", 50)
    monkeypatch.setattr(M, "ROWS", 7)
    codec = M.PieceCodec(model)
    cases = texts(300, 2)
    got = [codec.encode_texts([t])[0] for t in cases + cases]
    assert [np.frombuffer(g[0], "<i4").tolist() for g in got] == lib.encode(cases + cases)
    assert len(codec._words) < 50 + 100


def test_a_difference_shows(model):
    codec = M.PieceCodec(model)
    codec.place = {}
    codec._places = np.full_like(codec._places, M._NONE)  # nothing merges
    got = codec.encode_texts(["the house", "x"], check=True)
    ids = [i + np.array([2], "<i4").tobytes() for i, _ in got]
    assert codec.differ and codec.agrees(["the house", "x"], ids, [s for _, s in got])[0] is False


def test_edge_rows_and_clashing_columns(spark, lib):
    rows = [(1, None, "x"), (None, "", "y"), (2, "same text", "z"), (2, "same text", "z"), (3, "word " * 60_000, "w"), (4, "q" * 5_000, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), r.decoded, r.agrees) for r in M.encode_documents(df).collect())
    want = sorted((i is None, i or 0, lib.encode(t or "", add_eos=True), t or "", True) for i, t, _ in rows)
    assert got == want
    assert M.encode_documents(df.limit(0)).collect() == []
    assert {r.agrees for r in M.encode_documents(df, check=False).collect()} == {None}


def test_query(spark, lib):
    got = {r.doc_id: r for r in M.op11_piece_encoding(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode(d.text or "", add_eos=True)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.agrees
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
