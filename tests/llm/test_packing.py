"""Packing: round trip against direct encoding, gapless windows, padding, edge rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skiff.llm import packing as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    t.encode_special_tokens = True
    return t


def brute_fill(lengths, cap):
    """Largest subset sum <= cap that includes the largest length."""
    rest = sorted(lengths)
    sums = {rest.pop()}
    for n in rest:
        sums |= {s + n for s in sums if s + n <= cap}
    return max(sums)


def test_best_fill_is_optimal():
    rnd = random.Random(5)
    for _ in range(300):
        lengths = [rnd.randint(1, 40) for _ in range(rnd.randint(1, 14))]
        counts = {n: lengths.count(n) for n in lengths}
        used = P.best_fill(sorted(counts), counts, 40)
        assert all(used[n] <= counts[n] for n in used)
        assert sum(n * m for n, m in used.items()) == brute_fill(lengths, 40)


def test_word_encoder_equals_direct_encoding(tok):
    texts = [
        "Hello, world!! it's we'll 'tis O'Neil's ... a.b,c __x__ 3.14 1,000 x",
        "Été ÉTÉ ñandú Straße ÜBER İstanbul ΣΑΣ ﬁn éte ́ a ́b",
        "<|endoftext|> a<|startoftext|>b \x1c\x1d\t\r\x0b x y​z 中文字 한국어 👍🏽 ###*** don't. 'S",
        "",
        " \n \n",
    ]
    enc = P.WordEncoder(open(public_tokenizers.path(P.TOKENIZER), encoding="utf-8").read())
    rnd = random.Random(3)
    alphabet = list("abcZÉéß'.,!#0٣́ \n\t ẞ-_") + ["'s", "'ll", "sΣ"]
    texts += ["".join(rnd.choice(alphabet) for _ in range(40)) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def check(rows, docs, tok, capacity=4096):
    """docs: (id, text) in any order, ids unique."""
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs}
    got, seqs = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.length, bytes(r.ids)))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id])
    assert set(got) == set(ids)
    for i, pieces in got.items():
        at, data = 0, b""
        for start, n, raw in sorted(pieces):
            assert start == at and len(raw) == 4 * n and n > 0
            at += n
            data += raw
        assert np.frombuffer(data, "<u4").tolist() == ids[i]
    padding = 0
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_round_trip_and_padding(spark, tok):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = P.pack_documents(d).collect()
    assert check(rows, [tuple(r) for r in d.collect()], tok) == 0


def test_small_capacity_and_blocks(spark, tok, monkeypatch):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice("ab cd the of x1 yes".split()) for _ in range(rnd.randint(0, 90)))) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert check(P.pack_documents(d, capacity=64).collect(), docs, tok, 64) == 0


def test_edge_rows(spark, tok):
    docs = [(1, None), (2, ""), (3, "word " * 30000), (4, "A a"), (5, "A a")]
    d = spark.createDataFrame([(i, t, 7, b"x") for i, t in docs], "doc_id long, text string, start int, ids binary")
    assert check(P.pack_documents(d).collect(), docs, tok) == 0
    assert P.pack_documents(d.limit(0)).collect() == []
    twice = P.pack_documents(spark.createDataFrame([(None, "same")] * 3, "doc_id long, text string")).collect()
    assert [r.doc_id for r in twice] == [None] * 3 and {r.doc_tokens for r in twice} == {2}


def test_query_digest(spark):
    q = P.op2_packing(spark, SF)
    raw = {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in P.pack_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in q.collect()} == raw
