"""Periodic runs against a brute force that extends every pair of places; the query."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from skiff.llm import periodic_runs as M

SF = "/root/testdata/sf0.001"


def brute(words, least=6, times=4):
    """Every stretch in which words p apart are equal, as far as it goes; smallest period."""
    n, found = len(words), {}
    for p in range(1, n):
        i = 0
        while i + p < n:
            k = i
            while k + p < n and words[k] == words[k + p]:
                k += 1
            if k > i:
                length = k - i + p
                if length >= max(least, times * p):
                    found.setdefault((i, length), p)  # p grows: the first is the smallest
            i = max(k, i) + 1
    return sorted(((s, l_, p) for (s, l_), p in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def cases():
    rnd = random.Random(3)
    out = [None, "", " \n\t", "a", "a " * 6, "a " * 5, "\x1ca\x85b c " * 3, "a b " * 4 + "a", "x" + " y" * 3000]
    for _ in range(700):
        n, k = rnd.randint(1, 60), rnd.randint(1, 4)
        out.append(" ".join(rnd.choice("abcd"[:k]) for _ in range(n)))
    for _ in range(150):  # repetitions of repetitions, glued
        bits = []
        for _ in range(rnd.randint(1, 5)):
            unit = [rnd.choice("abc") for _ in range(rnd.randint(1, 5))] * rnd.randint(1, 7)
            bits += (unit + [rnd.choice("abcd")] * rnd.randint(0, 2)) * rnd.randint(1, 5)
        out.append(rnd.choice([" ", "\n", "  "]).join(bits))
    return out


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (9, 3)])
def test_runs_equal_brute_force(least, times, monkeypatch):
    texts = cases()
    runs, rest = M.runs_of(pa.array(texts, pa.string()), [""] * len(texts), None, least, times)
    for t, r, c in zip(texts, runs, rest.to_pylist()):
        words = split(t)
        if len(words) > 500 and times == 2:
            continue
        want = brute(words, least, times)
        assert r == want, t
        assert c == collapse(words, want)


def test_suffix_order():
    rnd = random.Random(1)
    import numpy as np

    for _ in range(200):
        s = [rnd.randint(0, 2) for _ in range(rnd.randint(1, 40))]
        order, shared = M.suffix_order(np.array(s))
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        for a, b, n in zip(order, order[1:], shared):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert n == k


def test_long_texts_take_time_in_proportion():
    texts = ["a " * 60_000, "a b c " * 20_000, " ".join(str(i % 7919) for i in range(60_000)), ("q " * 40 + "r ") * 1_000]
    runs, _ = M.runs_of(pa.array(texts), [""] * 4, None, 6, 4)
    assert runs[0] == [(0, 60_000, 1)] and runs[1] == [(0, 60_000, 3)] and runs[2] == [(0, 60_000, 7919)]
    assert len(runs[3]) == 1001 and runs[3][:3] == [(0, 40, 1), (0, 41_000, 41), (41, 40, 1)]


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE_BYTES", 100)
    rows = [(1, None, "x"), (None, "b b b b b b", "y"), (2, "", "z"), (2, "q w " * 5, "z"), (2, "q w " * 5, "z"), (3, "u " * 70_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string").repartition(2)
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in M.find_runs(df).collect())
    want = []
    for i, t, _ in rows:
        runs = brute(split(t)) if i != 3 else [(0, 70_000, 1)]
        want.append((str(i), runs, collapse(split(t), runs)))
    assert got == sorted(want)
    assert M.find_runs(df.limit(0)).collect() == []


def test_query(spark):
    got = {r.doc_id: r for r in M.op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    wrapped = 0
    for d in docs:
        words = split(d.text)
        h = zlib.crc32(str(d.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            wrapped += 1
        if n > 3000:
            continue
        runs = brute(words)
        r = got[d.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n_},{p_}\n" for s, n_, p_ in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert wrapped > 5
