"""SRC-6 / SRC-7: arrays scanned piece by piece against Python's json on whole documents."""

import gzip
import json
import random

import pytest

from skiff.sources import bz2_reader, json_reader
from skiff.sources.objects import list_objects


def cut(text, rnd, most):
    at = 0
    while at < len(text):
        n = rnd.randint(1, most)
        yield text[at : at + n]
        at += n


def whole(text):
    """The rule on a whole document: its elements, or None."""
    try:
        doc = json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except ValueError:
        return None
    return doc if isinstance(doc, list) else None


def scanned(pieces):
    try:
        return list(json_reader.array_elements(pieces))
    except Exception:  # noqa: BLE001
        return None


GOOD = ['[]', ' [ ]\n', '[1]', '[1, 2 ,3]', '[null,true,"a b\\n\\"c,]"]', '[\n {"a" : 1,\r\n "b": [1, 2]},\t{}\n]\n', '[12345678901234567890, 1.50, 1E5, -0]',
        '[{"a":1,"a":2}]', '["' + "x" * 300 + '"]', '["\\ud83d\\ude00 é 中"]', "[[[[]]], [ ]]", "[" + " " * 50 + "1" + " " * 50 + "]"]
BAD = ["", " ", "{}", "1", "[", "[1", "[1,", "[1,]", "[,1]", "[1 2]", "[1]]", "[1] x", "[1]{}", "[01]", "[NaN]", "[Infinity]", '["a\tb"]', '["a]', "[tru]", "[1}", "﻿[1]",
       "[{'a':1}]", '[{"a"}]', '[{"a":}]', "[-]", '["\\x"]', '["\\u12"]', "[1" + " " * 100 + "2]", "[" * 100_000]


def test_elements_of_any_pieces():
    rnd = random.Random(1)
    for text in GOOD + BAD:
        want = whole(text) if len(text) < 90_000 else None
        for most in (1, 3, 20, 10**6):
            got = scanned(cut(text, rnd, most))
            assert (got is None) == (want is None), (text[:60], most)
            if got is not None:
                assert [json.loads(g) for g in got] == want
                assert not any("\n" in g or "\r" in g for g in got)
    assert scanned(iter(['[ {"a" : 1.50, ', '"b c": [1E5 , "d  e"]} ]'])) == ['{"a":1.50,"b c":[1E5,"d  e"]}']


def test_random_documents():
    rnd = random.Random(2)

    def value(depth):
        k = rnd.randint(0, 7 if depth else 4)
        if k <= 4:
            return [None, True, rnd.randint(-(10**9), 10**9), rnd.random(), "".join(rnd.choice('ab"\\ ,]}é\n') for _ in range(rnd.randint(0, 9)))][k]
        return [value(depth - 1) for _ in range(rnd.randint(0, 3))] if k == 5 else {rnd.choice("abc"): value(depth - 1) for _ in range(rnd.randint(0, 3))}

    for _ in range(500):
        doc = [value(3) for _ in range(rnd.randint(0, 6))]
        text = json.dumps(doc, indent=rnd.choice([None, 2]), ensure_ascii=rnd.random() < 0.5)
        got = scanned(cut(text, rnd, rnd.choice([1, 7, 50])))
        assert got is not None and [json.loads(g) for g in got] == doc
        broken = text[: rnd.randrange(len(text))] + rnd.choice(["", "x", "]", ",", '"']) + text[rnd.randrange(len(text)) :]
        got, want = scanned(cut(broken, rnd, 5)), whole(broken)
        assert (got is None) == (want is None) and (got is None or [json.loads(g) for g in got] == want), broken


def test_a_large_array_is_held_in_pieces():
    """60 MB in pieces of 1 MB: no element waits for the end, nothing gathers."""
    import tracemalloc

    unit = '{"k": [1, 2, 3], "s": "' + "y" * 990 + '"},\n'
    piece = unit * 1024

    def pieces():
        yield "["
        for _ in range(60):
            yield piece
        yield "0]"

    tracemalloc.start()
    n = sum(1 for _ in json_reader.array_elements(pieces()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60 * 1024 + 1 and peak < 32 << 20


def test_files(spark, tmp_path, monkeypatch):
    docs = {
        "a.json": b'[\n {"a": 1},\n {"b": [1, 2]}\n]', "b.json.gz": gzip.compress(b'[{"x":1},') + gzip.compress(b'{"x":2}]'), "c.json": b"[]",
        "no.json": b'{"a":1}', "cut.json.gz": gzip.compress(b"[1,2,3]")[:-6], "utf.json": b'["\xff"]', "late.json": b"[" + b"1," * 3_000_000 + b"oops]", "zero.json": b"",
        "notgz.json.gz": b"[1]",
    }
    for name, data in docs.items():
        (tmp_path / name).write_bytes(data)
    raw = json_reader.read_json_arrays(list_objects(spark, str(tmp_path), bucket="b"))
    lines = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.value) for r in bz2_reader.lines_of(raw).collect())
    assert lines == [("a.json", 0, '{"a":1}'), ("a.json", 1, '{"b":[1,2]}'), ("b.json.gz", 0, '{"x":1}'), ("b.json.gz", 1, '{"x":2}')]
    man = {r.path.rsplit("/", 1)[1]: r for r in bz2_reader.manifest_of(raw).collect()}
    assert {n for n, r in man.items() if r.error is None} == {"a.json", "b.json.gz", "c.json"}
    assert all(man[n].bytes == len(d) for n, d in docs.items())
    assert {n: man[n].lines for n in man} == {**dict.fromkeys(docs, 0), "a.json": 2, "b.json.gz": 2}
    assert "not a JSON array" in man["no.json"].error and "not a JSON array" in man["zero.json"].error
