"""Language ID and quality: held-out accuracy, folds, edge rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skiff.llm import language_id as L
from skiff.llm import quality_classifier as Q

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    rows = {r.doc_id: r for r in L.op4_language_id(spark, SF).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(rows) == set(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out]
    assert np.mean([rows[i].lang_pred == docs[i].lang for i in held]) > 0.97


def test_language_edges(spark):
    rows = [("the and of the house " * 5, "en"), ("der und die das haus " * 5, "de")] * 40
    m = L.fit_language_model(rows)
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "der und die", "x"), (4, "der und die", "x"), (5, "the of " * 50000, "x")], "doc_id long, text string, lang_pred string")
    got = sorted((r.doc_id, r.lang_pred, r.lang_accepted) for r in L.identify_language(d, m).collect())
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "de", True), (4, "de", True), (5, "en", True)]
    assert L.identify_language(d.limit(0), m).collect() == []
    none = L.fit_language_model([])
    assert none.predict("some text") == ("und", 0.0)
    unlabelled = spark.createDataFrame([(1, "a", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert L.labelled_sample(unlabelled) == []
    one = L.fit_language_model([("only this", "en")])
    assert one.predict("this")[0] == "en"


def plain_language(model, text):
    """(language, score) by a dictionary of counts, Python numbers and a soft-max."""
    if not model.langs or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    spaced = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower())
    raw = (" " + spaced + " ").encode("utf-8", "replace")
    counts = Counter()
    for at in range(len(raw) - 2):
        three = raw[at : at + 3]
        if three[1] != 32:
            counts[int.from_bytes(three, "little") * 0x9E3779B1 % 2**32 >> 32 - L.BITS] += 1
        four = raw[at : at + 4]
        if len(four) == 4 and 32 not in four[1:3]:
            counts[(int.from_bytes(four, "little") ^ 0x5BD1E995) * 0x9E3779B1 % 2**32 >> 32 - L.BITS] += 1
    total = sum(counts.values())
    z = [float(b) + (sum(n * float(model.table[s][k]) for s, n in counts.items()) / total if total else 0.0) for k, b in enumerate(model.bias)]
    e = [math.exp((x - max(z)) / model.temperature) for x in z]
    best = max(range(len(z)), key=lambda k: (e[k], -k))
    return model.langs[best], e[best] / sum(e)


def test_language_against_plain_arithmetic(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = L.fit_language_model(L.labelled_sample(docs.where("crc32(cast(string(doc_id) as binary)) % 4 <> 2")))
    rows = L.identify_language(docs.where("length(text) < 3000 or text is null"), m).collect()
    assert len(rows) > 500
    for r in rows:
        lang, score = plain_language(m, r.text)
        assert r.lang_pred == lang and r.lang_score == pytest.approx(score, abs=1e-4)


def test_language_ties():
    """Equally probable languages: the alphabetically first."""
    m = L.LanguageModel(["aa", "bb", "cc"], np.zeros((1 << L.BITS, 3), np.float32), np.array([0.0, 1.0, 1.0]), 1.0, 0.0)
    assert m.predict("word")[0] == "bb" == plain_language(m, "word")[0]


def plain_quality(model, text):
    """The score by a dictionary of counts and a plain dot product."""
    a, b, c, full = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 2**64
    words = re.findall(r"\w+|[^\w\s]+", text or "")
    h = [zlib.crc32(w.encode("utf-8", "replace")) for w in words]
    counts, seen = Counter(), set()
    for k, x in enumerate(h):
        counts[x * a % full >> 64 - Q.BITS] += 1
        if k:
            counts[(b if x == h[k - 1] else (x * b % full ^ h[k - 1] * c % full) * a % full) >> 64 - Q.BITS] += 1
        if k > 1:
            counts[c >> 64 - Q.BITS] += (h[k - 2], h[k - 1], x) in seen
            seen.add((h[k - 2], h[k - 1], x))
    n = sum(counts.values())
    z = model.bias + (sum(k * float(model.weights[s]) for s, k in counts.items()) / math.sqrt(n) if n else 0.0)
    return 1 / (1 + math.exp(-max(-60, min(60, z))))


def test_quality_against_a_plain_dot_product(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = Q.fit_ftrl(Q.labelled_sample(docs, labels))
    rows = Q.score_quality(docs, m).collect()
    assert len(rows) == docs.count()
    assert all(r.quality_score == pytest.approx(plain_quality(m, r.text), abs=1e-4) for r in rows)


def test_sample_bounds(spark):
    d = spark.createDataFrame([(i, "abc " * 10, "en") for i in range(100)] + [(None, "abc", "en")] * 5, "doc_id long, text string, lang string")
    assert len(L.labelled_sample(d, max_rows=10)) <= 10
    assert sum(len(t) for t, _ in L.labelled_sample(d, max_chars=200)) <= 200


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in Q.op8_quality_classifier(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == docs
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out and i in labels]
    assert np.mean([rows[i].predicted == labels[i] for i in held]) > 0.9
    clean = [i for i in held if labels[i] == 1]
    assert np.mean([rows[i].predicted for i in clean]) > 0.97


def test_quality_edges(spark):
    m = Q.fit_ftrl([("good words in a line", 1), ("bad### bad### bad###", 0)] * 30)
    d = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (3, "bad### x###", 3.0), (3, "bad### x###", 3.0), (4, "good words " * 50000, 4.0)], "doc_id long, text string, quality_score double")
    got = sorted((r.doc_id, r.quality_score) for r in Q.score_quality(d, m).collect())
    assert got[0][1] == got[1][1] and got[2][1] == got[3][1] < 0.3 and got[4][1] > 0.5
    assert Q.score_quality(d.limit(0), m).collect() == []
    assert Q.fit_ftrl([]).score("x") == 0.5


def test_quality_sample(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "c"), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    assert sorted(Q.labelled_sample(docs, labels)) == [("a", 0), ("b", 0)]
    assert Q.labelled_sample(docs, labels.limit(0)) == []


def test_features_mark_repetition():
    assert len(Q.features("")) == 0
    a, b = Q.features("one one one one"), Q.features("two two two two")
    assert len(set(a) & set(b)) >= 2
