"""Decontamination against a plain Python version, and its broadcast-free way."""

import hashlib
import random
import re

from skiff.llm import decontamination as D

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, bench):
    wins = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = []
    for i, t in docs:
        w = words(t)
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    items |= {x for x in wins[g] if x is not None}
        out.append((i, len(w), sorted(hit), sorted(items)))
    return sorted(out, key=str)


def run(spark, docs, bench):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, items int").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = [(r.doc_id, r.n_words, list(r.hit_words), list(r["items"])) for r in D.find_contamination(d, b).collect()]
    return sorted(got, key=str)


def cases():
    rnd = random.Random(2)
    vocab = ["alpha", "beta", "gamma", "é", "the", "of", "x1", "zeta", "THE"]
    bench = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 25)))) for k in range(12)]
    bench += [(50, None), (51, ""), (52, "!?"), (53, "Short One"), (54, "short, one"), (None, "no id item here"), (55, "É x" * 5)]
    docs = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for k in range(60)]
    for k in range(60, 90):
        words_ = bench[k % 12][1].split()
        docs.append((k, " ".join([rnd.choice(vocab)] * 3 + words_ + ["end"] * 2)))
    docs += [(90, None), (91, ""), (92, "short-ONE"), (92, "short-ONE"), (None, "a short one b"), (93, "no id item here"), (94, "éx éx éx éx É x"), (95, "w " * 30000 + bench[0][1])]
    return docs, bench


def test_equals_brute_force(spark):
    docs, bench = cases()
    assert run(spark, docs, bench) == brute(docs, bench)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs, bench = cases()
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert run(spark, docs, bench) == brute(docs, bench)


def test_empty_tables(spark):
    docs, bench = cases()
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], bench) == []


def test_query_columns(spark):
    rows = D.op3_decontamination(spark, "/root/testdata/sf0.001").collect()
    none = hashlib.sha256(b"").hexdigest()
    assert all((r.n_items == 0) == (r.items_sha256 == none) and r.contaminated == (r.n_hit > 0) for r in rows)
    assert any(r.contaminated for r in rows)
