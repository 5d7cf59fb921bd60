"""Jaccard classes against all pairs, blocks, banding and components."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skiff.llm import jaccard_join as J
from skiff.llm.components import connected_components


def shingles(text, size=5):
    """Runs of words as tuples, by a pattern: nothing of the module's own."""
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(size, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def brute(rows, similarity=0.8):
    """rows: (id, text) with distinct ids; class_id, n_links, n_copies by id."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, copies = dict.fromkeys(ids, 0), dict.fromkeys(ids, 0)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= similarity * len(x | y) - 1e-9:
                for i in (a, b):
                    links[i] += 1
                    copies[i] += x == y
                r, s = root(a), root(b)
                parent[max(r, s)] = min(r, s)
    return {i: (root(i), links[i], copies[i]) for i in ids}


def family(rnd, n, words=60, edits=2):
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.randint(0, edits)):
            t[rnd.randrange(words)] = f"e{rnd.randint(0, 10**6)}"
        out.append(" ".join(t))
    return out


def classes(spark, rows, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, set_key string").repartition(3)
    return J.jaccard_classes(d, **kw).collect()


def test_banding_reaches_the_recall():
    for s, recall in ((0.8, 0.9995), (0.5, 0.95), (0.95, 0.999)):
        bands, rows = J.banding(s, recall, 128)
        assert bands * rows <= 128 and 1 - (1 - s**rows) ** bands >= recall
    assert J.banding(1.0, 0.9, 16)[0] == 1


def test_ngrams():
    assert len(J.ngrams("A b, c")) == 1 and len(J.ngrams(" !")) == 0 and len(J.ngrams(None)) == 0
    assert (J.ngrams("One two THREE four five six") == J.ngrams("one-two three four,five six")).all()
    assert len(J.ngrams("a b c d e f")) == 2


@pytest.mark.parametrize("block", [512, 7])
def test_equals_all_pairs(spark, block):
    rnd = random.Random(8)
    texts = []
    for n in (1, 2, 3, 40, 25):
        texts += family(rnd, n)
    texts += [texts[10]] * 6 + [texts[0].upper() + "!"] + ["tiny text"] * 3 + [" ".join(f"u{rnd.random()}" for _ in range(20)) for _ in range(20)]
    texts += [None, None, "", "!!", "!!"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in classes(spark, rows, block=block)}
    assert got == brute(rows)


def test_large_group_is_exact(spark):
    rnd = random.Random(9)
    rows = list(enumerate(family(rnd, 300, words=80, edits=4)))
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in classes(spark, rows, block=64)}
    want = brute(rows)
    wrong = [i for i in want if want[i] != got[i]]
    # the recall bounds how many pairs near the threshold may be missed
    lost = sum(want[i][1] - got[i][1] for i in want)
    assert 0 <= lost <= 0.002 * sum(w[1] for w in want.values()), (len(wrong), lost)
    assert [i for i in want if want[i][0] != got[i][0]] == []


@pytest.mark.parametrize("bounds", [{"most_blocks": 1}, {"most_blocks": 3}, {"most_blocks": 1, "block_bytes": 20_000}])
def test_blocks_of_many_tiles(spark, bounds):
    """Blocks larger than a tile, and blocks split by their bytes, lose and double no pair."""
    rnd = random.Random(12)
    texts = family(rnd, 90, edits=1) + [" ".join(f"v{rnd.random()}" for _ in range(30)) for _ in range(15)]
    rows = list(enumerate(texts + texts[:9]))
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in classes(spark, rows, block=16, **bounds)}
    assert got == brute(rows)


def test_blocks_follow_bytes_not_members(spark):
    """A bucket's texts are copied once a block: under ten times at 100,000 near copies of
    600 bytes, and a block never outgrows its bytes by more than rounding."""
    cases = [(2, 600), (512, 600), (513, 600), (4000, 600), (100_000, 600), (1_000_000, 600), (300, 2_000_000)]
    d = spark.createDataFrame([(n, n * (size + J.MEMBER_BYTES)) for n, size in cases], "n long, weight long")
    got = {r.n: (r.blocks, r.weight) for r in d.select("n", "weight", J.blocks_of(F.col("n"), F.col("weight")).alias("blocks")).collect()}
    assert [got[n][0] for n in (2, 512, 513, 4000)] == [1, 1, 2, 8]
    assert got[100_000][0] < 10 and got[1_000_000][0] < 100
    assert all(weight / blocks <= J.BLOCK_BYTES for blocks, weight in got.values())


def test_overlaps_both_ways():
    rnd = np.random.default_rng(1)
    a = [np.unique(rnd.integers(0, 60, 30).astype(np.uint64)) for _ in range(9)]
    b = [np.unique(rnd.integers(0, 60, 30).astype(np.uint64)) for _ in range(5)]
    full = np.array([[len(np.intersect1d(x, y)) for y in b] for x in a])
    assert (J._overlaps(a, b, np.ones((9, 5), bool)) == full).all()
    one = np.zeros((9, 5), bool)
    one[3, 2] = True
    assert J._overlaps(a, b, one)[3, 2] == full[3, 2]
    same = np.array([[len(np.intersect1d(x, y)) for y in a] for x in a])
    assert (J._overlaps(a, a, np.ones((9, 9), bool)) == same).all()


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None)]
    got = classes(spark, rows)
    assert len(got) == 5
    assert sorted((r.class_id, r.n_links) for r in got if r.class_key) == [(5, 3)] * 4
    assert [(r.class_id, r.n_links) for r in got if r.class_key is None] == [(None, 0)]
    assert classes(spark, []) == []


def test_components(spark):
    chain = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(40)] + [("z1", "z2"), ("z3", "z2")]
    rnd = random.Random(1)
    rnd.shuffle(chain)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert all(got[f"n{k:03d}"] == "n000" for k in range(41)) and {got["z1"], got["z2"], got["z3"]} == {"z1"}
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []
