"""Heap-bounded clustering against plain Lloyd rounds in Python integers; edge rows; ties."""

import hashlib
import math
import random

import pytest

from skiff.llm import centroids as M


def lloyd(rows, k, rounds, seed, scale=64):
    """rows: (id, components).  Plain rounds over Python integers."""
    dims = 4
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in first]

    def assign():
        out = []
        for _i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = assign()
        for c in range(len(cents)):
            mine = [v for (_, v), (a, _) in zip(kept, got) if a == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, c, d) for (i, _), (c, d) in zip(kept, assign())], cents


def run(spark, rows, k, rounds, parts=3, **kw):
    df = spark.createDataFrame([(i, v, "clash", 7) for i, v in rows], "vec_id bigint, embedding array<double>, cluster string, ids int").repartition(parts)
    out, cents, compared = M.cluster_vectors(df, k=k, rounds=rounds, dims=4, **kw)
    return sorted(map(tuple, out.collect()), key=str), cents, compared


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_rounds(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    # a coarse grid, so that distances tie; copies; a third of all rows one vector
    rows = [(n, [rnd.randint(-3, 3) / 16 + rnd.choice([0, 3, -4]) for _ in range(4)]) for n in range(400)]
    rows += [(1000 + n, [0.5, 0.5, 0.5, 0.5]) for n in range(200)] + rows[:50]
    monkeypatch.setattr(M, "BLOCK", 64)
    got, cents, compared = run(spark, rows, 9, 6, seed=seed)
    want, want_cents = lloyd(rows, 9, 6, seed)
    assert got == sorted(want, key=str) and cents == want_cents
    assert len(compared) == 7 and compared[0] == len(rows)


def test_settled_vectors_are_not_compared_again(spark):
    rnd = random.Random(5)
    rows = [(n, [rnd.gauss(0, 0.1) + 10 * (n % 4 == j) for j in range(4)]) for n in range(2000)]
    got, cents, compared = run(spark, rows, 4, 8)
    want, want_cents = lloyd(rows, 4, 8, 1)
    assert got == sorted(want, key=str) and cents == want_cents
    assert sum(compared[1:]) < 0.7 * 8 * len(rows) and compared[-1] == 0


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 3.0, None]), (5, [nan, 0.0, 0.0, 0.0]), (6, [inf, 0.0, 0.0, 0.0]),
            (7, [1.0, 0.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0, 0.0]), (None, [9.0, 9.0, 9.0, -9.01])]
    got, cents, _ = run(spark, rows, 16, 3)
    want, want_cents = lloyd(rows, 16, 3, 1)
    assert got == sorted(want, key=str) and cents == want_cents and len(cents) == 3
    assert run(spark, [(1, [0.1] * 4)], 2, 3)[0] == [(1, 0, 0)]
    assert run(spark, rows[:6], 16, 3)[0] == [] and run(spark, rows[-1:], 16, 3)[0] == []
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e30, 0.0, 0.0, 0.0])], 2, 1)


def test_large_components(spark):
    rnd = random.Random(8)
    rows = [(n, [rnd.uniform(-2e6, 2e6) for _ in range(4)]) for n in range(60)]
    got, cents, _ = run(spark, rows, 5, 3)
    want, want_cents = lloyd(rows, 5, 3, 1)
    assert got == sorted(want, key=str) and cents == want_cents
