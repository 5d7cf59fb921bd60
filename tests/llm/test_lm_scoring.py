"""LM scoring: exact counts and base, a proper distribution, held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skiff.llm import lm_scoring as L

SF = "/root/testdata/sf0.01"


def plain(text):
    return [*(text or "").encode().lower().split(), L.END]


def check_base(got, docs, held):
    c = Counter(w for i, t in docs if not held(i) for w in plain(t))
    n, v = sum(c.values()), len(c)
    for i, t in docs:
        r, w = got[i], plain(t)
        assert (r.n_tokens, r.n_known) == (len(w), sum(c[x] > 0 for x in w))
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    return n


def test_contract_query(spark):
    rows = L.op7_lm_scoring(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    n = check_base(got, docs, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    assert {r.train_tokens for r in rows} == {n}
    held = [r for r in rows if r.held_out]
    assert len(held) > 50
    # the unigram base gives every unknown word one share; the model spells it and is still ahead
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    for known in {*filter(None, lang.values()), None}:
        some = [r for r in held if known in (None, lang[r.doc_id])]
        assert sum(r.score for r in some) > sum(r.base_score for r in some), known


def test_words():
    kind, w = L.words_of("A É\x0b\x0cb\x1cc\xa0D \n")
    assert w == ["a".encode(), "É".encode(), b"b\x1cc\xc2\xa0d"] and 0 < kind < L.CLASSES
    assert L.words_of(None) == (0, []) and L.words_of("plain")[0] == 0


def test_codes_are_complete():
    """Each byte has a code, none is the beginning of another, and together they fill the tree."""
    codes = [format(c, f"0{n}b") for c, n in zip(L._CODE.tolist(), L._LENGTH.tolist())]
    assert sum(2.0 ** -len(c) for c in codes) == 1
    codes.sort()
    assert not any(b.startswith(a) for a, b in zip(codes, codes[1:]))


def test_bits_are_a_distribution():
    """The bits of one byte position share out all probability."""
    tokens = [b"\x00the", b"\x00of", b"\x00" + L.END]
    table = np.zeros((L.SLOTS, 2), np.float32)
    L.count_bits(tokens, np.array([5, 3, 2]), table, range(len(L.ORDERS)))
    mixer = L.Mixer.new()
    L.train_mixer(table, tokens, np.array([5, 3, 2]), mixer, 1)
    total = 0.0
    for byte in range(256):  # the first byte, by the probabilities of its code's bits
        owner, bit, slots, gate = L._events([b"\x00" + bytes([byte])])
        _, gates, z = mixer.mix(*L._gather(table, slots), gate)
        p = mixer.probability(z, gates[1])
        total += float(np.prod(np.where(bit == 1, p, 1 - p)[: L._LENGTH[byte]]))
    assert total == pytest.approx(1, abs=1e-6)
    costs = L.token_costs(table, mixer, [b"\x00the", b"\x00zzzz"])
    assert costs[0] > costs[1]


def test_training_helps_on_unseen_tokens():
    rnd = np.random.default_rng(3)
    parts = [b"the", b"re", b"on", b"in", b"st", b"al", b"ou", b"er", b"ng"]
    made = {b"\x00" + b"".join(parts[k] for k in rnd.integers(0, len(parts), rnd.integers(1, 5))) for _ in range(4000)}
    tokens = sorted(made)
    rnd.shuffle(tokens)
    tokens, held = tokens[300:], tokens[:300]
    counts = rnd.integers(1, 4, len(tokens))
    table = np.zeros((L.SLOTS, 2), np.float32)
    L.count_bits(tokens, counts, table, range(len(L.ORDERS) - 1))
    mixer = L.Mixer.new()
    before = L.token_costs(table, mixer, held).sum()
    L.train_mixer(table, tokens, counts, mixer, 1 << 62, batch=64)
    assert L.token_costs(table, mixer, held).sum() > before


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "word " * 40000), (4, "a b a"), (4, "a b a"), (None, "x \n y"), (6, "É é ÉÉ")]
    d = spark.createDataFrame([(i, t, False, 1.0) for i, t in docs], "doc_id long, text string, held_out boolean, score double").repartition(2)
    m = L.fit_language_model(d)
    for common in (L.COMMON_TOKENS, 0):  # costs held by the tasks, or all joined
        rows = L.score_documents(d, m, common=common).collect()
        assert len(rows) == len(docs)
        check_base({r.doc_id: r for r in rows}, docs, lambda i: False)
        assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert L.score_documents(d.limit(0), m).collect() == []
    nothing = L.fit_language_model(d.limit(0))
    assert nothing.train_tokens == 0
    r = L.score_documents(d.where("doc_id = 4"), nothing).collect()
    assert len(r) == 2 and all(x.n_known == 0 and math.isfinite(x.score) and x.base_score == 0 for x in r)


def test_whole_tokens_are_learnt_from_every_token():
    """Counts of whole-token contexts are those of a dictionary over all tokens, rare ones too."""
    rnd = np.random.default_rng(4)
    tokens = sorted({b"\x00same" + bytes(rnd.integers(97, 123, rnd.integers(1, 9)).astype(np.uint8)) for _ in range(60_000)})
    counts = rnd.integers(1, 4, len(tokens))
    near = L.count_whole([(tokens[:30_000], counts[:30_000]), (tokens[30_000:], counts[30_000:])], L.ORDERS)
    table = np.zeros((L.SLOTS, 2), np.float32)
    some = tokens[::977]
    owner, bit, slots, _ = L._events(some, L.ORDERS, near[1])
    n0, n1 = L._gather(table, slots, near[0])
    ends = Counter(dict(zip(tokens, counts.tolist())))
    # the last bit of a token's terminator is preceded by the whole token
    last = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True])
    seen = np.where(bit == 1, n1[-1], n0[-1])[last]
    right = [abs(s - ends[t]) < 0.5 for s, t in zip(seen, some)]
    assert min(seen) >= 1 and np.mean(right) > 0.8  # the others share a slot


def test_tables_grow_with_the_vocabulary():
    small, large = L.sized(1000), L.sized(2_000_000)
    assert small == L.ORDERS and len(small) == 6
    assert all(b >= a for (_, a), (_, b) in zip(small, large)) and L._slots_of(large) > L._slots_of(small)


def test_order_of_words_counts(spark):
    """Held-out texts score worse with their words shuffled; both ways of joining agree."""
    rnd = np.random.default_rng(7)
    names = [f"{a}{b}" for a in "bdfgklmn" for b in ("ar", "es", "il", "on", "ut")]

    def text(size):
        out = [int(rnd.integers(0, len(names)))]
        while len(out) < size:  # each word has three likely successors
            out.append((out[-1] * 7 + int(rnd.integers(0, 3))) % len(names) if rnd.random() < 0.9 else int(rnd.integers(0, len(names))))
        return [names[k] for k in out]

    rows = [(i, " ".join(text(60)), False) for i in range(200)]
    for i in range(1000, 1040):
        words = text(60)
        rows += [(i, " ".join(words), True), (i + 1000, " ".join(rnd.permutation(words).tolist()), True)]
    d = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    m = L.fit_language_model(d)
    held = d.where("held_out")
    got = {r.doc_id: r.score for r in L.score_documents(held, m).collect()}
    assert len(got) == 80 and all(got[i] > got[i + 1000] + 5 for i in range(1000, 1040))
    joined = {r.doc_id: r.score for r in L.score_documents(held, m, common=0, common_pairs=0).collect()}
    assert joined == pytest.approx(got, rel=1e-9)
    cost = {r.token: r.cost for r in m.vocabulary.collect()}
    gain = {bytes(r.token): r.cost for r in m.pairs.collect()}
    assert all(g > 0 for g in gain.values()) and all(math.isfinite(c) for c in cost.values())


def test_shared_beginnings_count_as_each_token():
    """Bits that sorted neighbours share are met once; counts and costs are those of each token alone."""
    rnd = np.random.default_rng(5)
    tokens = sorted(b"\x00" + bytes(rnd.choice(list("ab\xc3z".encode()), rnd.integers(1, 9)).astype(np.uint8)) for _ in range(300)) + [b"\x01" + L.END]
    counts = rnd.integers(1, 5, len(tokens))
    together, alone = np.zeros((2, L.SLOTS, 2), np.float32)
    L.count_bits(tokens, counts, together, range(len(L.ORDERS)))
    for t, n in zip(tokens, counts):
        L.count_bits([t], np.array([n]), alone, range(len(L.ORDERS)))
    assert np.array_equal(together, alone)
    assert len(L._events(tokens, shared=True)[0]) < 0.6 * len(L._events(tokens)[0])
    mixer = L.Mixer.new()
    costs = L.token_costs(together, mixer, tokens)
    assert costs == pytest.approx([L.token_costs(together, mixer, [t])[0] for t in tokens], rel=1e-12)


def test_pairs_travel_packed():
    """Neighbours go by bucket, not row by row, in fewer bytes than two hashes, and none is lost."""

    class Shared:
        value = [bytes([k]) for k in range(L.CLASSES)] + [b"\x00w%d" % k for k in range(200)]

    rnd = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rnd.integers(0, 220, 400)) for _ in range(100)] + [None, ""]
    want = Counter()
    for t in texts:
        words = [b"", *plain(t)]
        want.update(zip(words, words[1:]))
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    sent = list(L._pair_counter(Shared, 8)([batch, batch]))
    assert sum(b.num_rows for b in sent) <= 8
    sent.sort(key=lambda b: b.column(0)[0].as_py())
    summed = list(L._sum_pairs(sent))
    assert sum(len(x.as_py()) for b in sent for c in b.columns[1:] for x in c) < 6 * len(want)
    n = [k for b in summed for c in ("n", "m") for x in b.column(c) for k in L._unpack(x.as_py()).tolist()]
    assert sorted(n) == sorted(2 * k for k in want.values())
    for values in (np.array([], np.uint64), np.array([0, 255, 256, 1 << 63], np.uint64)):
        assert L._unpack(L._pack(values)).tolist() == values.tolist()
        assert L._unpack_sorted(L._pack_sorted(values)).tolist() == values.tolist()
    assert L._unfloats(L._floats(np.array([-0.5, 0, 3e-9]))).tolist() == [-0.5, 0, 3e-9]


def test_fit_leaves_the_model_alone_on_disk(spark):
    """Tables that only the fit needs are gone after it."""
    from skiff.session import shared_dir

    def tables():
        top = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        return {f.getPath().getName() for f in top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top)}

    before = tables()
    d = spark.createDataFrame([(k, f"a b {k} c", k == 3) for k in range(20)], "doc_id long, text string, held_out boolean")
    m = L.fit_language_model(d)
    assert sorted(n.split("-")[1] for n in tables() - before if not n.endswith(".zip")) == ["gains", "vocabulary"]
    assert L.score_documents(d, m).count() == 20


def test_compact_counts_are_exact():
    table = np.random.default_rng(8).integers(0, 200_000, (3 * L.SEGMENT, 2))
    compact = L.Counts(len(table))
    for at in range(0, len(table), L.SEGMENT):
        compact.put(at, table[at : at + L.SEGMENT])
    slots = np.arange(len(table), dtype=np.int32).reshape(3, -1)
    for a, b in zip(L._gather(compact, slots), L._gather(table.astype(np.float32), slots)):
        assert np.array_equal(a, b)
