"""Span dedup against a plain Python version."""

import random

from skiff.llm import span_dedup as S


def brute(rows):
    """rows: (id, text) with distinct ids (None last); remaining text, sentences and removed
    sentences by id.  Runs are compared as lists of words, without a hash."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        spans = S.sentences(t or "")
        words = [t[a:b].split() for a, b in spans]
        marked = [False] * len(spans)
        for k in range(len(spans) - 2):
            end = k + 3
            while sum(map(len, words[k:end])) < 10 and end < len(spans):
                end += 1
            if sum(map(len, words[k:end])) < 10:
                continue
            run = tuple(" ".join(w) for w in words[k:end])
            if run in seen:
                for x in range(k, end):
                    marked[x] = True
            seen.add(run)
        gone, k = set(), 0
        while k < len(spans):
            end = k
            while end < len(spans) and marked[end]:
                end += 1
            if sum(map(len, words[k:end])) >= S.SPAN_WORDS:
                gone |= set(range(k, end))
            k = max(end, k + 1)
        kept = None if t is None else "".join(t[a:b] for k, (a, b) in enumerate(spans) if k not in gone)
        out[i] = (kept, len(spans), len(gone))
    return out


def sentence(rnd):
    return " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(3, 9))).capitalize() + rnd.choice([". ", ".\n", "! ", "? "])


def run(spark, rows):
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n_removed int, id string").repartition(3)
    return S.remove_repeated_spans(d).collect()


def test_sentences_cover_the_text():
    rnd = random.Random(1)
    for t in ["", "one", "a. b", "x" * 50, " \n ", "word " * 100, "A.  B!\n\nC?\" D… e"] + ["".join(rnd.choice(" ab.\n!?") for _ in range(80)) for _ in range(200)]:
        spans = S.sentences(t)
        assert "".join(t[a:b] for a, b in spans) == t and all(a < b for a, b in spans)
        assert all(len(t[a:b].split()) <= S.SENTENCE_WORDS for a, b in spans)


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    passages = ["".join(sentence(rnd) for _ in range(rnd.randint(8, 14))) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [sentence(rnd) for _ in range(rnd.randint(0, 12))]
        if i % 3 == 0:
            parts.insert(rnd.randint(0, len(parts)), "\n" + rnd.choice(passages).strip() + "\n")
        rows.append((i, "".join(parts)))
    rows += [(60, rows[5][1]), (61, None), (62, ""), (63, passages[0] + passages[0]), (None, passages[1]), (64, "long word " * 20000)]
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in run(spark, rows)}
    assert got == brute(rows)


def test_passages_of_fifty_words_go(spark):
    rnd = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(55)) + "."  # one sentence
    rows = [(i, f"{sentence(rnd)}\n{passage}\n{sentence(rnd)}") for i in range(5)]
    got = {r.doc_id: r.text for r in run(spark, rows)}
    assert passage in got[0] and all("p20 p21" not in got[i] for i in range(1, 5))
    assert all(rows[i][1].split("\n")[0] in got[i] for i in range(5))


def test_repeated_rows_columns_and_empty(spark):
    rnd = random.Random(6)
    t = "".join(sentence(rnd) for _ in range(6))
    got = run(spark, [(1, t), (1, t), (2, t)])
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 6)]
    assert got[0].id == "z" and [c for c in got[0].asDict()] == ["doc_id", "text", "id", "n_sentences", "n_removed", "n_removed_words"]
    assert run(spark, []) == []


def test_passages_are_met_at_every_offset():
    """51 words glued into other sentences share a run with any other copy of them."""
    rnd = random.Random(8)
    for form in range(12):
        words = [f"p{rnd.randint(0, 10**6)}" for _ in range(51)]
        every = (0, 0, 3, 5, 9, 14)[form % 6]  # a sentence's words; 0: no punctuation
        passage = " ".join(w + "." if every and k % every == every - 1 else w for k, w in enumerate(words))
        copies = []
        for offset in range(40):
            ahead, behind = (" ".join(f"x{rnd.randint(0, 10**6)}" for _ in range(n)) for n in (offset, rnd.randint(0, 30)))
            copies.append({h for h in S.run_hashes(f"{ahead} {passage} {behind}") if h is not None})
        shared = [a & b for k, a in enumerate(copies) for b in copies[:k]]
        assert all(shared)
        other = {h for h in S.run_hashes(" ".join(f"y{rnd.randint(0, 10**6)}" for _ in range(300))) if h is not None}
        assert not other & set().union(*copies)


def test_passages_in_mid_sentence_go(spark):
    rnd = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    fill = [" ".join(f"f{rnd.randint(0, 10**6)}" for _ in range(k)) for k in range(1, 18)]
    got = {r.doc_id: r.text for r in run(spark, [(i, f"{f} {passage} {f[::-1]}") for i, f in enumerate(fill)])}
    assert passage in got[0] and all("p29 p30" not in got[i] for i in range(1, 17))
    assert all(f in got[i] and f[::-1] in got[i] for i, f in enumerate(fill))


def test_text_without_spaces(spark):
    """Copies of a passage without spaces are found at any place; others stay."""
    rnd = random.Random(11)
    letters = [chr(0x4E00 + k) for k in range(3000)]

    def prose(n):
        return "".join(rnd.choice(letters) + ("。" if rnd.random() < 0.06 else "") for _ in range(n))

    passage = prose(80)
    rows = [(i, prose(rnd.randint(30, 60)) + passage + prose(rnd.randint(30, 60))) for i in range(8)] + [(8, prose(300)), (9, passage * 6)]
    got = {r.doc_id: r.text for r in run(spark, rows)}
    assert got[0] == rows[0][1] and got[8] == rows[8][1]
    assert all(passage[30:50] not in got[i] and len(got[i]) < len(rows[i][1]) - 40 for i in range(1, 8))
    assert len(got[9]) < len(passage)
    assert S.words_of("a b猫はc。 d") == ["a", "b", "猫", "は", "c。", "d"]


def test_short_repeats_stay(spark):
    """A few sentences met by chance, or one word again and again, are no repeated span."""
    rnd = random.Random(12)
    phrase = "Not so fast he said. They went home by noon. It was late then. "
    rows = [(i, f"{sentence(rnd)}{phrase}{sentence(rnd)}Was Was Was Was Was Was Was Was Was Was Was.\n") for i in range(4)]
    assert {r.doc_id: r.text for r in run(spark, rows)} == dict(rows)


def test_hot_and_other_hashes_agree(spark, monkeypatch):
    """The rows joined in place and those joined by a shuffle make the same result; ids that
    are equal with other texts are told apart by the text's hash."""
    rnd = random.Random(13)
    passage = "".join(sentence(rnd) for _ in range(8))
    rows = [(i // 2, f"{sentence(rnd)}\n{passage}{sentence(rnd)}") for i in range(40)]
    out = []
    for share in (0.0, 1.0):
        monkeypatch.setattr(S, "HOT_SHARE", share)
        out.append(sorted((r.doc_id, r.text) for r in run(spark, rows)))
    assert out[0] == out[1] and sum(passage in t for _, t in out[0]) == 1 and out[0][0][0] == 0
    assert sum(passage in t for i, t in out[0] if i == 0) == 1
