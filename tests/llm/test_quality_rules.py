"""Quality rules against a plain Python version."""

import random
import re
from collections import Counter

from skiff.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return dict(
        n_words=len(w),
        word_chars=sum(map(len, w)),
        n_symbols=sum(c in "#*$%&|<>" for c in t),
        n_exclaims=t.count("!"),
        n_other_letters=sum(c.isalpha() and c > "\xff" and c not in "œŒẞ" for c in t),
        n_stop_words=sum(x in Q._STOPS for x in w),
        n_lines=len(lines),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=len(covered),
    )


def texts():
    rnd = random.Random(4)
    out = [None, "", " \t\n", "one", "a b c d", "a b c d e", "a b c d e a b c d e", "x " * 40, "a\na\n\na\nb \nb", "é ñ ü # * | <b> !", " lead", "trail\x0b\x0c", "\x1c\xa0 x", "long " * 20000, "œuvre ẞ ½ — € 😀 łódź дом 漢字 かな 한국 ệ ω ÿ"]
    out += ["".join(rnd.choice(["a", "b", "the ", " ", "\n", "c ", "!", "#"]) for _ in range(rnd.randint(0, 120))) for _ in range(150)]
    return out


def test_counts_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    d = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id long, text string, n_words int, _row string").repartition(3)
    q = Q.quality_rules(d)
    assert q.columns[:2] == ["doc_id", "_row"]
    got = {r.doc_id: r.asDict() for r in q.collect()}
    for i, t in rows:
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, repr(t)[:200]


def test_rules_and_verdict(spark):
    prose = "The house of the river and the old mill was near to it for a long time. "
    rows = [(1, prose * 1), (2, None), (3, "| cell " * 40), (4, "THIS!! IS!! LOUD!! " * 10), (5, (prose + "\n") * 30), (6, "de### la$$$ " * 20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.passes, r.failed_rules) for r in Q.quality_rules(d).collect()}
    assert got[1] == (True, [])
    assert "length" in got[2][1] and "symbols" in got[3][1] and "exclamations" in got[4][1] and "repeated_lines" in got[5][1] and "symbols" in got[6][1]
    own = Q.quality_rules(d, rules=(("any", "n_words", None, None, None),)).collect()
    assert all(r.passes for r in own)


def test_empty_table_and_repeats(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert Q.quality_rules(d).collect() == []
    same = spark.createDataFrame([(None, "x y")] * 3, "doc_id long, text string")
    assert len(Q.quality_rules(same).collect()) == 3


def test_clean_texts_of_any_length_and_other_languages_pass(spark):
    prose = "The house of the river and the old mill was near to it for a long time, {0} years ago or so {1}. "
    long = "".join(prose.format(i, i * 7 % 1001) for i in range(13_700))
    assert len(long.split()) > 270_000
    russian = "Старый дом стоял у реки, и вода медленно текла мимо мельницы. Мы долго шли по дороге, пока не стемнело. "
    polish = "Stary dom stał przy rzece, a woda powoli płynęła obok młyna. Długo szliśmy drogą, aż zrobiło się ciemno. "
    greek = "Το παλιό σπίτι ήταν κοντά στο ποτάμι και το νερό κυλούσε αργά δίπλα στον μύλο όλη τη νύχτα. "
    junk = " ".join(f"xq{i}z" for i in range(300))
    rows = [(1, long), (2, russian), (3, polish), (4, greek), (5, junk), (6, junk + " é ü 😀 ─ ▒"), (7, "")]
    got = {r.doc_id: r.failed_rules for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == [] for i in (1, 2, 3, 4)), got
    assert got[5] == ["stop_words"] and got[6] == ["stop_words"] and "length" in got[7]
