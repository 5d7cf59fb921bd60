"""The pipeline, stage by stage, against brute force on the stage's own input."""

import re

import __spark_entry__ as E
import corpus_pipeline as C
from skiff.llm.jaccard_join import ngrams

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["language_id", "jaccard_join", "decontamination", "secret_scan", "packing"]
    stage = dict(C.STAGES)
    columns = docs.columns

    named = stage["language_id"](spark, docs, SF).cache()
    assert named.columns == columns and named.count() == docs.count()  # every text here is clean

    single = stage["jaccard_join"](spark, named, SF).cache()
    rows = sorted((r.doc_id, r.text) for r in named.collect())
    sets = {i: set(ngrams(t).tolist()) for i, t in rows}
    first = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = a, b
                while first[x] != x:
                    x = first[x]
                while first[y] != y:
                    y = first[y]
                first[max(x, y)] = min(x, y)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {i for i in sets if first[i] == i}

    clean = stage["decontamination"](spark, single, SF).cache()
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall((r.text or "").encode().lower())
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    want = set()
    for r in single.collect():
        w = WORD.findall(r.text.encode().lower())
        if not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1)):
            want.add(r.doc_id)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == want and len(want) < single.count()

    masked = stage["secret_scan"](spark, clean, SF).cache()
    before = {r.doc_id: r.text for r in clean.collect()}
    assert masked.columns == columns
    for r in masked.collect():
        assert r.text == re.sub(r'(?i)(token = ")[0-9a-f]{40}', r"\1<SECRET>", before[r.doc_id]) and r.n_chars == len(r.text)

    packed = stage["packing"](spark, masked, SF).collect()
    assert {r.doc_id for r in packed} == want
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())


def test_run_is_registered(spark):
    assert E.queries()["pipeline"] is C.run and "pipeline" not in E.oracle_sql()
    assert C.run(spark, SF).count() > 0


def test_odd_rows(spark, tmp_path):
    sf = str(tmp_path / "sf")
    text = "the house of the river and the old mill was near to it"
    rows = [(1, text, "en"), (1, text, "en"), (2, text, "en"), (None, text, None), (3, None, None), (4, "", "en"), (5, "!!", "en"), (6, "das haus und der fluss sind alt und gut", "de"), (7, "das wort " * 30000, "de")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _text_key long, class_key string"
    d = spark.createDataFrame([(i, t, g, None, None, "d", 4, "c") for i, t, g in rows], schema)
    d.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    stage = dict(C.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("language_id", "jaccard_join", "decontamination", "secret_scan"):
        assert stage[name](spark, docs, sf).columns == docs.columns
        assert stage[name](spark, docs.limit(0), sf).collect() == []
    assert sorted((r.doc_id or 0, r.text or "") for r in stage["jaccard_join"](spark, docs, sf).collect()) == sorted([(1, text), (3, ""), (4, ""), (5, "!!"), (6, rows[7][1]), (7, rows[8][1])])
    out = C.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {1, 6, 7}


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in C.language(spark, docs, SF).collect()] == [1]
