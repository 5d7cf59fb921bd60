"""Selection (JON-1, AGG-1, AGG-9, RUN-7) against brute force over random listings."""

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skiff.operators import select

SEGS = ["a", "ab", "b", "src1", "src10", "x.bz2", "y.json", ""]


def brute(keys, prefixes, boundary, exts=(".bz2",)):
    out = set()
    for b, k in keys:
        if not k.endswith(exts):
            continue
        for pb, p in prefixes:
            if pb != b:
                continue
            if boundary == "prefix":
                hit = k.startswith(p)
            else:
                hit = p == "" or k == p or k.startswith(p + "/")
            if hit:
                out.add((b, k))
    return out


def objects_df(spark, keys):
    return spark.createDataFrame([(b, k, len(k)) for b, k in keys], "bucket string, key string, size_bytes bigint")


key_st = st.lists(st.sampled_from(SEGS), min_size=1, max_size=4).map("/".join)
bucket_st = st.sampled_from(["b0", "b1"])


@settings(max_examples=15, deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(
    keys=st.sets(st.tuples(bucket_st, key_st), min_size=1, max_size=40),
    paths=st.lists(st.tuples(bucket_st, key_st), min_size=1, max_size=6),
)
def test_select_matches_brute_force(spark, keys, paths):
    keys = sorted(keys)
    objs = objects_df(spark, keys)
    sel = spark.createDataFrame(paths, "bucket string, path string")
    pats = select.build_patterns(sel)
    prefixes = {(b, p.strip("/")) for b, p in paths}
    for boundary in ("path", "prefix"):
        got = [(r.bucket, r.key) for r in select.select_objects(objs, pats, boundary).collect()]
        assert len(got) == len(set(got)), "an object selected twice"
        assert set(got) == brute(keys, prefixes, boundary), boundary


def test_empty_segments_regression(spark):
    keys = [("b1", "/src1/a/x.bz2"), ("b1", "src1/x.bz2"), ("b1", "/x.bz2"), ("b1", "a//b.bz2")]
    objs = objects_df(spark, keys)
    for paths in (["src1"], [""], ["a"], ["/a/"]):
        sel = spark.createDataFrame([("b1", p) for p in paths], "bucket string, path string")
        pats = select.build_patterns(sel)
        prefixes = {("b1", p.strip("/")) for p in paths}
        for boundary in ("path", "prefix"):
            got = [(r.bucket, r.key) for r in select.select_objects(objs, pats, boundary).collect()]
            assert len(got) == len(set(got))
            assert set(got) == brute(keys, prefixes, boundary), (paths, boundary)


def test_literal_selection_cases(spark):
    keys = [("bk", k) for k in ["src1/en/1.bz2", "src1/en/2.bz2", "src10/en/3.bz2", "src2/en/4.bz2",
                                "src2/de/5.bz2", "src10/en/", "src1/en/6.json", "top.bz2"]]
    objs = objects_df(spark, keys)
    paths = ["src1", "/src2/en/", "src10/en", "src1/en/1.bz2", "nosuch", ""]
    for boundary in ("path", "prefix"):
        for p in paths:
            pats = select.build_patterns(select.selection(spark, "bk", [p]))
            got = {(r.bucket, r.key) for r in select.select_objects(objs, pats, boundary).collect()}
            assert got == brute(keys, {("bk", p.strip("/"))}, boundary), (boundary, p)


def test_validation_and_gate(spark):
    keys = [("bk", "a/1.bz2"), ("bk", "a/2.bz2"), ("bk", "a/3.json"), ("bk", "b/4.bz2")]
    objs = objects_df(spark, keys)
    sel = select.selection(spark, "bk", ["a", "b", "a"])
    pats = select.build_patterns(sel)
    per = {r.pattern: r for r in select.validate_patterns(objs, pats).collect()}
    assert per["gs://bk/a/*.bz2"].file_count == 2 and per["gs://bk/a/*.bz2"].entries == 2
    assert per["gs://bk/b/**/*.bz2"].file_count == 1
    files = select.select_objects(objs, pats, "prefix")
    s = select.validation_summary(select.validate_patterns(objs, pats), files).first()
    # totals are summed over pattern entries (each file counted once per pattern entry)
    assert s.total_files == 2 * 2 * 2 + 1 * 2 and s.distinct_files == 3 and s.all_valid and s.submit_ok
    assert select.gate(select.validation_summary(select.validate_patterns(objs, pats)))["submit_ok"]
    bad = select.build_patterns(select.selection(spark, "bk", ["a", "nosuch"]))
    with pytest.raises(select.ValidationError):
        select.gate(select.validation_summary(select.validate_patterns(objs, bad)))
    raw = spark.createDataFrame([("bk", "s3://bk/a/*.bz2")], "bucket string, pattern string")
    r = select.validate_patterns(objs, raw).first()
    assert not r.valid and r.error == "Pattern must start with gs://" and r.file_count == 0


def test_pattern_reduction(spark):
    pre = spark.createDataFrame(
        [("b", ""), ("b", "a"), ("c", "a"), ("c", "a/b"), ("c", "ab"), ("d", "src1"), ("d", "src10")],
        "bucket string, prefix string",
    )
    path = {tuple(r) for r in select.reduce_prefixes(pre, "path").collect()}
    assert path == {("b", ""), ("c", "a"), ("c", "ab"), ("d", "src1"), ("d", "src10")}
    pref = {tuple(r) for r in select.reduce_prefixes(pre, "prefix").collect()}
    assert pref == {("b", ""), ("c", "a"), ("d", "src1")}


def test_selection_summary(spark):
    keys = [("bk", "a/1.bz2"), ("bk", "a/2.bz2"), ("bk", "b/3.bz2")]
    objs = objects_df(spark, keys)
    sel = select.selection(spark, "bk", ["a", "a/1.bz2", "b"])
    files = select.select_objects(objs, select.build_patterns(sel))
    r = select.selection_summary(sel, files).first()
    assert (r.selected_paths, r.files, r.size_bytes) == (3, 3, sum(len(k) for _, k in keys))


def test_large_pattern_branch_without_broadcast(spark):
    # broadcast_limit=0 forces the sort-merge path used for selections above the limit
    keys = [("b0", k) for k in ["a/x.bz2", "a/b/y.bz2", "ab/z.bz2", "src1/q.bz2", "src10/r.bz2", "t.bz2"]]
    objs = objects_df(spark, keys)
    sel = spark.createDataFrame([("b0", "a"), ("b0", "src1"), ("b0", "t.bz2")], "bucket string, path string")
    pats = select.build_patterns(sel)
    prefixes = {("b0", "a"), ("b0", "src1"), ("b0", "t.bz2")}
    for boundary in ("path", "prefix"):
        df = select.select_objects(objs, pats, boundary, broadcast_limit=0)
        got = [(r.bucket, r.key) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == brute(keys, prefixes, boundary)
    per = {r.pattern: r.file_count for r in select.validate_patterns(objs, pats, broadcast_limit=0).collect()}
    assert per["gs://b0/src1/*.bz2"] == 2


def test_prefix_lengths_join(spark):
    """One row per key and prefix length, whatever the number of selected files of a folder."""
    keys = [f"d/f{i:04d}.bz2" for i in range(300)] + ["d/f", "x/y/z.bz2", "top.bz2"]
    objs = spark.createDataFrame([("b", k, 1) for k in keys], "bucket string, key string, size_bytes long")
    sel = [f"d/f{i:03d}" for i in range(0, 30)] + ["top.bz2", "x"]
    prefixes = spark.createDataFrame([("b", p) for p in sel], "bucket string, prefix string")
    got = sorted(r.key for r in select.match_prefixes(objs, prefixes, "prefix").collect())
    assert got == sorted(k for k in keys if any(k.startswith(p) for p in sel))
    assert select.match_prefixes(objs, prefixes.limit(0), "prefix").collect() == []
    root = spark.createDataFrame([("b", "")], "bucket string, prefix string")
    assert select.match_prefixes(objs, root, "prefix").count() == len(keys)


def test_validation_by_boundary_and_extension(spark):
    objs = spark.createDataFrame([("b", k, 1) for k in ("Jan/10/a.bz2", "Feb/1/a.json.gz", "Feb/1/b.gz")], "bucket string, key string, size_bytes long")
    pats = select.build_patterns(select.selection(spark, "b", ["Jan/1"]))
    assert {r.file_count for r in select.validate_patterns(objs, pats).collect()} == {1}
    assert {r.file_count for r in select.validate_patterns(objs, pats, boundary="path").collect()} == {0}
    gz = select.build_patterns(select.selection(spark, "b", ["Feb"]), ".json.gz")
    assert {r.file_count for r in select.validate_patterns(objs, gz, exts=(".gz", ".json.gz")).collect()} == {1}


@pytest.mark.parametrize("boundary", ["path", "prefix"])
def test_sieve_below_the_exchange(spark, boundary, monkeypatch):
    keys = [(f"b{i % 2}", f"d{i % 50}/s{i % 7}/f{i}.bz2") for i in range(3000)] + [("b0", "/x.bz2"), ("b0", "d1//y.bz2"), ("b0", "other.txt")]
    objs = spark.createDataFrame([(b, k, 1) for b, k in keys], "bucket string, key string, size_bytes bigint")
    pre = spark.createDataFrame([("b0", "d4"), ("b1", "d3/s5"), ("b0", ""), ("b1", "d7/s1/f57.bz2"), ("b0", "nosuch")], "bucket string, prefix string")
    pre = pre.where("prefix <> ''")

    def rows(df):
        return sorted((r.bucket, r.key) for r in df.collect())

    broadcast = rows(select.match_prefixes(objs, pre, boundary))
    sieved = select.match_prefixes(objs, pre, boundary, broadcast_limit=0)
    assert rows(sieved) == broadcast and len(broadcast) > 50
    # few exploded keys are left to shuffle: those of the matches, and one in twenty others
    bits = select._sieve(pre, ["bucket", "prefix"])
    every = objs.select("bucket", F.explode(F.split("key", "/")).alias("p"))
    assert every.where(bits(F.col("bucket"), F.col("p"))).count() < 0.2 * every.count()
    assert pre.where(bits(F.col("bucket"), F.col("prefix"))).count() == pre.count()
    plan = sieved._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") and "getbit" in plan
    monkeypatch.setattr(select, "SIEVE_BITS_MAX", 4)  # a side too large for a sieve: the same rows
    assert rows(select.match_prefixes(objs, pre, boundary, broadcast_limit=0)) == broadcast
