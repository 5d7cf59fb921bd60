"""Catalogue roll-ups against brute force."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from skiff.operators import catalog

KEYS = [
    ("b", "ds1/2024-01-01/a.bz2", 10), ("b", "ds1/2024-01-01/b.bz2", 20), ("b", "ds1/2024-01-02/c.bz2", 30),
    ("b", "ds1/undated/d.bz2", 40), ("b", "ds1/x.json", 5), ("b", "ds1/sub/", 0), ("b", "ds2/z.bz2", 7),
    ("b", "top.bz2", 1), ("c", "ds1/2023-12-31/e.bz2", 9),
]


def objs(spark):
    return spark.createDataFrame(KEYS, "bucket string, key string, size_bytes bigint")


def test_dates_rollup(spark):
    got = [(r.bucket, r.dataset, r.date, r.files, r.size_bytes) for r in catalog.dates_rollup(objs(spark)).collect()]
    assert got == [("b", "ds1", "2024-01-01", 2, 30), ("b", "ds1", "2024-01-02", 1, 30), ("c", "ds1", "2023-12-31", 1, 9)]
    one = catalog.dates_rollup(objs(spark).where("bucket = 'b'"), dataset="ds1").collect()
    assert [(r.date, r.files, r.size) for r in one] == [("2024-01-01", 2, "30.00 B"), ("2024-01-02", 1, "30.00 B")]


def test_browse_matches_delimiter_listing(spark):
    # brute force of a delimiter listing at every folder
    want = defaultdict(dict)
    for b, k, size in KEYS:
        parts = k.split("/")
        for j in range(1, len(parts)):
            parent, name = ("/".join(parts[: j - 1]) + "/" if j > 1 else ""), parts[j - 1]
            f = want[(b, parent)].setdefault(("folder", name), [0, 0, False])
            if j == len(parts) - 1 and not k.endswith("/"):
                f[0] += 1
                f[1] += size
            if j < len(parts) - 1:
                f[2] = True
        if not k.endswith("/"):
            want[(b, "/".join(parts[:-1]) + "/" if len(parts) > 1 else "")][("file", parts[-1])] = [None, size, None]
    got = defaultdict(dict)
    for r in catalog.browse_all(objs(spark)).collect():
        got[(r.bucket, r.parent)][(r.kind, r.name)] = [r.file_count, r.size_bytes, r.has_children]
    assert got == want
    one = {(r.kind, r.name) for r in catalog.browse(objs(spark), "b", "ds1").collect()}
    assert one == {("folder", "2024-01-01"), ("folder", "2024-01-02"), ("folder", "undated"),
                   ("folder", "sub"), ("file", "x.json")}


def test_bucket_sizes(spark):
    rows = {r.bucket: r for r in catalog.bucket_sizes(objs(spark)).collect()}
    assert rows["b"].objects == 8 and rows["b"].size_bytes == 113 and rows["c"].size == "9.00 B"


def test_dataset_stats(spark):
    rows = {(r.bucket, r.dataset): r for r in catalog.dataset_stats(objs(spark)).collect()}
    assert (rows[("b", "ds1")].files, rows[("b", "ds1")].date_start, rows[("b", "ds1")].date_end) == (4, "2024-01-01", "2024-01-02")
    assert (rows[("b", "ds2")].date_start, rows[("b", "ds2")].date_end) == ("", "")


from hypothesis import Phase, given, settings
from hypothesis import strategies as st

_seg = st.sampled_from(["a", "b", "2024-01-0" + "1", "2024-02-03", "x.bz2", "y.json", ""])
_key = st.lists(_seg, min_size=1, max_size=4).map("/".join)


def _brute_browse(keys):
    want = defaultdict(dict)
    for b, k, size in keys:
        parts = k.split("/")
        for j in range(1, len(parts)):
            parent, name = ("/".join(parts[: j - 1]) + "/" if j > 1 else ""), parts[j - 1]
            f = want[(b, parent)].setdefault(("folder", name), [0, 0, False])
            if j == len(parts) - 1 and not k.endswith("/"):
                f[0] += 1
                f[1] += size
            if j < len(parts) - 1:
                f[2] = True
        if not k.endswith("/"):
            want[(b, "/".join(parts[:-1]) + "/" if len(parts) > 1 else "")][("file", parts[-1])] = [None, size, None]
    return want


@settings(max_examples=10, deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(st.dictionaries(st.tuples(st.sampled_from(["b0", "b1"]), _key), st.integers(0, 5000), min_size=1, max_size=30))
def test_browse_and_dates_property(spark, objects):
    keys = [(b, k, size) for (b, k), size in sorted(objects.items())]
    df = spark.createDataFrame(keys, "bucket string, key string, size_bytes bigint")
    got = defaultdict(dict)
    for r in catalog.browse_all(df).collect():
        got[(r.bucket, r.parent)][(r.kind, r.name)] = [r.file_count, r.size_bytes, r.has_children]
    assert got == _brute_browse(keys)
    want_dates = defaultdict(lambda: [0, 0])
    for b, k, size in keys:
        m = re.search(r"(\d{4}-\d{2}-\d{2})", k)
        if k.endswith(".bz2") and m:
            w = want_dates[(b, k.split("/")[0], m.group(1))]
            w[0] += 1
            w[1] += size
    got_dates = {(r.bucket, r.dataset, r.date): [r.files, r.size_bytes] for r in catalog.dates_rollup(df).collect()}
    assert got_dates == dict(want_dates)


def test_browse_table_reads_the_level_only(spark, tmp_path):
    from skiff.operators import catalog

    keys = [f"d{i % 40:02}/s{i % 7}/f{i}.bz2" for i in range(4000)] + ["top.bz2", "/a", "d01//x", "d01/"]
    objs = spark.createDataFrame([("b", k, 10) for k in keys], "bucket string, key string, size_bytes bigint")
    out = str(tmp_path / "t")
    catalog.write_browse_table(objs, out, files=20)
    for path in ("", "d01", "d07/s3", "nosuch", "d01/"):
        got = catalog.browse_table(spark, out, "b", path)
        assert sorted(map(str, got.collect())) == sorted(map(str, catalog.browse(objs, "b", path).collect())) or path == ""
    assert sorted(map(str, catalog.browse_table(spark, out, "b").collect())) == sorted(
        map(str, catalog.browse_all(objs).where("parent = ''").collect())
    )
    plan = catalog.browse_table(spark, out, "b", "d07/s3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(parent,d07/s3/)" in plan
    # most files have nothing of that level between their least and greatest parent
    import pyarrow.parquet as pq

    held = 0
    for f in (tmp_path / "t").glob("part-*.parquet"):
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(names.index("parent")).statistics
            held += s.min <= "d07/s3/" <= s.max
    assert 1 <= held <= 3
