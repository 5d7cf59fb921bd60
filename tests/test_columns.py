"""Scalar rules (SCL-*) against small Python statements of the same rules."""

import sys
from datetime import datetime

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skiff.functions import columns as C


def py_format_bytes(b: int) -> str:
    if b == 0:
        return "0 B"
    units = ["B", "KB", "MB", "GB", "TB"]
    v, i = float(b), 0
    while v >= 1024 and i < len(units) - 1:
        v /= 1024
        i += 1
    return f"{v:.2f} {units[i]}"


def js_format_bytes_short(b):
    """History-report variant: half-up to 2 decimals on the exact value, zeros cut."""
    from decimal import ROUND_HALF_UP, Decimal

    if not b:
        return "-"
    units = ["B", "KB", "MB", "GB", "TB"]
    i = 0
    while i < 4 and b >= 1024 ** (i + 1):
        i += 1
    d = (Decimal(b) / Decimal(1024**i)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    s = format(d, "f").rstrip("0").rstrip(".")
    return f"{s} {units[i]}"


def col_values(spark, values, expr, typ="bigint"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_format_bytes_fixed_examples(spark):
    assert col_values(spark, [0, 5, 1152, 1408], C.format_bytes) == ["0 B", "5.00 B", "1.12 KB", "1.38 KB"]


@settings(max_examples=25, deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(st.lists(st.integers(min_value=0, max_value=2**52), min_size=1, max_size=200))
def test_format_bytes_matches_python(spark, values):
    assert col_values(spark, values, C.format_bytes) == [py_format_bytes(v) for v in values]


def test_format_bytes_ties_and_units(spark):
    vals = [1023, 1024, 1025, 1536, 1152, 1048575, 1048576, 1024**3 * 5 + 7, 1024**4, 1024**5 * 3]
    assert col_values(spark, vals, C.format_bytes) == [py_format_bytes(v) for v in vals]


def test_format_bytes_short(spark):
    vals = [None, 0, 5, 1152, 1408, 1536, 1024, 2048 * 1024, 1024**4 * 2]
    got = col_values(spark, vals, C.format_bytes_short)
    assert got == [js_format_bytes_short(v) for v in vals]
    assert got[3] == "1.13 KB" and got[4] == "1.38 KB" and got[5] == "1.5 KB" and got[6] == "1 KB"


def test_format_duration(spark):
    vals = [None, 0, 5, 59, 60, 61, 3599, 3600, 3661, 86400]
    assert col_values(spark, vals, C.format_duration) == [
        "-", "-", "5s", "59s", "1m 0s", "1m 1s", "59m 59s", "1h 0m", "1h 1m", "24h 0m"
    ]


ALL_WS = [chr(c) for c in range(0x10000) if chr(c).isspace()]


def test_strip_class_equals_python_whitespace(spark):
    # every BMP code point: blank-after-strip in Spark iff Python says isspace
    cps = [chr(c) for c in range(1, 0x10000) if not (0xD800 <= c <= 0xDFFF)]
    df = spark.createDataFrame([(c,) for c in cps], "x string")
    got = {r[0] for r in df.where(C.is_blank("x")).collect()}
    assert got == set(ALL_WS)


def test_strip_whole_document(spark):
    texts = ["\n  a\r\n\n   \nb  \nc\r\n\n", "　x ", "", "   ", "a\x1cb\x1f"]
    got = col_values(spark, texts, C.strip_ws, "string")
    assert got == [t.strip() for t in texts]


def test_normalize_lines_rule(spark):
    from skiff.operators.transport import normalize_lines

    texts = ["\n  {\"a\":1}\r\n\n   \n{\"a\":2}  \n{\"a\":3}\r\n\n", "x \n \n y ", " only "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, value string")
    got = sorted((r.id, r.value) for r in normalize_lines(df, keep=["id"]).collect())
    want = sorted((i, ln) for i, t in enumerate(texts) for ln in t.strip().split("\n") if ln.strip())
    assert got == want
    assert [v for i, v in got if i == 0] == ['{"a":1}\r', '{"a":2}  ', '{"a":3}']


def test_pattern_pair_and_prefix(spark):
    df = spark.createDataFrame([("bk", "/2016/Jan/"), ("bk", ""), ("bk", "a/b")], "bucket string, path string")
    got = [r[0] for r in df.select(C.pattern_pair("bucket", "path")).collect()]
    assert got == [
        ["gs://bk/2016/Jan/*.bz2", "gs://bk/2016/Jan/**/*.bz2"],
        ["gs://bk/*.bz2", "gs://bk/**/*.bz2"],
        ["gs://bk/a/b/*.bz2", "gs://bk/a/b/**/*.bz2"],
    ]
    pats = ["gs://bk/2016/Jan/**/*.bz2", "gs://bk/*.bz2", "gs://bk/x/*.json", "gs://bk", "s3://q/a/*.gz"]
    p = spark.createDataFrame([(x,) for x in pats], "p string")
    rows = p.select(
        C.uri_bucket("p"), C.list_prefix(C.uri_key("p")), C.pattern_extension("p"), C.is_valid_pattern("p")
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("bk", "2016/Jan", ".bz2", True),
        ("bk", "", ".bz2", True),
        ("bk", "x", ".json", True),
        ("bk", "", ".bz2", True),
        ("q", "a", ".gz", False),
    ]
    bad = spark.createDataFrame([("gs://b//x/*.bz2",), ("gs://b/x/*.bz2",)], "p string")
    assert [r[0] for r in bad.select(C.is_valid_pattern("p")).collect()] == [False, True]


def test_state_and_labels(spark):
    states = ["JOB_STATE_RUNNING", "JOB_STATE_DONE", "JOB_STATE_FAILED", "JOB_STATE_CANCELLED",
              "JOB_STATE_PENDING", "JOB_STATE_QUEUED", "JOB_STATE_DRAINING"]
    assert col_values(spark, states, C.map_state, "string") == [
        "running", "completed", "failed", "cancelled", "submitted", "submitted", "running"
    ]
    assert col_values(spark, ["decompress_only", "other"], C.process_label, "string") == ["Decomp", "other"]


def test_iso_utc(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 2, 3, 4, 5),), (datetime(2024, 1, 2, 3, 4, 5, 120),), (None,)], "t timestamp_ntz"
    )
    got = [r[0] for r in df.select(C.iso_utc("t")).collect()]
    assert got == ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.000120Z", None]


def test_extract_date_and_segments(spark):
    keys = ["a/2024-01-05/x.bz2", "a/b/c", "2016/Jan/1/f.bz2", "x-2024-99-99-2023-01-01.bz2"]
    assert col_values(spark, keys, C.extract_date, "string") == ["2024-01-05", "", "", "2024-99-99"]
    assert col_values(spark, keys, C.last_segment, "string") == ["x.bz2", "c", "f.bz2", "x-2024-99-99-2023-01-01.bz2"]
    assert col_values(spark, keys, C.parent_path, "string") == ["a/2024-01-05", "a/b", "2016/Jan/1", ""]


def test_iso_utc_does_not_depend_on_the_session_zone(spark):
    from datetime import datetime, timezone

    t = datetime.fromtimestamp(1704067200, timezone.utc)
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1704067200,)], "s long").select(F.timestamp_seconds("s").alias("t"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("n"))
        r = df.select(C.iso_utc("t").alias("a"), C.iso_utc("n").alias("b")).first()
        assert (r.a, r.b) == ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z") and t.year == 2024
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
