"""Strict NDJSON validation (SCL-13) and JSON-array documents (SRC-7)."""

import json

from pyspark.sql import functions as F

from skiff.operators import ndjson

VALID = ['{"a":1}', '{"_bad":"x","v":1}', "-0", "1e400", " [ ] ", '"\\ud800"', "[" * 900 + "]" * 900, "[1,2]", "3", "null", '""', '  {"a":1}\r', '{"a":1,"a":2}']
INVALID = ["{bad", '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', "1] x", "1} x", '1,"w":2',
           '{"a":1}]', '{"a":1}}', "", " ", "{'a':1}", '"a\tb"', "01", "1.", "+1", "/* c */1", "1,", "[1,]", '{"a":1,}',
           "tru", '"\\x"', "\ufeff1", "\u00a01", "1//x", '"a', "1],[2", '1}, {"v":2', '"a\\\nb"', "-", "{a:1}", "1]//", '{"_bad":1']


def py_valid(s):
    try:
        json.loads(s)
        return True
    except ValueError:
        return False


def test_strict_validation_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in VALID + INVALID], "value string")
    got = {r.value: r.valid for r in ndjson.validate(df).collect()}
    assert got == {s: py_valid(s) for s in VALID + INVALID}


def test_write_split(spark, tmp_path):
    lines = [s for s in VALID + INVALID if "\n" not in s]
    df = spark.createDataFrame([(s,) for s in lines], "value string")
    ndjson.write_split(df, str(tmp_path / "o"))
    rows = ndjson.read_split(spark, str(tmp_path / "o")).collect()
    assert sorted((r.value, r.valid) for r in rows) == sorted((s, s in VALID) for s in lines)


def test_repeated_keys_need_no_setting(spark):
    key = "spark.sql.variant.allowDuplicateKeys"
    assert spark.conf.get(key, "false") == "false"
    deep = '{"a":{"b":1,"b":[{"c":1,"c":2}]}}'
    df = spark.createDataFrame([(deep,), ('{"a":1,"a":2',)], "value string")
    assert [r.valid for r in ndjson.validate(df).collect()] == [True, False]
    other = ndjson.session_beside(spark)
    assert other.conf.get(key) == "true" and spark.conf.get(key, "false") == "false"
    assert other.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    got = other.range(1).selectExpr(f"to_json(parse_json('{deep}')) v").first().v
    assert got == '{"a":{"b":[{"c":2}]}}'


def test_explode_json_array(spark):
    docs = spark.createDataFrame(
        [("f1", '[\n {"a": 1},\n {"b": [1, 2]}\n]'), ("f2", "[]"), ("f3", "{not json"), ("f4", '{"a":1}')],
        "path string, value string",
    )
    rows = ndjson.explode_json_array(docs).collect()
    got = sorted((r.path, r.value) for r in rows if r.value is not None)
    assert got == [("f1", '{"a":1}'), ("f1", '{"b":[1,2]}')]
    assert {r.path for r in rows if r.value is None} == {"f2", "f3", "f4"}


from hypothesis import Phase, given, settings
from hypothesis import strategies as st

_json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.text(max_size=5),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=3), inner, max_size=3),
    max_leaves=6,
)
_pieces = st.sampled_from(["", " ", "\r", "x", ",", "]", "}", "{", "[", '"', ":", "1"])


@settings(max_examples=10, deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(st.lists(st.tuples(_json_values, _pieces, _pieces), min_size=1, max_size=30))
def test_validation_property(spark, cases):
    strings = [a + json.dumps(v) + b for v, a, b in cases]
    df = spark.createDataFrame([(s,) for s in strings], "value string")
    got = [r.valid for r in ndjson.validate(df).collect()]
    assert got == [py_valid(s) for s in strings]
