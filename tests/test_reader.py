"""Strict bz2 reader and the objects listing on the byte fixtures (FIXTURES §4)."""

import bz2

import pytest
from pyspark.sql import functions as F

from skiff.operators import select
from skiff.sources import bz2_reader, json_reader, objects
from skiff.sources.objects import list_objects


def py_reference_lines(data: bytes):
    """The reference's rule for one object, as a plain statement: (lines, failed)."""
    try:
        text = bz2.decompress(data).decode("utf-8")
    except Exception:  # noqa: BLE001
        return [], True
    return [ln for ln in text.strip().split("\n") if ln.strip()], False


def multi_block_bz2() -> bytes:
    import random

    rnd = random.Random(7)
    text = "\n".join("".join(rnd.choice("abcdefghij \t") for _ in range(120)) for _ in range(30000))
    return bz2.compress(text.encode(), compresslevel=1)


FIXTURES = {
    "ws.bz2": bz2.compress(b'\n  {"a":1}\r\n\n   \n{"a":2}  \n{"a":3}\r\n\n'),
    "multi.bz2": bz2.compress(b"a\n") + bz2.compress(b"b\n"),
    "trail.bz2": bz2.compress(b"t\n") + b"garbage",
    "empty.bz2": bz2.compress(b""),
    "zero.bz2": b"",
    "garbage.bz2": b"not bzip",
    "badutf.bz2": bz2.compress(b'{"ok":1}\n\xff\xfe\n'),
    "_under.bz2": bz2.compress(b"u1\nu2\n"),
    ".dot.bz2": bz2.compress(b"d1\n"),
    "_h/y.bz2": bz2.compress(b"h1\n"),
    "Jan/1/a.bz2": bz2.compress(b"jan1\n"),
    "Jan/10/z.bz2": bz2.compress(b"jan10\n"),
    "notes.txt": b"not selected",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("objs")
    data = dict(FIXTURES)
    big = multi_block_bz2()
    data["trunc.bz2"] = big[: len(big) * 2 // 3]
    data["big.bz2"] = big
    for name, b in data.items():
        p = d / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b)
    return str(d), data


def test_listing_hides_nothing(spark, root):
    path, data = root
    got = {r.key: r.size_bytes for r in list_objects(spark, path, bucket="b").collect()}
    assert got == {k: len(v) for k, v in data.items()}


def test_listing_of_prefixes_opens_only_their_folders(spark, root):
    path, data = root
    for prefixes in (["Jan/1"], ["Jan/1/", "_"], ["ws"], ["nosuch/x"], ["Jan", "big.bz2"], ["Jan/1/a.bz2"]):
        df = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
        got = sorted(r.key for r in list_objects(spark, path, bucket="b", prefixes=df).collect())
        assert got == sorted(k for k in data if any(k.startswith(p) for p in prefixes)), prefixes


def test_unselected_folders_are_never_opened(tmp_path, monkeypatch):
    for k in ("a/x/1.bz2", "a/y/2.bz2", "ab/3.bz2", "b/z/4.bz2"):
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_bytes(b"x")
    opened = []
    plain = objects._children
    monkeypatch.setattr(objects, "_children", lambda fs, base, deep: opened.append(base[len(str(tmp_path)) :]) or plain(fs, base, deep))
    uri = f"file://{tmp_path}"
    here = list(objects._list(uri, "a/x", False, False))
    assert [(k, f) for k, _, _, f in here] == [("a/x", True)] and opened == ["/a"]
    assert [k for k, *_ in objects._list(uri, "a/x", True, True)] == ["a/x/1.bz2"] and opened == ["/a", "/a/x"]


def check_reader(spark, path, data):
    files = list_objects(spark, path, bucket="b").where(F.col("key").endswith(".bz2"))
    raw = bz2_reader.read_files(files)
    lines = {}
    base = f"file://{path}/"
    for r in bz2_reader.lines_of(raw).collect():
        lines.setdefault(r.path[len(base) :], []).append((r.line_no, r.value))
    man = {r.path[len(base) :]: r for r in bz2_reader.manifest_of(raw).collect()}
    for name, b in data.items():
        if not name.endswith(".bz2"):
            assert name not in man
            continue
        want, failed = py_reference_lines(b)
        got = sorted(lines.get(name, []))
        assert [n for n, _ in got] == list(range(len(want))) and [v for _, v in got] == want, name
        assert (man[name].error is not None) == failed, name
        assert man[name].lines == len(want)
        assert man[name].bytes == len(b)
    return raw, lines, man


@pytest.mark.parametrize("piece", [16 << 20, 1000])  # pieces larger and smaller than the documents
def test_reader_failure_matrix(spark, root, piece, monkeypatch):
    path, data = root
    if piece == 1000:
        lines, man = in_process(path, data, piece, monkeypatch)
    else:
        raw, lines, man = check_reader(spark, path, data)
        c = bz2_reader.counters_of(bz2_reader.manifest_of(raw)).first()
        n_bz2 = sum(1 for k in data if k.endswith(".bz2"))
        assert c.files_failed == 3 and c.files_processed == n_bz2 - 3
        assert c.lines_yielded == sum(len(py_reference_lines(b)[0]) for k, b in data.items() if k.endswith(".bz2"))
        assert c.bytes_read == sum(len(b) for k, b in data.items() if k.endswith(".bz2"))
    assert [v for _, v in sorted(lines["ws.bz2"])] == ['{"a":1}\r', '{"a":2}  ', '{"a":3}']
    for bad in ("garbage.bz2", "trunc.bz2", "badutf.bz2"):
        assert man[bad].error and man[bad].lines == 0
    for ok in ("zero.bz2", "empty.bz2", "trail.bz2", "multi.bz2"):
        assert man[ok].error is None


def in_process(path, data, piece, monkeypatch):
    """The task's own function with small chunks and pieces, and the commit rule applied."""
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(bz2_reader, "_PIECE", piece)
    monkeypatch.setattr(bz2_reader, "_CHUNK", 700)
    names = [k for k in data if k.endswith(".bz2")]
    batch = pa.RecordBatch.from_pydict({"path": [f"file://{path}/{k}" for k in names], "size_bytes": [len(data[k]) for k in names]})
    rows = [r for b in bz2_reader._read_partition([batch]) for r in b.to_pylist()]
    base = len(f"file://{path}/")
    man = {r["path"][base:]: r for r in rows if r["line_no"] is None}
    lines = {}
    for r in rows:
        if r["line_no"] is not None:
            last = man[r["path"][base:]]["stream"]
            if last is None or r["stream"] <= last:
                lines.setdefault(r["path"][base:], []).append((r["line_no"], r["value"]))
    for k in names:
        want, failed = py_reference_lines(data[k])
        assert [v for _, v in sorted(lines.get(k, []))] == want, k
        assert [n for n, _ in sorted(lines.get(k, []))] == list(range(len(want)))
        assert (man[k]["error"] is not None) == failed and man[k]["n_lines"] == len(want)
    return lines, {k: SimpleNamespace(error=r["error"], lines=r["n_lines"]) for k, r in man.items()}


def test_corrupt_later_stream_gives_no_lines(spark, tmp_path):
    """A later stream that breaks after much of it was decoded is taken back."""
    import random

    rnd = random.Random(1)
    body = "\n".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(200)) for _ in range(100_000)).encode()
    second = bytearray(bz2.compress(body, 1))
    assert len(second) > 9 << 20
    second[-3_000_000:-2_999_000] = bytes(1000)
    data = {
        "one.bz2": bz2.compress(b"first\nhalf a li") + bytes(second),
        "two.bz2": bz2.compress(b"a\n") + bz2.compress(b"b\nc") + bytes(second),
        "first.bz2": bytes(second),
    }
    for k, b in data.items():
        (tmp_path / k).write_bytes(b)
    _, lines, man = check_reader(spark, str(tmp_path), data)
    assert [v for _, v in lines["one.bz2"]] == ["first", "half a li"] and man["one.bz2"].error is None
    assert man["first.bz2"].error


def test_two_gigabytes_from_one_stream(tmp_path):
    """Memory and arrays stay bounded however much a stream expands to."""
    import resource

    line = b"x" * 1023 + b"\n"
    block = line * 1024
    comp = bz2.BZ2Compressor(9)
    with open(tmp_path / "big.bz2", "wb") as f:
        for _ in range(2200):  # 2.2 GB
            f.write(comp.compress(block))
        f.write(comp.flush())
    import pyarrow as pa

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    path = tmp_path / "big.bz2"
    batch = pa.RecordBatch.from_pydict({"path": [f"file://{path}"], "size_bytes": [path.stat().st_size]})
    n = last = 0
    for b in bz2_reader._read_partition([batch]):
        assert b.nbytes < 64 << 20
        n += b.num_rows
        last = b
    row = last.to_pylist()[-1]
    assert row["error"] is None and row["n_lines"] == 2200 * 1024 == n - 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # KB


def test_read_error_in_mid_file(tmp_path, monkeypatch):
    """An error after some lines were given out fails the file as a whole."""
    import pyarrow as pa

    data = bz2.compress(b"\n".join(b"line %d" % k for k in range(50_000)), 1)
    (tmp_path / "f.bz2").write_bytes(data)
    monkeypatch.setattr(bz2_reader, "_CHUNK", 1 << 14)
    plain = bz2_reader._raw_chunks

    def broken(stream):
        for k, b in enumerate(plain(stream)):
            if k == 3:
                raise OSError("connection lost")
            yield b

    monkeypatch.setattr(bz2_reader, "_raw_chunks", broken)
    monkeypatch.setattr(bz2_reader, "_PIECE", 1 << 14)
    batch = pa.RecordBatch.from_pydict({"path": [f"file://{tmp_path}/f.bz2"], "size_bytes": [len(data)]})
    rows = [r for b in bz2_reader._read_partition([batch]) for r in b.to_pylist()]
    assert rows[-1]["error"].startswith("OSError") and rows[-1]["stream"] == -1 and rows[-1]["n_lines"] == 0


def test_json_array_reader(spark, tmp_path):
    import gzip

    (tmp_path / "a.json").write_text('[{"a": 1}, {"b": 2}]')
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(b"[]"))
    (tmp_path / "c.json").write_text('{"not": "an array"}')
    (tmp_path / "d.json.gz").write_bytes(b"not gzip")
    raw = json_reader.read_json_arrays(list_objects(spark, str(tmp_path), bucket="b"))
    assert sorted((r.path.rsplit("/")[-1], r.line_no, r.value) for r in bz2_reader.lines_of(raw).collect()) == [("a.json", 0, '{"a":1}'), ("a.json", 1, '{"b":2}')]
    man = {r.path.rsplit("/")[-1]: r for r in bz2_reader.manifest_of(raw).collect()}
    assert man["a.json"].lines == 2 and man["a.json"].bytes == 20 and man["b.json.gz"].error is None
    assert man["c.json"].error and man["d.json.gz"].error


def test_path_vs_prefix_boundary(spark, root):
    path, _ = root
    objs = list_objects(spark, path, bucket="b")
    sel = select.selection(spark, "b", ["Jan/1"])
    pats = select.build_patterns(sel)
    by_path = sorted(r.key for r in select.select_objects(objs, pats, "path").collect())
    by_prefix = sorted(r.key for r in select.select_objects(objs, pats, "prefix").collect())
    assert by_path == ["Jan/1/a.bz2"]
    assert by_prefix == ["Jan/1/a.bz2", "Jan/10/z.bz2"]


def test_listing_deals_a_hot_folder_by_its_sub_folders(spark, tmp_path):
    for i in range(20):
        p = tmp_path / "hot" / f"d{i}" / "deep" / "f.bz2"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    (tmp_path / "cold").mkdir()
    (tmp_path / "cold" / "g.bz2").write_bytes(b"y")
    (tmp_path / "top.bz2").write_bytes(b"z")
    got = sorted(r.key for r in list_objects(spark, str(tmp_path), bucket="b").collect())
    assert got == sorted(["top.bz2", "cold/g.bz2"] + [f"hot/d{i}/deep/f.bz2" for i in range(20)])


def test_listing_by_path_does_not_open_siblings(spark, tmp_path, monkeypatch):
    for name in ("Jan/1/a.bz2", "Jan/10/b.bz2", "Jan/1.bz2", "Jan/1/2/3/c.bz2", "Feb/d.bz2"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "Jan" / "10").chmod(0o000)
    opened = []
    real = objects._children
    monkeypatch.setattr(objects, "_children", lambda fs, base, recursive: opened.append(base) or real(fs, base, recursive))
    run = objects._lister(f"file://{tmp_path}", False, False, True)
    import pyarrow as pa

    rows = [r for b in run([pa.RecordBatch.from_pydict({"prefix": ["Jan/1"]})]) for r in b.to_pylist()]
    assert [(r["key"], r["folder"]) for r in rows] == [("Jan/1", True)] and opened == [f"{tmp_path}/Jan"]
    (tmp_path / "Jan" / "10").chmod(0o755)
    pats = spark.createDataFrame([("Jan/1",), ("Feb/d.bz2",)], "prefix string")
    by_path = sorted(r.key for r in list_objects(spark, str(tmp_path), prefixes=pats, boundary="path").collect())
    assert by_path == ["Feb/d.bz2", "Jan/1/2/3/c.bz2", "Jan/1/a.bz2"]
    by_prefix = sorted(r.key for r in list_objects(spark, str(tmp_path), prefixes=pats).collect())
    assert by_prefix == ["Feb/d.bz2", "Jan/1.bz2", "Jan/1/2/3/c.bz2", "Jan/1/a.bz2", "Jan/10/b.bz2"]
