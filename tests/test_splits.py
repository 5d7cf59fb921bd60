"""SRC-2 in ranges: the same lines, counters and failures as one task reading the whole file."""

import bz2
import random

import pytest

from skiff.sources import bz2_reader, bz2_splits
from skiff.sources.objects import list_objects


def body(rnd, lines, width=400):
    return "".join(
        rnd.choice(["", "  ", "\r", f"{i} " + "".join(rnd.choice("abcdé中 \t") for _ in range(rnd.randint(1, width)))]) + "\n" for i in range(lines)
    ).encode()


def test_marks_and_blocks():
    rnd = random.Random(1)
    for _ in range(6):
        text = body(rnd, 6000)
        data = bz2.compress(text, 1)
        at = sorted(bz2_splits.marks(data, bz2_splits._BLOCK))
        end = bz2_splits.marks(data, bz2_splits._END)
        assert at[0] == 32 and len(end) == 1 and len(at) > 2
        assert b"".join(bz2_splits.decode_block(data, a, b) for a, b in zip(at, [*at[1:], end[0]])) == text
    for shift in range(8):
        bits = (bz2_splits._BLOCK << (16 - shift)).to_bytes(8, "big")
        assert bz2_splits.marks(b"\x00" + bits, bz2_splits._BLOCK) == [8 + shift]


def files(rnd):
    a, b = body(rnd, 9000), body(rnd, 5000)
    whole = bz2.compress(a, 1)
    broken = bytearray(whole)
    broken[len(whole) // 2] ^= 0x40
    second = bytearray(bz2.compress(b, 1))
    second[-len(second) // 3] ^= 0x10
    return {
        "plain": whole, "two": bz2.compress(a[:-5], 1) + bz2.compress(b, 1), "empty-stream": bz2.compress(b"") + whole + bz2.compress(b""),
        "outer": bz2.compress(b"\n \t " + a + b"  last \n\n", 1), "no-line-end": bz2.compress(b"x" * 900_000, 1) + bz2.compress(random.Random(3).randbytes(400_000).hex().encode(), 1),
        "cut": whole[: len(whole) * 2 // 3], "cut-end": whole[:-2], "broken": bytes(broken), "tail": whole + b"garbage", "broken-later": whole + bytes(second),
        "not": b"BZh9" + whole[5:], "utf": bz2.compress(a + b"\xff\xfe\n" + b, 1), "crc": whole[:-4] + bytes([whole[-4] ^ 1]) + whole[-3:],
    }


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("large")
    for name, data in files(random.Random(7)).items():
        (d / f"{name}.bz2").write_bytes(data)
    return d


def test_ranges_equal_one_task(spark, root, monkeypatch):
    from pyspark.sql import Observation

    listing = list_objects(spark.newSession(), str(root), bucket="b")  # observations stay in that session
    plain = bz2_reader._read_whole(listing, 1 << 30, None)

    def ordered(raw):
        rows = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.value) for r in bz2_reader.lines_of(raw).collect())
        return [(p, v) for p, _n, v in rows]

    def manifest(raw):
        return {r.path.rsplit("/", 1)[1]: (r.bytes, r.lines, r.error is None) for r in bz2_reader.manifest_of(raw).collect()}

    want, want_manifest = ordered(plain), manifest(plain)
    assert want_manifest["plain.bz2"][2] and not want_manifest["broken.bz2"][2]
    monkeypatch.setattr(bz2_splits, "SPLIT_ABOVE", 50_000)
    for size in (50_000, 90_000):
        monkeypatch.setattr(bz2_splits, "RANGE_BYTES", size)
        seen = Observation("read")
        raw = bz2_reader.read_files(listing, observation=seen)
        assert ordered(raw) == want and manifest(raw) == want_manifest
        assert seen.get["lines_yielded"] == sum(n for _b, n, _ok in want_manifest.values())
    staged, again = bz2_splits.read_large_files(listing, 90_000)
    assert {r.path.rsplit("/", 1)[1] for r in again.collect()} >= {"cut.bz2", "broken.bz2", "tail.bz2", "crc.bz2", "utf.bz2", "not.bz2"}
    assert {r.path.rsplit("/", 1)[1] for r in staged.select("path").distinct().collect()} >= {"plain.bz2", "two.bz2", "empty-stream.bz2", "outer.bz2"}
