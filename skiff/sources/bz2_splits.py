"""SRC-2 for large files: one bz2 object read by several tasks.

A bz2 stream is a row of blocks that can be decoded one by one; each begins, at any bit, with
a fixed 48-bit mark.  A large file is dealt in byte ranges.  A task looks for the marks in its
range, decodes the blocks that begin there (reading on to where the last one ends), and splits
their text into lines.  It keeps back what lies before its first and behind its last line end;
one small row a range carries these ends, the blocks' checksums and the line count.

The ranges of a file are then put together, all or nothing: every range must be there, every
block sound, the checksum of each stream must be that of its blocks, and the last stream must
end with the file.  The lines across two ranges are joined from their ends.  Whatever is not
like that (a broken or cut file, text behind the last stream, no UTF-8, a range without a line
end) is read again by one task, whose rule of failure is the only one.

Line numbers grow with the lines of a file; ranges leave gaps between them.
"""

from __future__ import annotations

import bz2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files above the first size are dealt in ranges of about the second.
SPLIT_ABOVE, RANGE_BYTES = 256 << 20, 64 << 20
#: Read on by so much behind a range until its last block ends.
_STEP = 2 << 20
_LINE_BITS = 40  # a range's lines are numbered from its number times 2^40

# fixed values: the 48-bit marks of the format (a block, the end of a stream)
_BLOCK, _END = 0x314159265359, 0x177245385090

_SPLIT_SCHEMA = (
    "path string, line_no bigint, value string, bytes bigint, n_lines bigint, error string, stream bigint, "
    "part int, parts int, head binary, tail binary, kinds array<boolean>, sums array<bigint>"
)


def marks(data: bytes, mark: int) -> list[int]:
    """Bit positions of a 48-bit mark."""
    out = []
    for shift in range(8):
        wide = (mark << (8 - shift)).to_bytes(7, "big")
        inner = wide[1:6]  # bytes that belong to the mark whole (for shift 0: all but the first)
        first, last = (1 << (8 - shift)) - 1, (0xFF << (8 - shift)) & 0xFF
        at = data.find(inner, 1)
        while at >= 0:
            if data[at - 1] & first == wide[0] & first and (not shift or (at + 5 < len(data) and data[at + 5] & last == wide[6])):
                out.append(8 * (at - 1) + shift)
            at = data.find(inner, at + 1)
    return out


def _bits(data: bytes, start: int, end: int) -> int:
    whole = int.from_bytes(data[start // 8 : -(-end // 8)], "big")
    return (whole >> (-end % 8)) & ((1 << (end - start)) - 1)


def decode_block(data: bytes, start: int, end: int) -> bytes:
    """The block in these bits, as a stream of its own."""
    check = _bits(data, start + 48, start + 80)
    bits = (_bits(data, start, end) << 80) | (_END << 32) | check
    n = end - start + 80
    return bz2.decompress(b"BZh9" + (bits << (-n % 8)).to_bytes(-(-n // 8), "big"))


class Irregular(Exception):
    """Not a file to be read in ranges."""


def _read_range(stream, size: int, start: int, end: int, first: bool, last: bool):
    """Decoded blocks that begin in a byte range, then (kinds, sums): per mark whether it is a
    block, and its checksum."""
    stream.seek(start)
    data = stream.read(end - start)
    reach = end
    while True:
        at = sorted([(p, True) for p in marks(data, _BLOCK)] + [(p, False) for p in marks(data, _END)])
        own = [m for m in at if m[0] < 8 * (end - start)]
        behind = next((m for m in at if m[0] >= 8 * (end - start)), None)
        # the last block ends at the next mark; an end needs its checksum and what follows it
        if not own or reach >= size or (behind is not None and 8 * len(data) >= behind[0] + 200):
            break
        more = stream.read(_STEP)
        data, reach = data + more, reach + len(more)
    if first and (data[:3] != b"BZh" or not 0x31 <= data[3] <= 0x39 or not own or own[0][0] != 32):
        raise Irregular("no bz2 header")
    if not own:
        raise Irregular("no block in a range")
    chain = [*own, behind]
    kinds, sums = [], []
    for (p, is_block), after in zip(chain, chain[1:]):
        if 8 * len(data) < p + 80:
            raise Irregular("cut short")
        kinds.append(is_block)
        sums.append(_bits(data, p + 48, p + 80))
        if is_block:
            if after is None:
                raise Irregular("cut short")
            yield decode_block(data, p, after[0])
            continue
        close = -(-(p + 80) // 8)
        if start + close == size and after is None:
            continue
        if after is None or after[0] != 8 * (close + 4) or data[close : close + 3] != b"BZh" or not 0x31 <= data[close + 3] <= 0x39:
            raise Irregular("not a stream behind a stream")
    if last and (kinds[-1] or start + -(-(own[-1][0] + 80) // 8) != size):
        raise Irregular("the last stream does not end with the file")
    yield kinds, sums


def _split_rows(path: str, size: int, part: int, parts: int, cache: dict):
    """Arrow batches of one range: its lines, then its row."""
    import pyarrow as pa

    from .bz2_reader import _line_batch, _Lines, _open_file

    start, end = part * size // parts, (part + 1) * size // parts
    lines = _Lines()
    lines.first = part == 0
    lines.done = base = part << _LINE_BITS
    lines.done += 1  # (the number itself is for the line across the range's start)
    head = tail = None
    waiting: list[bytes] | None = [] if part else None  # blocks before the first line end
    with _open_file(path, cache) as stream:
        for piece in _read_range(stream, size, start, end, part == 0, part == parts - 1):
            if isinstance(piece, tuple):
                kinds, sums = piece
                break
            if waiting is not None:
                cut = piece.find(b"\n")
                if cut < 0:
                    waiting.append(piece)
                    continue
                head, piece, waiting = b"".join([*waiting, piece[:cut]]), piece[cut + 1 :], None
            for at, values in lines.feed(piece):
                yield _line_batch(path, 0, at, values)
    if waiting is not None:
        raise Irregular("a range without a line end")
    if part == parts - 1:
        for at, values in lines.finish():
            yield _line_batch(path, 0, at, values)
    else:
        tail = b"".join(lines.pending)
        if lines.held is not None:
            yield _line_batch(path, 0, lines.done, pa.array([lines.held], pa.string()))
            lines.done += 1
    n = lines.done - base - 1
    if not n and part in (0, parts - 1):
        raise Irregular("the document begins or ends in another range")
    yield [path, None, None, None, n, None, None, part, parts, head, tail, kinds, sums]


def _read_splits(batches):
    import pyarrow as pa

    schema = pa.schema(
        [
            ("path", pa.string()), ("line_no", pa.int64()), ("value", pa.string()), ("bytes", pa.int64()), ("n_lines", pa.int64()), ("error", pa.string()),
            ("stream", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("head", pa.binary()), ("tail", pa.binary()),
            ("kinds", pa.list_(pa.bool_())), ("sums", pa.list_(pa.int64())),
        ]
    )

    def row(values: list):
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema)], schema=schema)

    cache: dict = {}
    for b in batches:
        for path, size, part, parts in zip(*(c.to_pylist() for c in b.columns)):
            try:
                for out in _split_rows(path, size, part, parts, cache):
                    if isinstance(out, list):
                        yield row(out)
                    else:
                        empty = [pa.nulls(out.num_rows, f.type) for f in list(schema)[7:]]
                        yield pa.RecordBatch.from_arrays([*out.columns, *empty], schema=schema)
            except Exception as e:  # noqa: BLE001 -- decided when the ranges are put together
                yield row([path, None, None, None, 0, f"{type(e).__name__}: {e}", None, part, parts, None, None, None, None])


def put_together(parts: list[dict]) -> tuple[list[tuple[int, str]], int]:
    """Lines across the ranges of a file (number, line) and its line count; ``Irregular`` if
    the ranges are not one sound file."""
    parts = sorted(parts, key=lambda r: r["part"])
    if [r["part"] for r in parts] != list(range(parts[0]["parts"])) or any(r["error"] for r in parts):
        raise Irregular(next((r["error"] for r in parts if r["error"]), "a range is missing"))
    whole = 0
    for is_block, check in (e for r in parts for e in zip(r["kinds"], r["sums"])):
        if is_block:
            whole = ((whole << 1 | whole >> 31) & 0xFFFFFFFF) ^ check
        elif whole != check:
            raise Irregular("a stream's checksum differs")
        else:
            whole = 0
    across = []
    for before, after in zip(parts, parts[1:]):
        line = ((before["tail"] or b"") + (after["head"] or b"")).decode("utf-8")
        if line.strip():
            across.append((after["part"] << _LINE_BITS, line))
    return across, sum(r["n_lines"] for r in parts) + len(across)


def _put_files_together(batches):
    import pyarrow as pa

    from .bz2_reader import _arrow_schema

    schema = _arrow_schema()
    for b in batches:
        for r in b.to_pylist():
            rows: list[tuple]
            try:
                across, n = put_together(r["ranges"])
                rows = [(r["path"], at, line, None, None, None, 0) for at, line in across]
                rows.append((r["path"], None, None, r["size_bytes"], n, None, None))
            except Exception as e:  # noqa: BLE001 -- read again by one task
                rows = [(r["path"], None, None, r["size_bytes"], 0, f"{type(e).__name__}: {e}", -1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_large_files(files: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The staged rows (``bz2_reader.OUT_SCHEMA``) of the files that could be read in ranges,
    and the files that could not."""
    from ..session import materialize
    from .bz2_reader import OUT_SCHEMA

    n = F.ceil(F.col("size_bytes") / range_bytes).cast("int")
    ranges = files.select("path", "size_bytes", n.alias("parts")).select("path", "size_bytes", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    total = ranges.count()
    staged = materialize(ranges.repartition(max(1, total)).mapInArrow(_read_splits, _SPLIT_SCHEMA), "ranges")
    # a row a range: a file's ranges, and the ends of lines they carry, meet in one task
    facts = ["part", "parts", "n_lines", "error", "head", "tail", "kinds", "sums"]
    per_file = staged.where("line_no is null").groupBy("path").agg(F.collect_list(F.struct(*facts)).alias("ranges"))
    joined = materialize(per_file.join(files.select("path", "size_bytes"), "path").select("path", "size_bytes", "ranges").mapInArrow(_put_files_together, OUT_SCHEMA), "joined")
    failed = joined.where("line_no is null and error is not null").select("path")
    again = files.join(failed, "path", "left_semi")
    lines = staged.where("line_no is not null").select(*joined.columns)
    if not failed.isEmpty():
        good = joined.where("line_no is null and error is null").select("path")
        lines, joined = lines.join(good, "path", "left_semi"), joined.join(good, "path", "left_semi")
    return lines.unionByName(joined), again
