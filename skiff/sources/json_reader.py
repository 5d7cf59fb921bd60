"""SRC-6 / SRC-7: JSON documents (plain or gzip), the elements of their arrays as lines.

``read_json_arrays(files)`` is a staged read like ``bz2_reader.read_files``, with the same
columns and the same rule: a file's manifest row commits or discards its lines.  A document is
decompressed, decoded and scanned piece by piece, once; an element is handed on as soon as it
is whole, so a task holds one element and the piece it ends in, however large the document.

A line is the element as it was written, without white space outside strings.  A document
fails, alone, if it is not one JSON array (strict JSON, UTF-8, no text behind it), if it cannot
be decompressed, or if an element is too long for a Spark string.
"""

from __future__ import annotations

import codecs
import json
import re
import zlib
from typing import Iterator

from pyspark.sql import DataFrame, Observation

from .bz2_reader import OUT_SCHEMA, FileError, _arrow_schema, _line_batch, _open, _raw_chunks, observed, plan_tasks

_SPACE = re.compile(r"[ \t\n\r]*")
_BETWEEN = re.compile(r'("(?:[^"\\]|\\.)*")|[ \t\n\r]+')
_BEHIND = tuple(" \t\n\r,]")
#: An error this close to the end of what was read may be for want of the rest.
_NEAR = 16
#: Lines go on when so many characters are gathered; no element may be longer than the most.
_BATCH_CHARS, _MOST_CHARS = 4 << 20, (1 << 31) - 16


def _gunzipped(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """A gzip object of one or more members, piece by piece."""
    member = None
    for data in chunks:
        while data:
            member = member or zlib.decompressobj(wbits=31)
            yield member.decompress(data, 16 << 20)
            while member.unconsumed_tail:
                yield member.decompress(member.unconsumed_tail, 16 << 20)
            data = b""
            if member.eof:
                # zero bytes may follow a member
                data, member = member.unused_data.lstrip(b"\0"), None
    if member is not None:
        raise FileError("Compressed data ended before the end-of-stream marker was reached")


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def array_elements(pieces: Iterator[str]) -> Iterator[str]:
    """The elements of a JSON array that comes in pieces, each as it was written but for the
    white space between its parts."""
    value = json.JSONDecoder(parse_constant=_no_constant).raw_decode
    text, at = "", 0

    def more() -> bool:
        """Read on: as much again as is left, so a long element is scanned a few times only."""
        nonlocal text, at
        rest, got = [text[at:]], 0
        for piece in pieces:
            rest.append(piece)
            got += len(piece)
            if got and got >= len(rest[0]):
                break
        if not got:
            return False
        text, at = "".join(rest), 0
        if len(text) > _MOST_CHARS:
            raise FileError("an element is too long")
        return True

    def sign() -> str:
        """The next character that is no white space; none at the end."""
        nonlocal at
        while True:
            at = _SPACE.match(text, at).end()
            if at < len(text):
                return text[at]
            if not more():
                return ""

    if sign() != "[":
        raise FileError("not a JSON array")
    at += 1
    if sign() == "]":
        at += 1
    else:
        while True:
            sign()
            while True:
                try:
                    end = value(text, at)[1]
                    # a number may go on in the next piece ("1.", "1e")
                    if text[end : end + 1] in _BEHIND or end < len(text) - _NEAR or not more():
                        break
                except json.JSONDecodeError as e:
                    short = e.msg.startswith("Unterminated string") or e.pos >= len(text) - _NEAR
                    if not short or not more():
                        raise
            element = text[at:end]
            at = end
            yield _BETWEEN.sub(r"\1", element) if any(c in element for c in " \t\n\r") else element
            c = sign()
            at += 1
            if c == "]":
                break
            if c != ",":
                raise FileError("not a JSON array: no comma behind an element")
    if sign():
        raise FileError("text behind the JSON array")


def _decoded(chunks: Iterator[bytes]) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8")("strict")
    for b in chunks:
        yield decoder.decode(b)
    yield decoder.decode(b"", final=True)


def _read_partition(batches):
    """``mapInArrow`` body: documents of this task -> line batches, then a manifest row."""
    import pyarrow as pa

    cache: dict = {}
    schema = _arrow_schema()
    for rb in batches:
        for path, size in zip(rb.column("path").to_pylist(), rb.column("size_bytes").to_pylist()):
            read, lines, error, opened = [0], 0, None, False

            def counted(stream, read=read):
                for b in _raw_chunks(stream):
                    read[0] += len(b)
                    yield b

            try:
                with _open(path, cache) as stream:
                    opened = True
                    raw = counted(stream)
                    held, chars = [], 0
                    for element in array_elements(_decoded(_gunzipped(raw) if path.endswith(".gz") else raw)):
                        if held and chars + len(element) > _BATCH_CHARS:
                            yield _line_batch(path, 0, lines, pa.array(held, pa.string()))
                            lines, held, chars = lines + len(held), [], 0
                        held.append(element)
                        chars += len(element)
                    if held:
                        yield _line_batch(path, 0, lines, pa.array(held, pa.string()))
                        lines += len(held)
            except Exception as e:  # noqa: BLE001 -- any failure isolates the file
                error = f"{type(e).__name__}: {e}"
            # an object that was opened counts whole, also where reading it stopped early
            n = int(size) if opened and size is not None else read[0]
            row = (path, None, None, n, 0 if error else lines, error, -1 if error else None)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)


def read_json_arrays(files: DataFrame, target_bytes: int = 128 << 20, observation: Observation | None = None) -> DataFrame:
    """The staged table of ``files`` (``path`` with a scheme, ``size_bytes``); see the module."""
    from ..session import materialize, ship_package

    ship_package(files.sparkSession)
    spread = files.select("path", "size_bytes").repartition(plan_tasks(files, target_bytes))
    return materialize(observed(spread.mapInArrow(_read_partition, OUT_SCHEMA), observation), "read")
