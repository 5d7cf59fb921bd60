"""SRC-2: read bz2 line files with all-or-nothing failure per file.

``read_files(files)`` takes a DataFrame of objects (``path``, ``size_bytes``), reads every
file once and stages what it read in the shared folder; it returns the staged table with

* line rows     ``path, line_no, value, stream``           (``line_no`` not null)
* manifest rows ``path, bytes, n_lines, error, stream``    (``line_no`` null, one per file)

The manifest row commits or discards a file's lines, at every file size: ``lines_of`` leaves
out the lines of failed files (undecodable, cut short, not strict UTF-8) and of a trailing
part that turned out not to be bz2 (``stream`` of the manifest row: the last one that counts).
Lines follow the whole-document rule: strip the document, split on ``\n`` only, drop lines
that are blank after stripping, keep the others as they are.

Work distribution: files are dealt round-robin over ``ceil(total_bytes / target_bytes)``
tasks, at least four per core (one small aggregate over the listing decides the count).  A
task holds one decompressed piece of at most ``_PIECE`` bytes and the line it cuts.  Files
above ``bz2_splits.SPLIT_ABOVE`` bytes are read by several tasks each (see there).
"""

from __future__ import annotations

import bz2
import codecs
import math
from typing import Iterator

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..files import arrow_uri
from . import bz2_splits

OUT_SCHEMA = "path string, line_no bigint, value string, bytes bigint, n_lines bigint, error string, stream bigint"

_CHUNK = 8 << 20  # bytes per read from storage
_PIECE = 16 << 20  # decompressed bytes handled at a time
#: Discarded files are broadcast up to this many; beyond that the join shuffles.
BROADCAST_DISCARDS = 100_000


class FileError(Exception):
    pass


def _place(path: str, cache: dict):
    """File system and inner path of an object; one handle per scheme+host per task."""
    import pyarrow.fs as pafs

    uri = arrow_uri(path)
    scheme, rest = uri.split("://", 1)
    host = f"{scheme}://{rest.split('/', 1)[0]}"
    if host not in cache:
        cache[host] = pafs.FileSystem.from_uri(f"{host}/")
    fs, root = cache[host]
    return fs, root.rstrip("/") + "/" + rest.split("/", 1)[1]


def _open(path: str, cache: dict):
    """Raw byte stream of one object."""
    fs, inner = _place(path, cache)
    # compression=None: hand us the raw bytes, we decompress ourselves
    return fs.open_input_stream(inner, compression=None)


def _open_file(path: str, cache: dict):
    """One object for reading anywhere."""
    fs, inner = _place(path, cache)
    return fs.open_input_file(inner)


def _bz2_pieces(raw_chunks: Iterator[bytes]) -> Iterator[tuple[int, bytes | None]]:
    """(stream number, decompressed bytes) of a (possibly multi-stream) bz2 object, at most
    ``_PIECE`` bytes each.

    Same outcome as ``bz2.decompress`` on the whole object: every complete stream is
    decoded; what follows a complete stream and is not bz2 is ignored, also where that shows
    only after some of it was decoded: ``(n, None)`` takes back stream ``n`` and is the last
    item.  A stream cut short or a first stream that is not bz2 is an error.
    """
    dec, number = None, 0
    for data in raw_chunks:
        while data or (dec is not None and not dec.eof and not dec.needs_input):
            dec = dec or bz2.BZ2Decompressor()
            try:
                out = dec.decompress(data, _PIECE)
            except OSError:
                if not number:
                    raise
                yield number, None
                return
            data = b""
            if out:
                yield number, out
            if dec.eof:
                data, dec, number = dec.unused_data, None, number + 1
    if dec is not None:
        raise FileError("Compressed data ended before the end-of-stream marker was reached")


# Python's whitespace set (``str.isspace``), derived by rule, as an RE2 class.
_PY_WS = "".join(ch for ch in map(chr, range(0x10000)) if ch.isspace())
_BLANK_RE = "^[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in _PY_WS) + "]*$"


class _Lines:
    """Non-blank lines of one document as Arrow string arrays, fed piece by piece.

    Splitting on ``\n``, strict UTF-8 validation (the cast) and the blank test run in
    Arrow's C++ kernels; Python touches only the document's first and last kept line,
    which get the whole-document strip (``lstrip`` / ``rstrip``).  Pieces are cut at their
    last ``\n`` (never inside a UTF-8 sequence), so only a partial line is carried.
    """

    def __init__(self):
        self.pending: list[bytes] = []
        self.held = None  # last kept line, held back: it may be the document's last
        self.first = True
        self.done = 0  # lines given out

    def copy(self) -> _Lines:
        other = _Lines()
        other.pending, other.held, other.first, other.done = list(self.pending), self.held, self.first, self.done
        return other

    def _kept(self, buf: bytes):
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = pc.split_pattern(pa.array([buf], pa.binary()), b"\n").flatten()
        lines = parts.cast(pa.string())  # raises on invalid UTF-8
        return lines.filter(pc.invert(pc.match_substring_regex(lines, _BLANK_RE)))

    def _emit(self, kept):
        import pyarrow as pa

        n = len(kept)
        if n == 0:
            return
        if self.first:
            kept = pa.concat_arrays([pa.array([kept[0].as_py().lstrip()], pa.string()), kept.slice(1)])
            self.first = False
        out = kept.slice(0, n - 1)
        if self.held is not None:
            out = pa.concat_arrays([pa.array([self.held], pa.string()), out])
        self.held = kept[n - 1].as_py()
        if len(out):
            yield self.done, out
            self.done += len(out)

    def feed(self, piece: bytes):
        """(first line number, lines) of what the piece completes."""
        cut = piece.rfind(b"\n")
        if cut < 0:
            self.pending.append(piece)
            return
        head = b"".join([*self.pending, piece[:cut]])
        self.pending = [piece[cut + 1 :]]
        # a document that is one long line after another may complete more than a piece
        yield from self._emit(self._kept(head))

    def finish(self):
        import pyarrow as pa

        yield from self._emit(self._kept(b"".join(self.pending)))
        if self.held is not None:
            yield self.done, pa.array([self.held.rstrip()], pa.string())
            self.done += 1


def _raw_chunks(stream) -> Iterator[bytes]:
    while True:
        b = stream.read(_CHUNK)
        if not b:
            return
        yield b


def _scan(path: str, fs_cache: dict, counter: list, last_stream: int | None = None):
    """(stream, first line number, lines) of one file.

    ``counter``: [compressed bytes read, object opened, lines, last stream that counts or
    None if all do].  With ``last_stream`` nothing behind that stream is read.
    """

    def counted():
        with _open(path, fs_cache) as stream:
            counter[1] = True
            for b in _raw_chunks(stream):
                counter[0] += len(b)
                yield b

    lines, number, before = _Lines(), 0, _Lines()
    for stream, piece in _bz2_pieces(counted()):
        if last_stream is not None and stream > last_stream:
            break
        if piece is None:
            if stream == number:  # some of it was given out: go back to where it began
                lines, number = before, stream - 1
                counter[3] = number
            break
        if stream != number:
            before, number = lines.copy(), stream
        for at, values in lines.feed(piece):
            yield number, at, values
    for at, values in lines.finish():
        yield number, at, values
    counter[2] = lines.done


_OUT_FIELDS = [
    ("path", "string"), ("line_no", "int64"), ("value", "string"),
    ("bytes", "int64"), ("n_lines", "int64"), ("error", "string"), ("stream", "int64"),
]


def _arrow_schema():
    import pyarrow as pa

    return pa.schema([(n, getattr(pa, t)()) for n, t in _OUT_FIELDS])


def _line_batch(path: str, stream: int, start: int, values):
    import numpy as np
    import pyarrow as pa

    n = len(values)
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(n, pa.string()).fill_null(path),
            pa.array(np.arange(start, start + n, dtype=np.int64)),
            values,
            pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.string()),
            pa.array(np.full(n, stream, dtype=np.int64)),
        ],
        schema=_arrow_schema(),
    )


def _read_partition(batches):
    """``mapInArrow`` body: files of this task -> line batches, then manifest rows."""
    import pyarrow as pa

    fs_cache: dict = {}
    manifest: list[tuple] = []
    for rb in batches:
        cols = rb.to_pydict()
        for path, size in zip(cols["path"], cols["size_bytes"]):
            counter = [0, False, 0, None]
            err = None
            try:
                for stream, start, values in _scan(path, fs_cache, counter):
                    yield _line_batch(path, stream, start, values)
            except Exception as e:  # noqa: BLE001 -- any failure isolates the file
                err = f"{type(e).__name__}: {e}"
            # an object that was opened counts whole, also where reading it stopped early
            if counter[1] and size is not None:
                counter[0] = int(size)
            manifest.append((path, None, None, counter[0], 0 if err else counter[2], err, -1 if err else counter[3]))
    if manifest:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*manifest), _arrow_schema())], schema=_arrow_schema())


def plan_tasks(files: DataFrame, target_bytes: int) -> int:
    """Task count for the read (one small aggregate over the listing): total compressed
    bytes / ``target_bytes``, but at least four tasks per core while there are files."""
    row = files.agg(F.sum("size_bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    total, n = int(row["b"] or 0), int(row["n"] or 0)
    if not n:
        return 1
    cores = files.sparkSession.sparkContext.defaultParallelism
    return max(1, min(n, max(4 * cores, math.ceil(total / target_bytes))))


def observed(staged: DataFrame, observation: Observation | None) -> DataFrame:
    """AGG-10 gathered by the staging write itself, without a pass of its own.  (Spark keeps
    observations in the session, which Spark ML models fitted in it then fail to ship: observe
    in a session of its own, as a job does.)"""
    if observation is None:
        return staged
    is_file = F.col("line_no").isNull()
    return staged.observe(
        observation,
        F.count_if(is_file & F.col("error").isNull()).alias("files_processed"),
        F.count_if(is_file & F.col("error").isNotNull()).alias("files_failed"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes_read"),
        F.coalesce(F.sum("n_lines"), F.lit(0)).cast("long").alias("lines_yielded"),
    )


def read_files(files: DataFrame, target_bytes: int = 128 << 20, num_tasks: int | None = None, observation: Observation | None = None) -> DataFrame:
    """Strict reader over a DataFrame of objects (``path`` with a scheme, ``size_bytes``):
    the staged table of the module's description."""
    from ..session import ship_package

    ship_package(files.sparkSession)
    large = F.coalesce(F.col("size_bytes") > bz2_splits.SPLIT_ABOVE, F.lit(False))
    if files.where(large).isEmpty():
        return _read_whole(files, target_bytes, num_tasks, observation)
    in_ranges, again = bz2_splits.read_large_files(files.where(large), bz2_splits.RANGE_BYTES)
    one_by_one = files.where(~large).select("path", "size_bytes").unionByName(again.select("path", "size_bytes"))
    raw = _read_whole(one_by_one, target_bytes, num_tasks).unionByName(in_ranges)
    if observation is not None:
        observed(raw.where("line_no is null"), observation).write.format("noop").mode("overwrite").save()
    return raw


def _read_whole(files: DataFrame, target_bytes: int, num_tasks: int | None, observation: Observation | None = None) -> DataFrame:
    """Each file by one task."""
    from ..session import materialize

    n = num_tasks or plan_tasks(files, target_bytes)
    # round-robin: equal file counts per task (Spark sorts first, so retries deal the same)
    spread = files.select("path", "size_bytes").repartition(n)
    return materialize(observed(spread.mapInArrow(_read_partition, OUT_SCHEMA), observation), "read")


def lines_of(raw: DataFrame) -> DataFrame:
    """Committed lines of a staged read: path, line_no, value."""
    lines = raw.where(F.col("line_no").isNotNull())
    gone = raw.where(F.col("line_no").isNull() & F.col("stream").isNotNull()).select("path", F.col("stream").alias("_last"))
    n = gone.count()
    if n:
        gone = F.broadcast(gone) if n <= BROADCAST_DISCARDS else gone
        lines = lines.join(gone, "path", "left").where(F.col("_last").isNull() | (F.col("stream") <= F.col("_last")))
    return lines.select("path", "line_no", "value")


def manifest_of(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("line_no").isNull()).select("path", "bytes", F.col("n_lines").alias("lines"), "error")


def counters_of(manifest: DataFrame) -> DataFrame:
    """AGG-10: one row of counters from a manifest."""
    return manifest.agg(
        F.count_if(F.col("error").isNull()).alias("files_processed"),
        F.count_if(F.col("error").isNotNull()).alias("files_failed"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes_read"),
        F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("lines_yielded"),
    )
