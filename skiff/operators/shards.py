"""SNK-1 / SNK-2: named text shards written and named by the tasks themselves.

A data source (``skiff_shards``) whose writer gives partition ``S`` of ``N`` the file
``output-SSSSS-of-NNNNN.ndjson`` (plus the codec's suffix), empty partitions included.  A task
streams to a draft beside its shard and moves it there when the shard is whole, so a task that
is run again replaces its own file and nothing else; the driver moves nothing.  What the tasks
wrote comes back as commit messages: committing writes ``_shards.json`` (name, lines and bytes
of every shard) and ``_SUCCESS``; a failed or cancelled write takes its shards away again.

Rows with a second, boolean column go to one of two folders by it (``<column>=true`` / ``false``).
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .. import files
from ..session import ship_package

NAME = "skiff_shards"
SHARD_NAME = "output-{i:05d}-of-{n:05d}.ndjson"
SUFFIX = {"none": "", "gzip": ".gz", "snappy": ".snappy"}
#: Most bytes of a block that Hadoop's snappy reader takes by default.
_SNAPPY_BLOCK = 1 << 17


class TextSink:
    """Lines into one file of a codec that Spark reads back by its suffix."""

    def __init__(self, fs, name: str, compression: str):
        import pyarrow as pa

        self._raw = fs.open_output_stream(name, compression=None)
        # gzip members may follow each other, so every piece is one
        self._compression = compression
        self._snappy = pa.Codec("snappy")
        self.lines = 0
        if compression == "gzip":
            self._raw.write(_gzip(b""))

    def write(self, values) -> None:
        """An Arrow string array, a line each; a null is an empty line."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(values):
            return
        self.lines += len(values)
        one = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.fill_null(""))
        text = pc.binary_join(one, "\n")[0].as_buffer()
        if self._compression == "none":
            self._raw.write(text)
            self._raw.write(b"\n")
        elif self._compression == "gzip":
            self._raw.write(_gzip(text.to_pybytes() + b"\n"))
        else:
            data = memoryview(text.to_pybytes() + b"\n")
            for at in range(0, len(data), _SNAPPY_BLOCK):
                raw = data[at : at + _SNAPPY_BLOCK]
                packed = self._snappy.compress(raw, asbytes=True)
                self._raw.write(struct.pack(">II", len(raw), len(packed)) + packed)

    def close(self) -> None:
        self._raw.close()


def _gzip(data: bytes) -> bytes:
    import gzip

    return gzip.compress(data, 6, mtime=0)


@dataclass
class _Written(WriterCommitMessage):
    shards: list  # (name, lines, bytes)


class _ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, split: str | None):
        self.uri, self.shards, self.compression, self.split = options["uri"], int(options["shards"]), options["compression"], split

    def _fs(self):
        import pyarrow.fs as pafs

        return pafs.FileSystem.from_uri(self.uri)

    def write(self, iterator):
        import pyarrow.compute as pc
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, base = self._fs()
        name = SHARD_NAME.format(i=context.partitionId(), n=self.shards) + SUFFIX[self.compression]
        folders = [f"{base}/{self.split}={v}" for v in ("true", "false")] if self.split else [base]
        drafts = [f"{f}/_{name}.{context.taskAttemptId()}.inprogress" for f in folders]
        sinks = []
        try:
            for folder, draft in zip(folders, drafts):
                fs.create_dir(folder, recursive=True)
                sinks.append(TextSink(fs, draft, self.compression))
            for batch in iterator:
                values = batch.column(0)
                if self.split:
                    flag = batch.column(1).fill_null(False)
                    sinks[0].write(values.filter(flag))
                    sinks[1].write(values.filter(pc.invert(flag)))
                else:
                    sinks[0].write(values)
            done = []
            for folder, draft, sink in zip(folders, drafts, sinks):
                sink.close()
                size = fs.get_file_info(draft).size
                fs.move(draft, f"{folder}/{name}")
                done.append((f"{folder[len(base) + 1 :]}/{name}".lstrip("/"), sink.lines, size))
            return _Written(done)
        except BaseException:
            for draft, sink in zip(drafts, sinks):
                sink.close()
                if fs.get_file_info(draft).is_file:
                    fs.delete_file(draft)
            raise

    def commit(self, messages) -> None:
        fs, base = self._fs()
        shards = sorted(s for m in messages if m is not None for s in m.shards)
        for name, data in (("_shards.json", json.dumps(shards).encode()), ("_SUCCESS", b"")):
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(data)

    def abort(self, messages) -> None:
        fs, base = self._fs()
        for m in messages:
            for name, _lines, _size in m.shards if m is not None else ():
                if fs.get_file_info(f"{base}/{name}").is_file:
                    fs.delete_file(f"{base}/{name}")


class ShardSource(DataSource):
    """The data source; see the module."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool):
        names = [f.name for f in schema.fields]
        return _ShardWriter(dict(self.options), names[1] if len(names) > 1 else None)


def write_shards(lines: DataFrame, out: str, num_shards: int, compression: str = "none", split: str | None = None, spread_by: list | None = None) -> list[str]:
    """Write ``value`` as newline-terminated text into exactly ``num_shards`` named files (for
    each value of the boolean column ``split``, if given) in a new folder; their names.

    Rows are dealt by a hash of ``spread_by`` (a unique key deals the same when a task is run
    again), else round-robin."""
    spark = lines.sparkSession
    ship_package(spark)
    out = files.qualified(spark, out)
    if files.children(spark, out):
        raise FileExistsError(f"{out} is there already")
    spark.dataSource.register(ShardSource)
    rows = lines.repartition(num_shards, *spread_by) if spread_by else lines.repartition(num_shards)
    rows = rows.select("value", split) if split else rows.select("value")
    rows.write.format(NAME).mode("append").options(uri=files.arrow_uri(out), shards=num_shards, compression=compression).save()
    return [name for name, _lines, _bytes in committed_shards(spark, out)]


def committed_shards(spark: SparkSession, out: str) -> list[tuple[str, int, int]]:
    """Name, lines and bytes of a committed folder's shards (a row a shard)."""
    return [tuple(s) for s in json.loads(files.read(spark, f"{out}/_shards.json"))]
