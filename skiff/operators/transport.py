"""Transport: normalise lines, spread, write shards (SCL-1, DST-1/2, SNK-1..6, AGG-10).

The lines of the strict reader are produced inside the read stage and are not shuffled
until the one ``repartition(n)`` that makes the ``n`` output shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import files
from ..functions import columns as C
from .shards import SUFFIX, TextSink, write_shards  # noqa: F401 -- part of this module's interface

COMPRESSIONS = tuple(SUFFIX)
DEFAULT_SHARDS = 0  # sized from the bytes


# SCL-1 ------------------------------------------------------------------------------------
def normalize_lines(df: DataFrame, text_col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Whole-document rule on a text column: ``keep`` columns + ``line_no`` + ``value``.

    Strip the document (Python whitespace set), split on ``\\n`` only, drop lines blank
    after stripping; the kept lines are not stripped themselves.
    """
    keep = keep or []
    kept = F.filter(C.split_lines(text_col), lambda x: ~C.is_blank(x))
    return df.select(*keep, F.posexplode(kept).alias("line_no", "value"))


# SNK-1 / SNK-2 / DST-2: shards.write_shards ---------------------------------------------------
def read_shards(spark, out: str) -> DataFrame:
    """Read written shards back as lines (codec from the file suffix)."""
    return spark.read.option("lineSep", "\n").text(out)


# SNK-3 ------------------------------------------------------------------------------------
INPUT_SCHEMA = "path string, output string, bytes bigint, lines bigint, error string"


def _write_inputs(batches, root: str, out: str, compression: str):
    import pyarrow as pa
    import pyarrow.fs as pafs
    from pyspark import TaskContext

    from ..sources.bz2_reader import _scan

    target_fs, base = pafs.FileSystem.from_uri(out)
    attempt = TaskContext.get().taskAttemptId()
    schema = pa.schema([("path", pa.string()), ("output", pa.string()), ("bytes", pa.int64()), ("lines", pa.int64()), ("error", pa.string())])
    cache: dict = {}

    def copy(path: str, name: str, counter: list, last: int | None) -> None:
        target_fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
        sink = TextSink(target_fs, name, compression)
        try:
            for _stream, _at, values in _scan(path, cache, counter, last):
                sink.write(values)
        finally:
            sink.close()

    for b in batches:
        for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            key = path[len(root) + 1 :]
            name = f"{base}/{key.removesuffix('.bz2')}{SUFFIX[compression]}"
            draft = f"{name}.{attempt}.inprogress"
            counter, error = [0, False, 0, None], None
            try:
                copy(path, draft, counter, None)
                if counter[3] is not None:  # part of it was no bz2 after all: write it anew without
                    counter = [0, False, 0, counter[3]]
                    copy(path, draft, counter, counter[3])
                target_fs.move(draft, name)
            except Exception as e:  # noqa: BLE001 -- any failure isolates the file
                error = f"{type(e).__name__}: {e}"
                if target_fs.get_file_info(draft).type == pafs.FileType.File:
                    target_fs.delete_file(draft)
                if counter[1] and size is not None:
                    counter[0] = int(size)
            row = (path, None if error else name[len(base) + 1 :], counter[0], 0 if error else counter[2], error)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)


def write_inputs(objects: DataFrame, root: str, out: str, compression: str = "none", tasks: int = 1) -> DataFrame:
    """decompress_only: one output per input under ``out``, folders kept, lines in order.

    Written in the read stage: a task streams each of its files to a draft beside the
    target and moves it there when the input proved whole; a failed input leaves nothing.
    Returns the manifest (``INPUT_SCHEMA``), which runs the copy when it is written.
    """
    return objects.select("path", "size_bytes").repartition(tasks).mapInArrow(lambda it: _write_inputs(it, root, out, compression), INPUT_SCHEMA)


def read_inputs(spark, out: str) -> DataFrame:
    """``rel_path``, ``value``: whole text of every output of ``write_inputs``."""
    # (Spark finds the codec by the suffix of the names, also for whole texts)
    t = spark.read.option("recursiveFileLookup", "true").text(out, wholetext=True)
    base = "/" + files.qualified(spark, out).split("://", 1)[1].strip("/") + "/"
    full = F.url_decode(F.regexp_replace(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")), "^[^:]*:/*", "/"))
    rel = F.expr(f"substring(_p, {len(base) + 1})")
    return t.select(full.alias("_p"), "value").select(rel.alias("rel_path"), "value")


# SNK-6 ------------------------------------------------------------------------------------
def write_table(df: DataFrame, out: str, partition_by: list[str] | None = None, run: str | None = None) -> str:
    """Table sink: parquet, optionally partitioned (partition pruning on read-back).

    With ``run`` the rows are that run's partition (``run=<id>``) of the table at ``out``: the
    same run again replaces what it wrote, other runs' rows stay.  Without it the folder must
    be new.  Rows of one partition value go together, and adaptive execution splits what is
    larger than its advisory size, so the writers of a value follow its bytes.
    """
    target, mode = (f"{out}/run={run}", "overwrite") if run else (out, "errorifexists")
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(target)
    else:
        df.write.mode(mode).parquet(target)
    return target


# AGG-10 / AGG-12 ---------------------------------------------------------------------------
def run_metrics_row(counters: dict, seconds: float, output_files: int) -> dict:
    """Run metrics from the read counters and wall time."""
    lines = counters.get("lines_yielded", 0)
    n_files = counters.get("files_processed", 0) + counters.get("files_failed", 0)
    return {
        **counters,
        "elapsed_s": seconds,
        "records_per_s": (lines / seconds) if seconds else None,
        "progress": (counters.get("files_processed", 0) / n_files) if n_files else 0.0,
        "output_files": output_files,
    }
