"""SRC-1: a storage listing as a DataFrame.

``list_objects(spark, root, bucket, prefixes)`` returns
``bucket STRING, key STRING, path STRING, size_bytes BIGINT, updated TIMESTAMP`` of every
object under ``root`` whose key starts with one of the prefixes (all, if none are given).
``root`` is the bucket root (``gs://bucket``, ``s3://bucket``, a folder): keys are relative
to it, as object names are.

Unlike ``binaryFile``/``text`` it hides nothing: zero-byte objects and names starting
with ``_`` or ``.`` are listed, as a storage listing would.  No file content is read.

Only folders that can hold a prefix are opened, and only by executors: each of the first
``LEVELS`` rounds lists one level of the folders found so far and deals the folders below
out anew, so a folder with most of the objects is shared by its sub-folders; the last round
lists what is below in full.  Each round is a table in the shared folder, and there are no
more rounds than there are folders left.  (Arrow's file layer can neither page a listing nor
begin one at a key, so one folder without sub-folders is one task: dealing its names to
several tasks would make each of them list it whole.)

By the path boundary a prefix stands for the object or folder of that name, so folders whose
names only begin with it are not opened; by the prefix boundary they are.
"""

from __future__ import annotations

from datetime import timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files

SCHEMA = "bucket string, key string, path string, size_bytes bigint, updated timestamp"
_ROW = "key string, size_bytes bigint, updated timestamp, folder boolean"
_BATCH = 8192
#: Rounds that list one level of folders.
LEVELS = 2


def _children(fs, base: str, recursive: bool):
    """File infos in a folder; none if there is no such folder."""
    import pyarrow.fs as pafs

    return fs.get_file_info(pafs.FileSelector(base, recursive=recursive, allow_not_found=True))


def _list(uri: str, prefix: str, recursive: bool, whole: bool, exact: bool = False):
    """(key, size, updated, is folder) at or below the folder of ``prefix`` that start with it.

    ``whole``: the prefix is a folder and everything in it is wanted.  ``exact``: what it
    names itself, and nothing whose name goes on behind it."""
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(uri)
    root = root.rstrip("/")
    folder, part = (prefix, "") if whole else (prefix.rpartition("/")[0], prefix)
    for info in _children(fs, f"{root}/{folder}" if folder else root, recursive):
        key = info.path[len(root) + 1 :]
        is_folder = info.type == pafs.FileType.Directory
        if not (is_folder or info.type == pafs.FileType.File):
            continue
        # "a/b" and "a/b/" both want what is in the folder "a/b"
        if exact and not whole and part:
            wanted = key == part or (is_folder and f"{key}/" == part)
        else:
            wanted = key.startswith(part) or (is_folder and f"{key}/" == part)
        if not wanted:
            continue
        if is_folder and recursive:
            continue
        time = info.mtime
        if time is not None and time.tzinfo is None:
            time = time.replace(tzinfo=timezone.utc)
        yield key, None if is_folder else info.size, time, is_folder


def _lister(uri: str, recursive: bool, whole: bool, exact: bool = False):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("key", pa.string()), ("size_bytes", pa.int64()), ("updated", pa.timestamp("us", tz="UTC")), ("folder", pa.bool_())])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        rows = []
        for b in batches:
            for prefix in b.column(0).to_pylist():
                for row in _list(uri, prefix, recursive, whole, exact):
                    rows.append(row)
                    if len(rows) >= _BATCH:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return run


def _default_bucket(uri: str) -> str:
    return "" if uri.startswith("file://") else uri.split("://", 1)[1].split("/", 1)[0]


def list_objects(
    spark: SparkSession, root: str, bucket: str | None = None, prefixes: DataFrame | None = None, tasks: int | None = None, boundary: str = "prefix"
) -> DataFrame:
    """See the module.  ``prefixes``: a DataFrame with a ``prefix`` column, none of which may
    start with another (by the boundary)."""
    from ..session import materialize, ship_package

    ship_package(spark)
    root = files.qualified(spark, root)
    uri = files.arrow_uri(root)
    exact = boundary == "path"
    n = tasks or 4 * spark.sparkContext.defaultParallelism
    todo = (prefixes if prefixes is not None else spark.createDataFrame([("",)], "prefix string")).select("prefix")
    rounds = []
    for level in range(LEVELS + 1):
        last = level == LEVELS
        here = materialize(todo.repartition(n).mapInArrow(_lister(uri, last, level > 0, exact), _ROW), "listing")
        rounds.append(here)
        folders = here.where("folder").select(F.col("key").alias("prefix"))
        if last or folders.isEmpty():
            break
        todo = folders
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    return every.where("not folder").select(
        F.lit(_default_bucket(root) if bucket is None else bucket).alias("bucket"), "key", F.concat(F.lit(f"{root}/"), "key").alias("path"), "size_bytes", "updated"
    )
