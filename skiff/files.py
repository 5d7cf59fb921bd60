"""Driver-side file calls through Spark's own file systems, and the same paths for Arrow.

A path without a scheme means whatever it means to Spark: it is completed with the
session's default file system, never guessed to be local.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme and host, without a closing slash."""
    fs, p = _at(spark, path)
    text = fs.makeQualified(p).toString().rstrip("/")
    return "file://" + text[len("file:") :] if text.startswith("file:/") and not text.startswith("file://") else text


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files directly in a folder, sorted; none if there is no such folder."""
    fs, p = _at(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile())


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders directly in a folder; none if there is no such folder."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def count_files(spark: SparkSession, folder: str, start: str) -> int:
    """Files in a folder and all below it whose names begin with ``start``; listed page by page."""
    fs, p = _at(spark, folder)
    n, found = 0, fs.listFiles(p, True) if fs.exists(p) else None
    while found is not None and found.hasNext():
        n += found.next().getPath().getName().startswith(start)
    return n


def read(spark: SparkSession, path: str) -> bytes:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _at(spark, source)
    if not fs.rename(p, _at(spark, target)[1]):
        raise OSError(f"cannot move {source} to {target}")


def write(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    try:
        if data:
            out.write(bytearray(data))
    finally:
        out.close()


def write_whole(spark: SparkSession, folder: str, name: str, data: bytes) -> None:
    """A new file that readers of the folder see whole or not at all."""
    write(spark, f"{folder}/_{name}.draft", data)
    move(spark, f"{folder}/_{name}.draft", f"{folder}/{name}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def arrow_uri(path: str) -> str:
    """A qualified path as Arrow's file layer names it."""
    if "://" not in path:
        raise ValueError(f"a path with a scheme is needed, not {path!r}")
    return "s3://" + path[len("s3a://") :] if path.startswith("s3a://") else path
