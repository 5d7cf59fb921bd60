"""Catalogue: roll-ups over an object listing (IDs AGG-3..8, SRT-2, SRT-3, SCL-8..11).

Input is any DataFrame with ``bucket, key, size_bytes`` (``updated`` optional), normally
``sources.objects.list_objects``.  Each roll-up is one ``groupBy`` with partial
(map-side) aggregation, so a folder or bucket that holds a third of all objects costs
one partial row per task before the shuffle, not a third of the listing in one task.
The reference walks one folder at a time with one extra listing per sub-folder; one
grouping here yields every folder at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C



def _under(objects: DataFrame, prefix: str) -> DataFrame:
    return objects.where(F.col("key").startswith(prefix)) if prefix else objects


def _folder_prefix(path: str) -> str:
    return f"{path}/" if path and not path.endswith("/") else path


# AGG-3 / SCL-10 / SRT-3 -------------------------------------------------------------------
def dates_rollup(
    objects: DataFrame, dataset: str | None = None, ext: str = C.DEFAULT_EXTENSION
) -> DataFrame:
    """Per ISO date found in the key: files, bytes, formatted size; ascending by date.

    ``dataset=None`` rolls up every dataset (first key segment) at once.
    """
    df = objects.where(F.col("key").endswith(ext))
    keys = ["bucket"]
    if dataset is not None:
        df = _under(df, _folder_prefix(dataset))
    else:
        df = df.withColumn("dataset", C.first_segment("key"))
        keys.append("dataset")
    df = df.withColumn("date", C.extract_date("key")).where(F.col("date") != "")
    out = df.groupBy(*keys, "date").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").cast("long").alias("size_bytes")
    )
    return out.withColumn("size", C.format_bytes("size_bytes")).orderBy(*keys, "date")


# AGG-4 ------------------------------------------------------------------------------------
def dataset_stats(objects: DataFrame, ext: str = C.DEFAULT_EXTENSION) -> DataFrame:
    """Per dataset (first segment): files with ``ext``, bytes, first/last ISO date ('' if none).

    The date text ``YYYY-MM-DD`` is min/max-ed as the 8-digit number ``YYYYMMDD``: the
    same order, a fixed-width buffer (hash aggregation, no sort), and invalid dates such
    as ``2024-99-99`` are kept, as text comparison would.
    """
    date = C.extract_date("key")
    as_num = F.when(date != "", F.regexp_replace(date, "-", "").cast("int"))
    df = objects.where(F.col("key").endswith(ext)).select(
        "bucket", C.first_segment("key").alias("dataset"), "size_bytes", as_num.alias("d")
    )
    agg = df.groupBy("bucket", "dataset").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").cast("long").alias("size_bytes"),
        F.min("d").alias("_dmin"),
        F.max("d").alias("_dmax"),
    )

    def back(c):
        t = F.lpad(F.col(c).cast("string"), 8, "0")
        txt = F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 5, 2), F.lit("-"), F.substring(t, 7, 2))
        return F.coalesce(txt, F.lit(""))

    return agg.select("bucket", "dataset", "files", "size_bytes", back("_dmin").alias("date_start"),
                      back("_dmax").alias("date_end"))


# AGG-5 / AGG-6 / SCL-9 --------------------------------------------------------------------
def _children(objects: DataFrame, depth_from: int | None) -> DataFrame:
    """(parent, folder) rows for every folder level of every key, with its direct-file
    flag and a grandchild flag; ``depth_from`` limits to one level (1-based)."""
    segs = F.split(F.col("key"), "/", -1)
    n = F.size(segs)
    levels = F.sequence(F.lit(1), n - 1) if depth_from is None else F.array(F.lit(depth_from))
    rows = objects.select("bucket", "key", "size_bytes", n.alias("_n"), F.explode(levels).alias("_j"))
    rows = rows.where((F.col("_j") >= 1) & (F.col("_j") <= F.col("_n") - 1))
    j = F.col("_j")
    direct_file = (j == F.col("_n") - 1) & ~C.is_folder_placeholder("key")
    # parent as a listing prefix: '' at the root, else the folder path plus '/'; unlike the
    # bare path it stays unambiguous when keys have empty segments ('/a', 'a//b')
    parent = F.when(j == 1, F.lit("")).otherwise(F.concat(F.expr("substring_index(key, '/', _j - 1)"), F.lit("/")))
    return rows.select(
        "bucket",
        parent.alias("parent"),
        F.element_at(segs, j).alias("name"),
        F.expr("substring_index(key, '/', _j)").alias("path"),
        direct_file.alias("_direct"),
        (j < F.col("_n") - 1).alias("_deeper"),
        "size_bytes",
    )


def folder_stats(objects: DataFrame, level: int | None = None) -> DataFrame:
    """AGG-5 for every folder: direct-file count and bytes, and whether it has sub-folders."""
    ch = _children(objects, level)
    return ch.groupBy("bucket", "parent", "name", "path").agg(
        F.count_if("_direct").alias("file_count"),
        F.coalesce(F.sum(F.when(F.col("_direct"), F.col("size_bytes"))), F.lit(0)).cast("long").alias("size_bytes"),
        F.bool_or("_deeper").alias("has_children"),
    )


def _file_rows(objects: DataFrame) -> DataFrame:
    parent = F.when(~F.col("key").contains("/"), F.lit("")).otherwise(F.concat(C.parent_path("key"), F.lit("/")))
    return objects.where(~C.is_folder_placeholder("key")).select(
        "bucket",
        parent.alias("parent"),
        C.last_segment("key").alias("name"),
        F.col("key").alias("path"),
        "size_bytes",
        *([C.iso_utc("updated").alias("updated")] if "updated" in objects.columns else []),
    )


def browse_all(objects: DataFrame) -> DataFrame:
    """AGG-6 for every folder at once: one row per (parent, child folder | file).

    ``parent`` is the listing prefix browsed ('' for the bucket root, else ``folder/``);
    ``kind`` is ``folder`` or ``file``; folders carry ``file_count``/``has_children``, files
    carry ``size_bytes`` of the object; ``size`` is formatted for both.
    """
    return _folders(objects, None).unionByName(_files(objects)).withColumn("size", C.format_bytes("size_bytes"))


def _folders(objects: DataFrame, level: int | None) -> DataFrame:
    return folder_stats(objects, level).select(
        "bucket", "parent", F.lit("folder").alias("kind"), "name", "path",
        "file_count", "size_bytes", "has_children",
    )


def _files(objects: DataFrame) -> DataFrame:
    return _file_rows(objects).select(
        "bucket", "parent", F.lit("file").alias("kind"), "name", "path",
        F.lit(None).cast("long").alias("file_count"), "size_bytes",
        F.lit(None).cast("boolean").alias("has_children"),
    )


def browse(objects: DataFrame, bucket: str, path: str = "") -> DataFrame:
    """AGG-6 at one path, as the reference's browse: its sub-folders and files.  Each key below
    the path gives one row, for the level shown, however deep it lies."""
    prefix = _folder_prefix(path)
    scoped = _under(objects.where(F.col("bucket") == bucket), prefix)
    shown = _folders(scoped, prefix.count("/") + 1).unionByName(_files(scoped.where(~F.substring("key", len(prefix) + 1, 1 << 20).contains("/"))))
    return shown.where(F.col("parent") == prefix).withColumn("size", C.format_bytes("size_bytes"))


def write_browse_table(objects: DataFrame, out: str, files: int | None = None) -> None:
    """AGG-6 for repeated browsing: the rows of every folder, dealt and sorted by (bucket,
    parent, name), so the statistics of a file's row groups tell which parents it holds.  A
    folder with most of the objects is spread over several files by its names."""
    by = ["bucket", "parent", "name"]
    rows = browse_all(objects)
    spread = rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
    spread.sortWithinPartitions(*by).write.option("parquet.block.size", str(16 << 20)).parquet(out)


def browse_table(spark, out: str, bucket: str, path: str = "") -> DataFrame:
    """``browse`` from a written table: the level is a pushed filter on (bucket, parent), so only
    the row groups that may hold it are read."""
    return spark.read.parquet(out).where((F.col("bucket") == bucket) & (F.col("parent") == _folder_prefix(path)))


def browse_totals(browsed: DataFrame) -> DataFrame:
    """AGG-11: per browsed folder, how many sub-folders and files it shows."""
    return browsed.groupBy("bucket", "parent").agg(
        F.count_if(F.col("kind") == "folder").alias("total_folders"),
        F.count_if(F.col("kind") == "file").alias("total_files"),
    )


# AGG-7 ------------------------------------------------------------------------------------
def list_datasets(objects: DataFrame) -> DataFrame:
    """Top-level folders of each bucket with their AGG-5 stats."""
    st = folder_stats(objects, level=1)
    return st.select(
        "bucket", F.col("path").alias("dataset"), "file_count", "size_bytes",
        C.format_bytes("size_bytes").alias("size"), "has_children",
    )


# AGG-8 / SRT-2 ----------------------------------------------------------------------------
def bucket_sizes(objects: DataFrame) -> DataFrame:
    """Exact objects, bytes and display size per bucket."""
    out = objects.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("size_bytes").cast("long").alias("size_bytes")
    )
    return out.withColumn("size", C.format_bytes("size_bytes"))
