"""Session helpers: a tuned local session for tests/bench and a shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

from . import files

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "skiff") -> SparkSession:
    """Session for tests and the bench.  On a cluster, use the cluster's session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    Read from the session.  Where it is unset, a local session (tests) gets a folder of its
    own; on a cluster that is an error, as no folder of one machine will do.
    """
    d = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skiff-ckpt-"))
        d = spark.sparkContext.getCheckpointDir()
    return files.qualified(spark, d)


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh (not yet existing) sub-folder of the shared folder for one run's output."""
    base = shared_dir(spark)
    return f"{base}/skiff-{label}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``skiff`` importable in Python workers (what ``--py-files skiff.zip`` does).

    Zips the package once per application into the shared folder and adds it with
    ``addPyFile``; a no-op when already shipped.
    """
    import hashlib
    import io
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _dirs, names in os.walk(pkg_dir):
            for f in sorted(names):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    arc = os.path.relpath(full, os.path.dirname(pkg_dir))
                    zf.write(full, arc)
    data = buf.getvalue()
    name = f"skiff-{hashlib.sha1(data).hexdigest()[:12]}.zip"
    target = f"{shared_dir(spark)}/{name}"
    files.write(spark, target, data)
    sc.addPyFile(target)
    _SHIPPED.add(app)


_MADE: list[str] = []
_OPEN = 0


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialize`` writes inside the block are deleted at its end; what the
    block hands on must be written elsewhere by then."""
    global _OPEN
    mark = len(_MADE)
    _OPEN += 1
    try:
        yield
    finally:
        _OPEN -= 1
        for path in _MADE[mark:]:
            files.delete(spark, path)
        del _MADE[mark:]


def materialize(df, label: str, spark: SparkSession | None = None):
    """Write a derived DataFrame once as a parquet table in the shared folder and read it
    back (in its own session or the given one): later plans scan the table instead of
    recomputing its lineage, and the copy survives executor loss (unlike a cache)."""
    path = run_dir(df.sparkSession, label)
    if _OPEN:
        _MADE.append(path)
    df.write.parquet(path)
    return (spark or df.sparkSession).read.parquet(path)
