"""The transport job end to end: select -> list -> gate -> read -> write -> record.

The selected prefixes alone are listed, once, into a table in the shared folder, so the gate
and the read see the same objects.  Every selected file is read once; what was read and a
per-file manifest are staged together, and the manifest decides which lines count (see
``bz2_reader``).  ``decompress_only`` writes its outputs in the read stage instead.  The
counters (AGG-10) come from the manifest the job writes beside its output, so they stay exact
when tasks or stages are retried; a run shows them as soon as its read is staged.

A run moves through its stages (RUN-8) step by step, records its progress while Spark works,
and can be cancelled from any session (RUN-6): its Spark jobs are stopped, what it wrote is
taken away, and it stays ``cancelled``.
"""

from __future__ import annotations

import itertools
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files as fs
from ..functions import columns as C
from ..operators import ndjson, runs, select, transport
from ..session import materialize, scratch, shared_dir
from ..sources import bz2_reader
from ..sources.objects import list_objects
from ..sources.registry import open_source

# fixed values: process types and what each writes
PROCESS_TYPES = [
    "decompress_only",
    "decompress_and_concatenate",
    "decompress_concatenate_parse",
    "direct_to_bigquery",
]


@dataclass
class JobConfig:
    source_root: str  # listing root of the source bucket
    source_bucket: str
    selected_paths: list[str] | None = None  # or ``selection`` as a DataFrame(bucket, path)
    selection: DataFrame | None = None
    output: str = ""
    source_type: str = "betfair"
    process_type: str = "decompress_and_concatenate"
    output_shards: int = transport.DEFAULT_SHARDS  # <= 0: sized from the bytes read
    compression: str = "none"
    boundary: str = "path"
    skip_validation: bool = False
    poll_s: float = 2.0  # how often a running job looks for a cancel
    progress_s: float = 15.0  # how often it records how far its Spark jobs are
    job_id: str = field(default_factory=lambda: f"run-{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:10]}")


SHARD_TARGET_BYTES = 1 << 30  # automatic shard count: about 1 GB of text per shard
EXPANSION = 6  # typical bz2 expansion of line text, for sizing only


class RunCancelled(RuntimeError):
    """The run was cancelled while it worked."""


class _Watch:
    """Looks for a cancel while Spark works for a run, and records how far it is.

    The run's Spark jobs carry a tag, by which a cancel stops them and their tasks are
    counted; steps between Spark jobs call ``check``.
    """

    def __init__(self, spark: SparkSession, cfg: JobConfig, runs_table: str, record):
        self.spark, self.cfg, self.table, self.record = spark, cfg, runs_table, record
        self.tag = f"skiff-{cfg.job_id}"
        self.cancelled, self.ended = threading.Event(), threading.Event()
        self.thread = threading.Thread(target=self._look, daemon=True)

    def __enter__(self) -> _Watch:
        self.spark.sparkContext.addJobTag(self.tag)
        self.thread.start()
        return self

    def __exit__(self, *_exc) -> None:
        self.ended.set()
        self.thread.join()
        self.spark.sparkContext.removeJobTag(self.tag)

    def _look(self) -> None:
        told = time.monotonic()
        while not self.ended.wait(self.cfg.poll_s):
            if not self.cancelled.is_set() and runs.is_cancelled(self.spark, self.table, self.cfg.job_id):
                self.cancelled.set()
            if self.cancelled.is_set():
                self.spark.sparkContext.cancelJobsWithTag(self.tag)  # again and again: one may just have begun
            elif time.monotonic() - told >= self.cfg.progress_s:
                told = time.monotonic()
                done, every = self.tasks()
                self.record(config={"tasks_done": str(done), "tasks": str(every)})

    def tasks(self) -> tuple[int, int]:
        """Tasks that are done, and all tasks, of the run's active Spark jobs."""
        tracker = self.spark.sparkContext._jsc.sc().statusTracker()
        done = every = 0
        for job in list(tracker.getJobIdsForTag(self.tag)):
            info = tracker.getJobInfo(job)
            for stage in list(info.get().stageIds()) if info.isDefined() and str(info.get().status()) == "RUNNING" else ():
                s = tracker.getStageInfo(stage)
                if s.isDefined():
                    done, every = done + s.get().numCompletedTasks(), every + s.get().numTasks()
        return done, every

    def check(self) -> None:
        if self.cancelled.is_set() or runs.is_cancelled(self.spark, self.table, self.cfg.job_id):
            self.cancelled.set()
            raise RunCancelled(f"run {self.cfg.job_id} was cancelled")


def _auto_shards(bytes_read: int) -> int:
    return max(1, int(bytes_read * EXPANSION // SHARD_TARGET_BYTES) + 1)


def _places(spark: SparkSession, cfg: JobConfig) -> dict:
    """Where a run's output and its per-file manifest go.  Text goes to a new folder; the
    table keeps the rows and manifests of its runs apart, so a run can be made again."""
    out = fs.qualified(spark, cfg.output)
    if cfg.process_type == "direct_to_bigquery":
        return {"output": f"{out}/table", "manifest": f"{out}/_manifest/run={cfg.job_id}"}
    return {"output": f"{out}/inputs" if cfg.process_type == "decompress_only" else f"{out}/lines", "manifest": f"{out}/_manifest"}


def _written(spark: SparkSession, cfg: JobConfig, place: dict) -> str:
    """The folder that is this run's own."""
    return f"{place['output']}/run={cfg.job_id}" if cfg.process_type == "direct_to_bigquery" else place["output"]


def _read_and_write(spark: SparkSession, cfg: JobConfig, spec, files: DataFrame, place: dict, step) -> int:
    """Write the output and its manifest; how many output files there are.

    ``step(in_progress, completed, **facts)`` moves the run's stages on."""
    root = fs.qualified(spark, cfg.source_root)
    if cfg.process_type == "decompress_only":
        step(["read", "decompress", "write"])
        tasks = bz2_reader.plan_tasks(files, 128 << 20)
        transport.write_inputs(files, root, place["output"], cfg.compression, tasks).write.parquet(place["manifest"])
        # (nothing is concatenated: the stage is over with the others)
        step(["validate"], ["read", "decompress", "concatenate", "write"])
        return fs.count_files(spark, place["output"], "")
    step(["read", "decompress"])
    raw = spec.reader(spark, files)
    # from the staged manifest rows, not an ``Observation``: the session that keeps one cannot
    # ship Spark ML models any more (their training summaries hold the session)
    facts = bz2_reader.counters_of(bz2_reader.manifest_of(raw)).first().asDict()
    step(["concatenate", "write"], ["read", "decompress"], **facts)
    lines, manifest = bz2_reader.lines_of(raw), bz2_reader.manifest_of(raw)
    if cfg.process_type == "direct_to_bigquery":
        # table sink: lines with their source key, ISO date of the key and parsed VARIANT
        key = F.expr(f"substring(path, {len(root) + 2})")
        doc = F.when(ndjson.is_valid_json("value"), F.try_parse_json("value"))
        t = lines.select(key.alias("key"), "line_no", "value", doc.alias("doc")).withColumn("date", C.extract_date("key"))
        target = transport.write_table(t, place["output"], partition_by=["date"], run=cfg.job_id)
        written = fs.count_files(spark, target, "part-")
    else:
        shards = cfg.output_shards if cfg.output_shards > 0 else _auto_shards(facts["bytes_read"])
        split = None
        if cfg.process_type == "decompress_concatenate_parse":
            lines, split = ndjson.validate(lines), "valid"
        # hash on the unique (path, line_no): even shards, the same when a task is run again
        written = len(transport.write_shards(lines, place["output"], shards, cfg.compression, split, ["path", "line_no"]))
    manifest.write.mode("overwrite" if _is_table(cfg) else "errorifexists").parquet(place["manifest"])
    step(["validate"], ["concatenate", "write"])
    return written


def _is_table(cfg: JobConfig) -> bool:
    return cfg.process_type == "direct_to_bigquery"


def run_transport(spark: SparkSession, cfg: JobConfig, runs_table: str | None = None) -> dict:
    """Run one transport job; returns counters, output and the run's final status.

    Its listing, staged read and other intermediate tables are deleted at the end.  An unknown
    or disabled source and a selection that fails the gate, or has no file, are errors before
    anything is written or recorded.  A run that is cancelled while it works takes its output
    away and raises ``RunCancelled``.
    """
    with scratch(spark):
        return _run(spark, cfg, runs_table)


def _run(spark: SparkSession, cfg: JobConfig, runs_table: str | None) -> dict:
    if cfg.process_type not in PROCESS_TYPES:
        raise ValueError(f"process_type must be one of {PROCESS_TYPES}")
    if cfg.compression not in transport.COMPRESSIONS:
        raise ValueError(f"compression must be one of {transport.COMPRESSIONS}")
    runs_table = fs.qualified(spark, runs_table or f"{shared_dir(spark)}/skiff-runs")
    spec = open_source(cfg.source_type)
    if cfg.process_type == "decompress_only" and spec.compression != "bz2":
        raise ValueError(f"decompress_only copies bz2 files, not {spec.compression}")
    sel = cfg.selection
    if sel is None:
        sel = select.selection(spark, cfg.source_bucket, list(cfg.selected_paths or []))
    paths = [] if cfg.selected_paths is None else list(cfg.selected_paths)
    t0 = time.perf_counter()
    phases: dict[str, float] = {}

    def mark(name, since=[t0]):  # noqa: B006 -- running clock
        now = time.perf_counter()
        phases[name] = round(now - since[0], 3)
        since[0] = now

    # the table sink parses VARIANTs: its frames live in a session that takes repeated keys
    work = ndjson.session_beside(spark) if _is_table(cfg) else spark
    # the pattern set is selection-sized: computed once, shared by listing, gate and read
    patterns = materialize(spec.build_patterns(sel), "patterns", work)
    reduced = materialize(select.reduce_prefixes(select.prefixes_of(patterns).where(F.col("bucket") == cfg.source_bucket), cfg.boundary), "prefixes")
    listing = list_objects(work, cfg.source_root, cfg.source_bucket, reduced, boundary=cfg.boundary)
    mark("list")
    exts = tuple(spec.extensions)
    gate_row = None
    if not cfg.skip_validation:
        # the gate counts by the boundary and suffixes that the read uses
        per = select.validate_patterns(listing, patterns, boundary=cfg.boundary, exts=exts)
        gate_row = select.gate(select.validation_summary(per))
    files = materialize(select.select_objects(listing, patterns, cfg.boundary, exts), "files")
    total = files.agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b")).first()
    if not total.n:
        raise select.ValidationError("the selection has no file to read")
    mark("gate")
    # RUN-1: the run is recorded once the submission passed the gate (a rejected submission
    # leaves no record); this job numbers its events itself: no look at the table
    seq = itertools.count()
    config = {"output": cfg.output, "shards": str(cfg.output_shards), "compression": cfg.compression, "bytes_total": str(total.b or 0), "files": str(total.n)}
    runs.append_rows(spark, [runs.created(cfg.job_id, next(seq), paths, cfg.process_type, config)], runs_table)
    stages = dict.fromkeys(runs.STAGES, "waiting")

    def record(kind: str = "update", **fields) -> None:
        runs.append_rows(spark, [runs.simple(cfg.job_id, next(seq), kind, **fields)], runs_table)

    def step(begun: list[str], done: list[str] = (), **facts) -> None:
        """Stages move on; ``facts`` known by now (counters) are shown with the run."""
        watch.check()
        moved = {**dict.fromkeys(done, "completed"), **dict.fromkeys(begun, "in_progress")}
        stages.update(moved)
        secs = time.perf_counter() - t0
        if "lines_yielded" in facts:
            facts["records_per_s"] = facts["lines_yielded"] / secs
        record("job", status="running", stages=moved, config={k: str(v) for k, v in {**facts, "elapsed_s": secs}.items()})

    place = _places(work, cfg)
    new = not fs.children(work, _written(work, cfg, place))
    try:
        with _Watch(spark, cfg, runs_table, record) as watch:
            written = _read_and_write(work, cfg, spec, files, place, step)
            mark("read_write")
            counters = {k: int(v) for k, v in bz2_reader.counters_of(spark.read.parquet(place["manifest"])).first().asDict().items()}
            watch.check()
    except Exception as e:  # noqa: BLE001 -- recorded, then re-raised
        open_ = [s for s, v in stages.items() if v == "in_progress"]
        if watch.cancelled.is_set():
            if new:
                fs.delete(work, _written(work, cfg, place))
                fs.delete(work, place["manifest"])
            record("job", log="run cancelled", stages=dict.fromkeys(open_, "failed"))
            raise RunCancelled(f"run {cfg.job_id} was cancelled") from e
        record("job", status="failed", log=f"run failed: {e}", stages=dict.fromkeys(open_, "failed"))
        raise
    metrics = transport.run_metrics_row(counters, time.perf_counter() - t0, written)
    # AGG-10 / AGG-12 recorded with the run
    kept = {k: str(v) for k, v in metrics.items() if v is not None}
    record("job", status="completed", log="run completed", stages={"validate": "completed"}, config=kept)
    # a cancel that came in between has the last word
    status = "cancelled" if runs.is_cancelled(spark, runs_table, cfg.job_id) else "completed"
    return {"job_id": cfg.job_id, "status": status, "gate": gate_row, **place, **metrics, "runs_table": runs_table, "phases": phases}


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    """The per-file manifest a run wrote beside its output: path, bytes, lines, error (and
    run, for a table with the rows of several)."""
    return spark.read.parquet(f"{out.rstrip('/')}/_manifest")
