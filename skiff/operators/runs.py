"""Run history as an append-only event table (RUN-1..8, SRT-1, SRT-4, AGG-11, AGG-12).

Every change is an appended event row and the current state of a job is a fold over its
events by partially-aggregatable functions (``max_by``/``min_by`` with ``FILTER``), so a job
with a third of all events costs one partial row per task.

Event rows (``EVENT_SCHEMA``):

* ``kind = 'create'``   full record (RUN-1): status ``submitted``, paths, config, stages
* ``kind = 'update'``   partial update (RUN-3): non-null fields win, latest first
* ``kind = 'refresh'``  a service state observed by polling (RUN-5), in ``state``
* ``kind = 'cancel'``   user cancel (RUN-6)
* ``kind = 'job'``      the job's own report: ``running``, ``completed``, ``failed``
* ``kind = 'log'``      a log line (RUN-4, appended only if not already present)

Status rule (RUN-3/5/6), in event order: a create, an update with a status or a cancel sets
the status, the last write wins.  A refresh counts only while the job is ``submitted`` or
``running``, and one without a state (the status call failed) never counts.  So the folded
status is that of the last event that set one, if it is terminal; else the first terminal
refresh after that event, else the last refresh after it, else that event's.  A cancel is
final for the job's own reports: one counts like an update, unless a cancel came before it.

Single events are written as one small parquet file each, without a Spark job; a cancel also
leaves a mark (``_cancel/<job>``) in the table's folder, which a running job looks for.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import files
from ..functions import columns as C

EVENT_SCHEMA = (
    "job_id string, seq bigint, ts timestamp, kind string, status string, state string, "
    "log string, process_type string, selected_paths array<string>, "
    "stages map<string,string>, config map<string,string>"
)
# fixed values: the five stages, all "waiting" at creation, and what a stage can be
STAGES = ["read", "decompress", "concatenate", "write", "validate"]
STAGE_STATES = ["waiting", "in_progress", "completed", "failed"]
RECENT_DEFAULT, RECENT_MAX = 20, 100
LOG_TAIL = 50


def _order() -> F.Column:
    return F.struct("ts", "seq")


# RUN-1 / RUN-3 / RUN-6 / RUN-4: event constructors ----------------------------------------
def created(job_id: str, seq: int, paths: list[str], process_type: str, config: dict | None = None, ts: datetime | None = None) -> tuple:
    """A row of ``EVENT_SCHEMA``: the full record of a new run."""
    ts = ts or datetime.now(timezone.utc)
    return (job_id, seq, ts, "create", "submitted", None,
            f"[{ts.strftime('%Y-%m-%dT%H:%M:%S.%f')}Z] Pipeline submitted", process_type, paths,
            {s: "waiting" for s in STAGES}, config or {})


def simple(job_id: str, seq: int, kind: str, *, status=None, state=None, log=None, stages=None, config=None, ts: datetime | None = None) -> tuple:
    """A row of ``EVENT_SCHEMA`` of any other kind."""
    return (job_id, seq, ts or datetime.now(timezone.utc), kind, status, state, log, None, None, stages, config)


def create_event(spark: SparkSession, *args, **kw) -> DataFrame:
    return spark.createDataFrame([created(*args, **kw)], EVENT_SCHEMA)


def simple_event(spark: SparkSession, *args, **kw) -> DataFrame:
    return spark.createDataFrame([simple(*args, **kw)], EVENT_SCHEMA)


def append_events(events: DataFrame, table_path: str) -> None:
    """RUN-1/3/4/6: append to the run-event table (parquet, partitioned by nothing)."""
    events.write.mode("append").parquet(table_path)


def append_rows(spark: SparkSession, rows: list[tuple], table_path: str) -> None:
    """Append a few events as one file that readers see whole or not at all."""
    import uuid

    import pyarrow as pa
    import pyarrow.parquet as pq

    text, pairs = pa.string(), pa.map_(pa.string(), pa.string())
    types = [text, pa.int64(), pa.timestamp("us", tz="UTC"), *[text] * 5, pa.list_(text), pairs, pairs]
    names = [f.split()[0] for f in EVENT_SCHEMA.split(", ")]
    columns = [pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], t) for c, t in zip(zip(*rows), types)]
    sink = pa.BufferOutputStream()
    pq.write_table(pa.Table.from_arrays(columns, names=names), sink)
    files.write_whole(spark, table_path, f"part-{uuid.uuid4().hex}.parquet", sink.getvalue().to_pybytes())


def compact_events(spark: SparkSession, table_path: str, out_path: str, files: int | None = None) -> str:
    """Rewrite the run-event table (one small file per appended event) into ``files``
    files at ``out_path``, clustered by job so a job's events share row groups.

    Spark cannot overwrite a table it is reading, so the compacted copy goes to a new
    path; switch readers and writers to it, then retire the old folder.  Rows are
    unchanged, so ``fold_runs`` gives the same state on both.
    """
    events = spark.read.parquet(table_path)
    n = files or max(1, spark.sparkContext.defaultParallelism)
    events.repartition(n, "job_id").sortWithinPartitions("job_id", "ts", "seq").write.parquet(out_path)
    return out_path


def _next_seq(events: DataFrame, job_id: str) -> int:
    """The job's next event number; unknown jobs are an error."""
    row = events.where(F.col("job_id") == job_id).agg(F.max("seq"), F.count(F.lit(1))).first()
    if not row[1]:
        raise UnknownRun(f"no run {job_id!r}")
    return 0 if row[0] is None else int(row[0]) + 1


class UnknownRun(LookupError):
    pass


def read_events(spark: SparkSession, table_path: str) -> DataFrame:
    """The run-event table; empty if nothing was recorded yet."""
    if not files.exists(spark, table_path):
        return spark.createDataFrame([], EVENT_SCHEMA)
    return spark.read.schema(EVENT_SCHEMA).parquet(table_path)


def _record(spark: SparkSession, table_path: str, job_id: str, kind: str, **fields) -> None:
    seq = _next_seq(read_events(spark, table_path), job_id)
    append_rows(spark, [simple(job_id, seq, kind, **fields)], table_path)


def record_refresh(spark: SparkSession, table_path: str, job_id: str, service_state: str | None) -> None:
    """RUN-5: a polled service state.  ``None`` means the status call failed: recorded with
    no state, so it never changes the status."""
    _record(spark, table_path, job_id, "refresh", state=service_state)


def record_update(spark: SparkSession, table_path: str, job_id: str, **fields) -> None:
    """RUN-3: a partial update (status, log, stages, config)."""
    _record(spark, table_path, job_id, "update", **fields)


def record_stage(spark: SparkSession, table_path: str, job_id: str, stage: str, state: str) -> None:
    """RUN-8: one stage moves on."""
    if stage not in STAGES or state not in STAGE_STATES:
        raise ValueError(f"stage must be one of {STAGES}, its state one of {STAGE_STATES}")
    record_update(spark, table_path, job_id, stages={stage: state})


def record_cancel(spark: SparkSession, table_path: str, job_id: str) -> None:
    """RUN-6: cancel of a known run.  The job stops where it runs, in whatever session, when it
    next looks for the mark; the run is ``cancelled`` at once, whether it still runs or not."""
    _record(spark, table_path, job_id, "cancel")
    files.write(spark, f"{table_path}/_cancel/{job_id}", b"")


def is_cancelled(spark: SparkSession, table_path: str, job_id: str) -> bool:
    """Whether ``record_cancel`` left its mark: one look at the file system."""
    return files.exists(spark, f"{table_path}/_cancel/{job_id}")


def record_log(spark: SparkSession, table_path: str, job_id: str, line: str) -> None:
    """RUN-4: append a log line (duplicates are folded away by ``log_tail``)."""
    _record(spark, table_path, job_id, "log", log=line)


def get_logs(events: DataFrame, job_id: str, n: int = LOG_TAIL) -> list[str]:
    """SRT-4 for one job: its last ``n`` distinct log lines (a bounded list)."""
    row = log_tail(events.where(F.col("job_id") == job_id), n).first()
    return list(row["tail"]) if row else []


# status fold ------------------------------------------------------------------------------
def _statuses(events: DataFrame) -> DataFrame:
    """job_id, status by the rule of the module doc: two grouped passes, joined by job."""
    at = _order()
    sets = (F.col("kind") == "cancel") | (F.col("kind").isin("create", "update") & F.col("status").isNotNull())
    value = F.when(F.col("kind") == "cancel", F.lit("cancelled")).otherwise(F.col("status"))
    told = (F.col("kind") == "job") & F.col("status").isNotNull()
    last = events.groupBy("job_id").agg(
        F.max_by(F.when(sets, value), F.when(sets, at)).alias("_set"), F.max(F.when(sets, at)).alias("_at"),
        F.max_by(F.when(told, F.col("status")), F.when(told, at)).alias("_own"), F.max(F.when(told, at)).alias("_own_at"),
        F.min(F.when(F.col("kind") == "cancel", at)).alias("_cancel_at"),
    )
    # the job's own report counts if it came last and no cancel came before it
    own = F.col("_own_at").isNotNull() & (F.col("_at").isNull() | (F.col("_own_at") > F.col("_at")))
    own = own & (F.col("_cancel_at").isNull() | (F.col("_own_at") < F.col("_cancel_at")))
    last = last.select(
        "job_id", F.when(own, F.col("_own")).otherwise(F.col("_set")).alias("_set"), F.when(own, F.col("_own_at")).otherwise(F.col("_at")).alias("_at")
    )
    mapped = C.map_state("state")
    polls = events.where((F.col("kind") == "refresh") & F.col("state").isNotNull()).select("job_id", at.alias("_o"), mapped.alias("_m"))
    polls = polls.where(F.col("_m") != "unknown").join(last, "job_id").where(F.col("_at").isNull() | (F.col("_o") > F.col("_at")))
    ends = F.col("_m").isin(*C.TERMINAL_STATUSES)
    seen = polls.groupBy("job_id").agg(
        F.min_by(F.when(ends, F.col("_m")), F.when(ends, F.col("_o"))).alias("_end"), F.max_by("_m", "_o").alias("_now")
    )
    open_ = F.coalesce("_set", F.lit("submitted")).isin("submitted", "running")
    status = F.when(open_, F.coalesce("_end", "_now", "_set", F.lit("submitted"))).otherwise(F.col("_set"))
    return last.join(seen, "job_id", "left").select("job_id", status.alias("status"))


def _latest(col: str) -> F.Column:
    """RUN-3: last write wins per field; nulls do not overwrite."""
    c = F.col(col)
    return F.max_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), _order()))


def _merged_map(events: DataFrame, col: str) -> DataFrame:
    """RUN-3/RUN-8 for a map field: per key, the latest value wins (``map_concat`` in event
    order).  Grouped by ``(job, key)``, so a job's map has one row per key (stage names,
    config keys), never one row per event."""
    entries = events.where(F.col(col).isNotNull()).select(
        "job_id", "ts", "seq", F.explode(col).alias("_k", "_v")
    )
    per_key = entries.groupBy("job_id", "_k").agg(F.max_by("_v", _order()).alias("_v"))
    return per_key.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias(col))


def fold_runs(events: DataFrame) -> DataFrame:
    """RUN-2/3/5/6/8: current state of every job, one row per job."""
    extra = [c for c in ("process_type", "selected_paths") if c in events.columns]
    state = events.groupBy("job_id").agg(
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.count(F.lit(1)).alias("n_events"),
        F.max_by("state", F.when(F.col("state").isNotNull(), _order())).alias("last_state"),
        *[_latest(c).alias(c) for c in extra],
    )
    state = state.join(_statuses(events), "job_id")
    for col in ("stages", "config"):
        if col in events.columns:
            state = state.join(_merged_map(events, col), "job_id", "left")
    return state


def get_run(spark: SparkSession, table_path: str, job_id: str) -> dict:
    """RUN-2: the state of one run; an unknown id is an error."""
    row = fold_runs(read_events(spark, table_path).where(F.col("job_id") == job_id)).first()
    if row is None:
        raise UnknownRun(f"no run {job_id!r}")
    return row.asDict()


# SRT-1 / SCL-14 / SCL-16 / SCL-17 ----------------------------------------------------------
def recent_runs(runs: DataFrame, limit: int = RECENT_DEFAULT) -> DataFrame:
    """Newest jobs first, ``limit`` (default 20, at most 100) -- a top-k, not a full sort."""
    if not 1 <= limit <= RECENT_MAX:
        raise ValueError(f"limit must be in 1..{RECENT_MAX}")
    dur = F.timestamp_diff("SECOND", F.col("created_at"), F.col("updated_at"))
    top = runs.orderBy(F.col("created_at").desc(), F.col("job_id")).limit(limit)
    cols = [
        "job_id",
        "status",
        C.iso_utc("created_at").alias("created"),
        dur.alias("duration_s"),
        C.format_duration(dur).alias("duration"),
    ]
    if "process_type" in runs.columns:
        cols += ["process_type", C.process_label("process_type").alias("process")]
    return top.select(*cols)


# RUN-4 / SRT-4 ------------------------------------------------------------------------------
def log_tail(events: DataFrame, n: int = LOG_TAIL) -> DataFrame:
    """Per job: distinct log lines in order of first appearance, the last ``n`` of them.

    Set-semantics append: a repeated line keeps its first position.  The last ``n`` per job
    is a per-group top-k (``row_number() <= n``), planned with a partial limit before the
    shuffle, so only ``n`` lines per job ever meet in one place.
    """
    logs = events.where(F.col("log").isNotNull())
    first = logs.groupBy("job_id", "log").agg(F.min(_order()).alias("_first"))
    counts = first.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_logs"))
    w = Window.partitionBy("job_id").orderBy(F.col("_first").desc())
    tail = (
        first.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= n)
        .groupBy("job_id")
        .agg(F.sort_array(F.collect_list(F.struct("_first", "log"))).alias("_t"))
        .select("job_id", F.transform("_t", lambda x: x["log"]).alias("tail"))
    )
    return counts.join(tail, "job_id")


# AGG-11 / AGG-12 ----------------------------------------------------------------------------
def run_metrics(events: DataFrame) -> DataFrame:
    """Per job: events, elapsed seconds, events per second, formatted duration."""
    runs = events.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("ts").alias("_start"),
        F.max("ts").alias("_end"),
    )
    el = F.timestamp_diff("SECOND", F.col("_start"), F.col("_end"))
    return runs.select(
        "job_id",
        "records",
        el.alias("elapsed_s"),
        F.when(el > 0, F.col("records") / el).alias("records_per_s"),
        C.format_duration(el).alias("duration"),
    )
