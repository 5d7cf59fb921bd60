"""Run history fold (RUN-*), recent list (SRT-1), log tail (SRT-4, RUN-4)."""

from datetime import datetime, timedelta

import pytest

from skiff.operators import runs

T0 = datetime(2024, 1, 1)


def ev(job, seq, kind, status=None, state=None, log=None, process_type=None, stages=None, config=None):
    return (job, seq, T0 + timedelta(minutes=seq), kind, status, state, log, process_type, None, stages, config)


def fold(spark, rows):
    df = spark.createDataFrame(rows, runs.EVENT_SCHEMA)
    return {r.job_id: r for r in runs.fold_runs(df).collect()}


def test_status_rules(spark):
    rows = [
        # created, running, done, later a stale "running": completed sticks
        ev("j1", 0, "create", status="submitted", process_type="decompress_only"),
        ev("j1", 1, "refresh", state="JOB_STATE_RUNNING"),
        ev("j1", 2, "refresh", state="JOB_STATE_DONE"),
        ev("j1", 3, "refresh", state="JOB_STATE_RUNNING"),
        # cancel wins even after completion
        ev("j2", 0, "create", status="submitted"),
        ev("j2", 1, "refresh", state="JOB_STATE_DONE"),
        ev("j2", 2, "cancel"),
        # unknown state from the service maps to running; pending back to submitted
        ev("j3", 0, "create", status="submitted"),
        ev("j3", 1, "refresh", state="JOB_STATE_RUNNING"),
        ev("j3", 2, "refresh", state="JOB_STATE_PENDING"),
        # nothing but the create
        ev("j4", 0, "create", status="submitted"),
        # failure
        ev("j5", 0, "create", status="submitted"),
        ev("j5", 1, "refresh", state="JOB_STATE_WEIRD"),
        ev("j5", 2, "refresh", state="JOB_STATE_FAILED"),
        ev("j5", 3, "refresh", state="JOB_STATE_DONE"),
    ]
    f = fold(spark, rows)
    assert {j: r.status for j, r in f.items()} == {
        "j1": "completed", "j2": "cancelled", "j3": "submitted", "j4": "submitted", "j5": "failed"
    }
    assert f["j1"].n_events == 4 and f["j1"].process_type == "decompress_only"
    assert f["j1"].last_state == "JOB_STATE_RUNNING"


def sequential(rows):
    """The status of each job by going through its events in order."""
    mapped = {"JOB_STATE_RUNNING": "running", "JOB_STATE_DONE": "completed", "JOB_STATE_FAILED": "failed",
              "JOB_STATE_CANCELLED": "cancelled", "JOB_STATE_PENDING": "submitted", "JOB_STATE_QUEUED": "submitted"}
    status = {}
    for job, _seq, _ts, kind, st, state, *_ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        now = status.setdefault(job, "submitted")
        if kind == "cancel":
            status[job] = "cancelled"
        elif kind in ("create", "update") and st is not None:
            status[job] = st
        elif kind == "refresh" and state is not None and now in ("submitted", "running"):
            status[job] = mapped.get(state, "running")
    return status


def test_status_equals_the_sequential_rule(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for j in range(200):
        for k in range(rnd.randint(1, 8)):
            kind = rnd.choice(["create", "update", "refresh", "refresh", "refresh", "cancel", "log"])
            status = rnd.choice([None, "submitted", "running", "completed", "failed"]) if kind == "update" else "submitted" if kind == "create" else None
            state = rnd.choice([None, "JOB_STATE_RUNNING", "JOB_STATE_DONE", "JOB_STATE_FAILED", "JOB_STATE_PENDING", "ODD"]) if kind == "refresh" else None
            rows.append(ev(f"j{j}", k, kind, status=status, state=state))
    assert {j: r.status for j, r in fold(spark, rows).items()} == sequential(rows)


def test_polled_run_completes(spark):
    rows = [
        ev("j", 0, "create", status="submitted"), ev("j", 1, "refresh", state="JOB_STATE_RUNNING"),
        ev("j", 2, "update", status="completed"), ev("j", 3, "refresh", state="JOB_STATE_RUNNING"),
        ev("k", 0, "create", status="submitted"), ev("k", 1, "refresh", state="JOB_STATE_DONE"), ev("k", 2, "update", status="running"),
        ev("k", 3, "refresh", state="JOB_STATE_FAILED"),
    ]
    f = fold(spark, rows)
    assert (f["j"].status, f["k"].status) == ("completed", "failed")


def test_unknown_runs_are_errors(spark, tmp_path):
    table = str(tmp_path / "runs")
    for call in (runs.record_cancel, runs.get_run):
        with pytest.raises(runs.UnknownRun):
            call(spark, table, "no-such-job")
    assert not (tmp_path / "runs").exists()
    runs.append_events(runs.create_event(spark, "j", 0, ["a"], "decompress_only"), table)
    with pytest.raises(runs.UnknownRun):
        runs.record_log(spark, table, "other", "x")
    runs.record_stage(spark, table, "j", "read", "in_progress")
    got = runs.get_run(spark, table, "j")
    assert got["status"] == "submitted" and got["stages"]["read"] == "in_progress" and got["stages"]["write"] == "waiting"
    with pytest.raises(ValueError):
        runs.record_stage(spark, table, "j", "nosuch", "in_progress")


def test_command_line(spark, tmp_path, capsys):
    import json

    from skiff.__main__ import main

    table = str(tmp_path / "runs")
    assert main(["cancel", "--runs-table", table, "--job-id", "no-such-job"]) == 1
    assert "error" in json.loads(capsys.readouterr().out)
    runs.append_events(runs.create_event(spark, "j", 0, ["a"], "decompress_only"), table)
    assert main(["cancel", "--runs-table", table, "--job-id", "j"]) == 0
    capsys.readouterr()
    assert main(["status", "--runs-table", table, "--job-id", "j"]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "cancelled"
    assert main(["logs", "--runs-table", table, "--job-id", "j"]) == 0
    assert len(json.loads(capsys.readouterr().out)["logs"]) == 1
    assert main(["history", "--runs-table", table]) == 0
    assert [r["job_id"] for r in json.loads(capsys.readouterr().out)["jobs"]] == ["j"]


def test_partial_update_last_write_wins(spark):
    rows = [
        ev("j", 0, "create", status="submitted", process_type="a"),
        ev("j", 1, "update", process_type="b"),
        ev("j", 2, "update", process_type=None),
    ]
    assert fold(spark, rows)["j"].process_type == "b"


def test_log_tail_set_semantics(spark):
    rows = [ev("j", i, "log", log=f"line {i % 60}") for i in range(80)]
    df = spark.createDataFrame(rows, runs.EVENT_SCHEMA)
    r = runs.log_tail(df, 50).first()
    assert r.n_logs == 60
    # a repeated line keeps its first position: the tail is lines 10..59 in first-seen order
    assert r.tail == [f"line {i}" for i in range(10, 60)]


def test_recent_runs_bounds(spark):
    rows = [ev(f"j{i:03d}", i, "create", status="submitted", process_type="decompress_only") for i in range(30)]
    df = spark.createDataFrame(rows, runs.EVENT_SCHEMA)
    top = runs.recent_runs(runs.fold_runs(df), 20).collect()
    assert [r.job_id for r in top] == [f"j{i:03d}" for i in range(29, 9, -1)]
    assert top[0].process == "Decomp" and top[0].duration == "-"
    with pytest.raises(ValueError):
        runs.recent_runs(runs.fold_runs(df), 101)


def test_stage_and_config_maps_merge_per_key(spark):
    rows = [
        ev("j", 0, "create", status="submitted", stages={s: "waiting" for s in runs.STAGES}, config={"shards": "10"}),
        ev("j", 1, "update", stages={"read": "in_progress"}),
        ev("j", 2, "update", stages={"read": "completed", "decompress": "in_progress"}, config={"files": "3"}),
    ]
    f = fold(spark, rows)["j"]
    assert f.stages == {"read": "completed", "decompress": "in_progress", "concatenate": "waiting",
                        "write": "waiting", "validate": "waiting"}
    assert f.config == {"shards": "10", "files": "3"}


def test_record_helpers(spark, tmp_path):
    table = str(tmp_path / "runs")
    runs.append_events(runs.create_event(spark, "j", 0, ["a"], "decompress_only"), table)
    runs.record_refresh(spark, table, "j", "JOB_STATE_RUNNING")
    runs.record_refresh(spark, table, "j", None)  # failed status call: no change
    runs.record_log(spark, table, "j", "step 1")
    runs.record_log(spark, table, "j", "step 1")
    ev = spark.read.parquet(table)
    assert runs.fold_runs(ev).first().status == "running"
    assert runs.get_logs(ev, "j")[-1] == "step 1" and len(runs.get_logs(ev, "j")) == 2
    runs.record_cancel(spark, table, "j")
    assert runs.fold_runs(spark.read.parquet(table)).first().status == "cancelled"
    assert sorted(r.seq for r in spark.read.parquet(table).collect()) == [0, 1, 2, 3, 4, 5]


def test_compact_events(spark, tmp_path):
    table = str(tmp_path / "runs")
    for i in range(6):
        runs.append_events(spark.createDataFrame([ev(f"j{i % 2}", i, "refresh", state="JOB_STATE_RUNNING")],
                                                 runs.EVENT_SCHEMA), table)
    out = runs.compact_events(spark, table, str(tmp_path / "compact"), files=1)
    import glob
    assert len(glob.glob(out + "/*.parquet")) == 1
    before = sorted(tuple(r) for r in runs.fold_runs(spark.read.parquet(table)).collect())
    after = sorted(tuple(r) for r in runs.fold_runs(spark.read.parquet(out)).collect())
    assert before == after
