"""End-to-end transport job and the sinks (SNK-1..6), with the reference's recorded
regressions (empty output, files processed twice) as permanent tests."""

import bz2
import gzip
import os

import pytest
from pyspark.sql import functions as F

from skiff.operators import ndjson, runs, select, shards, transport
from skiff.plans.job import JobConfig, read_manifest, run_transport


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    d = tmp_path_factory.mktemp("src")
    files = {
        "2016/Jan/1/m1.bz2": b'{"m":1}\n{"m":2}\n',
        "2016/Jan/1/m2.bz2": b'{"m":3}\n\n  \n{"m":4} x\n',
        "2016/Jan/10/m3.bz2": b'{"m":5,"m":5}\n',
        "2016/Feb/2/m4.bz2": b'{"m":6}\n',
        "2016/Feb/2/bad.bz2": None,
    }
    for k, text in files.items():
        p = d / k
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(bz2.compress(text) if text is not None else b"corrupt")
    return str(d)


def _cfg(source, out, **kw):
    return JobConfig(source_root=source, source_bucket="bk", output=out, **kw)


def test_concatenate_job(spark, source, tmp_path):
    out = str(tmp_path / "out")
    runs_table = str(tmp_path / "runs")
    res = run_transport(spark, _cfg(source, out, selected_paths=["2016/Jan/1", "2016/Jan", "2016/Feb/"],
                                    output_shards=3), runs_table)
    # overlapping selections: every file once (regression: files processed twice)
    assert res["files_processed"] == 4 and res["files_failed"] == 1
    assert res["lines_yielded"] == 6
    assert res["output"].endswith("/out/lines") and res["output_files"] == 3
    names = sorted(n for n in os.listdir(tmp_path / "out" / "lines") if not n.startswith("."))
    assert names == ["_SUCCESS", "_shards.json", *(f"output-{i:05d}-of-00003.ndjson" for i in range(3))]
    lines = sorted(r.value for r in transport.read_shards(spark, res["output"]).collect())
    assert lines == sorted(['{"m":1}', '{"m":2}', '{"m":3}', '{"m":4} x', '{"m":5,"m":5}', '{"m":6}'])
    man = {os.path.basename(r.path): r for r in read_manifest(spark, out).collect()}
    assert man["bad.bz2"].error and man["m2.bz2"].lines == 2
    state = runs.fold_runs(spark.read.parquet(runs_table)).first()
    assert state.status == "completed" and state.n_events == 5
    assert state.stages == {s: "completed" for s in runs.STAGES}
    assert state.config["files_processed"] == "4" and state.config["lines_yielded"] == "6"
    assert state.config["shards"] == "3" and state.config["files"] == "5" and float(state.config["records_per_s"]) > 0
    assert int(state.config["bytes_total"]) == res["bytes_read"]
    # RUN-8: step by step, each stage in progress before it is completed; AGG-10 after the read
    told = [(r.stages, r.config) for r in spark.read.parquet(runs_table).where("kind = 'job'").orderBy("seq").collect()]
    assert [s for s, _ in told] == [
        {"read": "in_progress", "decompress": "in_progress"},
        {"read": "completed", "decompress": "completed", "concatenate": "in_progress", "write": "in_progress"},
        {"concatenate": "completed", "write": "completed", "validate": "in_progress"}, {"validate": "completed"},
    ]
    assert (told[1][1]["lines_yielded"], told[1][1]["files_failed"], told[1][1]["bytes_read"]) == ("6", "1", str(res["bytes_read"]))


def test_jobs_leave_the_session_fit_for_models(spark, source, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    run_transport(spark, _cfg(source, str(tmp_path / "out"), selected_paths=["2016"]), str(tmp_path / "r"))
    rows = spark.createDataFrame([(float(i), float(i % 2)) for i in range(20)], "x double, label double")
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=2, seed=1).fit(rows)
    assert model.transform(rows).select("probability").count() == 20
    assert len(model.transform(rows).select("probability").collect()) == 20


def test_gate_blocks_empty_selection(spark, source, tmp_path):
    # regression: empty output -- a selection that matches nothing never runs
    with pytest.raises(select.ValidationError):
        run_transport(spark, _cfg(source, str(tmp_path / "o"), selected_paths=["nosuch"]), str(tmp_path / "r"))
    assert not (tmp_path / "r").exists() and not (tmp_path / "o").exists()


def test_prefix_boundary_reproduces_sibling_leak(spark, source, tmp_path):
    out = str(tmp_path / "out")
    res = run_transport(spark, _cfg(source, out, selected_paths=["2016/Jan/1"], boundary="prefix"), str(tmp_path / "r"))
    assert res["files_processed"] == 3  # Jan/1 and Jan/10
    res = run_transport(spark, _cfg(source, str(tmp_path / "o2"), selected_paths=["2016/Jan/1"]), str(tmp_path / "r"))
    assert res["files_processed"] == 2
    res = run_transport(spark, _cfg(source, str(tmp_path / "o3"), selected_paths=["2016/Jan/1", "2016/Jan/10", "2016/Jan/1/m2.bz2"]), str(tmp_path / "r"))
    assert res["files_processed"] == 3


@pytest.mark.parametrize("compression", ["none", "gzip", "snappy"])
def test_decompress_only_layout(spark, source, tmp_path, compression):
    out = str(tmp_path / "per")
    res = run_transport(spark, _cfg(source, out, selected_paths=["2016"], process_type="decompress_only", compression=compression),
                        str(tmp_path / "r"))
    assert (res["files_processed"], res["files_failed"], res["lines_yielded"], res["output_files"]) == (4, 1, 6, 4)
    suffix = {"none": "", "gzip": ".gz", "snappy": ".snappy"}[compression]
    assert {r.rel_path: r.value for r in transport.read_inputs(spark, res["output"]).collect()} == {
        f"2016/Jan/1/m1{suffix}": '{"m":1}\n{"m":2}\n', f"2016/Jan/1/m2{suffix}": '{"m":3}\n{"m":4} x\n',
        f"2016/Jan/10/m3{suffix}": '{"m":5,"m":5}\n', f"2016/Feb/2/m4{suffix}": '{"m":6}\n',
    }
    left = [f for _d, _s, names in os.walk(tmp_path / "per" / "inputs") for f in names if "inprogress" in f]
    assert not left
    assert {r.output for r in read_manifest(spark, out).collect()} >= {f"2016/Jan/1/m1{suffix}", None}


def test_decompress_only_takes_back_a_broken_later_stream(spark, tmp_path):
    import random

    rnd = random.Random(2)
    body = "\n".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(200)) for _ in range(20_000)).encode()
    second = bytearray(bz2.compress(body, 1))
    second[-400_000:-399_000] = bytes(1000)
    (tmp_path / "s" / "a").mkdir(parents=True)
    (tmp_path / "s" / "a" / "x.bz2").write_bytes(bz2.compress(b"one\ntw") + bytes(second))
    (tmp_path / "s" / "a" / "empty.bz2").write_bytes(bz2.compress(b"\n \n"))
    res = run_transport(spark, _cfg(str(tmp_path / "s"), str(tmp_path / "o"), selected_paths=["a"], process_type="decompress_only"), str(tmp_path / "r"))
    got = {r.rel_path: r.value for r in transport.read_inputs(spark, res["output"]).collect()}
    assert got.get("a/x") == "one\ntw\n" and (tmp_path / "o" / "inputs" / "a" / "empty").read_bytes() == b""


def test_parse_split(spark, source, tmp_path):
    out = str(tmp_path / "parse")
    res = run_transport(spark, _cfg(source, out, selected_paths=["2016"], process_type="decompress_concatenate_parse"),
                        str(tmp_path / "r"))
    assert (res["files_processed"], res["files_failed"], res["lines_yielded"]) == (4, 1, 6)
    assert res["output_files"] == 2 and shards.committed_shards(spark, res["output"])[0][0] == "valid=false/output-00000-of-00001.ndjson"
    rows = ndjson.read_split(spark, res["output"]).collect()
    assert [r.value for r in rows if not r.valid] == ['{"m":4} x'] and len(rows) == 6


def test_table_sink(spark, source, tmp_path):
    out = str(tmp_path / "tbl")
    res = run_transport(spark, _cfg(source, out, selected_paths=["2016"], process_type="direct_to_bigquery"),
                        str(tmp_path / "r"))
    assert (res["files_processed"], res["files_failed"], res["lines_yielded"]) == (4, 1, 6)
    t = spark.read.parquet(res["output"])
    assert t.count() == 6
    assert t.where(F.col("doc").isNull()).count() == 1
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") == "false"


def test_gate_and_read_agree(spark, source, tmp_path):
    # only Jan/10 exists under that start: nothing to read by the path rule, so nothing is written
    (tmp_path / "s" / "Jan" / "10").mkdir(parents=True)
    (tmp_path / "s" / "Jan" / "10" / "a.bz2").write_bytes(bz2.compress(b"x"))
    cfg = dict(selected_paths=["Jan/1"])
    for extra in ({}, {"skip_validation": True}):
        with pytest.raises(select.ValidationError):
            run_transport(spark, _cfg(str(tmp_path / "s"), str(tmp_path / "o"), **cfg, **extra), str(tmp_path / "r"))
    assert not (tmp_path / "o").exists() and not (tmp_path / "r").exists()


def test_disabled_and_unknown_sources(spark, source, tmp_path):
    for kind in ("racing_api", "nosuch"):
        with pytest.raises(ValueError):
            run_transport(spark, _cfg(source, str(tmp_path / "o"), selected_paths=["2016"], source_type=kind), str(tmp_path / "r"))
    assert not (tmp_path / "r").exists()


def test_json_source_is_read_by_its_reader(spark, tmp_path):
    from dataclasses import replace

    from skiff.sources import registry

    registry.register_source(replace(registry.get_source("racing_api"), id="json_on", enabled=True))
    (tmp_path / "s" / "d").mkdir(parents=True)
    (tmp_path / "s" / "d" / "a.json").write_text('[{"a":1},{"a":2}]')
    (tmp_path / "s" / "d" / "b.json.gz").write_bytes(gzip.compress(b'[{"a":3}]'))
    (tmp_path / "s" / "d" / "c.json").write_text("oops")
    res = run_transport(spark, _cfg(str(tmp_path / "s"), str(tmp_path / "o"), selected_paths=["d"], source_type="json_on"), str(tmp_path / "r"))
    assert (res["files_processed"], res["files_failed"], res["lines_yielded"]) == (2, 1, 3)
    assert sorted(r.value for r in transport.read_shards(spark, res["output"]).collect()) == ['{"a":1}', '{"a":2}', '{"a":3}']
    del registry._SOURCES["json_on"]


def test_failed_run_is_recorded(spark, source, tmp_path):
    (tmp_path / "o" / "lines").mkdir(parents=True)  # the output is there already
    (tmp_path / "o" / "lines" / "x").write_text("x")
    table = str(tmp_path / "r")
    with pytest.raises(Exception):
        run_transport(spark, _cfg(source, str(tmp_path / "o"), selected_paths=["2016"]), table)
    state = runs.fold_runs(spark.read.parquet(table)).first()
    assert state.status == "failed" and state.stages["read"] == "completed" and state.stages["write"] == "failed"
    assert state.stages["validate"] == "waiting" and (tmp_path / "o" / "lines" / "x").exists()


def test_table_run_again_replaces_its_rows(spark, source, tmp_path):
    def job(run, paths):
        cfg = _cfg(source, str(tmp_path / "t"), selected_paths=paths, process_type="direct_to_bigquery", job_id=run)
        return run_transport(spark, cfg, str(tmp_path / "r"))

    assert job("one", ["2016/Jan"])["output_files"] >= 1
    job("two", ["2016/Feb"])
    res = job("one", ["2016/Jan/10"])
    rows = spark.read.parquet(res["output"]).groupBy("run").count().collect()
    assert sorted((r.run, r["count"]) for r in rows) == [("one", 1), ("two", 1)]
    assert sorted(r.run for r in read_manifest(spark, str(tmp_path / "t")).collect()) == ["one", "two", "two"]


class _Slow:
    """A reader whose tasks take a minute."""

    def __call__(self, spark, files):
        def wait(batches):
            import time

            time.sleep(60)
            yield from batches

        files.repartition(2).mapInArrow(wait, files.schema).write.format("noop").mode("overwrite").save()
        raise AssertionError("not cancelled")


@pytest.mark.parametrize("kind", ["decompress_and_concatenate", "direct_to_bigquery"])
def test_cancel_stops_a_running_job(spark, source, tmp_path, kind):
    import threading
    import time
    from dataclasses import replace

    from skiff.plans.job import RunCancelled
    from skiff.sources import registry

    registry.register_source(replace(registry.get_source("betfair"), id="slow", reader=_Slow()))
    table, out = str(tmp_path / "r"), str(tmp_path / "o")
    cfg = _cfg(source, out, selected_paths=["2016"], source_type="slow", process_type=kind, job_id="j", poll_s=0.2, progress_s=0.5)

    def cancel():
        while not any(r.stages and r.stages.get("read") == "in_progress" for r in runs.read_events(spark, table).collect()):
            time.sleep(0.3)
        time.sleep(2)
        runs.record_cancel(spark, table, "j")

    t = threading.Thread(target=cancel)
    t.start()
    began = time.monotonic()
    with pytest.raises(RunCancelled):
        run_transport(spark, cfg, table)
    t.join()
    assert time.monotonic() - began < 45
    state = runs.get_run(spark, table, "j")
    assert state["status"] == "cancelled" and state["stages"]["read"] == "failed" and state["stages"]["write"] == "waiting"
    assert int(state["config"]["tasks"]) >= int(state["config"]["tasks_done"]) + 2
    assert not os.path.exists(out) or not os.listdir(out)
    del registry._SOURCES["slow"]


def test_cancel_before_the_commit_takes_the_output_away(spark, source, tmp_path, monkeypatch):
    from skiff.plans import job

    table, out = str(tmp_path / "r"), str(tmp_path / "o")
    write = transport.write_shards

    def write_then_cancel(*args, **kw):
        done = write(*args, **kw)
        runs.record_cancel(spark, table, "j")
        return done

    monkeypatch.setattr(transport, "write_shards", write_then_cancel)
    with pytest.raises(job.RunCancelled):
        run_transport(spark, _cfg(source, out, selected_paths=["2016"], job_id="j", poll_s=60), table)
    assert runs.get_run(spark, table, "j")["status"] == "cancelled"
    assert not os.path.exists(f"{out}/lines") and not os.path.exists(f"{out}/_manifest")


def test_a_cancel_is_final_for_the_jobs_reports(spark, tmp_path):
    def status(*kinds):
        table = str(tmp_path / "-".join(k for k, _ in kinds))
        rows = [runs.simple("j", i, k, status=s) if k != "create" else runs.created("j", i, [], "x") for i, (k, s) in enumerate(kinds)]
        runs.append_rows(spark, rows, table)
        return runs.get_run(spark, table, "j")["status"]

    assert status(("create", None), ("job", "running")) == "running"
    assert status(("create", None), ("job", "running"), ("job", "completed")) == "completed"
    assert status(("create", None), ("cancel", None), ("job", "completed"), ("log", None)) == "cancelled"
    assert status(("create", None), ("job", "completed"), ("cancel", None)) == "cancelled"
    assert status(("create", None), ("job", "failed"), ("update", "running")) == "running"


@pytest.mark.parametrize("compression", ["none", "gzip", "snappy"])
def test_shard_roundtrip(spark, tmp_path, compression):
    rows = [(f'{{"i":{i}}}',) for i in range(100)] + [("x\r",)]
    df = spark.createDataFrame(rows, "value string")
    out = str(tmp_path / compression)
    files = transport.write_shards(df, out, num_shards=4, compression=compression)
    assert len(files) == 4 and sum(n for _, n, _ in shards.committed_shards(spark, out)) == 101
    with pytest.raises(FileExistsError):
        transport.write_shards(df, out, num_shards=4)

    assert sorted(r.value for r in transport.read_shards(spark, out).collect()) == sorted(v for (v,) in rows)


@pytest.mark.parametrize("compression", ["none", "gzip", "snappy"])
def test_exact_shard_count_with_empty_shards(spark, tmp_path, compression):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "value string")
    out = str(tmp_path / compression)
    files = transport.write_shards(df, out, num_shards=10, compression=compression)
    names = sorted(os.path.basename(f) for f in files)
    suffix = {"none": "", "gzip": ".gz", "snappy": ".snappy"}[compression]
    assert names == [f"output-{i:05d}-of-00010.ndjson{suffix}" for i in range(10)]
    assert sorted(r.value for r in transport.read_shards(spark, out).collect()) == ["a", "b", "c"]


def test_command_line(spark, source, tmp_path, capsys):
    import json

    from skiff.__main__ import main

    table = str(tmp_path / "runs")
    main(["transport", "--source-root", source, "--bucket", "bk", "--paths", "2016/Feb",
          "--output", str(tmp_path / "cli"), "--shards", "2", "--runs-table", table])
    res = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert res["files_processed"] == 1 and res["files_failed"] == 1 and res["output_files"] == 2
    main(["cancel", "--runs-table", table, "--job-id", res["job_id"]])
    capsys.readouterr()
    main(["history", "--runs-table", table])
    jobs = json.loads(capsys.readouterr().out.strip().splitlines()[-1])["jobs"]
    assert [(j["job_id"], j["status"]) for j in jobs] == [(res["job_id"], "cancelled")]


def test_intermediate_tables_are_deleted(spark, source, tmp_path):
    from skiff import files
    from skiff.session import shared_dir

    base = shared_dir(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def tables():
        return {x.getPath().getName() for x in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(base))}

    before = tables()
    run_transport(spark, _cfg(source, str(tmp_path / "o"), selected_paths=["2016"]), str(tmp_path / "r"))
    assert {n for n in tables() - before if not n.endswith(".zip")} == set() and files.exists(spark, str(tmp_path / "o"))
