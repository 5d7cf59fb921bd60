"""Command line: the job submission and history calls, for ``spark-submit``.

    spark-submit --py-files skiff.zip -m skiff transport --source-root gs://b --bucket b \
        --paths ADVANCED/2016/Jan --output gs://out/run-1 --shards 10 --compression gzip
    python -m skiff history --runs-table <table> [--limit 20]
    python -m skiff status --runs-table <table> --job-id <id>
    python -m skiff logs --runs-table <table> --job-id <id>
    python -m skiff cancel --runs-table <table> --job-id <id>

Prints one JSON document per call; an unknown job id is an error and records nothing.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _spark() -> SparkSession:
    return SparkSession.builder.appName("skiff").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    from .operators import runs
    from .plans.job import PROCESS_TYPES, JobConfig, run_transport
    from .session import shared_dir

    ap = argparse.ArgumentParser(prog="skiff")
    sub = ap.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("transport", help="run one transport job")
    t.add_argument("--source-root", required=True)
    t.add_argument("--bucket", required=True)
    t.add_argument("--paths", nargs="*", default=[""])
    t.add_argument("--output", required=True)
    t.add_argument("--source-type", default="betfair")
    t.add_argument("--process-type", default="decompress_and_concatenate", choices=PROCESS_TYPES)
    t.add_argument("--shards", type=int, default=0, help="0: sized from the bytes read")
    t.add_argument("--compression", default="none", choices=["none", "gzip", "snappy"])
    t.add_argument("--boundary", default="path", choices=["path", "prefix"])
    t.add_argument("--runs-table")
    h = sub.add_parser("history", help="recent runs")
    h.add_argument("--runs-table")
    h.add_argument("--limit", type=int, default=runs.RECENT_DEFAULT)
    for name, text in (("status", "one run"), ("logs", "a run's last log lines"), ("cancel", "record a cancel")):
        c = sub.add_parser(name, help=text)
        c.add_argument("--runs-table")
        c.add_argument("--job-id", required=True)
    a = ap.parse_args(argv)

    spark = _spark()
    table = a.runs_table or f"{shared_dir(spark)}/skiff-runs"
    if a.cmd == "transport":
        res = run_transport(spark, JobConfig(
            source_root=a.source_root, source_bucket=a.bucket, selected_paths=a.paths, output=a.output,
            source_type=a.source_type, process_type=a.process_type, output_shards=a.shards,
            compression=a.compression, boundary=a.boundary), table)
        out = {k: v for k, v in res.items() if k != "gate"}
    elif a.cmd == "history":
        rows = runs.recent_runs(runs.fold_runs(runs.read_events(spark, table)), a.limit).collect()
        out = {"jobs": [r.asDict() for r in rows]}
    else:
        try:
            if a.cmd == "cancel":
                runs.record_cancel(spark, table, a.job_id)
                out = {"cancelled": True}
            else:
                out = runs.get_run(spark, table, a.job_id)
                if a.cmd == "logs":
                    out = {"logs": runs.get_logs(runs.read_events(spark, table), a.job_id)}
        except runs.UnknownRun as e:
            print(json.dumps({"error": str(e)}))
            return 1
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
