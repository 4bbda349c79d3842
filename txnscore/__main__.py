"""``python -m txnscore <job> ...``: thin command line over ``txnscore.jobs``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from txnscore import jobs
from txnscore.config import Settings
from txnscore.plans.runstats import run_report
from txnscore.session import prepare as prepare_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="txnscore")
    top.add_argument("--root", required=True, help="deployment folder")
    jobs_ = top.add_subparsers(dest="job", required=True)
    p = jobs_.add_parser("prepare", help="load history, build features, train, register")
    p.add_argument("raw", help="JSON transactions")
    p.add_argument("--lines", action="store_true", help="one JSON object per line")
    w = jobs_.add_parser("worker", help="score the message feed")
    w.add_argument("feed", help="folder of message files")
    w.add_argument("--model-version")
    w.add_argument("--worker-id", default="spark")
    w.add_argument("--files-per-batch", type=int, default=8)
    w.add_argument("--once", action="store_true", help="stop when the feed is read")
    m = jobs_.add_parser("monitor", help="run statistics, run list, latest or arriving results")
    m.add_argument("what", choices=["stats", "runs", "latest", "workers", "live"])
    m.add_argument("--run-id")
    m.add_argument("--count", type=int, default=10)
    m.add_argument("--json", help="write the run statistics as JSON to this folder")
    c = jobs_.add_parser("cleanup", help="empty the tables of the scoring stream")
    c.add_argument("groups", nargs="*", default=list(jobs.OWNED))
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = prepare_session(SparkSession.builder.appName("txnscore").getOrCreate())
    settings, root = Settings.from_env(), args.root.rstrip("/")
    if args.job == "prepare":
        version, metrics = jobs.prepare(spark, args.raw, root, settings, multiline=not args.lines)
        print(f"model version {version}")
        metrics.show(truncate=False, vertical=True)
    elif args.job == "worker":
        jobs.start_worker(
            spark, root, args.feed, args.model_version, args.worker_id, settings, args.once, args.files_per_batch
        ).awaitTermination()
    elif args.job == "cleanup":
        jobs.purge(spark, root, tuple(args.groups)).show()
    elif args.what == "runs":
        jobs.list_runs(spark, root, args.count).show(args.count, truncate=False)
    elif args.what == "live":
        jobs.latest_results(spark, root, 5, args.run_id).show(5, truncate=False)
        jobs.show_results(spark, root, args.run_id).awaitTermination()
    elif args.what == "latest":
        jobs.latest_results(spark, root, args.count, args.run_id).show(args.count, truncate=False)
    elif args.what == "workers":
        workers = jobs.worker_stats(spark, root)
        shown = workers if args.run_id is None else workers.filter(workers["run_id"] == args.run_id)
        shown.orderBy("run_id", "worker_id").show(args.count, truncate=False)
    else:
        if args.json:
            jobs.export_run_stats(spark, root, args.json, args.run_id)
        run_report(jobs.run_stats(spark, root, args.run_id)).show(truncate=False, vertical=True)


if __name__ == "__main__":
    main()
