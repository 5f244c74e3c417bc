"""Job entry points (spark-submit): the daily policy check.

    spark-submit vigil/jobs.py policy-check --snapshots s3://.../fleet --out s3://.../checks \
        --run-date 2024-01-02 [--as-of "2024-01-02 00:00:05"] [--filter 1,3,9 [--invert]]

Reads one snapshot date of every catalog, writes the numbered report (partition
``run_date``) and its HTML pages, and returns per-server message counts.  Cadence
and alerting are the scheduler's business, as before.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vigil.plans import report as rpt  # noqa: E402
from vigil.plans.context import CheckContext  # noqa: E402
from vigil.sources.tables import SnapshotInputs  # noqa: E402


def policy_check(spark: SparkSession, snapshots: str, out: str, run_date: str, as_of: str | None = None,
                 policy_filter: str | None = None, invert: bool = False) -> DataFrame:
    ctx = CheckContext(SnapshotInputs(spark, snapshots, run_date), as_of=as_of or f"{run_date} 00:00:00")
    report = rpt.policy_report(ctx, policy_filter, invert)
    rpt.write_report(report, os.path.join(out, "report"), run_date)
    written = rpt.read_report(spark, os.path.join(out, "report"), run_date)
    rpt.report_html(written).write.mode("overwrite").parquet(rpt.date_folder(os.path.join(out, "report_html"), run_date))
    return rpt.policy_counts(written)


def main(argv=None) -> None:
    from vigil.session import get_session
    ap = argparse.ArgumentParser(prog="vigil")
    sub = ap.add_subparsers(dest="cmd", required=True)
    pc = sub.add_parser("policy-check")
    pc.add_argument("--snapshots", required=True)
    pc.add_argument("--out", required=True)
    pc.add_argument("--run-date", required=True)
    pc.add_argument("--as-of")
    pc.add_argument("--filter")
    pc.add_argument("--invert", action="store_true")
    args = ap.parse_args(argv)
    spark = get_session()
    counts = policy_check(spark, args.snapshots, args.out, args.run_date, args.as_of, args.filter, args.invert)
    total = counts.agg(F.sum("n_messages")).first()[0] or 0
    print(f"{args.run_date}: {total} message(s)" if total else f"{args.run_date}: no messages")


if __name__ == "__main__":
    main()
