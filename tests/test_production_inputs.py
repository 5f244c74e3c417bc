import os
import tempfile

from pyspark.sql import functions as F

from conftest import SMALL
from vigil.operators import snapshots as snap
from vigil.plans import report as rpt
from vigil.plans.context import CheckContext
from vigil.sources.tables import FleetInputs, SnapshotInputs

CATALOGS = ["servers", "databases", "files", "error_log", "jobs", "job_steps", "categories", "options",
            "services", "logins", "config", "retention_overrides"]


def test_snapshot_tables_give_the_fixture_report(spark):
    root = tempfile.mkdtemp(prefix="vigil-snap-")
    fx = FleetInputs(spark, SMALL)
    for name in CATALOGS:
        df = fx.fx(name)
        # two snapshot dates; the older one holds different (stale) rows
        (df.withColumn("snapshot_date", F.lit("2024-01-02"))
           .unionByName(df.limit(3).withColumn("snapshot_date", F.lit("2024-01-01")))
           .write.partitionBy("snapshot_date").parquet(os.path.join(root, name)))
    prod = rpt.policy_report(CheckContext(SnapshotInputs(spark, root, "2024-01-02")))
    want = rpt.policy_report(CheckContext(fx))
    assert sorted(map(tuple, prod.collect())) == sorted(map(tuple, want.collect()))
    plan = prod._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "snapshot_date" in plan


def test_expire_partitions(spark):
    path = tempfile.mkdtemp(prefix="vigil-ret-") + "/activity"
    rows = [(d, 1) for d in ["2024-01-01", "2024-01-10", "2024-01-20"]]
    spark.createDataFrame(rows, "snap_date string, v int").write.partitionBy("snap_date").parquet(path)
    dropped = snap.expire_partitions(spark, path, "snap_date", "2024-01-07")
    assert dropped == ["snap_date=2024-01-01"]
    assert sorted(r.snap_date for r in spark.read.parquet(path).select(F.col("snap_date").cast("string")).collect()) \
        == ["2024-01-10", "2024-01-20"]


def test_policy_check_job(spark):
    from vigil.jobs import policy_check
    root = tempfile.mkdtemp(prefix="vigil-job-")
    fx = FleetInputs(spark, SMALL)
    for name in CATALOGS:
        fx.fx(name).withColumn("snapshot_date", F.lit("2024-01-02")).write.partitionBy("snapshot_date") \
            .parquet(os.path.join(root, "snap", name))
    counts = policy_check(spark, os.path.join(root, "snap"), os.path.join(root, "out"), "2024-01-02",
                          as_of="1998-08-02 00:00:00")
    want = rpt.policy_report(CheckContext(fx))
    assert counts.agg(F.sum("n_messages")).first()[0] == want.count()
    html = spark.read.parquet(os.path.join(root, "out", "report_html"))
    assert html.agg(F.sum("n_messages")).first()[0] == want.count()
