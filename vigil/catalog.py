"""Registered queries: name -> (spark, data_dir) -> DataFrame, and their DuckDB twins.

Every query reads the driver's tables (through the fixture views) over their
whole extent.  Operators whose only input is a fixed configuration table
(module versions, filter text, operator lookup, bound CHECK) are covered by
tests/ instead, see README.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import oracle, oracle_more
from vigil.operators import quality as q
from vigil.operators import registry as reg
from vigil.operators import retention as ret
from vigil.operators import selection as sel
from vigil.operators import snapshots as snap
from vigil.plans import policies as pol
from vigil.plans import report as rpt
from vigil.plans.context import CONFIG_KEYS, CheckContext
from vigil.session import scratch_dir
from vigil.sources import volumes as src_vol
from vigil.sources.tables import FleetInputs
from vigil.sources.versions import VersionedTable
from vigil.streaming import counters, throttle
from vigil.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]


_INPUTS: dict[tuple, FleetInputs] = {}


def inputs(spark: SparkSession, data_dir: str) -> FleetInputs:
    """One input catalog per (session, folder): plans are reused, nothing is cached."""
    key = (id(spark), spark.sparkContext.applicationId, data_dir)
    if key not in _INPUTS:
        _INPUTS[key] = FleetInputs(spark, data_dir)
    return _INPUTS[key]


def context(spark: SparkSession, data_dir: str, **kw) -> CheckContext:
    return CheckContext(inputs(spark, data_dir), **({"instance_separator": "/"} | kw))  # FIXTURES.md


def _policy_query(n: int) -> Query:
    return lambda spark, d: rpt.policy_result(context(spark, d), n)


# ---------------------------------------------------------------- framework

def _registered_report(spark, d):
    """P1 end to end: register the built-in set into the fixture registry, then run."""
    src = inputs(spark, d)
    specs = reg.default_policies()
    new = reg.registry_frame(spark, specs)
    registry, exclusions = reg.register(src.fx("registry"), src.fx("exclusions"), new,
                                        reg.exclusion_requests(spark, specs))
    return rpt.policy_report(CheckContext(src, registry=registry, exclusions=exclusions, instance_separator="/"))


CUSTOM_POLICY = reg.PolicySpec(30, "Databases must not be read-only", False, False)


def read_only_policy(ctx: CheckContext) -> DataFrame:
    """Example user policy: built from the catalog like any built-in."""
    d = ctx.frame("databases").filter(F.col("is_read_only"))
    return pol.db_violations(d, CUSTOM_POLICY.number, F.lit("READ_ONLY=ON"))


def _custom(spark, d):
    ctx = context(spark, d)
    pol.register_policy(ctx, CUSTOM_POLICY, read_only_policy)
    return rpt.policy_result(ctx, CUSTOM_POLICY.number)


# ---------------------------------------------------------------- selection

def _select(pattern: str, kind: str = "expand", skip_read_only: bool = False) -> Query:
    def run(spark, d):
        i = inputs(spark, d)
        args = (pattern, i.fx("databases"), i.fx("servers"), i.fx("config"))
        if kind == "expand":
            return sel.expand(*args)
        if kind == "for_each":
            return sel.for_each(*args, skip_read_only=skip_read_only)
        return sel.affected_list(*args)
    return run


# ---------------------------------------------------------------- snapshots

def _activity(spark, d):
    i = inputs(spark, d)
    req = i.fx("requests")
    return snap.activity_snapshot(req.drop("sql_text"), i.fx("sessions"),
                                  req.select("server_id", "session_id", "request_id", "sql_text"),
                                  i.fx("jobs"), i.fx("job_steps"), i.fx("databases"))


def _retention(spark, d):
    i = inputs(spark, d)
    as_of = i.table("events").select(F.max("ts")).scalar()
    return snap.retained(_activity(spark, d), "snap_time_stamp", snap.ACTIVITY_RETENTION_DAYS, as_of)


def _backup(spark, d):
    ctx = context(spark, d)
    i = ctx.inputs
    days = reg.config_int(i.fx("config"), "maint.backup_retention_days")
    return snap.backup_expiry(i.fx("backup_files"), i.fx("databases"), i.fx("retention_overrides"), days,
                              ctx.as_of_col())


def _backup_per_server(spark, d):
    ctx = context(spark, d)
    i = ctx.inputs
    days = "maint.backup_retention_days"
    own = i.fx("server_config").filter(F.col("name") == days).select("server_id", F.col("value").try_cast("int").alias("days"))
    return snap.backup_expiry(i.fx("backup_files"), i.fx("databases"), i.fx("retention_overrides"),
                              reg.config_int(i.fx("config"), days), ctx.as_of_col(), i.fx("server_retention"), own)


AS_OF = dt.datetime(1998, 8, 2)


def _scratch_table(spark, name: str) -> VersionedTable:
    return VersionedTable(spark, scratch_dir(spark, f"{name}-{uuid.uuid4().hex}"))


def _config_retention(spark, d):
    """C4: a history of configuration snapshots by month, expired after 365 days."""
    table = _scratch_table(spark, "job-history")
    table.overwrite(inputs(spark, d).fx("job_history").filter(F.col("snap_time_stamp") <= F.lit(AS_OF).cast("timestamp_ntz")),
                    ret.month_part("snap_time_stamp"))
    return table.read(ret.expire_rows(table, "snap_time_stamp", snap.CONFIG_RETENTION_DAYS, AS_OF))


def _upsert_inventory(spark, d):
    """A later job inventory merged into an earlier one."""
    jobs = inputs(spark, d).fx("jobs").select("server_id", "job_id", "name", "enabled", "version_number")
    table = _scratch_table(spark, "inventory")
    key = ["server_id", "job_id"]
    number = F.left("job_id", F.lit(8)).cast("int")
    ret.merge_rows(table, jobs.filter(number % 10 != 3), key)
    later = jobs.filter(number % 4 == 3).select("server_id", "job_id", F.concat("name", F.lit(" (v2)")).alias("name"),
                                                (~F.col("enabled")).alias("enabled"), (F.col("version_number") + 1).alias("version_number"))
    return table.read(ret.merge_rows(table, later, key))


def _volume_inventory(spark, d):
    """The raw XML form, written from the fixture, read back, machines resolved to servers."""
    i = inputs(spark, d)
    path = scratch_dir(spark, f"volume-inventory-{uuid.uuid4().hex}")
    src_vol.write_volume_inventory(i.fx("volume_inventory"), path)
    servers = i.fx("servers").select("server_id", F.col("machine_name").alias("node"))
    return src_vol.read_volume_inventory(spark, path).join(servers, "node").select(
        "server_id", "name", "label", "capacity", "free_space", "drive_type")


def _listed_context(spark, d):
    return context(spark, d, exclusions=inputs(spark, d).fx("like_exclusions"))


def _per_server(number: int) -> Query:
    return lambda spark, d: rpt.policy_result(context(spark, d, server_config=inputs(spark, d).fx("server_config")), number)


def _volume_scan(spark, d):
    path = scratch_dir(spark, f"volumes-xml-{uuid.uuid4().hex}")
    src_vol.write_volumes_xml(inputs(spark, d).fx("volumes"), path)
    return src_vol.read_volumes_xml(spark, path)


def _dq_unique(spark, d):
    i = inputs(spark, d)
    return (q.duplicate_keys(i.fx("databases"), ["server_id", F.lower("name")], "databases(server_id, name)")
             .unionByName(q.duplicate_keys(i.fx("files"), ["server_id", "db_key", "file_id"],
                                           "files(server_id, db_key, file_id)")))


def _dq_fk(spark, d):
    i = inputs(spark, d)
    req = q.orphans(i.fx("requests").select("server_id", "database_id"),
                    i.fx("databases"), ["server_id", "database_id"])
    steps = q.orphans(i.fx("job_steps").select("server_id", "job_key"), i.fx("jobs"), ["server_id", "job_key"])
    return (req.select(F.lit("requests -> databases").alias("constraint_name"), "server_id",
                       F.col("database_id").cast("bigint").alias("key_id"))
               .unionByName(steps.select(F.lit("job_steps -> jobs").alias("constraint_name"), "server_id",
                                         F.col("job_key").alias("key_id"))))


# ---------------------------------------------------------------- streams (batch twins)

def _xe(spark, d):
    return inputs(spark, d).fx("xe_events")


def _alert_matches(spark, d):
    return ev.alert_match(_xe(spark, d), ev.alert_rules(reg.MAINT_DB))


def _alert_throttle(spark, d):
    """ST5 over the table: the same rule as the keyed-state stream, as a batch plan."""
    return _ntz(throttle.throttled(_alert_matches(spark, d)), "ts")


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


QUERIES: dict[str, Query] = {
    "policy_report": lambda spark, d: rpt.policy_report(context(spark, d)),
    "policy_eligibility": lambda spark, d: reg.eligible_databases(
        inputs(spark, d).fx("databases"), inputs(spark, d).fx("registry"),
        inputs(spark, d).fx("exclusions")),
    "filter_intersect": lambda spark, d: rpt.policy_report(context(spark, d), "1,3,9,99"),
    "filter_except": lambda spark, d: rpt.policy_report(context(spark, d), "1,2,5,19,22", invert=True),
    "register_policies": _registered_report,
    "policy_counts": lambda spark, d: rpt.policy_counts(rpt.eligible_violations(context(spark, d))),
    "report_html": lambda spark, d: rpt.report_html(rpt.policy_report(context(spark, d))),
    "custom_policy": _custom,
    "select_system": _select("*system"),
    "select_user": _select("*user"),
    "select_all": _select("*"),
    "select_list": _select("list(master, DB_4,DB_4 ,tempdb,)"),
    "select_list_config": _select("list($usedefinition)"),
    "select_exact": _select("ReportServer"),
    "for_each_online": _select("*user", "for_each"),
    "for_each_writable": _select("*user", "for_each", skip_read_only=True),
    "for_each_list": _select("*", "list"),
    "csv_rows": lambda spark, d: sel.csv_rows(inputs(spark, d).table("documents"), "doc_id", "text"),
    "dq_unique": _dq_unique,
    "dq_fk": _dq_fk,
    "activity_snapshot": _activity,
    "job_inventory": lambda spark, d: _ntz(snap.job_inventory(inputs(spark, d).fx("jobs"), inputs(spark, d).fx("categories"),
                                                              inputs(spark, d).fx("principals")), "date_created", "date_modified"),
    "step_inventory": lambda spark, d: snap.step_inventory(inputs(spark, d).fx("job_steps"),
                                                           inputs(spark, d).fx("jobs")),
    "snapshot_retention": _retention,
    "disk_space": lambda spark, d: snap.disk_space(inputs(spark, d).fx("volumes"),
                                                   inputs(spark, d).fx("volume_bounds")),
    "disk_space_per_server": lambda spark, d: snap.disk_space(inputs(spark, d).fx("volumes"), inputs(spark, d).fx("volume_bounds"),
                                                              inputs(spark, d).fx("server_volume_bounds")),
    "backup_retention": _backup,
    "backup_retention_per_server": _backup_per_server,
    "server_settings": lambda spark, d: reg.effective_settings(
        inputs(spark, d).fx("servers"), inputs(spark, d).fx("config"), inputs(spark, d).fx("server_config"),
        [*CONFIG_KEYS, "maint.backup_retention_days"]),
    "config_retention": _config_retention,
    "counter_folders": lambda spark, d: _ntz(ret.newest_folders(inputs(spark, d).fx("counter_samples"), F.to_date("ts")), "ts"),
    "upsert_inventory": _upsert_inventory,
    "volume_inventory": _volume_inventory,
    "eligibility_many_patterns": lambda spark, d: reg.eligible_databases(
        inputs(spark, d).fx("databases"), inputs(spark, d).fx("registry"), inputs(spark, d).fx("like_exclusions")),
    "pol_20_listed": lambda spark, d: rpt.policy_result(_listed_context(spark, d), 20),
    "file_plan": lambda spark, d: snap.file_plan(inputs(spark, d).fx("files"), inputs(spark, d).fx("databases")),
    "job_log_names": lambda spark, d: pol.nonconforming_steps(context(spark, d)),
    "volume_scan": _volume_scan,
    "xe_waits": lambda spark, d: ev.wait_filter(_xe(spark, d)),
    "xe_events": lambda spark, d: ev.session_filter(_xe(spark, d)),
    "alert_match": _alert_matches,
    "alert_throttle": _alert_throttle,
    "alert_throttle_hot": lambda spark, d: _ntz(throttle.throttled(inputs(spark, d).fx("alert_matches")), "ts"),
    "activity_rollup_dense": lambda spark, d: _ntz(ev.activity_rollup(inputs(spark, d).fx("activity")), "window_start", "window_end"),
    "counter_rollup": lambda spark, d: _ntz(counters.counter_rollup(inputs(spark, d).fx("counter_samples")), "window_start"),
    "activity_rollup": lambda spark, d: _ntz(ev.activity_rollup(_activity(spark, d)), "window_start", "window_end"),
    "perf_rollup": lambda spark, d: _ntz(ev.perf_rollup(inputs(spark, d).fx("perf_samples")), "window_start"),
}
ORACLE: dict[str, str] = {"policy_report": oracle.report_sql()}
ORACLE.update(oracle_more.sql())

for _n in (3, 16, 18):
    QUERIES[f"pol_{_n:02d}_per_server"] = _per_server(_n)
for _n in pol.ALL_POLICIES:
    QUERIES[f"pol_{_n:02d}"] = _policy_query(_n)
    ORACLE[f"pol_{_n:02d}"] = oracle.policy_sql(_n)
