"""Retention and upsert on versioned tables (C4, P4, S14): only the parts that a change
touches are written again, then a version is published.

Activity snapshots are kept for 14 days, configuration snapshots for 365 days, counter
collections in the newest 14 folders of each server.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.text import boundary_days
from vigil.operators.registry import upsert
from vigil.operators.snapshots import ACTIVITY_RETENTION_DAYS, CONFIG_RETENTION_DAYS, PERF_RETENTION_FOLDERS
from vigil.sources.versions import Version, VersionedTable

KEY_BUCKETS = 32
# The snapshot tables, their columns and how many days they are kept.
SNAPSHOTS = {
    "active_user_requests": (
        "snap_time_stamp timestamp, server_id long, session_id long, request_id int, login_name string, program_name string, "
        "dbname string, start_time timestamp, duration_sec long, command string, status string, last_wait_type string, "
        "wait_time int, sql_text string", ACTIVITY_RETENTION_DAYS),
    "msdb_dbo_sysjobs": (
        "snap_time_stamp timestamp, server_id long, job_id string, name string, owner string, category string, "
        "description string, enabled boolean, start_step_id int, delete_level int, date_created timestamp, "
        "date_modified timestamp, version_number int", CONFIG_RETENTION_DAYS),
    "msdb_dbo_sysjobsteps": (
        "snap_time_stamp timestamp, server_id long, job_id string, step_id int, step_name string, subsystem string, "
        "command string, cmdexec_success_code int, on_success_action int, on_success_step_id int, on_fail_action int, "
        "on_fail_step_id int, server string, database_name string, database_user_name string, retry_attempts int, "
        "retry_interval int, output_file_name string, proxy_id int", CONFIG_RETENTION_DAYS),
}


def month_part(ts_col: str) -> Column:
    return F.date_format(F.col(ts_col), "yyyy-MM")


def expire_rows(table: VersionedTable, ts_col: str, days: int, as_of: dt.datetime) -> Version:
    """C4 on a table whose parts are months of ``ts_col`` (named by year and month, and whatever
    follows): rows of the last ``days`` calendar days up to ``as_of`` stay.  Whole months before the
    cut are left out by name; the one month through which the cut goes is written again; later
    months are not read."""
    base = table.current()
    first_kept = as_of.date() - dt.timedelta(days=days - 1)
    cut = f"{first_kept:%Y-%m}"
    changed: dict[str, str | None] = {p: None for p in base.parts if p[:7] < cut}
    through = [p for p in base.parts if p[:7] == cut]
    if through and first_kept.day > 1:
        kept = table.read(base, through).filter(boundary_days(F.col(ts_col), F.lit(as_of).cast("timestamp_ntz")) < days)
        changed |= dict.fromkeys(through) | table.write(kept, month_part(ts_col))
    return table.publish(base, changed, retained_from=str(first_kept))


def store_snapshot(table: VersionedTable, name: str, rows: DataFrame, taken_at: dt.datetime | None = None) -> Version:
    """Append a collection's rows to the snapshot table ``name`` as new parts of their months.

    The table has the columns of ``SNAPSHOTS``; a column that ``rows`` lacks is an error.
    ``taken_at`` is the time of the snapshot where the collection does not carry it itself.
    """
    schema = T.StructType.fromDDL(SNAPSHOTS[name][0])
    if taken_at is not None:
        rows = rows.withColumn("snap_time_stamp", F.lit(taken_at))
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    base = table.current()
    new = table.write(rows, month_part("snap_time_stamp"))
    return table.publish(base, {f"{month}-{base.number + 1:08d}": path for month, path in new.items()}, schema)


def expire_snapshots(table: VersionedTable, name: str, as_of: dt.datetime) -> Version:
    """C4: what the snapshot table ``name`` keeps on ``as_of``."""
    return expire_rows(table, "snap_time_stamp", SNAPSHOTS[name][1], as_of)


def newest_folders(df: DataFrame, folder: Column, by: str = "server_id", most: int = PERF_RETENTION_FOLDERS) -> DataFrame:
    """Rows in the newest ``most`` folders of each server.  Folders are numbered after they have
    been reduced to one row each, so a server with many samples is no hot window."""
    rows = df.withColumn("_folder", folder)
    seen = rows.select(by, "_folder").distinct()
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("_folder").desc()))
    kept = seen.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")
    return rows.join(kept, [by, "_folder"], "left_semi").drop("_folder")


def key_part(key: list[str], buckets: int) -> Column:
    return F.format_string("b%05d", F.pmod(F.xxhash64(*key), F.lit(buckets)))


def merge_rows(table: VersionedTable, updates: DataFrame, key: list[str], buckets: int = KEY_BUCKETS) -> Version:
    """P4 on a table split by a hash of its key: new keys are added, present ones updated.

    Only the buckets that get a row are read and written.  As with MERGE, a key that comes twice
    in ``updates`` is an error.  The names of the buckets (at most ``buckets``) are all the driver sees.
    """
    base = table.current()
    if not base.parts:
        return table.overwrite(updates, key_part(key, buckets), buckets=buckets)
    buckets = base.facts["buckets"]
    twice = updates.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one update for the key {twice[0].asDict()}")
    touched = [r[0] for r in updates.select(key_part(key, buckets).alias("p")).distinct().collect()]
    target = table.read(base, touched)
    joined = upsert(target, updates.select(*target.columns), key)
    return table.publish(base, table.write(joined, key_part(key, buckets)))
