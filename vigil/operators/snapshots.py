"""Snapshot and capacity jobs (C1-C7): activity snapshot, job/step inventories,
retention, disk-space classification, backup-file expiry, file-size plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.joins import literal_rows, small

from vigil.functions.text import boundary_days, boundary_seconds, fill

# Fixed values (must equal the reference's).
AGENT_PROGRAM_PREFIX = "SQLAgent - TSQL JobStep"
RECEIVE_WAIT = "BROKER_RECEIVE_WAITFOR"
DEFAULT_DESCRIPTION = "No description available."
STEP_COMMAND_CHARS = 1000
ACTIVITY_RETENTION_DAYS = 14
CONFIG_RETENTION_DAYS = 365
PERF_RETENTION_FOLDERS = 14
DEFAULT_BACKUP_RETENTION_DAYS = 4
# (database, new size KB or None, new growth KB) from the server preparation script
FILE_TARGETS = (("model", 51200, 102400), ("msdb", None, 51200), ("tempdb", None, 102400))
# the program name shown for a session run by an agent job step
JOB_STEP_LABEL = 'Job "%s" : Step %s "%s"'
# the size / growth statement of the file plan, and its optional size part
FILE_STATEMENT = "ALTER DATABASE [%s] MODIFY FILE (NAME=N'%s', %sMAXSIZE=UNLIMITED, FILEGROWTH=%sKB)"
FILE_SIZE_PART = "SIZE = %sKB, "
# Default disk bounds when a volume has none configured (our choice).
DEFAULT_WARNING_PCT = 80.0
DEFAULT_ERROR_PCT = 90.0


def guid_bytes_hex(guid: Column) -> Column:
    """Hex of a uniqueidentifier's bytes: the first three groups are stored
    little-endian, the last two as written (so byte order != text order)."""
    g = F.upper(guid)
    part = lambda start, n: F.substring(g, start, n)
    return F.concat(part(7, 2), part(5, 2), part(3, 2), part(1, 2),
                    part(12, 2), part(10, 2),
                    part(17, 2), part(15, 2),
                    part(20, 4), part(25, 12))


def with_agent_job(sessions: DataFrame) -> DataFrame:
    """``job_id_vb`` (job id bytes) and ``step_id`` of sessions that run an agent job step,
    parsed from the program name on the row; NULL for all others."""
    p = F.col("program_name")
    hexpart = F.substring(p, 30, 34)        # "0x" + 32 hex digits
    job = p.like(AGENT_PROGRAM_PREFIX + "%")
    return (sessions.withColumn("job_id_vb", F.when(job, F.unhex(F.substring(hexpart, 3, 32))))
                    .withColumn("step_id", F.when(job, F.substring(p, F.lit(72), F.length(p) - 72).try_cast("int"))))


def activity_snapshot(requests: DataFrame, sessions: DataFrame, sql_text: DataFrame, jobs: DataFrame,
                      steps: DataFrame, databases: DataFrame, self_session: int | None = None) -> DataFrame:
    """Active user requests with login, database, duration and -- for agent
    jobs -- the job and step instead of the raw program name.

    Join chain: requests x sessions (inner), x sql text (inner, J7), jobs by the id bytes
    in the program name (left, J8), their steps (left), database names (left).  Every join
    carries ``server_id``: ids are unique per server only.
    """
    r = requests.filter(F.col("command").isNotNull()
                        & (F.coalesce(F.col("wait_type"), F.lit("")) != RECEIVE_WAIT))
    s = sessions.filter(F.col("is_user_process"))
    if self_session is not None:
        s = s.filter(F.col("session_id") != self_session)
    base = (r.join(s.select("server_id", "session_id", "login_name", "program_name"), ["server_id", "session_id"])
             .join(sql_text, ["server_id", "session_id", "request_id"]))
    base = with_agent_job(base)
    j = jobs.select("server_id", "job_key", F.unhex(guid_bytes_hex(F.col("job_id"))).alias("job_id_vb"),
                    F.col("name").alias("job_name"))
    st = steps.select("server_id", "job_key", "step_id", "step_name")
    dbs = databases.select("server_id", "database_id", F.col("name").alias("dbname"))
    out = (base.join(j, ["server_id", "job_id_vb"], "left").join(st, ["server_id", "job_key", "step_id"], "left")
               .join(dbs, ["server_id", "database_id"], "left"))
    job_label = fill(JOB_STEP_LABEL, F.col("job_name"), F.col("step_id"), F.col("step_name"))
    return out.select(
        F.col("snap_ts").alias("snap_time_stamp"), "server_id", "session_id", "request_id", "login_name",
        F.coalesce(job_label, F.col("program_name")).alias("program_name"), "dbname", "start_time",
        boundary_seconds(F.col("start_time"), F.col("snap_ts")).alias("duration_sec"), "command",
        "status", "last_wait_type", "wait_time",
        F.left(F.col("sql_text"), F.lit(1000)).alias("sql_text"))


def append_snapshot(df: DataFrame, path: str, ts_col: str, checkpoint: str | None = None):
    """Append a snapshot (batch or stream) to a table partitioned by snapshot
    date, so retention (``expire_partitions``) drops whole folders."""
    out = df.withColumn("snap_date", F.to_date(F.col(ts_col)))
    if out.isStreaming:
        return (out.writeStream.format("parquet").option("path", path)
                   .option("checkpointLocation", checkpoint).partitionBy("snap_date")
                   .outputMode("append").trigger(availableNow=True).start())
    out.write.mode("append").partitionBy("snap_date").parquet(path)
    return None


def job_inventory(jobs: DataFrame, categories: DataFrame, principals: DataFrame) -> DataFrame:
    """Jobs with category (inner) and owner (left); the default description -> NULL."""
    cats = categories.select("category_id", F.col("name").alias("category"))
    out = jobs.join(small(cats), "category_id")
    out = out.join(principals.select("server_id", "owner_sid", F.col("name").alias("owner")),
                   ["server_id", "owner_sid"], "left")
    return out.select("server_id", "job_id", "name", "owner", "category",
                      F.nullif(F.col("description"), F.lit(DEFAULT_DESCRIPTION)).alias("description"), "enabled",
                      "start_step_id", "delete_level", "date_created", "date_modified", "version_number")


def step_inventory(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """Job steps; the command text is cut to 1000 characters."""
    j = jobs.select("server_id", "job_key", "job_id")
    return steps.join(j, ["server_id", "job_key"]).select(
        "server_id", "job_id", "step_id", "step_name", "subsystem",
        F.left(F.col("command"), F.lit(STEP_COMMAND_CHARS)).alias("command"), "cmdexec_success_code", "on_success_action",
        "on_success_step_id", "on_fail_action", "on_fail_step_id", "server", "database_name", "database_user_name",
        "retry_attempts", "retry_interval", "output_file_name", "proxy_id")


def retained(df: DataFrame, ts_col: str, days: int, as_of: Column) -> DataFrame:
    """C4: rows of the last ``days`` calendar days up to ``as_of`` (the rest expires)."""
    return df.filter(boundary_days(F.col(ts_col), as_of) < days)


def expire_partitions(spark: SparkSession, path: str, column: str, keep_from: str) -> list[str]:
    """C4 on a date-partitioned table: drop partition folders older than ``keep_from``
    (metadata work on the driver; no data passes through it)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    dropped = []
    if not fs.exists(root):
        return dropped
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(column + "="):
            if name.split("=", 1)[1] < keep_from:
                fs.delete(status.getPath(), True)
                dropped.append(name)
    return dropped


def disk_space(volumes: DataFrame, bounds: DataFrame, server_bounds: DataFrame | None = None) -> DataFrame:
    """Used percentage of each volume against its warning / error bound: the server's
    own bound row for the volume, else the fleet's, else the defaults."""
    b = bounds.select(F.upper("volume_name").alias("k"), F.col("warning_pct").cast("double").alias("w"),
                      F.col("error_pct").cast("double").alias("e"))
    used = (F.col("capacity") - F.col("free_space")) * F.lit(100.0) / F.col("capacity")
    v = volumes.withColumn("used_pct", used.cast("double"))
    out = v.join(small(b), F.upper(v.name) == b.k, "left")
    if server_bounds is not None:
        s = server_bounds.select(F.col("server_id").alias("_own_id"), F.upper("volume_name").alias("_own_k"),
                                 F.struct(F.col("warning_pct").cast("double").alias("w"), F.col("error_pct").cast("double").alias("e")).alias("_own"))
        out = out.join(small(s), (F.col("server_id") == F.col("_own_id")) & (F.upper("name") == F.col("_own_k")), "left")
        # a row gives both bounds: they are not mixed from two rows
        for c in ("w", "e"):
            out = out.withColumn(c, F.when(F.col("_own").isNotNull(), F.col("_own")[c]).otherwise(F.col(c)))
    w = F.coalesce(F.col("w"), F.lit(DEFAULT_WARNING_PCT))
    e = F.coalesce(F.col("e"), F.lit(DEFAULT_ERROR_PCT))
    status = F.when(F.col("used_pct") >= e, "ERROR").when(F.col("used_pct") >= w, "WARNING").otherwise("OK")
    return out.select("server_id", F.col("name").alias("volume_name"), "used_pct", w.alias("warning_pct"),
                      e.alias("error_pct"), status.alias("status"))


def backup_expiry(files: DataFrame, databases: DataFrame, overrides: DataFrame, default_days: Column,
                  as_of: Column, server_overrides: DataFrame | None = None,
                  server_defaults: DataFrame | None = None) -> DataFrame:
    """Backup files older than their database's retention by last write time -- the files a
    cleanup would delete.  Retention: the server's override for the database, the fleet's override,
    the server's default (server_id, days), the fleet's default."""
    dbs = databases.select("server_id", "db_key", F.col("name").alias("db_name"))
    ovr = overrides.select(F.lower("db_name").alias("k"), F.col("retention_days").alias("override_days"))
    # no retention is shorter than the smallest override or default: newer files go before the joins
    least = F.least(ovr.select(F.min("override_days")).scalar(),
                    F.coalesce(default_days, F.lit(DEFAULT_BACKUP_RETENTION_DAYS)).cast("int"))
    if server_overrides is not None:
        least = F.least(least, server_overrides.select(F.min("retention_days")).scalar(), server_defaults.select(F.min("days")).scalar())
    f = files.filter(boundary_days(F.col("last_write_time"), as_of) > least).join(dbs, ["server_id", "db_key"], "left")
    f = f.join(small(ovr), F.lower(f.db_name) == ovr.k, "left")
    chosen = [F.col("override_days"), default_days]
    if server_overrides is not None:
        own = server_overrides.select(F.col("server_id").alias("_own_id"), F.lower("db_name").alias("_own_k"), F.col("retention_days").alias("_own_days"))
        f = f.join(small(own), (F.col("server_id") == F.col("_own_id")) & (F.lower("db_name") == F.col("_own_k")), "left")
        base = server_defaults.select(F.col("server_id").alias("_base_id"), F.col("days").alias("_base_days"))
        f = f.join(small(base), F.col("server_id") == F.col("_base_id"), "left")
        chosen = [F.col("_own_days"), F.col("override_days"), F.col("_base_days"), default_days]
    days = F.coalesce(*chosen, F.lit(DEFAULT_BACKUP_RETENTION_DAYS)).cast("int")
    return (f.withColumn("retention_days", days)
             .filter(boundary_days(F.col("last_write_time"), as_of) > F.col("retention_days"))
             .select("server_id", "db_name", "file_name", "last_write_time", "size_bytes", "retention_days"))


def file_plan(files: DataFrame, databases: DataFrame) -> DataFrame:
    """Size / growth statements for the model, msdb and tempdb files (a plan,
    never executed): resize only when the target exceeds the current size."""
    spark = files.sparkSession
    targets = literal_rows(spark, [(n, s, g) for n, s, g in FILE_TARGETS],
                                    "k string, new_size_kb int, new_growth_kb int")
    dbs = (databases.select("server_id", "db_key", F.col("name").alias("db_name"))
                    .join(small(targets), F.lower(F.col("db_name")) == F.col("k")))
    f = files.select("server_id", "db_key", F.col("name").alias("file_name"),
                     (F.col("size_pages") * 8).alias("current_kb")).join(dbs, ["server_id", "db_key"])
    size_part = F.when(F.col("new_size_kb") > F.col("current_kb"),
                       fill(FILE_SIZE_PART, F.col("new_size_kb"))).otherwise(F.lit(""))
    stmt = fill(FILE_STATEMENT, F.col("db_name"), F.col("file_name"), size_part, F.col("new_growth_kb"))
    return f.select("server_id", "db_name", "file_name", "current_kb", stmt.alias("statement"))
