"""The 28 built-in policies as set-based DataFrames over the whole fleet.

Every policy yields rows of ``VIOLATION_COLUMNS``.  Database-level policies that
only read the database catalog are evaluated together in ONE pass: each database
row produces an array of (policy, statement, message) structs for the rules it
breaks, and ``inline`` turns the array into rows.  File, log and server-level
policies read their own catalogs; the two log policies share one log scan.

Eligibility (registry flags, LIKE exclusions) is applied afterwards, to the
violations only (see ``plans.report``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.joins import small

from vigil.functions.text import boundary_days, ci_equal, date120, fill, format_message, like_to_regex, safe_os_name
from vigil.plans.context import CheckContext

VIOLATION_COLUMNS = ["server_id", "policy_no", "db_level", "db_name", "db_state",
                     "stmt_no", "log_order", "log_date", "message"]

# Fixed values (must equal the reference's).
SHAREPOINT_COLLATION = "Latin1_General_CI_AS_KS_WS"
GROWTH_100MB_PAGES = 12800
BACKUP_MAX_AGE_DAYS = 2
PRIORITY_BOOST_OPTION = 1517
MAXDOP_OPTION = 1539
REPORT_SERVER_DBS = ("ReportServer", "ReportServerTempDB")
CHECK_JOB_SUFFIX = ": Check Database (User DBs)"
FATAL_PATTERNS = ("%DBCC database corruption%", "%Stack Dump%SQLDump%")
PERF_PATTERNS = ("FlushCache: % for db %:%", "% I/O requests taking longer than 15 seconds %")
MSG_LEN = 250

DB_SCAN_POLICIES = (3, 4, 5, 6, 7, 8, 9, 18, 26, 27, 28, 29)
FILE_POLICIES = (1, 2)
LOG_POLICIES = (21, 25)


# Fixed values (must equal the reference's): the message texts, in policy order.
# "%s" marks an inserted value.  In the FORMATTED ones a NULL value prints as "(null)"; in the
# others it makes the whole message NULL, as string "+" does.
MESSAGES = {
    "file": "File: %s",                                                                    # 1, 2
    "sharepoint_unset": "pol.allow_sharepoint is not set.",                                 # 3
    "collation": "DB: %s; Server: %s",                                                      # 3
    "compat_level": "DB: %s; Server: %s",                                                   # 4
    "full_backup": "Last Full Backup: %s, Last Diff. Backup: %s",                           # 5
    "log_backup": "Last Log Backup: %s",                                                    # 5
    "auto_close": "AutoClose=ON",                                                           # 6
    "auto_shrink": "AutoShrink=ON",                                                         # 7
    "start_mode": "%s (%s) must be configured to start %s.",                                # 10
    "account": "%s (%s) must run under named account. Currently runs under %s.",           # 11
    "priority_boost": 'The option "priority boost" must be turned off.',                    # 12
    "servername_null": "@@servername may not be null.",                                     # 13
    "instance_name": "Invalid instance name. Machine: %s, but instance: %s.",              # 13
    "check_job_missing": "Job for check of user databases does not exist.",                 # 14
    "check_job_disabled": "Job for check of user databases is disabled.",                   # 14
    "maxdop_unset": "pol.required_maxdop is not set.",                                      # 16
    "maxdop": "Must be set to %s, but currently is %s.",                                    # 16
    "sa_disabled": "SA account is disabled.",                                               # 17
    "sa_expiration": "Expiration for SA account is set.",                                   # 17
    "sa_policy": "Policy check for SA account is set.",                                     # 17
    "vlf_unset": "pol.allowed_max_vlf is not set.",                                         # 18
    "vlf": "Max. allowed: %s, but currently: %s.",                                          # 18
    "orphan_exclusion": "The database cannot be found, but an entry exists in "
                        "base.tblProcessingExclusion. Please check.",                       # 19
    "orphan_retention": "The database cannot be found, but an entry exists in "
                        "base.tblIndividualBackupSetting. Please check.",                   # 19
    "unneeded_exclusion": "This exclusion for policy 3 is not needed, since the database has "
                          "SharePoint collation and pol.allow_sharepoint=1.",               # 20
    "log_names": "%s job step log name(s) do not conform to naming rules.",                 # 22
    "job_category": 'Job "%s": Category "%s"',                                              # 23
    "job_notification": 'Job "%s": mail notification must be "on failure" or "on completion".',  # 24
    "arithabort": "ARITHABORT=OFF",                                                         # 26
    "not_mirrored": "It seems that mirroring is not configured for this DB. Please check.", # 27
    "safety_unset": "pol.mirr_safety_level is not set.",                                    # 29
    "timeout_unset": "pol.mirr_conn_timeout is not set.",                                   # 29
    "partner_unset": "pol.mirr_partner_name is not set.",                                   # 29
    "safety": "Safety level: is=%s, must be=%s.",                                           # 29
    "timeout": "Connection timeout: is=%s, must be=%s.",                                    # 29
    "partner": "Partner name: is=%s, must be=%s.",                                          # 29
}
FORMATTED = {"maxdop", "vlf", "log_names", "job_category", "job_notification", "safety", "timeout", "partner"}
#: shown for a value that is not known, and for a message that would be NULL
UNKNOWN = "?"
SERVICE_LABELS = {"engine": "SQL Server", "agent": "SQL Server Agent"}                   # 10, 11
START_MODES = {3: "manually", 2: "automatically"}                                        # 10 (clustered, not)


def message(key: str, *values: Column) -> Column:
    """A message of ``MESSAGES`` with its values inserted."""
    return (format_message if key in FORMATTED else fill)(MESSAGES[key], *values)


def _violations(df: DataFrame, *, db_level: bool, policy_no: Column | int | None = None,
                db_name: Column | None = None, stmt_no: Column | int = 1, message: Column | None = None,
                db_state: Column | None = None, log_order: Column | None = None,
                log_date: Column | None = None) -> DataFrame:
    def c(v, default=None):
        if v is None:
            return F.lit(default)
        return v if isinstance(v, Column) else F.lit(v)
    return df.select(
        F.col("server_id").cast("bigint").alias("server_id"),
        c(policy_no).cast("int").alias("policy_no"),
        F.lit(db_level).alias("db_level"),
        c(db_name).cast("string").alias("db_name"),
        c(db_state).cast("int").alias("db_state"),
        c(stmt_no).cast("int").alias("stmt_no"),
        c(log_order).cast("int").alias("log_order"),
        c(log_date).cast("timestamp_ntz").alias("log_date"),
        c(message).cast("string").alias("message"))


def db_violations(df: DataFrame, policy_no: int, message: Column, stmt_no: int = 1) -> DataFrame:
    """Rows of a database-catalog frame (``server_id, name, state``) as violations of a
    database-level policy -- the helper user policies build on."""
    return _violations(df, db_level=True, policy_no=policy_no, db_name=F.col("name"), db_state=F.col("state"),
                       stmt_no=stmt_no, message=message)


def register_policy(ctx: CheckContext, spec, build: Callable[[CheckContext], DataFrame]) -> None:
    """User extension: add a policy to the run's registry (if its number is new) with
    its exclusions and the function that builds its violations."""
    from vigil.operators import registry as reg
    new = reg.registry_frame(ctx.spark, [spec])
    ctx.registry, ctx.exclusions = reg.register(ctx.registry, ctx.exclusions, new,
                                                reg.exclusion_requests(ctx.spark, [spec]))
    ctx.extra[spec.number] = build


def _inline_rules(df: DataFrame, rules: list[tuple[int, int, Column, Column]]) -> DataFrame:
    """Rows of ``df`` -> one row per broken rule (policy, stmt, message).

    The rule array is built in a plain projection (config scalars may appear in the
    conditions; subqueries are not allowed inside higher-order functions)."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    hits = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(p).alias("p"), lit(s).cast("int").alias("s"),
                                                          msg.alias("m")))
                                     for p, s, cond, msg in rules]))
    return (df.withColumn("_hits", hits)
              .filter(F.size("_hits") > 0)
              .select("*", F.inline("_hits"))
              .drop("_hits"))


# ---------------------------------------------------------------- database catalog

def _database_rules(ctx: CheckContext) -> dict[int, list[tuple[int, Column, Column]]]:
    col = F.col
    name, coll = col("name"), col("collation_name")
    srv_coll = col("srv_collation")
    allow = ctx.cfg_int("pol.allow_sharepoint")
    allow01 = F.when(allow == 1, F.lit(1)).otherwise(F.lit(0))
    srv_level = F.concat(F.substring_index(col("srv_product_version"), ".", 1), F.lit("0"))
    compat_txt = col("compatibility_level").cast("string")
    as_of = ctx.as_of_col()

    def too_old(c: str) -> Column:
        return col(c).isNull() | (boundary_days(col(c), as_of) > BACKUP_MAX_AGE_DAYS)

    def shown(c: str) -> Column:
        return F.coalesce(date120(col(c)), F.lit("?"))

    max_vlf = ctx.cfg_int("pol.allowed_max_vlf")
    m_safety = ctx.cfg_int("pol.mirr_safety_level")
    m_timeout = ctx.cfg_int("pol.mirr_conn_timeout")
    m_partner = ctx.cfg("pol.mirr_partner_name")
    m_all_set = m_safety.isNotNull() & m_timeout.isNotNull() & m_partner.isNotNull()
    mirrored = col("mirroring_guid").isNotNull()

    return {
        3: [(1, allow.isNull(), message("sharepoint_unset")),
            (1, allow.isNotNull() & (coll.isNull() | ((coll != srv_coll)
                                                      & ((allow01 == 0) | (coll != SHAREPOINT_COLLATION)))),
             message("collation", F.coalesce(coll, F.lit(UNKNOWN)), F.coalesce(srv_coll, F.lit(UNKNOWN))))],
        4: [(1, col("compatibility_level").isNull() | (compat_txt != srv_level),
             message("compat_level", F.coalesce(compat_txt, F.lit(UNKNOWN)), F.coalesce(srv_level, F.lit(UNKNOWN))))],
        5: [(1, too_old("last_full_backup") & too_old("last_diff_backup"),
             message("full_backup", shown("last_full_backup"), shown("last_diff_backup"))),
            (2, too_old("last_log_backup") & (F.lower(col("recovery_model_desc")) != "simple")
                & (F.lower(name) != "model"),
             message("log_backup", shown("last_log_backup")))],
        6: [(1, col("is_auto_close_on"), message("auto_close"))],
        7: [(1, col("is_auto_shrink_on"), message("auto_shrink"))],
        8: [(1, col("recovery_model") == 3, col("recovery_model_desc"))],
        9: [(1, col("state") != 0, col("state_desc"))],
        18: [(1, max_vlf.isNull(), message("vlf_unset")),
             (1, col("vlf_number") > max_vlf,
              message("vlf", max_vlf, col("vlf_number")))],
        26: [(1, col("is_arithabort_on") == F.lit(False), message("arithabort"))],
        27: [(1, ~mirrored, message("not_mirrored"))],
        28: [(1, mirrored & ~col("mirroring_state").isin(2, 4), col("mirroring_state_desc"))],
        29: [(1, m_safety.isNull(), message("safety_unset")),
             (2, m_timeout.isNull(), message("timeout_unset")),
             (3, m_partner.isNull(), message("partner_unset")),
             (4, m_all_set & mirrored & (col("mirroring_safety_level") != m_safety),
              message("safety", col("mirroring_safety_level"), m_safety)),
             (5, m_all_set & mirrored & (col("mirroring_conn_timeout") != m_timeout),
              message("timeout", col("mirroring_conn_timeout"), m_timeout)),
             (6, m_all_set & mirrored & ~ci_equal(col("mirroring_partner_name"), m_partner),
              message("partner", col("mirroring_partner_name"), m_partner))],
    }


def scan_databases(ctx: CheckContext, numbers) -> DataFrame | None:
    numbers = [n for n in DB_SCAN_POLICIES if n in set(numbers)]
    if not numbers:
        return None
    d = ctx.frame("databases")
    if {3, 4} & set(numbers):
        srv = ctx.frame("servers").select("server_id", F.col("collation").alias("srv_collation"),
                                          F.col("product_version").alias("srv_product_version"))
        d = d.join(srv, "server_id", "left")
    d = ctx.with_cfg(d)
    rules = _database_rules(ctx)
    flat = [(p, s, cond, msg) for p in numbers for s, cond, msg in rules[p]]
    hits = _inline_rules(d, flat)
    return _violations(hits, db_level=True, policy_no=F.col("p"), db_name=F.col("name"),
                       db_state=F.col("state"), stmt_no=F.col("s"), message=F.col("m"))


# ---------------------------------------------------------------- data files (1, 2)

def scan_files(ctx: CheckContext, numbers) -> DataFrame | None:
    numbers = [n for n in FILE_POLICIES if n in set(numbers)]
    if not numbers:
        return None
    pct = F.col("is_percent_growth")
    growth = F.col("growth_pages")
    msg = message("file", F.col("name"))
    rules = {1: (1, 1, pct, msg),
             2: (2, 1, (growth != 0) & (growth != GROWTH_100MB_PAGES) & ~pct, msg)}
    chosen = [rules[n] for n in numbers]
    # Only breaking files cross the shuffle of the file->database join.
    files = _inline_rules(ctx.frame("files").select("server_id", "db_key", "name", "is_percent_growth",
                                                    "growth_pages"), chosen)
    dbs = ctx.frame("databases").select("server_id", "db_key", F.col("name").alias("db_name"),
                                        F.col("state").alias("db_state"))
    joined = files.select("server_id", "db_key", "p", "s", "m").join(dbs, ["server_id", "db_key"])
    return _violations(joined, db_level=True, policy_no=F.col("p"), db_name=F.col("db_name"),
                       db_state=F.col("db_state"), stmt_no=F.col("s"), message=F.col("m"))


# ---------------------------------------------------------------- error log (21, 25)

def _ilike_any(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [c.ilike(p) for p in patterns])


def perf_db_id(text: Column) -> Column:
    """Database id named by a slow-flush or long-I/O line; 0 when neither form matches."""
    flush = F.regexp_extract(text, r"(?is)^.*? for db ([^:]*):", 1)
    long_io = F.regexp_extract(text, r"(?is) in database \[[^(]*\(([^)]*)\)", 1)
    tag = (F.when(text.ilike("% for db %:%"), flush)
            .when(text.ilike("% in database [%] (%). %"), long_io)
            .otherwise(F.lit("0")))
    return F.trim(tag).try_cast("int")


def scan_logs(ctx: CheckContext, numbers) -> DataFrame | None:
    numbers = [n for n in LOG_POLICIES if n in set(numbers)]
    if not numbers:
        return None
    text, when = F.col("text"), F.col("log_date")
    logs = ctx.frame("error_log").filter(F.col("log_order").isin(0, 1) & text.isNotNull())
    rules = {21: (21, 1, _ilike_any(text, FATAL_PATTERNS),
                  F.left(F.concat(date120(when), F.lit(" "), F.ltrim(F.replace(text, F.lit("*"), F.lit("")))),
                         F.lit(MSG_LEN))),
             25: (25, 1, _ilike_any(text, PERF_PATTERNS),
                  F.left(F.concat(date120(when), F.lit(" "), text), F.lit(MSG_LEN)))}
    hits = _inline_rules(logs.select("server_id", "log_order", "log_date", "text"), [rules[n] for n in numbers])
    hits = hits.withColumn("db_id", F.when(F.col("p") == 25, perf_db_id(text)))
    db_name = F.lit(None).cast("string")
    if 25 in numbers:
        # one scan feeds both policies; the lookup join has (server_id, NULL) keys for
        # policy 21 rows, which still spread over partitions by server_id
        dbs = ctx.frame("databases").select("server_id", F.col("database_id").alias("db_id"),
                                            F.col("name").alias("db_found"))
        hits = hits.join(dbs, ["server_id", "db_id"], "left")
        db_name = F.when(F.col("p") == 25, F.coalesce(F.col("db_found"), F.lit("???")))
    return _violations(hits, db_level=False, policy_no=F.col("p"), db_name=db_name, stmt_no=1,
                       message=F.col("m"), log_order=F.col("log_order"), log_date=F.col("log_date"))


# ---------------------------------------------------------------- server level

def _service_label(kind: Column) -> tuple[Column, Column]:
    """(statement number, label) of a service kind: engine first, agent second."""
    stmt = F.when(kind == "engine", F.lit(1)).otherwise(F.lit(2))
    label = F.when(kind == "engine", F.lit(SERVICE_LABELS["engine"])).otherwise(F.lit(SERVICE_LABELS["agent"]))
    return stmt, label


SERVICE_POLICIES = (10, 11)


def scan_services(ctx: CheckContext, numbers) -> DataFrame | None:
    """Policies 10 (start mode) and 11 (named account) in one pass over the services."""
    numbers = [n for n in SERVICE_POLICIES if n in set(numbers)]
    if not numbers:
        return None
    s = ctx.frame("services").filter(F.col("kind").isin("engine", "agent"))
    if 10 in numbers:
        s = s.join(ctx.frame("servers").select("server_id", "is_clustered"), "server_id", "left")
    stmt, label = _service_label(F.col("kind"))
    rules = []
    if 10 in numbers:
        clustered = F.coalesce(F.col("is_clustered"), F.lit(False))
        expected = F.when(clustered, F.lit(3)).otherwise(F.lit(2))
        how = F.when(clustered, F.lit(START_MODES[3])).otherwise(F.lit(START_MODES[2]))
        rules.append((10, stmt, F.col("start_mode") != expected,
                      message("start_mode", label, F.col("service_name"), how)))
    if 11 in numbers:
        acct = F.col("account")
        rules.append((11, stmt, (F.instr(acct, "\\") == 0) & (F.instr(acct, "@") == 0),
                      message("account", label, F.col("service_name"), acct)))
    hits = _inline_rules(s, rules)
    return _violations(hits, db_level=False, policy_no=F.col("p"), stmt_no=F.col("s"), message=F.col("m"))


SERVER_ROW_POLICIES = (12, 13, 14, 16)


def scan_servers(ctx: CheckContext, numbers) -> DataFrame | None:
    """Policies 12 (priority boost), 13 (instance name), 14 (check job) and 16 (max
    degree of parallelism) in one pass over the servers, joined once with the two
    options pivoted per server and once with the check-job state per server (both
    hash aggregates, combined map-side)."""
    numbers = [n for n in SERVER_ROW_POLICIES if n in set(numbers)]
    if not numbers:
        return None
    s = ctx.frame("servers").select("server_id", "machine_name", "servername")
    if {12, 16} & set(numbers):
        opt = F.col("configuration_id")
        options = (ctx.frame("options").filter(opt.isin(PRIORITY_BOOST_OPTION, MAXDOP_OPTION))
                      .groupBy("server_id")
                      .agg(F.max(F.when(opt == PRIORITY_BOOST_OPTION, F.col("value_in_use"))).alias("boost"),
                           F.max(F.when(opt == MAXDOP_OPTION, F.col("value_in_use"))).cast("int").alias("maxdop")))
        s = s.join(options, "server_id", "left")
    if 14 in numbers:
        job_name = (ctx.maint_db + CHECK_JOB_SUFFIX).lower()
        jobs = (ctx.frame("jobs").filter(F.lower(F.col("name")) == job_name)
                                 .groupBy("server_id").agg(F.bool_or("enabled").alias("any_enabled")))
        s = s.join(jobs, "server_id", "left")
    if 16 in numbers:
        s = ctx.with_cfg(s)
    rules = []
    if 12 in numbers:
        rules.append((12, 1, F.col("boost") == 1, message("priority_boost")))
    if 13 in numbers:
        sname, machine = F.col("servername"), F.col("machine_name")
        bad_name = (~F.startswith(F.lower(sname), F.lower(F.concat(machine, F.lit(ctx.instance_separator))))
                    & ~ci_equal(sname, machine))
        rules.append((13, 1, sname.isNull(), message("servername_null")))
        rules.append((13, 1, sname.isNotNull() & bad_name,
                      message("instance_name", machine, sname)))
    if 14 in numbers:
        rules.append((14, 1, F.col("any_enabled").isNull(), message("check_job_missing")))
        rules.append((14, 1, ~F.col("any_enabled"), message("check_job_disabled")))
    if 16 in numbers:
        required = ctx.cfg_int("pol.required_maxdop")
        rules.append((16, 1, required.isNull(), message("maxdop_unset")))
        rules.append((16, 1, required != F.col("maxdop"),
                      message("maxdop", required, F.col("maxdop"))))
    hits = _inline_rules(s, rules)
    return _violations(hits, db_level=False, policy_no=F.col("p"), stmt_no=F.col("s"), message=F.col("m"))


def pol_17(ctx):
    sa = ctx.frame("logins").filter(F.lower(F.col("name")) == "sa")
    rules = [(17, 1, F.col("is_disabled"), message("sa_disabled")),
             (17, 2, F.col("is_expiration_checked"), message("sa_expiration")),
             (17, 3, F.col("is_policy_checked"), message("sa_policy"))]
    hits = _inline_rules(sa.select("server_id", "is_disabled", "is_expiration_checked", "is_policy_checked"), rules)
    return _violations(hits, db_level=False, policy_no=17, stmt_no=F.col("s"), message=F.col("m"))


def pol_19(ctx):
    """Orphaned housekeeping entries, per server: exclusion patterns without '%' '[' ']'
    that match no database (statement 1) and retention overrides naming no database
    (statement 2).  Both lists are bounded configuration: they reach each server row
    as one scalar array, and per server only the matched entries are collected."""
    dbs = ctx.frame("databases").select("server_id", "name")
    pats = (ctx.exclusions.select("pattern").distinct()
               .filter(~F.lower(F.col("pattern")).isin([n.lower() for n in REPORT_SERVER_DBS])
                       & (F.instr("pattern", "%") == 0) & (F.instr("pattern", "[") == 0)
                       & (F.instr("pattern", "]") == 0)))
    overrides = ctx.frame("retention_overrides").select(F.col("db_name").alias("pattern")).distinct()
    entries = (pats.select(F.lit(1).alias("stmt"), "pattern")
                   .unionByName(overrides.select(F.lit(2).alias("stmt"), "pattern")))
    # plain names and override names: broadcast hash join on the lower-cased name
    exact = (entries.filter((F.col("stmt") == 2) | (F.instr("pattern", "_") == 0))
                    .withColumn("k", F.lower("pattern")))
    hit_exact = dbs.join(small(exact), F.lower(F.col("name")) == F.col("k")).select("server_id", "stmt", "pattern")
    # "_" patterns match names of exactly their length: length is the hash key, the
    # regex (rewritten once on the small side) the residual
    wild = (entries.filter((F.col("stmt") == 1) & (F.instr("pattern", "_") > 0))
                   .withColumn("rx", like_to_regex("pattern")).withColumn("n", F.length("pattern")))
    hit_wild = (dbs.join(small(wild), (F.length(F.col("name")) == F.col("n"))
                         & F.regexp_like(F.col("name"), F.col("rx")))
                   .select("server_id", "stmt", "pattern"))
    entry = lambda: F.struct(F.col("stmt").cast("int").alias("stmt"), F.col("pattern"))
    all_entries = entries.select(F.sort_array(F.collect_set(entry()))).scalar()
    found = (hit_exact.unionByName(hit_wild).groupBy("server_id")
                      .agg(F.collect_set(entry()).alias("found")))
    none = F.array().cast("array<struct<stmt:int,pattern:string>>")
    missing = (ctx.frame("servers").select("server_id").join(found, "server_id", "left")
                  .select("server_id", F.explode(F.array_except(all_entries, F.coalesce(F.col("found"), none)))
                          .alias("e")))
    return _violations(missing, db_level=False, policy_no=19, db_name=F.col("e.pattern"), stmt_no=F.col("e.stmt"),
                       message=F.when(F.col("e.stmt") == 1, message("orphan_exclusion"))
                                .otherwise(message("orphan_retention")))


def pol_20(ctx):
    allow = ctx.cfg_int("pol.allow_sharepoint")
    pats = (ctx.exclusions.filter((F.col("policy_no") == 3)
                                  & ~F.lower(F.col("pattern")).isin([n.lower() for n in REPORT_SERVER_DBS]))
               .select("pattern", F.lower("pattern").alias("k")))
    dbs = ctx.frame("databases").filter(F.col("collation_name") == SHAREPOINT_COLLATION).select("server_id", "name")
    dbs = ctx.with_cfg(dbs)
    j = dbs.join(pats, F.lower(F.col("name")) == F.col("k")).filter(F.coalesce(allow, F.lit(0)) == 1)
    return _violations(j, db_level=False, policy_no=20, db_name=F.col("pattern"),
                       message=message("unneeded_exclusion"))


def nonconforming_steps(ctx: CheckContext) -> DataFrame:
    """J9 / policy 22 rule: a step's log file, when set, must be named after its job
    (job name made OS-safe).  Compared without folder and extension, ignoring case."""
    jobs = ctx.frame("jobs").select("server_id", "job_key", F.col("name").alias("job_name"))
    steps = ctx.frame("job_steps").filter(F.col("output_file_name").isNotNull())
    j = steps.join(jobs, ["server_id", "job_key"])
    file_part = F.regexp_extract(F.col("output_file_name"), r"([^/\\]*)$", 1)
    base = F.regexp_replace(file_part, r"\.[^.]*$", "")
    expected = safe_os_name(F.col("job_name"))
    return (j.filter(~ci_equal(base, expected))
             .select("server_id", "job_key", "job_name", "step_id", "output_file_name",
                     expected.alias("expected_name")))


def pol_22(ctx):
    n = nonconforming_steps(ctx).groupBy("server_id").agg(F.count(F.lit(1)).alias("n"))
    return _violations(n.filter(F.col("n") > 0), db_level=False, policy_no=22,
                       message=message("log_names", F.col("n")))


JOB_POLICIES = (23, 24)


def scan_jobs(ctx: CheckContext, numbers) -> DataFrame | None:
    """Policies 23 (uncategorized) and 24 (mail notification) in one pass over the jobs;
    categories are a bounded lookup (broadcast after a size check)."""
    numbers = [n for n in JOB_POLICIES if n in set(numbers)]
    if not numbers:
        return None
    j = ctx.frame("jobs").select("server_id", "name", "category_id", "notify_level_email")
    rules = []
    if 23 in numbers:
        cats = ctx.frame("categories").select("category_id", F.col("name").alias("category_name"))
        j = j.join(small(cats), "category_id", "left")
        rules.append((23, 1, F.startswith(F.lower(F.col("category_name")), F.lit("[uncategorized")),
                      message("job_category", F.col("name"), F.col("category_name"))))
    if 24 in numbers:
        rules.append((24, 1, ~F.col("notify_level_email").isin(2, 3),
                      message("job_notification", F.col("name"))))
    hits = _inline_rules(j, rules)
    return _violations(hits, db_level=False, policy_no=F.col("p"), stmt_no=F.col("s"), message=F.col("m"))


SERVER_POLICIES: dict[int, Callable[[CheckContext], DataFrame]] = {17: pol_17, 19: pol_19, 20: pol_20, 22: pol_22}
SCANS = (scan_databases, scan_files, scan_logs, scan_services, scan_jobs, scan_servers)

ALL_POLICIES = sorted(set(DB_SCAN_POLICIES) | set(FILE_POLICIES) | set(LOG_POLICIES) | set(SERVICE_POLICIES)
                      | set(JOB_POLICIES) | set(SERVER_ROW_POLICIES) | set(SERVER_POLICIES))


def raw_violations(ctx: CheckContext, numbers=None) -> DataFrame:
    """Violations of the given policies (default: all known), before eligibility."""
    numbers = set(ALL_POLICIES if numbers is None else numbers)
    parts = [scan(ctx, numbers) for scan in SCANS]
    parts += [SERVER_POLICIES[n](ctx) for n in sorted(numbers) if n in SERVER_POLICIES]
    parts += [ctx.extra[n](ctx) for n in sorted(numbers) if n in ctx.extra]
    parts = [p for p in parts if p is not None]
    if not parts:
        return _violations(ctx.frame("servers").limit(0), db_level=False)
    # a NULL message could not be inserted in the reference; the violation is kept, its text unknown
    return reduce(DataFrame.unionByName, parts).withColumn("message", F.coalesce("message", F.lit(UNKNOWN)))
