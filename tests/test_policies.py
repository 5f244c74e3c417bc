import datetime as dt

from pyspark.sql import functions as F

from conftest import FrameInputs
from vigil.operators.numbering import number_within
from vigil.plans import policies as P
from vigil.plans import report as rpt
from vigil.plans.context import CheckContext


def test_perf_issue_database_id_parse(spark):
    texts = [("FlushCache: cleaned up 5 bufs for db 7:0", 7),
             ("SQL Server has encountered 2 occurrence(s) of I/O requests taking longer than 15 seconds to complete "
              "on file [x] in database [DB] (12). OS handle", 12),
             ("There were I/O requests taking longer than 15 seconds in total", 0),
             ("FlushCache: x for db abc:0", None)]
    df = spark.createDataFrame(texts, "text string, want int")
    assert all(r.got == r.want for r in df.select("want", P.perf_db_id(F.col("text")).alias("got")).collect())


def test_log_policies_generations_and_unknown_db(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    logs = spark.createDataFrame([
        (1, 0, t0, "x", "FlushCache: cleaned up 1 bufs for db 2:0"),
        (1, 1, t0, "x", "FlushCache: cleaned up 1 bufs for db 99:0"),
        (1, 2, t0, "x", "* DBCC database corruption"),                 # generation 2 is not read
        (1, 1, t0, "x", "** Stack Dump being sent to SQLDump0001"),
        (1, 0, t0, "x", None)],
        "server_id bigint, log_order int, log_date timestamp_ntz, process_info string, text string")
    dbs = spark.createDataFrame([(1, 2, 10, "tempdb", 0)], "server_id bigint, database_id int, db_key bigint, name string, state int")
    srv = spark.createDataFrame([(1,)], "server_id bigint")
    ctx = CheckContext(FrameInputs(spark, {"error_log": logs, "databases": dbs, "servers": srv}))
    got = sorted((r.policy_no, r.db_name, r.message) for r in P.raw_violations(ctx, [21, 25]).collect())
    assert got == [(21, None, "2024-01-01 10:00:00 Stack Dump being sent to SQLDump0001"),
                   (25, "???", "2024-01-01 10:00:00 FlushCache: cleaned up 1 bufs for db 99:0"),
                   (25, "tempdb", "2024-01-01 10:00:00 FlushCache: cleaned up 1 bufs for db 2:0")]


def test_backup_age_counts_midnights(spark):
    ctx_rows = [(1, 1, 1, "d1", 0, "FULL", dt.datetime(1998, 7, 30, 23, 59), None, dt.datetime(1998, 7, 30, 23, 59)),
                (1, 2, 2, "d2", 0, "FULL", dt.datetime(1998, 7, 31, 0, 0), None, dt.datetime(1998, 7, 31, 0, 0))]
    dbs = spark.createDataFrame(ctx_rows, "server_id bigint, database_id int, db_key bigint, name string, state int, "
                                          "recovery_model_desc string, last_full_backup timestamp_ntz, "
                                          "last_diff_backup timestamp_ntz, last_log_backup timestamp_ntz")
    ctx = CheckContext(FrameInputs(spark, {"databases": dbs}), as_of="1998-08-02 00:00:00")
    got = sorted((r.db_name, r.stmt_no) for r in P.scan_databases(ctx, [5]).collect())
    assert got == [("d1", 1), ("d1", 2)]   # 3 midnights for d1, exactly 2 for d2


def test_instance_name_rule(spark):
    srv = spark.createDataFrame([(1, "HOST1", "host1"), (2, "HOST2", "HOST2/INST"), (3, "HOST3", None),
                                 (4, "HOST4", "OTHER")], "server_id bigint, machine_name string, servername string")
    ctx = CheckContext(FrameInputs(spark, {"servers": srv}), instance_separator="/")
    got = sorted((r.server_id, r.message) for r in P.scan_servers(ctx, [13]).collect())
    assert got == [(3, "@@servername may not be null."),
                   (4, "Invalid instance name. Machine: HOST4, but instance: OTHER.")]


def test_numbering_is_dense_and_ordered_under_skew(spark):
    # one server holds most rows; its buckets are numbered apart
    rows = [(0, i) for i in range(5000)] + [(s, i) for s in range(1, 50) for i in range(20)]
    df = spark.createDataFrame(rows, "server_id bigint, v int")
    out = number_within(df, "server_id", F.struct((-F.floor(F.col("v") / 100)).alias("b")), [F.col("v").desc()], "seq")
    got = {}
    for r in out.collect():
        got.setdefault(r.server_id, []).append((r.seq, r.v))
    for sid, pairs in got.items():
        pairs.sort()
        assert [p[0] for p in pairs] == list(range(1, len(pairs) + 1))
        assert [p[1] for p in pairs] == sorted((p[1] for p in pairs), reverse=True)


def test_report_numbering_order(spark):
    from conftest import SMALL
    from vigil.sources.tables import FleetInputs
    rep = rpt.policy_report(CheckContext(FleetInputs(spark, SMALL)))
    rows = rep.orderBy("server_id", "seq").collect()
    by_server = {}
    for r in rows:
        by_server.setdefault(r.server_id, []).append(r.policy_no)
    # processing order == policy number for the built-in registry
    assert all(v == sorted(v) for v in by_server.values())


def test_unneeded_sharepoint_exclusion(spark):
    from vigil.operators import registry as reg
    dbs = spark.createDataFrame([(1, 1, 1, "SP_Content", 0, "Latin1_General_CI_AS_KS_WS"),
                                 (1, 2, 2, "Other", 0, "Latin1_General_CI_AS_KS_WS"),
                                 (2, 1, 3, "sp_content", 0, "SQL_Latin1_General_CP1_CI_AS")],
                                "server_id bigint, database_id int, db_key bigint, name string, state int, "
                                "collation_name string")
    excl = spark.createDataFrame([(3, "sp_content"), (3, "ReportServer"), (4, "Other")], reg.EXCLUSION_SCHEMA)
    on = spark.createDataFrame([("pol.allow_sharepoint", "1")], "name string, value string")
    off = spark.createDataFrame([("pol.allow_sharepoint", "0")], "name string, value string")
    inputs = FrameInputs(spark, {"databases": dbs})
    got = P.pol_20(CheckContext(inputs, exclusions=excl, config=on)).collect()
    assert [(r.server_id, r.db_name) for r in got] == [(1, "sp_content")]
    assert P.pol_20(CheckContext(inputs, exclusions=excl, config=off)).count() == 0


def test_fixture_sanity_counts(spark):
    """FIXTURES.md: policies 3, 4, 6, 9, 18 under the fixture registry and exclusions,
    and the log policies, at sf0.01."""
    from conftest import MEDIUM
    from vigil.sources.tables import FleetInputs
    i = FleetInputs(spark, MEDIUM)
    ctx = CheckContext(i, registry=i.fx("registry"), exclusions=i.fx("exclusions"))
    got = {n: rpt.policy_result(ctx, n).count() for n in (3, 4, 6, 9, 18)}
    assert got == {3: 3706, 4: 2805, 6: 518, 9: 653, 18: 4170}
    base = CheckContext(i)
    assert (rpt.policy_result(base, 21).count(), rpt.policy_result(base, 25).count()) == (265, 396)


def test_inventories_with_owner_and_long_command(spark):
    from vigil.operators import snapshots as snap
    day = dt.datetime(2020, 1, 1)
    jobs = spark.createDataFrame([(1, 10, "J-1", "backup", 0, "No description available.", True, "sid1", 1, 0, day, day, 3),
                                  (1, 11, "J-2", "index", 1, "nightly", False, "sid9", 1, 0, day, day, 4)],
                                 "server_id bigint, job_key bigint, job_id string, name string, category_id int, "
                                 "description string, enabled boolean, owner_sid string, start_step_id int, delete_level int, "
                                 "date_created timestamp, date_modified timestamp, version_number int")
    cats = spark.createDataFrame([(0, "[Uncategorized (Local)]"), (1, "Fleet")], "category_id int, name string")
    owners = spark.createDataFrame([(1, "sid1", "CORP\\dba")], "server_id bigint, owner_sid string, name string")
    inv = {r.job_id: r for r in snap.job_inventory(jobs, cats, owners).collect()}
    assert inv["J-1"].owner == "CORP\\dba" and inv["J-1"].description is None and inv["J-1"].category.startswith("[")
    assert inv["J-2"].owner is None and inv["J-2"].description == "nightly"
    steps = spark.createDataFrame([(1, 10, 1, "s", "TSQL", None, "x" * 1500, 0, 1, 0, 2, 0, None, "master", None, 0, 0, None)],
                                  "server_id bigint, job_key bigint, step_id int, step_name string, subsystem string, "
                                  "output_file_name string, command string, cmdexec_success_code int, on_success_action int, "
                                  "on_success_step_id int, on_fail_action int, on_fail_step_id int, server string, database_name string, "
                                  "database_user_name string, retry_attempts int, retry_interval int, proxy_id int")
    r = snap.step_inventory(steps, jobs).first()
    assert r.job_id == "J-1" and len(r.command) == 1000 and len(r) == 18


def test_formatted_messages_print_null_and_missing_servers_keep_their_violations(spark):
    jobs = spark.createDataFrame([(1, 1, "j", None, True, 0, 0, "d")], "server_id bigint, job_key bigint, job_id string, name string, "
                                 "enabled boolean, category_id int, notify_level_email int, description string")
    got = {r.policy_no: r.message for r in P.raw_violations(CheckContext(FrameInputs(spark, {"jobs": jobs})), [23, 24]).collect()}
    assert got[23].startswith('Job "(null)": Category "[Uncategorized') and got[24].startswith('Job "(null)": mail')
    inputs = FrameInputs(spark, {})
    servers = inputs.fx("servers").filter("server_id < 0")  # none is known
    ctx = CheckContext(FrameInputs(spark, {"servers": servers}))
    v = P.raw_violations(ctx, [3, 4])
    dbs = inputs.fx("databases")
    assert v.filter("policy_no = 3").count() == dbs.filter("collation_name is null").count() > 0
    assert v.filter("policy_no = 4").count() == dbs.filter("compatibility_level is null").count() > 0
    assert {r.message for r in v.collect()} == {"DB: ?; Server: ?"}
