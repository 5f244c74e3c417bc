import datetime as dt
import tempfile

from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL
from vigil.operators import quality as q
from vigil.sources.tables import FleetInputs
from vigil.streaming import events as ev
from vigil.streaming import throttle
from vigil.streaming.event_files import EventFiles


def test_bound_check_flags_only_broken_row(spark):
    b = FleetInputs(spark, SMALL).fx("volume_bounds")
    bad = q.check_violations(b, q.volume_bound_check(b), "CK_volume_bound").collect()
    assert [r.volume_name for r in bad] == ["X:/"]


def test_fk_orphans_and_cascade(spark):
    i = FleetInputs(spark, SMALL)
    reg = i.fx("registry")
    excl = i.fx("exclusions").unionByName(spark.createDataFrame([(15, "x")], "policy_no int, pattern string"))
    assert [r.policy_no for r in q.orphans(excl, reg, ["policy_no"]).collect()] == [15]
    kept = q.cascade_keep(excl, reg.filter("policy_no <> 3"), ["policy_no"])
    assert sorted(r.policy_no for r in kept.collect()) == [1, 4, 9, 18]


def _sorted(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_event_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="vigil-xe-")
    stream = ev.session_filter(ev.stream_fixture(spark, MEDIUM, "xe_events"))
    ev.run_available_now(stream, base + "/out", base + "/ck")
    got = spark.read.parquet(base + "/out")
    want = ev.session_filter(FleetInputs(spark, MEDIUM).fx("xe_events"))
    assert got.count() == 5074 and _sorted(got) == _sorted(want.select(got.columns))


def test_counter_stream_with_watermark_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="vigil-perf-")
    stream = ev.perf_rollup(ev.stream_fixture(spark, SMALL, "perf_samples"), watermark="2 minutes")
    ev.run_available_now(stream, base + "/out", base + "/ck", output_mode="append")
    got = spark.read.parquet(base + "/out")
    want = ev.perf_rollup(FleetInputs(spark, SMALL).fx("perf_samples"))
    # append mode emits a window once the watermark has passed its end: just those are there
    newest = want.agg(F.max("window_start")).first()[0]
    last = FleetInputs(spark, SMALL).fx("perf_samples").agg(F.max("ts")).first()[0] - dt.timedelta(minutes=2)
    closed = want.filter(F.col("window_start") + F.expr("interval 60 seconds") <= F.lit(last).cast("timestamp"))
    assert newest is not None and _sorted(got) == _sorted(closed.select(got.columns)) and got.count() > 900


def test_alert_throttle_suppresses_within_delay(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    secs = [0, 100, 3599, 3600, 3700, 7300, 7200 + 3600]
    rows = [(i, 1, t0 + dt.timedelta(seconds=s), "A") for i, s in enumerate(secs)]
    rows += [(100, 2, t0, "A"), (101, 1, t0 + dt.timedelta(seconds=50), "B")]
    src = tempfile.mkdtemp(prefix="vigil-alerts-")
    spark.createDataFrame(rows, "event_id long, server_id long, ts timestamp, alert_name string") \
         .coalesce(1).write.mode("overwrite").parquet(src + "/in")
    stream = spark.readStream.schema("event_id long, server_id long, ts timestamp, alert_name string").parquet(src + "/in")
    running = throttle.AlertThrottle(spark, src + "/out")
    running.start(stream, availableNow=True).awaitTermination()
    running.close()
    got = sorted(r.event_id for r in running.responses().collect())
    assert got == [0, 3, 5, 100, 101]     # 3600 s after 0, then 7300 (>= 3600 after 3600); 10800 - 7300 < 3600


def test_batch_throttle_does_not_depend_on_file_order(spark):
    src = tempfile.mkdtemp(prefix="vigil-throttle-") + "/in"
    t0 = dt.datetime(2024, 1, 1)
    schema = "event_id long, server_id long, ts timestamp, alert_name string"
    for files in ([(3, 5 * 3600)], [(1, 0), (2, 7200), (4, 7300), (5, 10799)]):
        rows = [(i, 1, t0 + dt.timedelta(seconds=s), "A") for i, s in files]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    got = sorted(r.event_id for r in throttle.throttled(spark.read.parquet(src)).collect())
    assert got == [1, 2, 3]
    rng = __import__("random").Random(2)
    rows = [(i, i % 2, t0 + dt.timedelta(seconds=rng.randrange(60_000)), "AB"[i % 3 == 0]) for i in range(3000)]
    want, last = [], {}
    for i, s, t, a in sorted(rows, key=lambda r: (r[2], r[0])):
        if (s, a) not in last or (t - last[s, a]).total_seconds() >= 3600:
            last[s, a] = t
            want.append(i)
    df = spark.createDataFrame(rows, schema).repartition(5)
    for cells in (2, 5, 48):  # pieces of long segments
        assert sorted(r.event_id for r in throttle.throttled(df, cells).collect()) == sorted(want) and len(want) < 200


def test_log_policies_on_a_streamed_log_equal_batch(spark):
    from conftest import FrameInputs
    from vigil.plans import policies as P
    from vigil.plans.context import CheckContext
    base = tempfile.mkdtemp(prefix="vigil-log-")
    stream = ev.stream_fixture(spark, SMALL, "error_log")
    ctx = CheckContext(FrameInputs(spark, {"error_log": stream}))
    ev.run_available_now(P.scan_logs(ctx, [21, 25]), base + "/out", base + "/ck")
    got = spark.read.parquet(base + "/out")
    want = P.scan_logs(CheckContext(FleetInputs(spark, SMALL)), [21, 25])
    assert got.count() > 0 and _sorted(got) == _sorted(want.select(got.columns))


def test_report_sink_replaces_only_its_run_date(spark):
    from vigil.plans import report as rpt
    from vigil.plans.context import CheckContext
    path = tempfile.mkdtemp(prefix="vigil-report-") + "/report"
    rep = rpt.policy_report(CheckContext(FleetInputs(spark, SMALL)), "6,9")
    rpt.write_report(rep, path, "2024-01-01")
    rpt.write_report(rep.filter("policy_no = 6"), path, "2024-01-02")
    rpt.write_report(rep.filter("policy_no = 9"), path, "2024-01-02")      # replaces that day only
    back = spark.read.parquet(path)
    counts = {str(r.run_date): r["count"] for r in back.groupBy("run_date").count().collect()}
    assert counts == {"2024-01-01": rep.count(), "2024-01-02": rep.filter("policy_no = 9").count()}
    rpt.write_report(rep.limit(0), path, "2024-01-02")                     # a clean rerun clears the day
    assert rpt.read_report(spark, path, "2024-01-02").count() == 0
    assert rpt.read_report(spark, path, "2024-01-01").count() == rep.count()
    clean = tempfile.mkdtemp(prefix="vigil-clean-") + "/report"
    rpt.write_report(rep.limit(0), clean, "2024-01-01")                    # a first run without violations
    assert rpt.read_report(spark, clean, "2024-01-01").count() == 0


def test_checkpoint_folder_must_be_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from vigil import session
    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with __import__("pytest").raises(RuntimeError):
        session.checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_alert_match_stream_equals_batch(spark):
    from vigil.operators import registry as reg
    base = tempfile.mkdtemp(prefix="vigil-alert-")
    rules = ev.alert_rules(reg.MAINT_DB)
    ev.run_available_now(ev.alert_match(ev.stream_fixture(spark, SMALL, "xe_events"), rules), base + "/out", base + "/ck")
    got = spark.read.parquet(base + "/out")
    want = ev.alert_match(FleetInputs(spark, SMALL).fx("xe_events"), rules)
    assert got.count() > 0 and _sorted(got) == _sorted(want.select(got.columns))


def test_list_from_unset_config_matches_nothing(spark):
    from vigil.operators import selection as sel
    i = FleetInputs(spark, SMALL)
    empty_cfg = i.fx("config").filter("name <> 'base.database_list'")
    assert sel.expand("list($usedefinition)", i.fx("databases"), i.fx("servers"), empty_cfg).count() == 0
    assert sel.expand("list($usedefinition)", i.fx("databases"), i.fx("servers"), i.fx("config")).count() > 0
    assert sel.expand("LIST(master)", i.fx("databases"), i.fx("servers")).count() == \
        sel.expand("master", i.fx("databases"), i.fx("servers")).count()


def test_event_session_query_runs_with_dispatch_trigger(spark):
    base = tempfile.mkdtemp(prefix="vigil-session-")
    q = ev.event_session(ev.stream_fixture(spark, SMALL, "xe_events"), base + "/out", base + "/ck")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = ev.session_filter(FleetInputs(spark, SMALL).fx("xe_events"))
    got = EventFiles(spark, base + "/out").read()
    assert _sorted(got) == _sorted(want.select(got.columns))


def test_alert_throttle_across_micro_batches(spark):
    # two files, one per trigger: the second batch must see the first batch's state
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    src = tempfile.mkdtemp(prefix="vigil-alerts2-")
    schema = "event_id long, server_id long, ts timestamp, alert_name string"
    spark.createDataFrame([(1, 1, t0, "A")], schema).coalesce(1).write.parquet(src + "/in/a")
    spark.createDataFrame([(2, 1, t0 + dt.timedelta(seconds=1800), "A"), (3, 1, t0 + dt.timedelta(seconds=3600), "A")],
                          schema).coalesce(1).write.parquet(src + "/in/b")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                   .option("recursiveFileLookup", "true").parquet(src + "/in"))
    running = throttle.AlertThrottle(spark, src + "/out")
    running.start(stream, availableNow=True).awaitTermination()
    running.close()
    assert sorted(r.event_id for r in running.responses().collect()) == [1, 3]


def test_wait_filter_by_numeric_keys(spark):
    rows = [(1, "wait_info", 60, 20000, 178), (2, "wait_info", 60, 20000, 5), (3, "wait_info", 40, 20000, 5),
            (4, "wait_info", 60, 15000, 5), (5, "xml_deadlock_report", 1, 0, 178)]
    df = spark.createDataFrame(rows, "event_id long, event_name string, session_id int, duration_ms long, wait_key int")
    got = ev.session_filter(df, ignored=ev.WAIT_KEYS_IGNORED_2012, key="wait_key")
    assert sorted(r.event_id for r in got.collect()) == [2, 5]


def test_activity_collector_stream_appends_like_batch(spark):
    from vigil.operators import snapshots as snap
    base = tempfile.mkdtemp(prefix="vigil-activity-")
    i = FleetInputs(spark, SMALL)

    def chain(req):
        return snap.activity_snapshot(req.drop("sql_text"), i.fx("sessions"),
                                      i.fx("requests").select("server_id", "session_id", "request_id", "sql_text"),
                                      i.fx("jobs"), i.fx("job_steps"), i.fx("databases"))

    q = snap.append_snapshot(chain(ev.stream_fixture(spark, SMALL, "requests")), base + "/t", "snap_time_stamp",
                             base + "/ck")
    q.awaitTermination()
    got = spark.read.parquet(base + "/t")
    want = chain(i.fx("requests"))
    assert got.count() == want.count() > 0
    assert _sorted(got.drop("snap_date")) == _sorted(want.select([c for c in got.columns if c != "snap_date"]))
    assert got.select("snap_date").distinct().count() > 1


def test_activity_rollup_stream_with_watermark(spark):
    from vigil.operators import snapshots as snap
    base = tempfile.mkdtemp(prefix="vigil-rollup-")
    i = FleetInputs(spark, SMALL)

    def chain(req):
        return snap.activity_snapshot(req.drop("sql_text"), i.fx("sessions"),
                                      i.fx("requests").select("server_id", "session_id", "request_id", "sql_text"),
                                      i.fx("jobs"), i.fx("job_steps"), i.fx("databases"))

    stream = ev.activity_rollup(chain(ev.stream_fixture(spark, SMALL, "requests")), watermark="30 minutes")
    ev.run_available_now(stream, base + "/out", base + "/ck")
    got = spark.read.parquet(base + "/out")
    want = ev.activity_rollup(chain(i.fx("requests")))
    # append mode: just the windows that the watermark has passed are there
    last = i.fx("requests").filter("command is not null and coalesce(wait_type, '') <> 'BROKER_RECEIVE_WAITFOR'") \
            .agg(F.max("snap_ts")).first()[0]
    closed = want.filter(F.col("window_end") <= F.lit(last - dt.timedelta(minutes=30)).cast("timestamp"))
    assert closed.count() > 0 and set(_sorted(closed.select(got.columns))) == set(_sorted(got))


def test_duplicate_keys_are_dealt_by_the_size_of_the_files(spark, monkeypatch, tmp_path):
    from vigil.operators import quality
    spark.range(20_000).select((F.col("id") % 19_999).alias("k"), F.lit(None).cast("long").alias("j")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(quality, "TASK_BYTES", 2_000)
    out = quality.duplicate_keys(df, ["k", "j"], "t")
    assert out.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism * 4  # a fixed number before
    assert [tuple(r) for r in out.collect()] == [("t", "0", 2)]
