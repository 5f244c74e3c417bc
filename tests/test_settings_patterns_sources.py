"""Settings of single servers, the pattern index, the report's single evaluation, volumes, counters,
log rotation and the throttle's late output."""
import datetime as dt
import re
import tempfile
import time
from functools import reduce

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL, FrameInputs
from test_like_property import like
from vigil.functions import joins
from vigil.operators import registry as reg
from vigil.operators import snapshots as snap
from vigil.plans import report as rpt
from vigil.plans.context import CheckContext
from vigil.sources import volumes as vol
from vigil.sources.tables import FleetInputs
from vigil.streaming import counters, throttle
from vigil.streaming import events as ev


# ---------------------------------------------------------------- settings

def test_a_servers_own_setting_comes_before_the_fleets(spark):
    fleet = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, value string")
    own = spark.createDataFrame([(1, "a", "9"), (2, "b", "x"), (2, "c", "5"), (3, "other", "0")], "server_id long, name string, value string")
    servers = spark.createDataFrame([(i,) for i in (1, 2, 3)], "server_id long")
    rows = reg.with_settings(servers, fleet, ["a", "b", "c"], own).select("server_id", "_cfg.*").collect()
    assert {tuple(r) for r in rows} == {(1, "9", "2", None), (2, "1", "x", "5"), (3, "1", "2", None)}
    listed = reg.effective_settings(servers, fleet, own, ["a", "b", "c"]).collect()
    assert {(r.server_id, r.name): (r.value, r.is_own) for r in listed}[2, "c"] == ("5", True)
    assert len(listed) == 7


def test_volume_bounds_of_a_server_are_not_mixed_with_the_fleets(spark):
    v = spark.createDataFrame([(1, "C:/", 100, 40), (2, "C:/", 100, 40), (1, "D:/", 100, 40)], "server_id long, name string, capacity long, free_space long")
    bounds = spark.createDataFrame([("c:/", 10.0, 50.0)], "volume_name string, warning_pct double, error_pct double")
    own = spark.createDataFrame([(2, "c:/", 70.0, 95.0)], "server_id long, volume_name string, warning_pct double, error_pct double")
    got = {(r.server_id, r.volume_name): (r.warning_pct, r.error_pct, r.status) for r in snap.disk_space(v, bounds, own).collect()}
    assert got == {(1, "C:/"): (10.0, 50.0, "ERROR"), (2, "C:/"): (70.0, 95.0, "OK"), (1, "D:/"): (80.0, 90.0, "OK")}


# ---------------------------------------------------------------- patterns

def _plan(df) -> str:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_pattern_index_keys(spark):
    rows = ["abcdef%", "ab%", "a%xyz1", "%xyz1", "[_]b[c]_", "_", "%", "[ab]cd", "%[ab]%", "É%", "x[^y]z%", "KELVIN%", "%12"]
    got = {r.pattern: (r.kind, r.literal) for r in joins.pattern_index(spark.createDataFrame([(p,) for p in rows], "pattern string")).collect()}
    assert got == {"abcdef%": ("prefix4", "abcd"), "ab%": ("prefix2", "ab"), "a%xyz1": ("gram", "xyz"), "%xyz1": ("gram", "xyz"),
                   "[_]b[c]_": ("gram", "_bc"), "_": ("any", ""), "%": ("any", ""), "[ab]cd": ("any", ""), "%[ab]%": ("any", ""),
                   "É%": ("any", ""), "x[^y]z%": ("prefix1", "x"), "KELVIN%": ("prefix4", "kelv"), "%12": ("any", "")}


ALPHA = "abkK_%.[]^\u212a\u017fsi\u0130"


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 2), st.text(alphabet="abcABC_%[].^", min_size=1, max_size=8)), min_size=20, max_size=60),
       st.lists(st.text(alphabet="abcABC_.", max_size=8), min_size=20, max_size=60))
def test_anti_like_equals_brute_force(spark, patterns, names):
    names = sorted(set(names))
    df = spark.createDataFrame([(k, n) for n in names for k in (1, 2)], "k int, name string")
    p = spark.createDataFrame(patterns, "k int, pattern string")
    want = {(k, n) for k in (1, 2) for n in names if not any(k == j and like(n, x) for j, x in patterns)}
    assert {tuple(r) for r in joins.anti_like(df, "name", p, ["k"]).collect()} == want
    given_names = df.select("name")
    assert {tuple(r) for r in joins.anti_like(df, "name", p, ["k"], names=given_names).collect()} == want


def test_letters_outside_ascii_match_as_in_the_regex(spark):
    from vigil.functions.text import like_to_regex
    names, patterns = ["\u212aelvin_x", "kelvin_x", "\u017ftop", "STOP", "\u0130nn", "inn", "\u0131nn", "stra\u00dfe"], ["KELV%", "sto_", "in%", "%elvin%", "STRA%"]
    p = spark.createDataFrame([(1, x) for x in patterns], "k int, pattern string")
    df = spark.createDataFrame([(1, n) for n in names], "k int, name string")
    pairs = df.join(p.withColumnRenamed("k", "j")).select("name", F.regexp_like("name", like_to_regex("pattern")).alias("m"))
    hit = {r.name for r in pairs.filter("m").collect()}
    assert {r.name for r in joins.anti_like(df, "name", p, ["k"]).collect()} == set(names) - hit and len(hit) >= 7


def test_many_patterns_have_no_join_on_the_policy_alone(spark):
    i = FleetInputs(spark, SMALL)
    got = reg.eligible_databases(i.fx("databases"), i.fx("registry"), i.fx("like_exclusions"))
    plan = _plan(got)
    joined = re.findall(r"(?:BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin) \[([^\]]*)\]", plan)
    # patterns without literal text are one row a policy; every other join has a name, a prefix or a gram in its key
    assert joined and sum(key.startswith("policy_no") and "," not in key for key in joined) <= 1


def test_names_meet_few_of_many_patterns(spark):
    n = spark.range(2000).withColumn("id", F.col("id").cast("string"))
    forms = ["concat('DB[_]', id, '%')", "concat('db_', id)", "concat('d__', id, '_')", "concat('%', id)", "concat('%x', id, '%y')", "concat('_b[_]', id)"]
    p = reduce(lambda a, b: a.unionByName(b), [n.select(F.expr(f + " as pattern")) for f in forms])
    names = n.select(F.concat(F.lit("DB_"), "id").alias("name"))
    pairs = joins.name_keys(names, joins.pattern_keys(p)).join(joins.pattern_keys(p), "key")
    # an index of first characters or of three-character pieces pairs hundreds of patterns with a name
    assert pairs.count() < 20 * 2000
    assert joins.pattern_keys(p).filter("key is null").count() == 0


def test_report_evaluates_its_policies_once(spark):
    plan = _plan(rpt.policy_report(CheckContext(FleetInputs(spark, SMALL))))
    exchanges = [line for line in plan.split("\n") if "_bucket" in line and "Exchange" in line and "REPARTITION" in line]
    # rows and counts read one exchange; a second one would stand over a second union of the policies
    assert len([line for line in exchanges if "ReusedExchange" not in line]) == 1
    assert "ReusedExchange" in plan


def test_rows_and_counts_of_the_report_ask_for_the_same_columns(spark):
    plan = rpt.policy_report(CheckContext(FleetInputs(spark, SMALL)))._jdf.queryExecution().optimizedPlan().toString()
    made = [re.sub(r"#\d+L?", "", line[line.index("Project ["):]) for line in plan.split("\n") if "AS _bucket#" in line]
    # other columns make another exchange, and a second evaluation of all policies
    assert made and len(set(made)) == 1


# ---------------------------------------------------------------- sources

def test_raw_volume_inventory(spark):
    path = tempfile.mkdtemp(prefix="vigil-vol-") + "/xml"
    rows = [("HOST1", "C:\\", "System <1> & more", 100, 40, 3), ("HOST1", "E:\\", None, None, None, 5), ("HOST2", "D:\\", "", 50, 5, 3), ("HOST2", "F:\\", "usb", 5, 5, 2)]
    df = spark.createDataFrame(rows, "node string, name string, label string, capacity long, free_space long, drive_type int")
    vol.write_volume_inventory(df, path)
    got = {(r.node, r.name): (r.label, r.capacity, r.free_space) for r in vol.read_volume_inventory(spark, path).collect()}
    assert got[("HOST1", "C:\\")] == ("System <1> & more", 100, 40) and set(got) == {("HOST1", "C:\\"), ("HOST2", "D:\\")}
    assert vol.read_volume_inventory(spark, path, None).count() == 4
    tool = tempfile.mkdtemp(prefix="vigil-vol-")  # as the tool writes it, properties in any order, some missing
    with open(tool + "/volumes.xml", "w") as f:
        f.write('<COMMAND SEQUENCENUM="1"><RESULTS NODE="HOST9"><CIM>'
                '<INSTANCE CLASSNAME="Win32_Volume"><PROPERTY NAME="FreeSpace" TYPE="uint64"><VALUE>7</VALUE></PROPERTY>'
                '<PROPERTY NAME="DriveType" TYPE="uint32"><VALUE>3</VALUE></PROPERTY><PROPERTY NAME="Label" TYPE="string"></PROPERTY>'
                '<PROPERTY NAME="Name" TYPE="string"><VALUE>C:\\</VALUE></PROPERTY><PROPERTY NAME="Capacity" TYPE="uint64"><VALUE>bad</VALUE></PROPERTY></INSTANCE>'
                '<INSTANCE CLASSNAME="Win32_Volume"><PROPERTY NAME="Name" TYPE="string"><VALUE>X:\\</VALUE></PROPERTY></INSTANCE>'
                '</CIM></RESULTS></COMMAND>')
    assert [tuple(r) for r in vol.read_volume_inventory(spark, tool).collect()] == [("HOST9", "C:\\", None, None, 7, 3)]


def test_collected_counters(spark):
    paths = {r"\Memory\Pages/sec": 1, r"\MEMORY\pages/SEC": 1, r"\Memory(x)\Pages/sec": None, r"\Processor(3)\% Processor Time": 3,
             r"\Processor\% Processor Time": None, r"\PhysicalDisk(_Total)\% Disk Time": 6, r"\PhysicalDisk(1 D:)\% Disk Time": None,
             r"\MSSQL$X:Databases(_Total)\Transactions/sec": 10, r"\SQLServer:Databases(_Total)\Transactions/sec": 10,
             r"\Databases(_Total)\Transactions/sec": None, r"\MSSQL$X:Memory\Pages/sec": None, "Memory": None,
             r"\MSSQL$A B:SQL Statistics\SQL Re-Compilations/sec": 15}
    df = spark.createDataFrame(list(paths.items()), "counter_path string, want int")
    got = {r.counter_path: (r.counter_no, r.sql_instance) for r in counters.collected(df).collect()}
    assert {p: n for p, (n, _) in got.items()} == {p: n for p, n in paths.items() if n}
    assert got[r"\SQLServer:Databases(_Total)\Transactions/sec"][1] == "MSSQLSERVER" and got[r"\MSSQL$X:Databases(_Total)\Transactions/sec"][1] == "X"
    assert len(counters.COUNTERS) == 15


def test_streamed_log_over_a_rotation_counts_a_line_once(spark):
    from vigil.plans import policies as P
    src = tempfile.mkdtemp(prefix="vigil-rotation-")
    schema = "server_id long, log_order int, log_date timestamp_ntz, process_info string, text string"
    t0 = dt.datetime(2024, 1, 1)
    text = lambda i: "DBCC database corruption %d" % i if i % 2 else "FlushCache: cleaned up %d bufs for db 3:0" % i
    line = lambda i, order: (1, order, t0 + dt.timedelta(minutes=i), "spid1", text(i))
    first, second = [line(i, 0) for i in range(6)], [line(i, 1) for i in range(6)] + [line(i, 0) for i in range(6, 9)]
    for rows in (first, second):  # before the log is cycled, and after
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src + "/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/in")
    ctx = CheckContext(FrameInputs(spark, {"error_log": ev.log_lines(stream)}))
    ev.run_available_now(P.scan_logs(ctx, [21, 25]), src + "/out", src + "/ck")
    now = spark.createDataFrame(second, schema)
    want = P.scan_logs(CheckContext(FrameInputs(spark, {"error_log": ev.log_lines(now)})), [21, 25])
    # the generation is the one in which a line was first seen
    key = lambda df: sorted((r.policy_no, r.message) for r in df.collect())
    assert key(spark.read.parquet(src + "/out")) == key(want) and want.count() == 9
    both = now.unionByName(spark.createDataFrame(first, schema))
    assert P.scan_logs(CheckContext(FrameInputs(spark, {"error_log": ev.log_lines(both)})), [21, 25]).count() == 9


# ---------------------------------------------------------------- throttle

SCHEMA = "event_id long, server_id long, ts timestamp, alert_name string"
T0 = dt.datetime(2024, 1, 1)


def _event(i, seconds, alert="A", server=1):
    return i, server, T0 + dt.timedelta(seconds=seconds), alert


@pytest.mark.parametrize("lateness, answered, late", [(600, [3], [1, 2, 4, 5]), (6 * 3600, [1, 2, 3], [])])
def test_throttle_stream_of_files_in_reversed_order(spark, lateness, answered, late):
    base = tempfile.mkdtemp(prefix="vigil-reversed-")
    for rows in ([_event(3, 5 * 3600)], [_event(1, 0), _event(2, 7200), _event(4, 7300), _event(5, 10799)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(base + "/in")
        time.sleep(1.1)
    running = throttle.AlertThrottle(spark, base + "/run", lateness)
    running.start(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(base + "/in"), availableNow=True).awaitTermination()
    running.close()
    assert sorted(r.event_id for r in running.responses().collect()) == answered
    assert sorted(r.event_id for r in running.late().collect()) == late
    everything = spark.read.parquet(base + "/in").filter(~F.col("event_id").isin(late))
    assert sorted(r.event_id for r in throttle.throttled(everything).collect()) == answered  # stream = batch


def test_throttle_batches_can_run_again(spark):
    running = throttle.AlertThrottle(spark, tempfile.mkdtemp(prefix="vigil-again-"), 60)
    frame = lambda *rows: spark.createDataFrame(list(rows), SCHEMA).select("event_id", "server_id", "alert_name", "ts")
    batches = [frame(_event(1, 0), _event(2, 30)), frame(_event(3, 3000), _event(4, 3700)), frame(_event(5, 3601), _event(6, 7400))]
    for n, df in enumerate(batches):
        running.batch(df, n)
        running.batch(df, n)
    running.close()
    # 5 comes 99 seconds behind 4, over the lateness; 6 is 3,700 seconds after 4
    assert sorted(r.event_id for r in running.responses().collect()) == [1, 4, 6]
    assert [r.event_id for r in running.late().collect()] == [5]


def test_hot_alert_runs_in_many_pieces(spark):
    df = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("server_id"), F.lit("hot").alias("alert_name"),
                                    (F.lit(T0).cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, id * 97)")).alias("ts"))
    got = throttle.throttled(df, 24)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # so few rows would be put together
    try:
        assert got.select(F.spark_partition_id()).distinct().count() >= 4
    finally:
        spark.conf.set(setting, "true")
    ids, last = [], None
    for i in range(20_000):
        if last is None or (i - last) * 97 >= 3600:
            ids.append(i)
            last = i
    assert sorted(r.event_id for r in got.collect()) == ids
