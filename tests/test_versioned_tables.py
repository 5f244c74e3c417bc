"""Versioned tables: retention, upsert and event files."""
import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from vigil.operators import retention as ret
from vigil.sources.versions import Conflict, VersionedTable
from vigil.streaming.event_files import EventFiles


def _table(spark, name="t"):
    return VersionedTable(spark, tempfile.mkdtemp(prefix="vigil-version-") + "/" + name)


def _days(spark, days):
    return spark.createDataFrame([(dt.datetime.fromisoformat(d + " 12:00:00"), i) for i, d in enumerate(days)], "at timestamp_ntz, v int")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_retention_rewrites_only_the_month_of_the_cut(spark):
    t = _table(spark)
    days = ["2023-01-05", "2023-02-09", "2023-02-10", "2023-02-11", "2023-03-01", "2024-02-09"]
    v1 = t.overwrite(_days(spark, days), ret.month_part("at"))
    v2 = ret.expire_rows(t, "at", 365, dt.datetime(2024, 2, 9, 8))  # the first day kept is 2023-02-10
    assert sorted(r.v for r in t.read().collect()) == [2, 3, 4, 5]
    assert sorted(v2.parts) == ["2023-02", "2023-03", "2024-02"]
    assert v2.parts["2023-03"] == v1.parts["2023-03"] and v2.parts["2023-02"] != v1.parts["2023-02"]
    assert t.read(v1).count() == 6  # the old version is still there
    again = ret.expire_rows(t, "at", 365, dt.datetime(2024, 2, 9, 8))
    assert t.read(again).count() == 4
    ret.expire_rows(t, "at", 10, dt.datetime(2030, 1, 1))
    assert t.read().count() == 0 and t.read().columns == ["at", "v"]
    gone = t.clean(keep=1)
    assert gone and t.read().count() == 0


def test_a_failed_run_leaves_the_old_version(spark):
    t = _table(spark)
    t.overwrite(_days(spark, ["2023-02-09", "2023-02-20"]), ret.month_part("at"))
    read = t.read
    t.read = lambda *a, **k: read(*a, **k).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        ret.expire_rows(t, "at", 365, dt.datetime(2024, 2, 10))
    t.read = read
    assert t.current().number == 1 and t.read().count() == 2
    t.write(_days(spark, ["2023-02-01"]), ret.month_part("at"))  # a run that ends before the switch
    assert t.read().count() == 2
    assert len(t.clean(keep=1)) == 1 and t.read().count() == 2


def test_two_writers_do_not_overwrite_each_other(spark):
    t = _table(spark)
    base = t.overwrite(_days(spark, ["2023-02-09"]), ret.month_part("at"))
    t.publish(base, {"2023-02": None})
    with pytest.raises(Conflict):
        t.publish(base, {})
    assert t.read().count() == 0


def test_newest_folders_by_server(spark):
    rows = [(s, f"2024-01-{d:02d}", d) for s in (1, 2) for d in range(1, 21) if s == 1 or d % 2] * 2
    df = spark.createDataFrame(rows, "server_id int, folder string, v int")
    got = ret.newest_folders(df, F.col("folder"))
    assert {(r.server_id, r.v) for r in got.collect()} == {(1, d) for d in range(7, 21)} | {(2, d) for d in range(1, 20, 2)}
    assert got.count() == 2 * (14 + 10) and got.columns == df.columns


def test_upsert_touches_only_its_buckets(spark):
    t = _table(spark)
    first = spark.createDataFrame([(i, "a", 1) for i in range(100)], "id long, name string, n int")
    v1 = ret.merge_rows(t, first, ["id"], buckets=8)
    update = spark.createDataFrame([(None, 7), ("b", 1000)], "name string, n int").withColumn("id", F.when(F.col("n") == 7, F.lit(3)).otherwise(F.lit(500)).cast("long"))
    v2 = ret.merge_rows(t, update, ["id"])
    want = {i: ("a", 1) for i in range(100)} | {3: (None, 7), 500: ("b", 1000)}  # a NULL is an update, too
    assert {r.id: (r.name, r.n) for r in t.read().collect()} == want
    assert sum(v1.parts[p] != v2.parts.get(p) for p in v1.parts) <= 2
    with pytest.raises(ValueError):
        ret.merge_rows(t, update.unionByName(update), ["id"])
    assert t.current().number == v2.number


def test_upsert_with_a_key_of_two_columns(spark):
    t = _table(spark)
    ret.merge_rows(t, spark.createDataFrame([(1, "x", 1), (2, "x", 2)], "s int, k string, v int"), ["s", "k"], buckets=4)
    ret.merge_rows(t, spark.createDataFrame([(1, "x", 10), (1, "y", 11)], "s int, k string, v int"), ["s", "k"])
    assert _rows(t.read()) == [(1, "x", 10), (1, "y", 11), (2, "x", 2)]


def test_event_files_roll_by_bytes(spark):
    limit = 200_000
    sink = EventFiles(spark, tempfile.mkdtemp(prefix="vigil-files-") + "/xe", limit=limit)
    made = 0
    # narrow rows, then wide ones, then narrow ones again
    for batch, (rows, words) in enumerate([(3000, 1), (4000, 1), (600, 60), (700, 60), (3000, 1), (50, 60)]):
        text = F.expr(f"concat_ws('', transform(sequence(1, {words}), i -> md5(concat(id, ':', i, ':{batch}'))))")
        df = spark.range(rows).select("id", F.lit(batch).alias("server_id"), text.alias("text"))
        sink.batch(df, batch)
        sink.batch(df, batch)  # a batch that is run again changes nothing
        made += rows
        assert sink.read().count() == made
    v, sizes = sink.table.current(), sink.files()
    closed = [s for p, s in sizes.items() if p not in v.facts["open"]]
    assert len(closed) >= 6 and all(0.85 * limit <= s <= limit for s in closed)
    assert all(sizes[p] <= limit for p in v.facts["open"])
    assert sink.read().distinct().count() == made
    body = json.loads(sink.table.folder.text(f"versions/{v.number:08d}.json"))
    assert body["facts"]["batch"] == 5


def test_snapshot_tables_have_their_columns_and_retention(spark):
    from conftest import SMALL
    from vigil.operators import snapshots as snap
    from vigil.sources.tables import FleetInputs
    i = FleetInputs(spark, SMALL)
    jobs = snap.job_inventory(i.fx("jobs"), i.fx("categories"), i.fx("principals"))
    steps = snap.step_inventory(i.fx("job_steps"), i.fx("jobs"))
    req = i.fx("requests")
    activity = snap.activity_snapshot(req.drop("sql_text"), i.fx("sessions"), req.select("server_id", "session_id", "request_id", "sql_text"),
                                      i.fx("jobs"), i.fx("job_steps"), i.fx("databases"))
    days = [dt.datetime(2023, 3, 1, 22), dt.datetime(2023, 3, 20, 22), dt.datetime(2024, 3, 18, 22)]
    for name, rows in (("msdb_dbo_sysjobs", jobs), ("msdb_dbo_sysjobsteps", steps)):
        t = _table(spark, name)
        for day in days:
            ret.store_snapshot(t, name, rows, day)
        assert t.read().count() == 3 * rows.count() and t.read().columns[0] == "snap_time_stamp"
        v = ret.expire_snapshots(t, name, days[2])  # 365 days: the first snapshot goes, the second is of the same month
        got = {r.snap_time_stamp: r["count"] for r in t.read(v).groupBy("snap_time_stamp").count().collect()}
        assert got == {day: rows.count() for day in days[1:]}
    assert len(t.read().columns) == 19
    with pytest.raises(Exception, match="owner"):
        ret.store_snapshot(_table(spark), "msdb_dbo_sysjobs", jobs.drop("owner"), days[0])
    t = _table(spark, "active_user_requests")
    ret.store_snapshot(t, "active_user_requests", activity)
    last = activity.agg(F.max("snap_time_stamp")).first()[0]
    want = snap.retained(activity, "snap_time_stamp", 14, F.lit(last).cast("timestamp_ntz"))
    assert t.read(ret.expire_snapshots(t, "active_user_requests", last)).count() == want.count() < activity.count() == t.read(t.version(1)).count()
