from pyspark.sql import functions as F

from conftest import SMALL, FrameInputs
from vigil.operators import registry as reg
from vigil.plans import report as rpt
from vigil.plans.context import CheckContext
from vigil.sources.tables import FleetInputs


def _numbers(df):
    return sorted(r.policy_no for r in df.collect())


def test_filter_semantics(spark):
    r = reg.registry_frame(spark, reg.default_policies())
    all_numbers = _numbers(r.select("policy_no"))
    assert _numbers(reg.policy_filter(r, None)) == all_numbers
    assert _numbers(reg.policy_filter(r, None, invert=True)) == []          # NULL + inverted -> none
    assert _numbers(reg.policy_filter(r, "3, 1,99,15,x")) == [1, 3]          # unknown numbers vanish
    inv = _numbers(reg.policy_filter(r, "3,1", invert=True))
    assert sorted(inv + [1, 3]) == all_numbers                               # intersect + inverted = all
    assert reg.filter_text(reg.policy_filter(r, "9,3,1")).first()[0] == "1,3,9"
    assert reg.filter_text(reg.policy_filter(r, None, invert=True)).first()[0] == "NULL"


def test_register_twice_changes_nothing(spark):
    i = FleetInputs(spark, SMALL)
    specs = reg.default_policies()
    new, req = reg.registry_frame(spark, specs), reg.exclusion_requests(spark, specs)
    r1, e1 = reg.register(i.fx("registry"), i.fx("exclusions"), new, req)
    r2, e2 = reg.register(r1, e1, new, req)
    assert r1.count() == 28 and r2.count() == 28 and e1.count() == e2.count()
    # present numbers keep their row and exclusions (fixture name for policy 1, not the built-in one)
    assert r1.filter("policy_no = 1").first().policy_name == "Autogrowth not in %"
    # 18 is already registered by the fixture, so its built-in list (with tempdb) is not added
    assert _numbers(e1.filter("pattern = 'tempdb'").select("policy_no")) == [5, 8, 26]


def test_upsert_versions(spark):
    i = FleetInputs(spark, SMALL)
    out = {r.module_name: (r.version_major, r.version_minor)
           for r in reg.upsert(i.fx("module_versions"), i.fx("module_updates"), "module_name").collect()}
    assert out == {"base": (1, 4), "tools": (1, 0), "pol": (1, 2)}


def test_active_policies_in_processing_order(spark):
    i = FleetInputs(spark, SMALL)
    r = i.fx("registry")
    rows = reg.active_policies(r, reg.policy_filter(r, None)).collect()
    assert [x.policy_no for x in rows] == [1, 3, 4, 6, 9, 13, 18]   # 27 is inactive


def test_operator_lookup(spark):
    i = FleetInputs(spark, SMALL)
    rows = reg.operator_lookup(i.fx("config"), i.fx("operators")).collect()
    assert [(x.config_name, x.email_address) for x in rows] == [("pol.notify_operator", "dba@example.com")]
    cfg = spark.createDataFrame([("maint.notify_operator", "Nobody")], "name string, value string")
    assert reg.operator_lookup(cfg, i.fx("operators")).first().email_address is None


def test_percent_exclusion_empties_a_policy(spark):
    i = FleetInputs(spark, SMALL)
    excl = spark.createDataFrame([(6, "%")], reg.EXCLUSION_SCHEMA)
    ctx = CheckContext(i, exclusions=excl)
    assert rpt.policy_result(ctx, 6).count() == 0
    assert rpt.policy_result(CheckContext(i), 6).count() > 0


def test_one_server_alone_equals_its_slice_of_the_fleet(spark):
    i = FleetInputs(spark, SMALL)
    fleet = rpt.policy_report(CheckContext(i))
    sid = fleet.groupBy("server_id").count().orderBy(F.desc("count")).first().server_id
    names = ["servers", "databases", "files", "error_log", "jobs", "job_steps", "options", "services", "logins"]
    alone = FrameInputs(spark, {n: i.fx(n).filter(F.col("server_id") == sid) for n in names})
    one = rpt.policy_report(CheckContext(alone))
    a = sorted(tuple(r) for r in one.collect())
    b = sorted(tuple(r) for r in fleet.filter(F.col("server_id") == sid).collect())
    assert a == b and len(a) > 0


def test_null_filter_inverted_gives_empty_report(spark):
    assert rpt.policy_report(CheckContext(FleetInputs(spark, SMALL)), None, invert=True).count() == 0
